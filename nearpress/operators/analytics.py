"""What is made of distances: groups, histograms, medians, parameters."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearpress.codecs import Spec
from nearpress.functions.distance import pair_size
from nearpress.functions.labels import hover_text, quality_bucket
from nearpress.session import cut

SAME, DIFFERENT = "Same Subject", "Different Subjects"
BINS = 100


def related_split(pairs: DataFrame) -> DataFrame:
    """``i, j, grp, d`` of the pairs ``j >= i`` of two aligned corpora: the diagonal is the same subject."""
    return pairs.where("j >= i").select("i", "j", F.when(F.col("i") == F.col("j"), SAME).otherwise(DIFFERENT).alias("grp"), "d")


def split_by_topic(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``i, j, grp, d`` by an explicit topic of each side (``id, topic``) instead of the position."""
    a = left.select(F.col("id").alias("i"), F.col("topic").alias("t_i"))
    b = right.select(F.col("id").alias("j"), F.col("topic").alias("t_j"))
    joined = pairs.join(a, "i").join(b, "j")
    return joined.select("i", "j", F.when(F.col("t_i") == F.col("t_j"), SAME).otherwise(DIFFERENT).alias("grp"), "d")


def histogram(rows: DataFrame, group: str = "grp", value: str = "d") -> DataFrame:
    """``grp, bin, n``: bins of a hundredth on [0, 1]; -1 below and 100 above."""
    v = F.col(value)
    bin_ = F.when(v < 0, -1).when(v >= 1, F.when(v == 1, BINS - 1).otherwise(BINS)).otherwise(F.floor(v * BINS))
    return rows.where(v.isNotNull()).groupBy(F.col(group).alias("grp"), bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


#: Ranges of values in which the middle is looked for.
MEDIAN_RANGES = 4_096


def group_median(rows: DataFrame, names: list[str] | None = None, group: str = "grp", value: str = "d") -> DataFrame:
    """``grp, median, label``: the exact median of each group; 0.0 for a named one without rows.

    Equal values are counted to one row.  The range of values that holds the
    middle is found from the counts of ``MEDIAN_RANGES`` ranges, and only the
    values of that range are put in order, so no group is sorted in one task.
    """
    spark = rows.sparkSession
    counts = cut(rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("grp"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")))
    ends = counts.groupBy("grp").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (MEDIAN_RANGES - 1))).otherwise(F.lit(0)).cast("int")
    placed = counts.join(ends, "grp").withColumn("range", place)
    sums = placed.groupBy("grp", "range", "total").agg(F.sum("n").alias("m"))
    upto = Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most MEDIAN_RANGES rows
    sums = sums.withColumn("upto", F.sum("m").over(upto)).withColumn("before", F.col("upto") - F.col("m"))
    middle = sums.select("grp", "range", "before", "upto", F.explode(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1"))).alias("at"))
    middle = middle.where("at > before and at <= upto").select("grp", "range", "before", "at")
    inside = placed.select("grp", "range", "v", "n").join(middle, ["grp", "range"])
    run = Window.partitionBy("grp", "range", "at").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("upto", F.sum("n").over(run) + F.col("before"))
    halves = inside.where("at <= upto and at > upto - n").select("grp", "v")
    exact = halves.groupBy("grp").agg(((F.min("v") + F.max("v")) / 2).alias("median"))
    if names is not None:
        all_ = spark.createDataFrame([(n,) for n in names], "grp string")
        exact = all_.join(exact, "grp", "left")
    out = exact.select("grp", F.coalesce("median", F.lit(0.0)).alias("median"))
    return out.withColumn("label", F.format_string("%.3f", "median"))


def scatter(rows: DataFrame) -> DataFrame:
    """Scatter data: ``series, hover, duration_s, distance`` by bucket of quality."""
    return rows.select(F.concat(F.lit("Q "), quality_bucket("quality")).alias("series"), hover_text("lg_window_size", "quality").alias("hover"), "duration_s", "distance")


def grid(spark: SparkSession, qualities: range, windows: range) -> DataFrame:
    """Every ``quality`` with every ``lg_window_size``."""
    q = spark.range(qualities.start, qualities.stop).select(F.col("id").cast("int").alias("quality"))
    return q.withColumn("lg_window_size", F.explode(F.array(*[F.lit(w) for w in windows])))


def _timed() -> Column:
    @F.arrow_udf("struct<distance: double, duration_s: double>")
    def measure(a: pa.Array, b: pa.Array, quality: pa.Array, window: pa.Array) -> pa.Array:
        out = []
        for x, y, q, w in zip(*(v.to_pylist() for v in (a, b, quality, window))):
            if x is None or y is None:
                out.append(None)
                continue
            codec = Spec("brotli", quality=q, lg_window_size=w)
            began = time.perf_counter()
            x, y = x.encode(), y.encode()
            c_x, c_y, both = codec.make().size(x), codec.make().size(y), pair_size(codec)(x, y)
            low, high = min(c_x, c_y), max(c_x, c_y)
            out.append({"distance": 0.0 if both < low or not high else (both - low) / high, "duration_s": time.perf_counter() - began})
        return pa.array(out, pa.struct([("distance", pa.float64()), ("duration_s", pa.float64())]))

    return measure


def sweep(pairs: DataFrame, params: DataFrame) -> DataFrame:
    """The distance and time of each pair (``text_a, text_b`` and other columns) for each setting."""
    keep = [c for c in pairs.columns if c not in ("text_a", "text_b")]
    each = pairs.crossJoin(F.broadcast(params))  # params is a grid of settings
    each = each.repartition(*keep, "quality", "lg_window_size") if keep else each.repartition("quality", "lg_window_size")
    done = each.withColumn("r", _timed()("text_a", "text_b", "quality", "lg_window_size"))
    return done.select(*keep, "quality", "lg_window_size", F.col("r.distance").alias("distance"), F.col("r.duration_s").alias("duration_s"))


def best_options(scores: DataFrame) -> DataFrame:
    """The setting with the highest score, of ties the first by quality and window.

    ``scores`` has ``quality, lg_window_size, sign, d``; the score is the sum of
    the squares with their signs.
    """
    out = scores.groupBy("quality", "lg_window_size").agg(F.sum(F.col("sign") * F.col("d") * F.col("d")).alias("score"))
    return out.orderBy(F.desc("score"), "quality", "lg_window_size").limit(1)


def topic_pairs(pages: DataFrame) -> DataFrame:
    """The six pairs of two topics in two corpora with their signs.

    ``pages`` has ``slot`` (w1, g1, w2, g2) and ``text``: four rows.
    """
    signs = [("w1", "g1", -1), ("w2", "g2", -1), ("w1", "w2", 1), ("g1", "g2", 1), ("w1", "g2", 1), ("g1", "w2", 1)]
    plan = pages.sparkSession.createDataFrame(signs, "a string, b string, sign int")
    a = pages.select(F.col("slot").alias("a"), F.col("text").alias("text_a"))
    b = pages.select(F.col("slot").alias("b"), F.col("text").alias("text_b"))
    return plan.join(a, "a").join(b, "b")
