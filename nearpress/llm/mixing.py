"""Problem 7: mixing sources to target weights.

Capped water-filling gives each source its tokens: a source that would have to
be repeated more often than allowed is clamped at that, and what it lacks is
shared out among the others in proportion to their weights, until all fit.
The rows of a source are then taken whole as often as the tokens allow, and a
seeded sample of them once more for the rest.

The sample is exact to one row without ordering a source in one task: rows
have a seeded place in [0, 1), the tokens of 4,096 ranges of places are summed,
the range in which the rest ends is found from these sums, and only the rows
of that range are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearpress.llm.common import cut, maybe_broadcast, table
from nearpress.llm.tokens import TOKENIZER, token_count

#: Ranges of places of a source.
RANGES = 4_096
#: Rows a table of targets may have; it is read to the driver.
MAX_TARGETS = 100_000


def water_fill(weights: dict[str, float], available: dict[str, float], total: float) -> dict[str, float]:
    """Amount of each source for a total, none above what is available.

    Sources above their cap are clamped; the excess is shared out by weight
    among the rest.  If everything is clamped, the amounts add up to less.
    """
    amount = {s: 0.0 for s in weights}
    free, left = {s for s, w in weights.items() if w > 0}, float(total)
    while free and left > 0:
        weight = sum(weights[s] for s in free)
        over = [s for s in sorted(free) if left * weights[s] / weight > available.get(s, 0.0)]
        if not over:
            for s in free:
                amount[s] = left * weights[s] / weight
            break
        for s in over:
            amount[s] = float(available.get(s, 0.0))
        free -= set(over)
        left = float(total) - sum(amount.values())
    return amount


def largest_exact_total(weights: dict[str, float], available: dict[str, float]) -> float:
    """The largest total at which every source that has tokens keeps its share.

    A source without any is clamped at nothing; its weight goes to the others.
    """
    there = {s: w for s, w in weights.items() if w > 0 and available.get(s, 0) > 0}
    weight = sum(there.values())
    return min((available[s] * weight / w for s, w in there.items()), default=0.0)


_PLAN = "mix_name string, source string, target_share double, max_repeats int, available long, wanted double, whole long, rest double"


def usable_targets(targets: DataFrame) -> DataFrame:
    """``mix_name, source, w, r`` of the targets that count; of a source given twice the sum and the smaller cap."""
    t = targets.select("mix_name", "source", F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r"))
    t = t.where("mix_name is not null and source is not null and w > 0 and r > 0")
    return t.groupBy("mix_name", "source").agg(F.sum("w").alias("w"), F.min("r").alias("r"))


def plan_mix(spark: SparkSession, sums: DataFrame, targets: DataFrame, total_tokens: int | str | None = None) -> DataFrame:
    """For each mix and source: tokens wanted, whole repetitions, tokens of the rest.

    ``sums`` has ``source, available``.  Both tables are as long as the list of
    targets at most.  ``total_tokens`` is a number, ``"available"`` for all
    tokens the sources of the mix have, or None for the largest total at which
    no source is clamped.
    """
    rows = usable_targets(targets).join(sums, "source", "left").orderBy("mix_name", "source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    by_mix: dict[str, list] = {}
    for r in rows:
        by_mix.setdefault(r.mix_name, []).append(r)
    out = []
    for mix, sources in by_mix.items():
        weights = {r.source: r.w for r in sources}
        caps = {r.source: float((r.available or 0) * r.r) for r in sources}
        total = largest_exact_total(weights, caps) if total_tokens is None else sum(r.available or 0 for r in sources) if total_tokens == "available" else total_tokens
        amount = water_fill(weights, caps, total)
        whole_weight = sum(weights.values())
        for r in sources:
            have, want = r.available or 0, amount[r.source]
            # the division leaves 1e-9 of an epoch; that is no rest
            epochs = min(r.r, int(want / have + 1e-9)) if have else 0
            rest = max(0.0, want - epochs * have) if epochs < r.r else 0.0
            out.append((mix, r.source, r.w / whole_weight, r.r, have, want, epochs, rest if rest > 0.5 else 0.0))
    return spark.createDataFrame(out, _PLAN)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = 42) -> DataFrame:
    """``mix_name, doc_id, source, n_tokens, repeats``: the rows of each mix.

    ``documents`` has ``doc_id, source, n_tokens``.  Rows with a null in any of
    them or without tokens are in no mix; a row given twice counts as two.
    Targets that are null or not positive are left out, shares of a mix are
    taken in proportion to their sum, of a source given twice in a mix the
    shares are added and the smaller cap holds.  Without a total the largest
    is taken at which every source has its share; with ``"available"`` it is
    what the sources of the mix hold, and small ones are clamped.  The same seed gives the
    same rows, however the input is cut.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("n_tokens").cast("long").alias("n_tokens"))
    docs = docs.where("doc_id is not null and source is not null and n_tokens > 0")
    wanted = cut(usable_targets(targets).select("source").distinct())
    docs = docs.join(maybe_broadcast(wanted, wanted.count()), "source", "left_semi")
    place = F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id"), F.lit(2**40))
    docs = docs.withColumn("place", place).withColumn("part", (F.col("place") / 2**40 * RANGES).cast("int"))
    docs = cut(docs)
    by_part = cut(docs.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens")))
    plan = plan_mix(spark, by_part.groupBy("source").agg(F.sum("tokens").alias("available")), targets, total_tokens)
    plan = F.broadcast(plan.where("wanted > 0"))
    # the range in which the rest ends: a running sum over at most RANGES rows a source
    run = Window.partitionBy("mix_name", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = by_part.join(plan.select("mix_name", "source", "rest"), "source").withColumn("upto", F.sum("tokens").over(run))
    last = sums.where(F.col("upto") - F.col("tokens") < F.col("rest")).groupBy("mix_name", "source")
    last = last.agg(F.max("part").alias("end"), F.max_by(F.col("upto") - F.col("tokens"), "part").alias("before"))
    steps = F.broadcast(plan.select("mix_name", "source", "whole", "rest").join(last, ["mix_name", "source"], "left"))
    rows = docs.join(steps, "source")
    within = F.col("part") < F.coalesce("end", F.lit(0))
    edge = rows.where("part = end")
    upto = F.sum("n_tokens").over(Window.partitionBy("mix_name", "source").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a row goes in if that brings the sum nearer to the rest
    edge = edge.withColumn("upto", upto + F.col("before"))
    edge = edge.withColumn("once", (F.col("upto") - F.col("n_tokens") / 2.0 <= F.col("rest")).cast("long"))
    others = rows.where("end is null or part <> end").withColumn("once", within.cast("long"))
    columns = ["mix_name", "doc_id", "source", "n_tokens", (F.col("whole") + F.col("once")).alias("repeats")]
    return others.select(columns).unionByName(edge.select(columns)).where("repeats > 0")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_name, source, target_share, reached_share, n_rows, n_tokens, most_repeats``."""
    done = mixed.groupBy("mix_name", "source").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    total = Window.partitionBy("mix_name")
    want = targets.select("mix_name", "source", "target_share")
    out = want.join(done, ["mix_name", "source"], "left").fillna(0, ["n_rows", "n_tokens", "most_repeats"])
    return out.withColumn("reached_share", F.col("n_tokens") / F.sum("n_tokens").over(total))


def sized(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where("text is not null").select("doc_id", "source", token_count("text", tokenizer).alias("n_tokens"))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each mix and how often each is used."""
    return mix(sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return mix_report(p7_mixed(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of mixes as large as their sources: small sources are clamped, the others take the excess."""
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(mix(sized(spark, sf_dir), targets, "available"), targets)


def _words_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    return docs.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", " "), lambda w: w != ""))).alias("available"))


def p7_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amounts of such mixes by words, which SQL can work out."""
    plan = plan_mix(spark, _words_of_sources(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "available")
    clamped = F.col("wanted") >= F.col("available") * F.col("max_repeats") - 1e-6
    return plan.select("mix_name", "source", "available", F.round("wanted", 2).alias("wanted"), clamped.alias("clamped"))


#: The amounts are those of one water level: of the sources in order of how soon they are full, the first few are.
ORACLE = {
    "p7_amounts": """WITH n AS (SELECT source, CAST(sum(len(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS BIGINT) AS available FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source),
t AS (SELECT mix_name, source, target_share AS w, coalesce(available, 0) AS available, coalesce(available, 0) * max_repeats AS cap FROM mix_targets LEFT JOIN n USING (source)),
o AS (SELECT *, row_number() OVER (PARTITION BY mix_name ORDER BY cap / w, source) AS k, sum(available) OVER (PARTITION BY mix_name) AS total FROM t),
l AS (SELECT a.mix_name, a.k, a.cap / a.w AS full_at, any_value(a.total) - coalesce(sum(b.cap) FILTER (WHERE b.k < a.k), 0) AS rest, sum(b.w) FILTER (WHERE b.k >= a.k) AS w
  FROM o a JOIN o b USING (mix_name) GROUP BY a.mix_name, a.k, a.cap, a.w),
f AS (SELECT mix_name, min_by(rest / w, k) FILTER (WHERE rest / w <= full_at) AS level FROM l GROUP BY mix_name)
SELECT mix_name, source, available, round(CASE WHEN level IS NULL OR cap <= level * w THEN cap ELSE level * w END, 2) AS wanted, (level IS NULL OR cap <= level * w) AS clamped FROM o JOIN f USING (mix_name)"""
}
