"""Compressed sizes and the normalized compression distance as columns."""

from __future__ import annotations

from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.codecs import Spec
from nearpress.session import cut


class Cache(Protocol):
    """A memo of sizes by content, for ``cache=`` of the operators.

    Texts are told apart by ``h0, h1``, 128 bits of hash, and sizes belong to
    one codec with its parameters.
    """

    def known(self, spark: SparkSession, codec: Spec) -> DataFrame | None:
        """``h0, h1, c`` of the texts whose sizes are known, each once; None if there are none."""

    def store(self, sizes: DataFrame, codec: Spec) -> None:
        """Keeps more of them; they aren't known yet."""


class ParquetCache:
    """Sizes kept in a folder, for more than one run."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _folder(self, codec: Spec) -> str:
        return f"{self.path}/{codec.name}" + "".join(f"-{k}{v}" for k, v in sorted(codec.params.items()))

    def known(self, spark: SparkSession, codec: Spec) -> DataFrame | None:
        try:
            return spark.read.schema("h0 long, h1 long, c long").parquet(self._folder(codec))
        except Exception as e:  # nothing was stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def store(self, sizes: DataFrame, codec: Spec) -> None:
        sizes.write.mode("append").parquet(self._folder(codec))


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compressed_size(col: Column | str, codec: Spec) -> Column:
    """Bytes of the UTF-8 text when compressed; null gives null."""

    @F.arrow_udf("long")
    def size(values: pa.Array) -> pa.Array:
        of = codec.make().size
        return pa.array([None if v is None else of(v.encode()) for v in values.to_pylist()], pa.int64())

    return size(_column(col))


def combined_size(a: Column | str, b: Column | str, codec: Spec) -> Column:
    """The smaller of the sizes of both orders of two texts, without anything between.

    The stand-in codec, which works on pieces, has a space put between.
    """

    @F.arrow_udf("long")
    def size(left: pa.Array, right: pa.Array) -> pa.Array:
        pair = pair_size(codec)
        rows = zip(left.to_pylist(), right.to_pylist())
        return pa.array([None if x is None or y is None else pair(x.encode(), y.encode()) for x, y in rows], pa.int64())

    return size(_column(a), _column(b))


def pair_size(codec: Spec):
    """A function of two byte strings: the smaller size of both orders."""
    of = codec.make().size
    if codec.name == "tokenset":
        return lambda x, y: of(x + b" " + y)
    return lambda x, y: min(of(x + y), of(y + x))


def distance(c_a: Column | str, c_b: Column | str, c_ab: Column | str) -> Column:
    """Distance from three sizes: 0 if the joint size is below both, never cut off above."""
    a, b, ab = _column(c_a), _column(c_b), _column(c_ab)
    low, high = F.least(a, b), F.greatest(a, b)
    known = a.isNotNull() & b.isNotNull() & ab.isNotNull()
    return F.when(known, F.when((ab < low) | (high == 0), F.lit(0.0)).otherwise((ab - low) / high))


def ncd(a: Column | str, b: Column | str, codec: Spec) -> Column:
    """Normalized compression distance of two text columns."""
    return distance(compressed_size(a, codec), compressed_size(b, codec), combined_size(a, b, codec))


def scaled(d: Column | str) -> Column:
    """A distance in ten-thousandths, halves away from zero."""
    return F.round(_column(d) * 10000).cast("long")


def sizes_of(df: DataFrame, text: str, codec: Spec, out: str = "c", cache: bool | Cache = True) -> DataFrame:
    """Adds the compressed size of a text column.

    With a cache each distinct text is compressed once: texts are told apart by
    128 bits of hash, one of each goes to the codec, and the size is joined
    back by the hash, so no text is shuffled twice.  A ``Cache`` gives the sizes
    it knows and is given the others; ``False`` compresses every row.
    """
    if cache is False:
        return df.withColumn(out, compressed_size(text, codec))
    keyed = df.withColumn("__h0", F.xxhash64(text)).withColumn("__h1", F.xxhash64(F.lit(7), text))
    key = ["__h0", "__h1"]
    once = keyed.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("__text"))
    known = None if cache is True else cache.known(df.sparkSession, codec)
    if known is not None:
        known = cut(known.select(F.col("h0").alias("__h0"), F.col("h1").alias("__h1"), F.col("c").alias(out)).dropDuplicates(key))
        once = once.join(known, key, "left_anti")
    sizes = once.dropDuplicates(key).select(*key, compressed_size("__text", codec).alias(out))
    if cache is not True:
        sizes = cut(sizes)
        cache.store(sizes.select(F.col("__h0").alias("h0"), F.col("__h1").alias("h1"), F.col(out).alias("c")), codec)
        sizes = sizes if known is None else sizes.unionByName(known)
    return keyed.join(sizes, key, "left").drop(*key)


def cache_stats(df: DataFrame, text: str) -> DataFrame:
    """``lookups, misses, hits`` of a memo of sizes by content."""
    key = F.struct(F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(7), text).alias("h1"))
    counts = df.where(F.col(text).isNotNull()).groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lookups"), F.count("*").alias("misses"))
    return out.withColumn("hits", F.col("lookups") - F.col("misses"))
