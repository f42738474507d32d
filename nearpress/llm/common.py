"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.session import cut

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "NON_SPACE", "SPACE", "cut", "key128", "maybe_broadcast", "table", "words_expr"]

#: White space in the wide sense: ASCII, next line, and the Unicode separators.
SPACE = r"[\s\x{85}\p{Z}]"
NON_SPACE = r"[^\s\x{85}\p{Z}]"

#: Rows up to which a derived table may be broadcast; it is counted first.
BROADCAST_ROWS = 200_000
#: Bytes up to which a table whose bytes are summed is broadcast.
BROADCAST_BYTES = 20 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key128(col: Column | str) -> Column:
    """A 128-bit key of a value, as a struct of two longs."""
    c = F.col(col) if isinstance(col, str) else col
    return F.struct(F.xxhash64(c).alias("h0"), F.xxhash64(F.lit(7), c).alias("h1"))


def words_expr(col: Column | str) -> Column:
    """Number of pieces between white space."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_count(c, F.lit(NON_SPACE + "+"))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Broadcasts a table whose counted rows, of about so many bytes, are few; joins by shuffle beyond."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and rows * row_bytes <= BROADCAST_BYTES else df
