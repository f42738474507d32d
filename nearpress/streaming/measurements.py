"""The scalar functions and the measurements on streams.

Nothing here is specific to a source: a stream is a DataFrame of
``readStream``.  Pair operators are for tables, not for streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpress.codecs import Spec
from nearpress.functions.distance import compressed_size, distance
from nearpress.functions.html import html_structure


def page_sizes(pages: DataFrame, codec: Spec) -> DataFrame:
    """``page_id, c`` of the structure of each page of a stream, as it comes."""
    return pages.select("page_id", compressed_size(html_structure("html"), codec).alias("c"))


def _timed(stream: DataFrame) -> DataFrame:
    """Watermarks take times with a zone; the tables have them without."""
    return stream.withColumn("measured_at", F.col("measured_at").cast("timestamp"))


def new_measurements(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Measurements without repeated rows; state is kept as long as rows may be late."""
    key = ["page_id", "pivot_id", "codec", "quality", "lg_window_size", "measured_at"]
    return _timed(stream).withWatermark("measured_at", late).dropDuplicatesWithinWatermark(key)


def window_counts(stream: DataFrame, width: str = "1 day", late: str = "30 days") -> DataFrame:
    """``start, codec, n, n_zero`` for windows of measuring time, closed by the watermark."""
    d = distance("c_page", "c_pivot", "c_both")
    w = F.window("measured_at", width).alias("w")
    counts = _timed(stream).withWatermark("measured_at", late).groupBy(w, "codec").agg(F.count("*").alias("n"), F.count_if(d == 0).alias("n_zero"))
    return counts.select(F.col("w.start").alias("start"), "codec", "n", "n_zero")
