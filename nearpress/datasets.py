"""A dataset on disk: a folder with a manifest and the files it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.functions.labels import page_label
from nearpress.sources.manifest import list_files, read_manifest, read_texts, resolve
from nearpress.sources.urls import topic


def load(spark: SparkSession, root: str, mode: str = "compat") -> DataFrame:
    """``pos, url, page_type, filepath, label, topic, text`` of the rows whose file exists.

    ``pos`` is the line of the manifest; rows without a file are left out.
    """
    rows = resolve(read_manifest(spark, root, mode), list_files(spark, root))
    texts = read_texts(spark, root).withColumnRenamed("content", "text")
    named = rows.select("*", page_label("url", "page_type").alias("label"), topic("url").alias("topic"))
    return named.join(texts, "filepath").select("pos", "url", "page_type", "filepath", "label", "topic", "text")


def extracted(rows: DataFrame, on_missing: str = "raise") -> DataFrame:
    """Rows with the article text in ``text``; one without is an error, or dropped."""
    from nearpress.functions.article import content_by_type

    if on_missing not in ("raise", "drop"):
        raise ValueError(f"on_missing is raise or drop, not {on_missing}")
    out = rows.withColumn("text", content_by_type("text", "page_type"))
    if on_missing == "drop":
        return out.where("text is not null")
    missing = F.raise_error(F.concat(F.lit("no article text in "), F.col("url")))
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(missing))
