"""Manifests of pages: reading, parsing, finding the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.session import cut, ordinal
from nearpress.sources.urls import url_stem

#: Suffixes a file may have, in the order they are tried.
SUFFIXES = (".html", ".txt", ".md", ".wiki", "")

_SPACE = r"[\s\x{85}\p{Z}]+"


def _trim(c: Column) -> Column:
    bare = F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")
    return F.regexp_replace(bare, '^"+|"+$', "")


def parse_line(line: Column | str) -> Column:
    """``struct(url, page_type)`` of a manifest line, or null with fewer than two parts.

    Parts are cut at every comma, also one within quotes.
    """
    parts = F.split(F.col(line) if isinstance(line, str) else line, ",")
    return F.when(F.size(parts) >= 2, F.struct(_trim(F.element_at(parts, 1)).alias("url"), _trim(F.element_at(parts, 2)).alias("page_type")))


def read_manifest(spark: SparkSession, path: str, mode: str = "compat") -> DataFrame:
    """``pos, url, page_type`` of ``dataset.csv`` in a folder, or of the file itself.

    ``compat`` cuts at every comma, ``csv`` minds quotes.  ``pos`` counts the
    lines after the header; lines that don't parse are left out.  The file may
    be read in pieces: lines are numbered by where their piece begins and their
    place in it.
    """
    path = path if path.endswith(".csv") else path.rstrip("/") + "/dataset.csv"
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    lines = ordinal(lines, ["start", "at"], out="n").where("n > 0").select((F.col("n") - 1).alias("pos"), "line")
    if mode == "csv":
        row = F.from_csv(F.col("line"), "url STRING, page_type STRING", {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
        return lines.where(F.trim("line") != "").select("pos", row.alias("row")).select("pos", "row.url", "row.page_type").where("url is not null and page_type is not null")
    if mode != "compat":
        raise ValueError(f"mode is compat or csv, not {mode}")
    return lines.select("pos", parse_line("line").alias("row")).where("row is not null").select("pos", "row.url", "row.page_type")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``filepath`` of the regular files below a folder, relative to it."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    plain = F.regexp_replace(F.col("path"), "^file:/*", "/")
    return files.select(F.when(F.startswith(plain, F.lit(base + "/")), F.substr(plain, F.lit(len(base) + 2))).otherwise(plain).alias("filepath"))


def resolve(manifest: DataFrame, listing: DataFrame, prefix: Column | str = "") -> DataFrame:
    """Adds the ``filepath`` of each row whose file is in the listing; others drop out.

    The decoded path of the url is tried with each suffix in turn, first as a
    folder with ``index.html``, then as a file.  ``prefix`` goes before it.
    A path that leads out of the root (``..``, or absolute) is never taken.
    The rows are told apart by all their columns, so repeated rows stay.
    """
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    stem = url_stem("url")
    inside = ~F.regexp_like("__stem", F.lit(r"(^/)|(^|/)\.\.(/|$)"))
    tried = [F.struct(F.lit(2 * k + d).alias("rank"), F.concat("__start", "__stem", F.lit(s + ("/index.html" if d == 0 else ""))).alias("filepath")) for k, s in enumerate(SUFFIXES) for d in (0, 1)]
    columns = manifest.columns
    # rows are numbered once; only the number and the path are shuffled for the candidates
    rows = cut(manifest.withColumn("__row", F.monotonically_increasing_id()))
    paths = rows.select("__row", stem.alias("__stem"), start.alias("__start")).where(inside)
    candidates = paths.select("__row", F.explode(F.array(*tried)).alias("t")).select("__row", "t.rank", "t.filepath")
    there = candidates.join(listing.select("filepath").distinct(), "filepath", "left_semi")
    best = there.groupBy("__row").agg(F.min_by("filepath", "rank").alias("filepath"))
    return rows.join(best, "__row").select(*columns, "filepath")


def first_by_url(entries: DataFrame, *keys: str) -> DataFrame:
    """The first entry of each url (within ``keys``), by position."""
    columns = [c for c in entries.columns if c not in ("url", *keys)]
    first = F.min_by(F.struct(*columns), "pos").alias("first")
    return entries.where("url is not null").groupBy(*keys, "url").agg(first).select(*keys, "url", *[f"first.{c}" for c in columns])


def read_texts(spark: SparkSession, root: str, errors: str = "raise") -> DataFrame:
    """``filepath, content`` of the files below a folder, each read whole.

    A file that isn't UTF-8 is an error; ``replace`` puts the replacement sign
    for what can't be read, ``null`` gives null.
    """
    how = {"raise": F.validate_utf8, "replace": F.make_valid_utf8, "null": F.try_validate_utf8}
    if errors not in how:
        raise ValueError(f"errors is raise, replace or null, not {errors}")
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace(F.col("path"), "^file:/*", "/")
    name = F.when(F.startswith(plain, F.lit(base + "/")), F.substr(plain, F.lit(len(base) + 2))).otherwise(plain)
    return files.select(name.alias("filepath"), how[errors](F.col("content").cast("string")).alias("content"))


def write_new(rows: DataFrame, path: str, key: str = "filepath") -> None:
    """Appends rows whose key isn't in the parquet table yet; a second run writes nothing."""
    spark = rows.sparkSession
    try:
        have = spark.read.parquet(path).select(key)
    except Exception as e:  # a table that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows.dropDuplicates([key]).write.parquet(path)
        return
    rows.dropDuplicates([key]).join(have, key, "left_anti").write.mode("append").parquet(path)
