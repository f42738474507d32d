"""Problem 3: lines repeated across the documents of one site.

The lines of all texts are hashed once: by their normal form, and as written
but for their case.  A map-side combined count drops the lines that occur too
seldom over all texts to be repeated on any host; as there are never fewer
occurrences than documents, none is lost.  Only what is left meets the hosts,
so no text is shuffled.

The texts of a host are numbered from 0, and a line's documents are held as
bitmaps over these numbers, in pieces of 32,768.  Within a host the numbers are
dense; a piece is kept from its first to its last byte in use, so a small host
or a line of few documents takes a few bytes, whatever the text ids are.  The
bitmaps of the writings of a line are united, their exact cardinality is held
against the thresholds, and a line is deleted from a document where its bitmap
has the document's bit.

What is left per host is bounded by the thresholds: a host can't have more than
(lines a document) / (least share) repeated lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.llm.common import BROADCAST_BYTES, SPACE, cut, maybe_broadcast, table
from nearpress.session import ordinal

#: A line is repeated from so many documents of a host on, and from that share of them on.
MIN_DOCS = 5
MIN_SHARE = 0.05


def host_of(url: Column | str) -> Column:
    """Host of a url in lower case; null if it has none."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", F.lower(host))


def file_hosts(entries: DataFrame) -> DataFrame:
    """``filepath, host``: one row for each file path with a host.

    A file listed several times has one host but for its case; were there
    more, the least in order is taken.
    """
    rows = entries.select("filepath", host_of("url").alias("host")).where("filepath is not null and host is not null")
    return rows.groupBy("filepath").agg(F.min("host").alias("host"))


def line_norm(line: Column) -> Column:
    """Lower case, each run of white space one space, trimmed, digits as one sign."""
    spaced = F.trim(F.regexp_replace(F.lower(line), SPACE + "+", " "))
    return F.regexp_replace(spaced, "[0-9]+", "0")


def hashed_lines(texts: DataFrame) -> DataFrame:
    """``text_id, line_no, h0, h1, raw`` of all lines that aren't empty, cut.

    ``h0, h1`` stand for the normal form, ``raw`` for the line as written but
    for its case: hashes, so that no text moves.
    """
    base = texts.select(F.col("text_id").cast("long").alias("text_id"), "body").where("body is not null and text_id is not null")
    lines = base.select("text_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line")).where("line <> ''")
    lines = lines.withColumn("norm", line_norm(F.col("line"))).where("norm <> ''")
    return cut(lines.select("text_id", F.col("line_no").cast("int").alias("line_no"), F.xxhash64("norm").alias("h0"), F.xxhash64(F.lit(7), "norm").alias("h1"), F.xxhash64(F.lower("line")).alias("raw")))


def placed_texts(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """``site, text_id, at`` of the texts with a body whose file has a host.

    ``site`` is a hash of the host, ``at`` the number of the text within it.
    """
    t = texts.where("body is not null and text_id is not null").select("filepath", F.col("text_id").cast("long").alias("text_id"))
    hosted = t.join(file_hosts(entries), "filepath").select(F.xxhash64("host").alias("site"), "text_id").distinct()
    return ordinal(hosted, ["text_id"], ["site"], out="at")


def _reached(n: str, min_docs: int, min_share: float) -> Column:
    return (F.col(n) >= min_docs) & (F.col(n) >= F.col("n_texts") * min_share - 1e-9)


def often_lines(lines: DataFrame, placed: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """The lines that occur often enough on their host to be repeated ones, cut.

    ``site, h0, h1, n_texts, n`` of the line and ``text_id, at, line_no, raw``
    of the occurrence.
    """
    seen = lines.groupBy("h0", "h1").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h0", "h1")
    seen = cut(seen)
    left = lines.join(maybe_broadcast(seen, seen.count()), ["h0", "h1"], "left_semi")
    left = cut(left.join(placed, "text_id"))
    sizes = placed.groupBy("site").agg(F.count("*").alias("n_texts"))
    on_host = left.groupBy("site", "h0", "h1").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    on_host = cut(on_host.join(sizes, "site").where(_reached("n", min_docs, min_share)))
    return cut(left.join(maybe_broadcast(on_host, on_host.count()), ["site", "h0", "h1"]))


def bitmaps(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``keys, piece, low, bits``: a bitmap of the numbers of each key, by pieces of 32,768.

    Of a piece the bytes from the first to the last in use are kept; ``low`` is
    the first one's place.
    """
    bit = F.bitmap_bit_position(F.col(at) + 1)
    out = rows.groupBy(*keys, F.bitmap_bucket_number(F.col(at) + 1).alias("piece")).agg(F.bitmap_construct_agg(bit).alias("bits"), F.min(bit).alias("least"), F.max(bit).alias("most"))
    low, high = F.floor(F.col("least") / 8).cast("int"), F.floor(F.col("most") / 8).cast("int")
    return out.select(*keys, "piece", low.alias("low"), F.substring("bits", low + 1, high - low + 1).alias("bits"))


def _whole() -> Column:
    """The 4,096 bytes of a piece."""
    zeros = F.lit(bytes(4_096))
    filled = F.concat(F.substring(zeros, F.lit(1), F.col("low")), F.col("bits"))
    return F.concat(filled, F.substring(zeros, F.lit(1), F.lit(4_096) - F.length(filled)))


def repeated_lines(candidates: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """``site, h0, h1, n_docs, piece, low, bits``: the repeated lines with their bitmaps.

    The key holds the piece and the writing, so a hot host or line is spread by
    the numbers of its texts.
    """
    line = ["site", "h0", "h1"]
    variants = bitmaps(candidates, [*line, "n_texts", "raw"], "at")
    united = variants.groupBy(*line, "n_texts", "piece").agg(F.bitmap_or_agg(_whole()).alias("all"), F.min("low").alias("low"), F.max(F.col("low") + F.length("bits")).alias("end"))
    united = cut(united.select(*line, "n_texts", "piece", "low", F.substring("all", F.col("low") + 1, F.col("end") - F.col("low")).alias("bits")))
    total = united.groupBy(*line, "n_texts").agg(F.sum(F.bitmap_count("bits")).alias("n_docs")).where(_reached("n_docs", min_docs, min_share))
    return united.drop("n_texts").join(total.select(*line, "n_docs"), line)


def _bit_set(bit: Column) -> Column:
    place = F.floor(bit / 8).cast("int") - F.col("low")
    byte = F.conv(F.hex(F.substring("bits", place + 1, F.lit(1))), 16, 10).cast("int")
    inside = (place >= 0) & (place < F.length("bits"))
    return inside & (F.floor(byte / F.pow(F.lit(2.0), bit % 8)).cast("int") % 2 == 1)


def looked_up(candidates: DataFrame, min_docs: int, min_share: float) -> DataFrame:
    """``text_id, line_no, share`` of the candidates that are repeated lines, by bitmap lookup.

    ``share`` is that of the host's texts which hold the line.
    """
    candidates = candidates.where(_reached("n", min_docs, min_share))
    repeated = repeated_lines(candidates, min_docs, min_share)
    size = repeated.agg(F.coalesce(F.sum(F.length("bits") + 64), F.lit(0))).first()[0]
    looked = candidates.withColumn("piece", F.bitmap_bucket_number(F.col("at") + 1))
    looked = looked.join(F.broadcast(repeated) if size <= BROADCAST_BYTES else repeated, ["site", "h0", "h1", "piece"])
    looked = looked.where(_bit_set(F.bitmap_bit_position(F.col("at") + 1)))
    return looked.select("text_id", F.col("line_no").cast("long").alias("line_no"), (F.col("n_docs") / F.col("n_texts")).alias("share"))


def repeated_occurrences(texts: DataFrame, entries: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """``text_id, line_no`` of every repeated line, by bitmap lookup.

    ``texts`` has ``text_id, filepath, body``, ``entries`` has ``filepath,
    url``; other columns are ignored.  A text with null body, id or path, or
    whose path has no entry with a host, has no repeated lines and doesn't
    count.  Rows given twice give one row; empty tables an empty result.  Lines
    are counted from 0 and parted at line feeds only.
    """
    often = often_lines(hashed_lines(texts), placed_texts(texts, entries), min_docs, min_share)
    return looked_up(often, min_docs, min_share).select("text_id", "line_no").distinct()


def remove_lines(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``text_id, body`` with the found lines deleted; a null body stays null.

    A body of which nothing is left is the empty text.
    """
    gone = found.groupBy(F.col("text_id").alias("gone_id")).agg(F.collect_set("line_no").alias("gone"))
    t = texts.select(F.col("text_id").cast("long").alias("text_id"), "body")
    t = t.join(gone, t.text_id == gone.gone_id, "left")
    kept = F.array_join(F.filter(F.split("body", "\n"), lambda x, i: ~F.array_contains("gone", i.cast("long"))), "\n")
    return t.select("text_id", F.when(F.col("gone").isNull(), F.col("body")).otherwise(kept).alias("body"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a repeated line of a host."""
    return repeated_occurrences(table(spark, sf_dir, "page_texts"), table(spark, sf_dir, "entries"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body without the lines repeated on its host."""
    texts = table(spark, sf_dir, "page_texts")
    return remove_lines(texts, p3_found(spark, sf_dir))


_SPACE_SQL = r"[\s\x{85}\p{Z}]+"

P3_LINES_SQL = rf"""
hosts AS (
  SELECT filepath, min(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))) AS host
  FROM entries WHERE filepath IS NOT NULL AND regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) <> ''
  GROUP BY filepath),
hosted AS (SELECT host, text_id, body FROM page_texts JOIN hosts USING (filepath) WHERE body IS NOT NULL),
cuts AS (SELECT host, text_id, string_split(body, chr(10)) AS ls FROM hosted),
raw AS (SELECT host, text_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM cuts),
lines AS (
  SELECT host, text_id, line_no, regexp_replace(trim(regexp_replace(lower(line), '{_SPACE_SQL}', ' ', 'g')), '[0-9]+', '0', 'g') AS norm
  FROM raw),
sizes AS (SELECT host, count(*) AS n_texts FROM hosted GROUP BY host),
rep AS (
  SELECT host, norm FROM lines JOIN sizes USING (host) WHERE norm <> ''
  GROUP BY host, norm, n_texts HAVING count(DISTINCT text_id) >= 5 AND count(DISTINCT text_id) * 20 >= n_texts),
found AS (SELECT DISTINCT text_id, line_no FROM lines JOIN rep USING (host, norm))
"""

ORACLE = {
    "p3_found": f"WITH {P3_LINES_SQL} SELECT text_id, line_no FROM found",
    "p3_clean": f"""WITH {P3_LINES_SQL},
kept AS (
  SELECT text_id, string_agg(line, chr(10) ORDER BY line_no) AS body FROM (
    SELECT r.text_id, r.line_no, r.line FROM raw r LEFT JOIN found f ON r.text_id = f.text_id AND r.line_no = f.line_no
    WHERE f.text_id IS NULL) GROUP BY text_id)
SELECT p.text_id, CASE WHEN p.text_id NOT IN (SELECT text_id FROM found) THEN p.body ELSE coalesce(k.body, '') END AS body
FROM page_texts p LEFT JOIN kept k ON p.text_id = k.text_id""",
}
