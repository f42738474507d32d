"""Command line: each command is a function that returns a DataFrame, and prints it.

    python -m nearpress.cli same-page FILE
    python -m nearpress.cli heatmap [FOLDER...]
    python -m nearpress.cli triangle-inequality [FOLDER...]
    python -m nearpress.cli wiki-vs-grok FOLDER
    python -m nearpress.cli bk-tree [FOLDER...] [--tolerance 0.25]
    python -m nearpress.cli optimal-opts W1 G1 W2 G2

Folders are looked for below ``--base`` (the current folder if not given).
"""

from __future__ import annotations

import argparse
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress import datasets
from nearpress.codecs import Spec
from nearpress.functions import html
from nearpress.functions.article import article_content, GROK, WIKI
from nearpress.operators import analytics, pairs, search, triangle
from nearpress.session import cut, ordinal, scratch

CODEC = "brotli_recommended"
#: The datasets of a command that is given none.
DATASETS = ("euronews.com", "amazon", "imdb", "wikipedia")


def same_page(spark: SparkSession, path: str) -> DataFrame:
    """Distance of a page to itself and time taken, at 24 settings of brotli."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("text_a"), F.col("value").alias("text_b"))
    return analytics.sweep(text, analytics.grid(spark, range(3, 11), range(20, 23)))


def _structures(spark: SparkSession, root: str) -> DataFrame:
    """``id, text, label, url``: pages by structure, numbered in the order of the manifest."""
    rows = datasets.load(spark, root).where("text is not null")
    rows = rows.select("pos", "url", "label", html.html_structure("text").alias("text"))
    return cut(ordinal(rows, ["pos", "url"], out="id").select("id", "text", "label", "url"))


def heatmap(spark: SparkSession, root: str, codec: Spec | None = None) -> DataFrame:
    """Heatmap data of all pages of a dataset with all."""
    pages = _structures(spark, root)
    square = pairs.mirrored(pairs.self_distances(pages, codec or Spec(CODEC)).select("i", "j", "d"))
    return pairs.labelled(square, pages, pages)


def triangle_inequality(spark: SparkSession, root: str, codec: Spec | None = None, strict: bool = False) -> DataFrame:
    """Triples of pages, as they are, that break the triangle inequality."""
    rows = datasets.load(spark, root).where("text is not null")
    pages = cut(ordinal(rows.select("pos", "url", "text"), ["pos", "url"], out="id"))
    return triangle.triangle_violations(pairs.self_distances(pages, codec or Spec(CODEC)), strict)


def wiki_vs_grok(spark: SparkSession, root: str, codec: Spec | None = None, on_missing: str = "raise") -> DataFrame:
    """``i, j, wiki_label, grok_label, d`` of the article texts of two corpora."""
    rows = datasets.load(spark, root).where("page_type in ('wiki', 'grok')")
    rows = cut(ordinal(datasets.extracted(rows, on_missing), ["pos", "url"], ["page_type"]))
    side = lambda kind: rows.where(F.col("page_type") == kind).select(F.col("i").alias("id"), "text", "label")
    wiki, grok = side("wiki"), side("grok")
    found = pairs.cross_distances(wiki, grok, codec or Spec(CODEC))
    named = pairs.labelled(found.select("i", "j", "d"), wiki, grok)
    return named.withColumnRenamed("row_label", "wiki_label").withColumnRenamed("col_label", "grok_label")


def distribution(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Histogram and medians of related and other pairs of ``wiki_vs_grok``."""
    rows = analytics.related_split(matrix)
    return analytics.histogram(rows), analytics.group_median(rows, [analytics.SAME, analytics.DIFFERENT])


def bk_tree(spark: SparkSession, root: str, tolerance: float = 0.25, codec: Spec | None = None, n_pivots: int = 8) -> DataFrame:
    """Brute and pruned range search of every page in all, in numbers.

    The pruned search measures only what its pivots don't rule out.
    """
    codec = codec or Spec(CODEC)
    pages = _structures(spark, root).select(F.col("id").alias("x"), "text")
    found = pairs.mirrored(pairs.self_distances(pages.withColumnRenamed("x", "id"), codec).select("i", "j", "d"))
    brute = cut(search.first_match(found.select(F.col("i").alias("q"), F.col("j").alias("x"), "d"), tolerance))
    hits, calls = search.indexed_search(pages, pages, codec, tolerance, n_pivots)
    return search.search_summary(brute, calls, search.divergence(brute, hits))


def optimal_opts(spark: SparkSession, w1: str, g1: str, w2: str, g2: str) -> DataFrame:
    """The setting of 143 which parts two topics in two corpora best."""
    rows = []
    for slot, path, how in (("w1", w1, WIKI), ("g1", g1, GROK), ("w2", w2, WIKI), ("g2", g2, GROK)):
        with open(path, encoding="utf-8") as f:  # four files named on the command line
            text = article_content(f.read(), *how)
        if text is None:
            raise ValueError(f"no article text in {path}")
        rows.append((slot, text))
    four = spark.createDataFrame(rows, "slot string, text string")
    swept = analytics.sweep(analytics.topic_pairs(four), analytics.grid(spark, range(1, 12), range(10, 23)))
    return analytics.best_options(swept.withColumn("d", F.col("distance")))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nearpress")
    parser.add_argument("--base", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("same-page").add_argument("file")
    for name in ("heatmap", "triangle-inequality", "bk-tree"):
        commands.add_parser(name).add_argument("folders", nargs="*", default=list(DATASETS))
    commands.choices["bk-tree"].add_argument("--tolerance", type=float, default=0.25)
    commands.add_parser("wiki-vs-grok").add_argument("folder")
    four = commands.add_parser("optimal-opts")
    for name in ("w1", "g1", "w2", "g2"):
        four.add_argument(name)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("nearpress").getOrCreate()
    at = lambda path: os.path.join(a.base, path)
    with scratch():
        if a.command == "same-page":
            out = same_page(spark, os.path.abspath(at(a.file)))
        elif a.command == "wiki-vs-grok":
            out = wiki_vs_grok(spark, at(a.folder))
        elif a.command == "optimal-opts":
            out = optimal_opts(spark, *map(at, (a.w1, a.g1, a.w2, a.g2)))
        else:
            one = {"heatmap": heatmap, "triangle-inequality": triangle_inequality, "bk-tree": lambda s, f: bk_tree(s, f, a.tolerance)}[a.command]
            out = reduce(DataFrame.unionByName, [one(spark, at(f)).withColumn("dataset", F.lit(f)) for f in a.folders])
        out.show(1_000, truncate=False)


if __name__ == "__main__":
    main()
