"""Problem 1: the main body of a page.

Gradient-boosted trees judge every node of a page from features of the node
and its place: density of the text below, attribute tokens, depth, siblings
before and after, parent and outer block, wording scores.  They are fitted with
and without the wording scores, and on made pages of random words and layouts;
pages whose words are mostly unknown are judged by their structure alone.  A page is then decoded as a whole: a node can be body only
with its ancestors, and an inner node only with something below it, and of all
such choices the one with the highest sum of log-odds is taken.

Each page is worked on alone.  The types of pages are broadcast where their
counted rows are few; beyond that pages meet them by a shuffle.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.llm.boosting import Trees
from nearpress.llm.common import cut, maybe_broadcast, table
from nearpress.llm.pagenodes import Block, batch_features, page_tree

#: Pages judged together.
PAGES_AT_ONCE = 128

MODEL = os.path.join(os.path.dirname(__file__), "pagemodel.json")


@lru_cache(maxsize=2)
def load_model(path: str = MODEL) -> tuple[Trees, dict[str, float]]:
    """The trees and the wording scores."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return Trees.from_dict(d["trees"]), d["scores"]


def decode(blocks: list[Block], odds: np.ndarray) -> np.ndarray:
    """The consistent choice with the highest sum of log-odds.

    ``blocks`` have parents before children.  A leaf may be chosen; an inner
    node is chosen with at least one child, and no node without its parent.
    """
    n = len(blocks)
    gain = np.zeros(n)  # of the best choice below and with the node
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        if not b.children:
            gain[i] = odds[i]
            continue
        kids = [gain[c.index] for c in b.children]
        some = sum(g for g in kids if g > 0)
        gain[i] = odds[i] + (some if some > 0 else max(kids))
    chosen = np.zeros(n, bool)
    if n:
        chosen[0] = gain[0] > 0
    for i, b in enumerate(blocks):
        if not chosen[i] or not b.children:
            continue
        kids = [c.index for c in b.children]
        good = [k for k in kids if gain[k] > 0]
        chosen[good or [max(kids, key=lambda k: gain[k])]] = True
    return chosen


def bodies_lines(pages: list[tuple[str, str | None]], model: tuple[Trees, dict[str, float]]) -> list[list[int]]:
    """For each page and its type the numbers of the lines with text of the body."""
    trees, scores = model
    roots = [page_tree(source) for source, _ in pages]
    some = [(root, kind) for root, (_, kind) in zip(roots, pages) if root.children]
    made, rows = batch_features(some, scores) if some else ([], None)
    odds = trees.margin(rows) if some else np.zeros(0)
    found, at = iter(made), 0
    out = []
    for root in roots:
        if not root.children:
            out.append([])
            continue
        blocks = next(found)
        chosen = decode(blocks, odds[at : at + len(blocks)])
        at += len(blocks)
        out.append(sorted({line for b in blocks if chosen[b.index] and b.text is not None for line in b.lines}))
    return out


def body_lines(source: str, page_type: str | None, model: tuple[Trees, dict[str, float]]) -> list[int]:
    """Numbers of the lines with text of the body, in order; empty without any."""
    return bodies_lines([(source, page_type)], model)[0]


def _found(path: str):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_model(path)
        for batch in batches:
            for part in range(0, batch.num_rows, PAGES_AT_ONCE):
                ids, sources, kinds = (c.to_pylist() for c in batch.slice(part, PAGES_AT_ONCE).columns)
                lines = bodies_lines(list(zip(sources, kinds)), model)
                flat = [(i, n) for i, here in zip(ids, lines) for n in here]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in flat], pa.int64()), pa.array([n for _, n in flat], pa.int64())], names=["page_id", "line_no"])

    return op


def typed_pages(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, html, page_type``: pages with the type of the entry of their file.

    A file listed several times takes the type that is listed most often, of
    ties the first in order; one without an entry or a type has none.
    """
    kind = F.lower(F.trim("page_type"))
    kinds = entries.select("filepath", kind.alias("kind")).where("filepath is not null and kind <> ''")
    kinds = kinds.groupBy("filepath", "kind").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("filepath").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("page_type"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "filepath", "html").where("page_id is not null and html is not null")
    paths = pages.select("filepath").where("filepath is not null and html is not null").distinct()
    kinds = cut(kinds.join(paths, "filepath", "left_semi"))
    return p.join(maybe_broadcast(kinds, kinds.count(), 300), "filepath", "left").select("page_id", "html", "page_type")


def main_body(pages: DataFrame, entries: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``page_id, line_no`` of the lines of each page's own body.

    ``pages`` has ``page_id, filepath, html``, ``entries`` has ``filepath,
    page_type``; other columns are ignored.  Pages with null id or html, or
    without visible text, have no lines.  Pages are read whole.  Rows given
    twice give one row.
    """
    return typed_pages(pages, entries).mapInArrow(_found(model_path), "page_id long, line_no long").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the body of each page."""
    return main_body(table(spark, sf_dir, "pages"), table(spark, sf_dir, "entries"))
