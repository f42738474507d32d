"""Fits the page model of problem 1 and writes it beside the operator.

    python -m nearpress.llm.train_pages /root/testdata/sf0.1 [--pages 2000] [--made 1500] [--out pagemodel.json]

The sample is bounded by ``--pages``, and ``--made`` pages of random words and
layouts are added, so that pages unlike those of the table are known too; what is beyond it of the table, up to a
quarter as many, is held out and the accuracy by line printed.
"""

from __future__ import annotations

import argparse
import json
import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from nearpress.llm.boosting import fit
from nearpress.llm.mainbody import MODEL, body_lines
from nearpress.llm.pagelabels import common_shapes, label
from nearpress.llm.pagemaker import made_pages
from nearpress.llm.pagenodes import Block, batch_features, page_kind, page_tree, walk, words_of

#: Pages a word has to stand on to be scored.
LEAST_PAGES = 40
#: Types the made pages are given in turn.
KINDS = ("article", "news_article", "wiki", "grok", None, "neutral", "movie")


def made_labels(root: Block, body: set[int]) -> np.ndarray:
    """1 for each block of a made page with lines of the body, in the order of ``walk``."""
    blocks = walk(root)
    out = np.array([float(b.text is not None and b.lines <= body) for b in blocks])
    for b in reversed(blocks):
        if b.parent is not None and out[b.index]:
            out[b.parent.index] = 1
    return out


def word_scores(pages: list, labels: list[list[int]]) -> dict[str, float]:
    """Log-odds of the body of the words of leaves that stand on enough pages."""
    yes, no, on = Counter(), Counter(), Counter()
    for (root, _), y in zip(pages, labels):
        seen = set()
        for b in walk(root):
            if b.text is not None:
                words = set(words_of(b.text))
                (yes if y[b.index] else no).update(words)
                seen |= words
        on.update(seen)
    total_yes, total_no = sum(yes.values()), sum(no.values())
    return {w: round(math.log((yes[w] + 1) / (no[w] + 1) * total_no / total_yes), 2) for w, n in sorted(on.items()) if n >= LEAST_PAGES}


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("dir")
    args.add_argument("--pages", type=int, default=2_000)
    args.add_argument("--trees", type=int, default=160)
    args.add_argument("--made", type=int, default=1_500)
    args.add_argument("--out", default=MODEL)
    a = args.parse_args()
    kinds: dict[str, Counter] = {}
    for e in pq.read_table(f"{a.dir}/entries.parquet", columns=["filepath", "page_type"]).to_pylist():
        if page_kind(e["page_type"]):
            kinds.setdefault(e["filepath"], Counter())[page_kind(e["page_type"])] += 1
    read = pq.read_table(f"{a.dir}/pages.parquet", columns=["page_id", "filepath", "html"]).to_pylist()
    read = [r for r in sorted(read, key=lambda r: r["page_id"]) if r["html"]]
    kind_of = [kinds[r["filepath"]].most_common(1)[0][0] if r["filepath"] in kinds else None for r in read]
    trees = [(page_tree(r["html"]), k) for r, k in zip(read, kind_of)]
    train, held = trees[: a.pages], trees[a.pages : a.pages + a.pages // 4]
    common = common_shapes(train)
    labels = [label(root, k, common) for root, k in train]
    scores = word_scores(train, labels)
    # each page twice, as it is and as one of whose words none is known, and the made ones, of which none is known
    made = made_pages(a.made)
    made_trees = [(page_tree(h), KINDS[k % len(KINDS)]) for k, (h, _) in enumerate(made)]
    rows = np.concatenate([batch_features(train, scores)[1], batch_features(train, {})[1], batch_features(made_trees, {})[1]])
    y = np.concatenate([np.array(y, float) for y in labels])
    model = fit(rows, np.concatenate([y, y, *(made_labels(root, body) for (root, _), (_, body) in zip(made_trees, made))]), n_trees=a.trees, depth=6)
    with open(a.out, "w", encoding="utf-8") as f:
        json.dump({"trees": model.to_dict(), "scores": scores}, f, ensure_ascii=False, separators=(",", ":"))
    for name, part, offset, scores in (("train", train[:500], 0, scores), ("held out", held, a.pages, scores), ("held out, no word known", held, a.pages, {})):
        right = found = there = pages = 0
        for i, (root, k) in enumerate(part):
            want = {n for b, y in zip(walk(root), label(root, k, common)) if y and b.text is not None for n in b.lines}
            got = set(body_lines(read[offset + i]["html"], k, (model, scores)))
            right, found, there, pages = right + len(want & got), found + len(got), there + len(want), pages + (want == got)
        if part:
            print(f"{name}: {len(part)} pages, precision {right / max(1, found):.4f}, recall {right / max(1, there):.4f}, pages right {pages / len(part):.4f}")


if __name__ == "__main__":
    main()
