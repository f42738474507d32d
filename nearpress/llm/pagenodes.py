"""Nodes of a page with their features, for problem 1.

A page becomes a tree of blocks.  Leaves are runs of text that stand together
(inline elements included, broken at ``br``) with the source lines they touch;
inner nodes are the elements that hold several of them.  A page of bare text
becomes a tree of its lines, grouped by blank lines.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nearpress.functions.htmltree import Node, Text, parse

#: Elements that don't part text into blocks.
INLINE = frozenset("a abbr acronym b bdo big cite code del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = frozenset("head script style noscript template svg iframe object select option".split())
#: Tags told apart by the features; others share a place.
TAGS = "html body div section article main nav aside header footer ul ol table tbody tr td p span li dd dt dl h1 h2 h3 h4 blockquote button small strong b a form #text #line #group".split()
#: Page types told apart by the features.
PAGE_TYPES = "article category grok wiki disambiguation user tag section product profile news_article search person video store special user_list neutral biased movie".split()
#: Share of a page's words that must have a score for scores to be used.
KNOWN_WORDS = 0.4
#: Places of hashed attribute tokens.
ATTR_PLACES = 24

_WORD = re.compile(r"[^\W\d_]+")
_VISIBLE = re.compile(r"[^\s ​‌‍⁠﻿­]")
_TOKENS = re.compile(r"[a-z]+")


class Block:
    """A leaf (``text`` is set) or an inner node."""

    __slots__ = ("tag", "depth", "children", "parent", "text", "linked", "lines", "attrs", "index", "n_tags")

    def __init__(self, tag: str, parent: Block | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Block] = []
        self.text: str | None = None
        self.linked, self.lines, self.index, self.n_tags = 0, set(), -1, 0
        if parent is not None:
            parent.children.append(self)


def _lines_of(source: str, starts: list[int], t: Text) -> set[int]:
    """Lines of the source on which a text node has something to see."""
    if t.value.strip(" ​﻿ \t\r\n\f") == "":
        return set()
    out, at = set(), t.start
    for piece in source[t.start : t.end].split("\n"):
        if _VISIBLE.search(piece.replace("&nbsp;", " ").replace("&#160;", " ")):
            out.add(bisect_right(starts, at) - 1)
        at += len(piece) + 1
    return out


def _fill(node: Node, block: Block, source: str, starts: list[int]) -> None:
    """Adds the children of an element to its block; iterative, for deep pages."""
    holds = _holds_blocks(node)
    todo: list[tuple[Node, Block]] = [(node, block)]
    while todo:
        node, block = todo.pop()
        run: Block | None = None
        stack: list[tuple[object, int, bool]] = [(c, 0, False) for c in reversed(node.children)]
        pieces: list[tuple[Node, Block]] = []
        while stack:
            child, _, linked = stack.pop()
            if type(child) is Text:
                lines = _lines_of(source, starts, child)
                if lines or (run is not None and child.value):
                    if run is None:
                        run = Block("#text", block)
                        run.text = ""
                    run.text += child.value
                    run.lines |= lines
                    run.linked += len(child.value.strip()) if linked else 0
            elif type(child) is Node and child.name not in HIDDEN:
                block.n_tags += 1
                if child.name == "br" or child.name == "hr":
                    run = None
                elif child.name in INLINE and id(child) not in holds:
                    if child.name in ("span", "small", "strong") and run is not None and _starts_line(child, source):
                        run = None  # one below the other they are paragraphs of their own
                    if run is None:
                        run = Block("#text" if child.name not in ("span", "small", "strong", "a") else child.name, block, _attrs(child))
                        run.text = ""
                    stack += [(c, 0, linked or child.name == "a") for c in reversed(child.children)]
                else:
                    run = None
                    pieces.append((child, Block(child.name, block, _attrs(child))))
        todo += reversed(pieces)


def _starts_line(node: Node, source: str) -> bool:
    first = next(node.texts(), None)
    if first is None:
        return False
    tag = source.rfind(f"<{node.name}", 0, first.start) - 1
    while tag >= 0 and source[tag] in " \t\r":
        tag -= 1
    return tag == -1 or (tag >= 0 and source[tag] == "\n")


def _holds_blocks(node: Node) -> set[int]:
    """The inline elements below that hold a block, by identity; worked out from below in one pass."""
    out: set[int] = set()
    for n in reversed(list(node.elements())):
        if n is not node and (id(n) in out or (n.name not in INLINE and n.name not in _PLAIN)):
            out.add(id(n.parent))
    return out


_PLAIN = HIDDEN | {"br", "img", "wbr", "input"}


def _attrs(node: Node) -> str:
    return f"{node.attrs.get('class', '')} {node.attrs.get('id', '')} {node.attrs.get('role', '')}".lower()


def _tidy(block: Block) -> Block:
    """Takes out empty blocks and lifts an element's only run of text into it."""
    order, todo = [], [block]
    while todo:
        b = todo.pop()
        order.append(b)
        todo += b.children
    for b in reversed(order):
        b.children = [c for c in b.children if c.children or (c.text is not None and c.lines)]
        if b.text is None and len(b.children) == 1 and b.children[0].text is not None and b.children[0].tag in ("#text", "a", "strong", "b"):
            only = b.children[0]
            b.text, b.linked, b.lines, b.children = only.text, only.linked, only.lines, []
        b.n_tags += sum(c.n_tags for c in b.children)
    return block


def page_tree(source: str) -> Block:
    """The tree of blocks of a page."""
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    root = Block("html", None)
    if "<" in source and re.search(r"<[a-zA-Z!/]", source):
        for body in parse(source).children:
            if type(body) is Node and body.name != "head":
                _fill(body, Block(body.name, root, _attrs(body)), source, starts)
        return _tidy(root)
    group: Block | None = None
    for no, line in enumerate(source.split("\n")):
        if not _VISIBLE.search(line):
            group = None
            continue
        group = group or Block("#group", root)
        leaf = Block("#line", group)
        leaf.text, leaf.lines = line, {no}
    return root


def walk(root: Block) -> list[Block]:
    """All blocks, parents before children, in document order; numbered."""
    out, todo = [], [root]
    while todo:
        b = todo.pop()
        b.index = len(out)
        out.append(b)
        todo += reversed(b.children)
    for i, b in enumerate(out):
        b.depth = b.parent.depth + 1 if b.parent else 0
    return out


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def page_kind(page_type: str | None) -> str:
    return (page_type or "").strip().lower()


#: Names of what is measured of the text of a node; the last six by the scores of words.
TEXT_FEATURES = (
    "words chars final link_share upper_share short_share digits colons bars angles commas quotes item "
    "score_mean score_min score_max known_share first_score"
).split()
_SCORE = TEXT_FEATURES.index("score_mean")


def text_features(texts: list[str], linked: np.ndarray, scores: dict[str, float]) -> np.ndarray:
    """A row for each text, of all texts at once."""
    spaced = pc.utf8_trim_whitespace(pc.replace_substring_regex(pa.array(texts, pa.string()), r"\s+", " "))
    number = lambda x: x.to_numpy(zero_copy_only=False).astype(float)
    count = lambda pattern: number(pc.count_substring_regex(spaced, pattern))
    has = lambda pattern: number(pc.match_substring_regex(spaced, pattern))
    chars = number(pc.utf8_length(spaced))
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.replace_substring_regex(spaced, r"[^\p{L}]+", " ")))
    of, words = pc.list_parent_indices(split).to_numpy(zero_copy_only=False), split.flatten()
    there = pc.not_equal(pc.binary_length(words), 0)
    coded, of = words.filter(there).dictionary_encode(), of[there.to_numpy(zero_copy_only=False)]
    n = np.bincount(of, minlength=len(texts)).astype(float)
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    short = np.bincount(of, (number(pc.utf8_length(coded.dictionary)) <= 3)[codes] if len(codes) else None, minlength=len(texts))
    out = np.zeros((len(texts), len(TEXT_FEATURES)))
    some = np.maximum(n, 1)
    out[:, :_SCORE] = np.column_stack([
        n, chars, np.where(has(r"[.!?…]$") > 0, 2.0, has(r"[”\"»“)]$")), linked / np.maximum(chars, 1), count(r"(?:^|[^\p{L}])\p{Lu}") / some, short / some, count("[0-9]"),
        count(":"), count(r"\|"), count(">"), count(","), count("[“”„«»\"]"), has("^[-*•] "),
    ])
    if scores and len(codes):
        of_word = np.array([scores.get(w, np.nan) for w in names])[codes]
        known = ~np.isnan(of_word)
        at, value = of[known], of_word[known]
        n_known = np.bincount(at, minlength=len(texts))
        low, high = np.full(len(texts), np.inf), np.full(len(texts), -np.inf)
        np.minimum.at(low, at, value)
        np.maximum.at(high, at, value)
        first = np.zeros(len(texts))
        first[of[::-1]] = np.nan_to_num(of_word[::-1])  # of several the first word's is written last
        seen = n_known > 0
        out[:, _SCORE:] = np.column_stack([np.bincount(at, value, minlength=len(texts)) / np.maximum(n_known, 1), np.where(seen, low, 0), np.where(seen, high, 0), n_known / some, first])
    return out


@lru_cache(maxsize=4_096)
def _places(attrs: str) -> tuple[int, ...]:
    return tuple({zlib.crc32(t.encode()) % ATTR_PLACES for t in _TOKENS.findall(attrs) if len(t) > 2})


def features(root: Block, page_type: str | None, scores: dict[str, float]) -> tuple[list[Block], np.ndarray]:
    """The blocks of a page and a row of features for each."""
    (blocks,), rows = batch_features([(root, page_type)], scores)
    return blocks, rows


def batch_features(pages: list[tuple[Block, str | None]], scores: dict[str, float]) -> tuple[list[list[Block]], np.ndarray]:
    """The blocks of each page, and a row of features for each block of all pages.

    Blocks are in document order, so what is below one is the run that follows
    it: sums are differences of running sums, and work is in proportion to the
    number of blocks.
    """
    of_page = [walk(root) for root, _ in pages]
    blocks = [b for page in of_page for b in page]
    n = len(blocks)
    sizes = np.array([len(page) for page in of_page], np.int64)
    page = np.repeat(np.arange(len(pages)), sizes)
    base = (np.cumsum(sizes) - sizes)[page]
    index = np.arange(n)
    parent = np.fromiter((b.parent.index if b.parent else 0 for b in blocks), np.int64, n) + base
    depth = np.fromiter((b.depth for b in blocks), float, n)
    n_tags = np.fromiter((b.n_tags for b in blocks), float, n)
    leaf = np.fromiter((b.text is not None for b in blocks), bool, n)
    tags = np.fromiter((_TAG_PLACE.get(b.tag, len(TAGS)) for b in blocks), np.int64, n)
    below = [1] * n
    up = parent.tolist()
    for i in range(n - 1, -1, -1):
        if up[i] != i:
            below[up[i]] += below[i]
    end = index + np.array(below, np.int64)
    leaves = np.flatnonzero(leaf)
    n_text = len(TEXT_FEATURES)
    own = np.zeros((n, n_text))
    if len(leaves):
        own[leaves] = text_features([blocks[i].text for i in leaves], np.array([blocks[i].linked for i in leaves], float), scores)
        # a few words alike in another language tell nothing
        known = np.bincount(page, own[:, 0] * own[:, _SCORE + 3], minlength=len(pages)) >= KNOWN_WORDS * np.bincount(page, own[:, 0], minlength=len(pages))
        own[~known[page], _SCORE:] = 0
    # sums over the leaves below
    h1 = leaf & (tags == _TAG_PLACE["h1"])
    listed = np.isin(tags, (_TAG_PLACE["li"], _TAG_PLACE["#line"]))
    summed = np.column_stack([leaf, own[:, 0], own[:, _SCORE], *(leaf & m for m in (own[:, 2] > 0, own[:, 0] <= 4, listed, own[:, 3] > 0.8)), h1])
    run = np.zeros((n + 1, summed.shape[1]))
    np.cumsum(summed, axis=0, out=run[1:])
    count, words, score, finals, short, items, links, heads = (run[end] - run[index]).T
    rank_all = run[index, 0].astype(np.int64)  # leaves before, of all pages
    first = np.full(n, -1)
    holds = count > 0
    first[holds] = leaves[rank_all[holds]]
    share = np.maximum(count, 1)
    group = np.column_stack([count, words, words / share, words / (n_tags + 1), finals / share, short / share, items / share, links / share, score / share, heads > 0])
    # place among the leaves, and from the first heading
    rank = rank_all - rank_all[base]
    n_leaves = count[base]
    h1_rank = np.full(len(pages), -1)
    at = np.flatnonzero(h1)
    h1_rank[page[at][::-1]] = rank[at][::-1]
    h1_rank = h1_rank[page]
    place = np.column_stack([rank, rank / np.maximum(1, n_leaves), np.where(h1_rank >= 0, rank - h1_rank, -99.0), n_leaves])
    # children of one parent, one after another
    child = np.flatnonzero(parent != index)
    child = child[np.argsort(parent[child], kind="stable")]
    of = parent[child]
    new = np.concatenate(([True], of[1:] != of[:-1]))[: len(child)]
    starts = np.flatnonzero(new)
    number = np.arange(len(child)) - np.repeat(starts, np.diff(np.append(starts, len(child))))
    _, kind, alike = np.unique(of * (len(TAGS) + 1) + tags[child], return_inverse=True, return_counts=True)
    same = np.zeros(len(child), bool)
    same[1:] = ~new[1:] & (tags[child[1:]] == tags[child[:-1]])
    sibling = np.zeros((n, 5))
    sibling[child] = np.column_stack([number, np.bincount(of, minlength=n)[of], alike[kind], same, np.append(same[1:], False)[: len(child)]])
    before, after = np.full(n, -1), np.full(n, -1)
    before[child[1:]] = np.where(new[1:], -1, child[:-1])
    after[child[:-1]] = np.where(new[1:], -1, child[1:])
    # the last line without a full stop that could head what follows: its scores
    first_in_parent = first[parent] == index
    heading = leaf & (np.isin(tags, _HEAD_TAGS) | ((own[:, 2] == 0) & (own[:, 0] <= 6) & (own[:, 12] == 0) & (first_in_parent | (index == base))))
    last = np.maximum.accumulate(np.where(heading, index, -1))
    last = np.concatenate(([-1], last[:-1])) if n else last
    there = last >= base
    since = np.where(there, rank - rank[np.maximum(last, 0)] - 1, 99 + rank)
    head = np.column_stack([np.where(there[:, None], own[np.maximum(last, 0)][:, [_SCORE, _SCORE + 1, 0]], 0.0), since])
    near_own, near_group = _near(before, own), _near(after, own)
    gb, ga, gp, gg = _near(before, group), _near(after, group), group[parent], group[parent[parent]]
    first_of_parent = own[np.maximum(first[parent], 0)][:, [0, 13, 14, 2]]
    first_own = own[np.maximum(first, 0)][:, [0, 13, 14, 2]]
    top = index.tolist()
    for i, d in enumerate(depth.tolist()):
        if d > 2:
            top[i] = top[up[i]]
    tag_hot = np.zeros((n, len(TAGS) + 1))
    tag_hot[index, tags] = 1
    any_leaf = len(leaves) > 0
    prev_leaf = np.where(rank > 0, leaves[np.maximum(rank_all - 1, 0)] if any_leaf else 0, base)
    last_of_page = rank_all[base] + n_leaves.astype(np.int64) - 1
    next_leaf = leaves[np.clip(np.minimum(rank_all + leaf, last_of_page), 0, len(leaves) - 1)] if any_leaf else np.zeros(n, int)
    pick = [0, 2, 3, 12, 13, 14]
    kinds = np.zeros((n, len(PAGE_TYPES) + 1))
    kinds[index, np.array([_KIND_PLACE.get(page_kind(k), len(PAGE_TYPES)) for _, k in pages], np.int64)[page]] = 1
    named: dict[str, int] = {}
    code = np.fromiter((named.setdefault(b.attrs, len(named)) for b in blocks), np.int64, n)
    places = np.zeros((len(named), ATTR_PLACES))
    for attrs, k in named.items():
        places[k, list(_places(attrs))] = 1
    has_parent = (parent != index)[:, None]
    rows = np.column_stack(
        [
            leaf, depth, own, group, place, sibling, head, tags[parent], near_own[:, pick], near_group[:, pick], own[prev_leaf][:, pick], own[next_leaf][:, pick],
            gb[:, [0, 2, 4, 8]], ga[:, [0, 2, 4, 8]], gp, gg, group[top], own[np.maximum(first[top], 0)][:, [0, 13, 14]], first_of_parent, first_own, tag_hot, kinds, places[code], places[code[parent]] * has_parent,
        ]
    )
    return of_page, rows.astype(np.float32)


_TAG_PLACE = {t: k for k, t in enumerate(TAGS)}
_KIND_PLACE = {t: k for k, t in enumerate(PAGE_TYPES)}
_HEAD_TAGS = [_TAG_PLACE[t] for t in ("h1", "h2", "h3", "h4", "strong")]


def _near(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.where((at >= 0)[:, None], values[np.maximum(at, 0)], 0.0)
