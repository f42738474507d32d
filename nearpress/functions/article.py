"""The running text of an article page, and how it is tidied."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearpress.functions.htmltree import Node, Text, parse

# Where articles stand on the two kinds of pages, and what is no text.
WIKI = (("div#bodyContent", "article", "main", "body"), "p")
GROK = (("article", "main", "body"), "span")
EXCLUDED = ("div#references", "table", ".infobox", "nav", ".toc", "footer", "aside")
#: Words from which a paragraph counts.
LEAST_WORDS = 8

# White space as Unicode's White_Space property has it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0              　"
_GAPS = re.compile(f"[{_WHITE}]+")
_BRACKETED = re.compile(r"\[[^\]]*\]")
# Signs that take no space before or after them, quotes, and endings.
_AFTER_CLOSING_QUOTE = frozenset(",.:;!?)")
_AFTER_CLOSING = frozenset(",.:;!?)]}")
_OPENING = frozenset("([{")
_TIGHT = ((" ,", ","), (" .", "."), (" :", ":"), (" ;", ";"), (" !", "!"), (" ?", "?"), (" )", ")"))
_QUOTES = (('" ', '"'), ("' ", "'"), (' "', '"'))
_CONTRACTIONS = ("'s", "'re", "n't", "'ve", "'ll", "'d", "'m")


def selector(text: str):
    """A test of an element for ``tag``, ``.class``, ``#id`` and their combinations."""
    m = re.fullmatch(r"([\w-]*)((?:[.#][\w-]+)*)", text)
    if not m:
        raise ValueError(f"selector {text!r} isn't tag, .class or #id")
    tag, rest = m.group(1).lower(), re.findall(r"([.#])([\w-]+)", m.group(2))

    def test(node: Node) -> bool:
        if tag and node.name != tag:
            return False
        for sign, name in rest:
            if sign == "#" and node.attrs.get("id") != name:
                return False
            if sign == "." and name not in node.attrs.get("class", "").split():
                return False
        return True

    return test


def article_content(page: str, containers: Sequence[str], candidate: str, excluded: Sequence[str] = EXCLUDED) -> str | None:
    """Paragraphs of a page, parted by blank lines; None without any.

    The container is the first match of the first selector that matches.  Of
    its descendants the candidates are taken in order, except below an excluded
    element in the container; short ones are left out.  A candidate within a
    candidate gives its text again.
    """
    root = parse(page)
    container = None
    for test in map(selector, containers):
        container = next((n for n in root.elements() if test(n)), None)
        if container is not None:
            break
    if container is None:
        return None
    is_candidate, barred = selector(candidate), [selector(x) for x in excluded]
    out: list[str] = []
    todo: list[tuple[Node, bool]] = [(c, False) for c in reversed(container.children) if type(c) is Node]
    while todo:
        node, out_of = todo.pop()
        if not out_of and is_candidate(node):
            text = clean_text(" ".join(t.value for t in _texts(node)))
            if len([w for w in _GAPS.split(text) if w]) >= LEAST_WORDS:
                out.append(text)
        below = out_of or any(test(node) for test in barred)
        todo += [(c, below) for c in reversed(node.children) if type(c) is Node]
    return "\n\n".join(out) if out else None


def _texts(node: Node) -> list[Text]:
    return list(node.texts())


def _quotes(text: str) -> str:
    """Space inside quotes taken out, and one put after a closing quote before a word."""
    out: list[str] = []
    inside = {'"': False, "'": False}
    at, n = 0, len(text)
    while at < n:
        ch = text[at]
        at += 1
        out.append(ch)
        if ch not in inside:
            continue
        inside[ch] = not inside[ch]
        if inside[ch]:
            while at < n and text[at] in _WHITE:
                at += 1
        elif at < n and text[at] not in _WHITE and text[at] not in _AFTER_CLOSING_QUOTE:
            out.append(" ")
    return "".join(out)


def _spacing(text: str) -> str:
    """Space around brackets and quotes put right; an apostrophe in a word is no quote."""
    out: list[str] = []
    inside = {'"': False, "'": False}
    at, n = 0, len(text)

    def skip(i: int) -> int:
        while i < n and text[i] in _WHITE:
            i += 1
        return i

    while at < n:
        ch = text[at]
        if ch in _OPENING:
            out.append(ch)
            at = skip(at + 1)
        elif ch in _WHITE:
            ahead = skip(at)
            if ahead < n and text[ahead] in inside:
                solid = next((c for c in reversed(out) if c not in _WHITE), "")
                if solid and solid not in _OPENING and out[-1] != " ":
                    out.append(" ")
                at = ahead
            else:
                if not out or out[-1] not in _WHITE:
                    out.append(" ")
                at += 1
        elif ch == "'" and at + 1 < n and text[at + 1].isalnum():
            out.append(ch)
            at += 1
        elif ch in inside:
            inside[ch] = not inside[ch]
            if inside[ch]:
                if out and out[-1] not in _WHITE and out[-1] not in _OPENING:
                    out.append(" ")
                out.append(ch)
                at = skip(at + 1)
            else:
                out.append(ch)
                at = skip(at + 1)
                if at < n and text[at] not in _AFTER_CLOSING:
                    out.append(" ")
        else:
            out.append(ch)
            at += 1
    return "".join(out)


def clean_text(raw: str) -> str:
    """Text without marks in brackets, with even spacing around marks and quotes."""
    text = _BRACKETED.sub(" ", raw.replace("\n", " "))
    text = _GAPS.sub(" ", text).strip(" ")
    for old, new in (*_TIGHT, *_QUOTES):
        text = text.replace(old, new)
    text = _spacing(_quotes(text))
    for ending in _CONTRACTIONS:
        text = text.replace(f" {ending}", ending)
    return text


def clean_text_basic(col: Column | str) -> Column:
    """The steps of ``clean_text`` before the quotes are paired, without Python."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(F.regexp_replace(c, "\n", " "), r"\[[^\]]*\]", " ")
    c = F.trim(F.regexp_replace(c, r"\p{IsWhite_Space}+", " "))
    for old, new in (*_TIGHT, *_QUOTES):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _udf(f):
    @F.arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.string())

    return apply


def _on(f, col: Column | str) -> Column:
    return _udf(f)(F.col(col) if isinstance(col, str) else col)


def clean(col: Column | str) -> Column:
    """``clean_text`` of a column; null gives null."""
    return _on(clean_text, col)


def article_text(col: Column | str, containers: Sequence[str], candidate: str) -> Column:
    """``article_content`` of a column of pages by one's own selectors."""
    chosen = tuple(containers)
    return _on(lambda page: article_content(page, chosen, candidate), col)


def wiki_content(col: Column | str) -> Column:
    return article_text(col, *WIKI)


def grok_content(col: Column | str) -> Column:
    return article_text(col, *GROK)


def content_by_type(page: Column | str, page_type: Column | str) -> Column:
    """Article text of ``wiki`` and ``grok`` pages; null for other types.

    One pass: the Python side is called once a row and picks by the type.
    """

    @F.arrow_udf("string")
    def pick(pages: pa.Array, kinds: pa.Array) -> pa.Array:
        by = {"wiki": WIKI, "grok": GROK}
        rows = zip(pages.to_pylist(), kinds.to_pylist())
        return pa.array([article_content(p, *by[k]) if p is not None and k in by else None for p, k in rows], pa.string())

    p, k = (F.col(c) if isinstance(c, str) else c for c in (page, page_type))
    return pick(p, k)
