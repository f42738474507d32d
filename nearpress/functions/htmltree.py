"""A tree builder for HTML documents, after the rules of the HTML standard.

It covers what documents in the wild need: implied ``html``, ``head`` and
``body``, void elements, raw and escapable raw text, character references,
implied end tags, the list of active formatting elements with the adoption
agency and its limit of three, tables with foster parenting, and ``select``.
Not covered: framesets, foreign content rules beyond nesting, and templates
(their content is kept in place).  ``noscript`` is raw text, as with scripts
turned on.

Text nodes keep the place in the source they come from.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Element names by their role in the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main "
    "marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td "
    "template textarea tfoot th thead title tr track ul wbr xmp".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search "
    "section summary ul pre listing form table hr h1 h2 h3 h4 h5 h6 xmp plaintext".split()
)
BLOCK_END = frozenset(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav "
    "ol pre search section summary ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noframes style script template noscript".split())
SCOPE_STOP = frozenset("applet caption html table td th marquee object template".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
MARKED = frozenset("applet marquee object".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_END = re.compile(r"[\s/]*>")
_BLANK = re.compile(r"[ \t\n\f\r]*")
_REFERENCE = re.compile(r"&(?:#[xX]?[0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;?)(?=(=|[A-Za-z0-9])?)")


class Node:
    """An element."""

    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs = name, attrs or {}
        self.children: list[Node | Text | Comment] = []
        self.parent: Node | None = None

    def append(self, child: Node | Text | Comment) -> None:
        child.parent = self
        self.children.append(child)

    def elements(self) -> Iterator[Node]:
        """This element and its descendants, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if type(c) is Node]

    def texts(self) -> Iterator[Text]:
        """The text nodes below, in document order."""
        todo: list = [self]
        while todo:
            node = todo.pop()
            if type(node) is Text:
                yield node
            elif type(node) is Node:
                todo += reversed(node.children)


class Text:
    """A text node with its place in the source."""

    __slots__ = ("value", "start", "end", "parent")

    def __init__(self, value: str, start: int, end: int):
        self.value, self.start, self.end, self.parent = value, start, end, None


class Comment:
    __slots__ = ("parent",)

    def __init__(self):
        self.parent = None


def _attribute(value: str) -> str:
    """Decodes references; one without a semicolon before ``=`` or a letter stays."""
    if "&" not in value:
        return value

    def one(m: re.Match) -> str:
        ref = m.group()
        if not ref.startswith("&#") and not ref.endswith(";") and m.group(1):
            return ref
        return html.unescape(ref)

    return _REFERENCE.sub(one, value)


#: A tag without attributes.
_BARE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")
_RAW_TEXT = frozenset((*RAW, *ESCAPABLE, "plaintext"))


def tokens(source: str) -> Iterator[tuple]:
    """``("text", value, start, end)``, ``("start", name, attrs)``, ``("end", name)``, ``("comment",)``."""
    at, size, since = 0, len(source), 0

    def text(end: int):
        value = source[since:end]
        return ("text", html.unescape(value) if "&" in value else value, since, end)

    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            break
        bare = _BARE.match(source, lt)
        if bare is not None and (name := bare.group(2).lower()) not in _RAW_TEXT:  # most tags have no attributes
            if since < lt:
                yield text(lt)
            at = since = bare.end()
            yield ("end", name) if bare.group(1) else ("start", name, {})
            continue
        tag = _TAG.match(source, lt)
        if tag is None:
            nxt = source[lt + 1 : lt + 2]
            if nxt not in ("!", "?", "/") or (nxt == "/" and lt + 2 >= size):
                at = lt + 1  # a lone sign is text
                continue
            if since < lt:
                yield text(lt)
            if source.startswith("<!--", lt):
                close = source.find("-->", lt + 4)
                if source.startswith("<!-->", lt) or source.startswith("<!--->", lt):
                    at = source.find(">", lt) + 1
                else:
                    at = size if close < 0 else close + 3
                yield ("comment",)
            else:
                close = source.find(">", lt)
                at = size if close < 0 else close + 1
                if not source[lt : lt + 9].lower().startswith("<!doctype") and not source.startswith("</>", lt):
                    yield ("comment",)
            since = at
            continue
        if since < lt:
            yield text(lt)
        name, pos, attrs = tag.group(2).lower(), tag.end(), {}
        while True:
            done = _END.match(source, pos)
            if done:
                pos = done.end()
                break
            attr = _ATTR.match(source, pos)
            if attr is None or attr.end() == pos:
                pos = size  # an unfinished tag swallows the rest
                name = ""
                break
            pos = attr.end()
            key = attr.group(1).lower()
            if key not in attrs:
                value = next((g for g in attr.group(2, 3, 4) if g is not None), "")
                attrs[key] = _attribute(value)
        at = since = pos
        if not name:
            break
        if tag.group(1):
            yield ("end", name)
            continue
        yield ("start", name, attrs)
        if name in RAW or name in ESCAPABLE or name == "plaintext":
            close = None if name == "plaintext" else re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            end = close.start() if close else size
            if at < end:
                value = source[at:end]
                yield ("text", html.unescape(value) if name in ESCAPABLE else value, at, end)
            at = since = end
    if since < size:
        yield text(size)


class _Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.active: list[Node | None] = []  # None is a marker
        self.head: Node | None = None
        self.mode = self.before_head
        self.back = None
        self.foster = False
        self.form: Node | None = None

    # places

    @property
    def current(self) -> Node:
        return self.stack[-1]

    def _place(self) -> tuple[Node, int | None]:
        """Where the next node goes: a parent, and an index if not at its end."""
        target = self.current
        if self.foster and target.name in ("table", "tbody", "tfoot", "thead", "tr"):
            table = next((n for n in reversed(self.stack) if n.name == "table"), None)
            if table is None:
                return self.stack[0], None
            if table.parent is not None:
                return table.parent, table.parent.children.index(table)
            return self.stack[self.stack.index(table) - 1], None
        return target, None

    def put(self, node: Node | Text | Comment) -> None:
        parent, index = self._place()
        if index is None:
            parent.append(node)
        else:
            node.parent = parent
            parent.children.insert(index, node)

    def text(self, token: tuple) -> None:
        self.put(Text(token[1], token[2], token[3]))

    def element(self, name: str, attrs: dict[str, str]) -> Node:
        node = Node(name, attrs)
        self.put(node)
        self.stack.append(node)
        return node

    def in_scope(self, names, extra: frozenset = frozenset()) -> bool:
        for node in reversed(self.stack):
            if node.name in names:
                return True
            if node.name in SCOPE_STOP or node.name in extra:
                return False
        return False

    def in_table_scope(self, names) -> bool:
        for node in reversed(self.stack):
            if node.name in names:
                return True
            if node.name in ("html", "table", "template"):
                return False
        return False

    def pop_until(self, names) -> None:
        while len(self.stack) > 1:
            if self.stack.pop().name in names:
                return

    def implied_ends(self, but: str = "") -> None:
        while self.current.name in IMPLIED_END and self.current.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        self.implied_ends("p")
        self.pop_until(("p",))

    def p_in_button_scope(self) -> bool:
        return self.in_scope(("p",), frozenset(("button",)))

    # formatting elements

    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.element(old.name, dict(old.attrs))

    def push_active(self, node: Node) -> None:
        same = []
        for other in reversed(self.active):
            if other is None:
                break
            if other.name == node.name and other.attrs == node.attrs:
                same.append(other)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(node)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, name: str) -> None:
        """The adoption agency for an end tag of a formatting element."""
        if self.current.name == name and self.current not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            at = next((i for i in range(len(self.active) - 1, -1, -1) if self.active[i] is None or self.active[i].name == name), None)
            if at is None or self.active[at] is None:
                self.any_end(name)
                return
            formatting = self.active[at]
            if formatting not in self.stack:
                del self.active[at]
                return
            if not any(n is formatting for n in self._scope_nodes()):
                return
            depth = self.stack.index(formatting)
            furthest = next((n for n in self.stack[depth + 1 :] if n.name in SPECIAL), None)
            if furthest is None:
                del self.stack[depth:]
                del self.active[at]
                return
            ancestor, bookmark = self.stack[depth - 1], at
            last, place = furthest, self.stack.index(furthest)
            inner = 0
            while True:
                inner += 1
                place -= 1
                node = self.stack[place]
                if node is formatting:
                    break
                if inner > 3 and node in self.active:
                    k = self.active.index(node)
                    del self.active[k]
                    bookmark -= k < bookmark
                if node not in self.active:
                    del self.stack[place]
                    continue
                fresh = Node(node.name, dict(node.attrs))
                self.active[self.active.index(node)] = fresh
                self.stack[place] = fresh
                if last is furthest:
                    bookmark = self.active.index(fresh) + 1
                self._move(last, fresh)
                last = fresh
            self._detach(last)
            if ancestor.name in ("table", "tbody", "tfoot", "thead", "tr"):
                keep, self.foster = self.foster, True
                saved = self.stack
                self.stack = self.stack[: self.stack.index(ancestor) + 1]
                self.put(last)
                self.stack, self.foster = saved, keep
            else:
                ancestor.append(last)
            fresh = Node(formatting.name, dict(formatting.attrs))
            for child in furthest.children:
                fresh.append(child)
            furthest.children = []
            furthest.append(fresh)
            k = self.active.index(formatting)
            del self.active[k]
            self.active.insert(bookmark - (k < bookmark), fresh)
            self.stack.remove(formatting)
            self.stack.insert(self.stack.index(furthest) + 1, fresh)

    def _scope_nodes(self) -> Iterator[Node]:
        for node in reversed(self.stack):
            yield node
            if node.name in SCOPE_STOP:
                return

    @staticmethod
    def _detach(node: Node) -> None:
        if node.parent is not None:
            node.parent.children = [c for c in node.parent.children if c is not node]
            node.parent = None

    def _move(self, node: Node, to: Node) -> None:
        self._detach(node)
        to.append(node)

    def any_end(self, name: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            node = self.stack[k]
            if node.name == name:
                self.implied_ends(name)
                k = next((j for j in range(len(self.stack) - 1, -1, -1) if self.stack[j] is node), None)
                if k:
                    del self.stack[k:]
                return
            if node.name in SPECIAL:
                return

    # modes: each takes a token and gives True if it is to be taken again

    def before_head(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text" and not token[1].strip(" \t\n\f\r"):
            return False
        if kind == "comment":
            self.put(Comment())
            return False
        if kind == "start" and token[1] == "html":
            self._merge(self.root, token[2])
            return False
        if kind == "end" and token[1] not in ("head", "body", "html", "br"):
            return False
        given = kind == "start" and token[1] == "head"
        self.head = self.element("head", token[2] if given else {})
        self.mode = self.in_head
        return not given

    @staticmethod
    def _merge(node: Node, attrs: dict[str, str]) -> None:
        for k, v in attrs.items():
            node.attrs.setdefault(k, v)

    def in_head(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "comment":
            self.put(Comment())
            return False
        if kind == "text":
            blank = _BLANK.match(token[1]).end()
            if blank == len(token[1]) or self.current.name in RAW or self.current.name in ESCAPABLE:
                self.text(token)
                return False
        if kind == "start":
            name = token[1]
            if name == "html":
                self._merge(self.root, token[2])
                return False
            if name in IN_HEAD:
                self._open_head(name, token[2])
                return False
            if name == "head":
                return False
        if kind == "end":
            if token[1] == "head":
                self.stack = [self.root]
                self.mode = self.after_head
                return False
            if token[1] in RAW or token[1] in ESCAPABLE or token[1] == "template":
                self.any_end(token[1])
                return False
            if token[1] not in ("body", "html", "br"):
                return False
        self.stack = [self.root]
        self.mode = self.after_head
        return True

    def _open_head(self, name: str, attrs: dict[str, str]) -> None:
        self.element(name, attrs)
        if name in VOID:
            self.stack.pop()

    def after_head(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "comment":
            self.put(Comment())
            return False
        if kind == "text":
            if self.current.name in RAW or self.current.name in ESCAPABLE:
                self.text(token)
                return False
            if not token[1].strip(" \t\n\f\r"):
                self.text(token)
                return False
        if kind == "start":
            name = token[1]
            if name == "html":
                self._merge(self.root, token[2])
                return False
            if name == "body":
                self.element("body", token[2])
                self.mode = self.in_body
                return False
            if name in IN_HEAD:
                self.stack.append(self.head)
                self._open_head(name, token[2])
                self.stack.remove(self.head)
                return False
            if name == "head":
                return False
        if kind == "end":
            if token[1] in RAW or token[1] in ESCAPABLE or token[1] == "template":
                if self.current.name == token[1]:
                    self.stack.pop()
                return False
            if token[1] not in ("body", "html", "br"):
                return False
        self.stack = [self.root]
        self.element("body", {})
        self.mode = self.in_body
        return True

    def in_body(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text":
            if self.current.name in RAW or self.current.name in ESCAPABLE:
                self.text(token)
                return False
            self.reconstruct()
            self.text(token)
        elif kind == "comment":
            self.put(Comment())
        elif kind == "start":
            self.start_in_body(token[1], token[2])
        else:
            return self.end_in_body(token[1])
        return False

    def start_in_body(self, name: str, attrs: dict[str, str]) -> None:
        if name == "html":
            self._merge(self.root, attrs)
        elif name == "body":
            if len(self.stack) > 1 and self.stack[1].name == "body":
                self._merge(self.stack[1], attrs)
        elif name in IN_HEAD:
            self._open_head(name, attrs)
        elif name in TABLE_PARTS or name in ("head", "frame", "frameset"):
            return
        elif name in CLOSES_P:
            self._start_block(name, attrs)
        elif name == "li" or name in ("dd", "dt"):
            self._start_item(name, attrs)
        elif name == "button":
            if self.in_scope(("button",)):
                self.implied_ends()
                self.pop_until(("button",))
            self.reconstruct()
            self.element(name, attrs)
        elif name in FORMATTING:
            self._start_formatting(name, attrs)
        elif name in MARKED:
            self.reconstruct()
            self.element(name, attrs)
            self.active.append(None)
        elif name in ("param", "source", "track"):
            self.element(name, attrs)
            self.stack.pop()
        elif name in VOID or name == "image":
            self.reconstruct()
            self.element("img" if name == "image" else name, attrs)
            self.stack.pop()
        elif name in ("textarea", "iframe", "noembed"):
            self.element(name, attrs)
        elif name == "select":
            self.reconstruct()
            self.element(name, attrs)
            self.back, self.mode = self.mode, self.in_select
        elif name in ("optgroup", "option"):
            if self.current.name == "option":
                self.stack.pop()
            self.reconstruct()
            self.element(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.in_scope(("ruby",)):
                self.implied_ends("" if name in ("rb", "rtc") else "rtc")
            self.element(name, attrs)
        else:
            self.reconstruct()
            self.element(name, attrs)

    def _start_block(self, name: str, attrs: dict[str, str]) -> None:
        if name == "form" and self.form is not None:
            return
        if self.p_in_button_scope():
            self.close_p()
        if name in HEADINGS and self.current.name in HEADINGS:
            self.stack.pop()
        node = self.element(name, attrs)
        if name == "form":
            self.form = node
        elif name == "hr":
            self.stack.pop()
        elif name == "table":
            self.mode = self.in_table

    def _start_item(self, name: str, attrs: dict[str, str]) -> None:
        closes = ("li",) if name == "li" else ("dd", "dt")
        for node in reversed(self.stack):
            if node.name in closes:
                self.implied_ends(node.name)
                self.pop_until((node.name,))
                break
            if node.name in SPECIAL and node.name not in ("address", "div", "p"):
                break
        if self.p_in_button_scope():
            self.close_p()
        self.element(name, attrs)

    def _start_formatting(self, name: str, attrs: dict[str, str]) -> None:
        if name == "a":
            since = []
            for node in reversed(self.active):
                if node is None:
                    break
                since.append(node)
            old = next((n for n in since if n.name == "a"), None)
            if old is not None:
                self.adopt("a")
                if old in self.active:
                    self.active.remove(old)
                if old in self.stack:
                    self.stack.remove(old)
        self.reconstruct()
        if name == "nobr" and self.in_scope(("nobr",)):
            self.adopt("nobr")
            self.reconstruct()
        self.push_active(self.element(name, attrs))

    def end_in_body(self, name: str) -> bool:
        if name in ("body", "html"):
            if self.in_scope(("body",)):
                self.mode = self.after_body
                return name == "html"
        elif name in RAW or name in ESCAPABLE:
            if self.current.name == name:
                self.stack.pop()
        elif name in BLOCK_END:
            if self.in_scope((name,)):
                self.implied_ends()
                self.pop_until((name,))
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and node in self.stack:
                self.implied_ends()
                self.stack.remove(node)
        elif name == "p":
            if not self.p_in_button_scope():
                self.element("p", {})
            self.close_p()
        elif name == "li":
            if self.in_scope(("li",), frozenset(("ol", "ul"))):
                self.implied_ends("li")
                self.pop_until(("li",))
        elif name in ("dd", "dt"):
            if self.in_scope((name,)):
                self.implied_ends(name)
                self.pop_until((name,))
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied_ends()
                self.pop_until(HEADINGS)
        elif name in FORMATTING:
            self.adopt(name)
        elif name in MARKED:
            if self.in_scope((name,)):
                self.implied_ends()
                self.pop_until((name,))
                self.clear_active()
        elif name == "br":
            self.reconstruct()
            self.element("br", {})
            self.stack.pop()
        else:
            self.any_end(name)
        return False

    def _clear_to(self, names) -> None:
        while self.current.name not in names and len(self.stack) > 1:
            self.stack.pop()

    def in_table(self, token: tuple) -> bool:
        kind = token[0]
        if self.current.name in RAW or self.current.name in ESCAPABLE:
            return self.in_body(token)
        if kind == "text":
            if not token[1].strip(" \t\n\f\r") and self.current.name in ("table", "tbody", "tfoot", "thead", "tr"):
                self.text(token)
                return False
        elif kind == "comment":
            self.put(Comment())
            return False
        elif kind == "start":
            name = token[1]
            if name == "caption":
                self._clear_to(("table", "html"))
                self.active.append(None)
                self.element(name, token[2])
                self.mode = self.in_caption
                return False
            if name == "colgroup" or name == "col":
                self._clear_to(("table", "html"))
                self.element("colgroup", token[2] if name == "colgroup" else {})
                self.mode = self.in_colgroup
                return name == "col"
            if name in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                self._clear_to(("table", "html"))
                given = name in ("tbody", "tfoot", "thead")
                self.element(name if given else "tbody", token[2] if given else {})
                self.mode = self.in_tbody
                return not given
            if name == "table":
                if self.in_table_scope(("table",)):
                    self.pop_until(("table",))
                    self.reset()
                    return True
                return False
            if name in ("style", "script", "template"):
                self._open_head(name, token[2])
                return False
            if name == "input" and token[2].get("type", "").lower() == "hidden":
                self.element(name, token[2])
                self.stack.pop()
                return False
            if name == "form":
                if self.form is None:
                    self.form = self.element(name, token[2])
                    self.stack.pop()
                return False
        elif token[1] == "table":
            if self.in_table_scope(("table",)):
                self.pop_until(("table",))
                self.reset()
            return False
        elif token[1] in TABLE_PARTS or token[1] in ("body", "html"):
            return False
        self.foster = True
        again = self.in_body(token)
        self.foster = False
        return again

    def in_caption(self, token: tuple) -> bool:
        ends = token[0] == "end" and token[1] in ("caption", "table")
        if ends or (token[0] == "start" and token[1] in TABLE_PARTS):
            if self.in_table_scope(("caption",)):
                self.implied_ends()
                self.pop_until(("caption",))
                self.clear_active()
                self.mode = self.in_table
                return not (ends and token[1] == "caption")
            return False
        if token[0] == "end" and token[1] in TABLE_PARTS | {"body", "html"}:
            return False
        return self.in_body(token)

    def in_colgroup(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text" and not token[1].strip(" \t\n\f\r"):
            self.text(token)
            return False
        if kind == "comment":
            self.put(Comment())
            return False
        if kind == "start" and token[1] == "col":
            self.element("col", token[2])
            self.stack.pop()
            return False
        if kind == "end" and token[1] == "col":
            return False
        if self.current.name != "colgroup":
            return False
        self.stack.pop()
        self.mode = self.in_table
        return not (kind == "end" and token[1] == "colgroup")

    def in_tbody(self, token: tuple) -> bool:
        groups = ("tbody", "tfoot", "thead")
        if token[0] == "start":
            if token[1] in ("tr", "td", "th"):
                self._clear_to((*groups, "html"))
                self.element("tr", token[2] if token[1] == "tr" else {})
                self.mode = self.in_row
                return token[1] != "tr"
            if token[1] in ("caption", "col", "colgroup", *groups):
                return self._leave_group(groups, True)
        elif token[0] == "end":
            if token[1] in groups:
                if self.in_table_scope((token[1],)):
                    self._clear_to((*groups, "html"))
                    self.stack.pop()
                    self.mode = self.in_table
                return False
            if token[1] == "table":
                return self._leave_group(groups, True)
            if token[1] in TABLE_PARTS or token[1] in ("body", "html"):
                return False
        return self.in_table(token)

    def _leave_group(self, groups, again: bool) -> bool:
        if not self.in_table_scope(groups):
            return False
        self._clear_to((*groups, "html"))
        self.stack.pop()
        self.mode = self.in_table
        return again

    def in_row(self, token: tuple) -> bool:
        if token[0] == "start":
            if token[1] in ("td", "th"):
                self._clear_to(("tr", "html"))
                self.element(token[1], token[2])
                self.mode = self.in_cell
                self.active.append(None)
                return False
            if token[1] in TABLE_PARTS:
                return self._leave_row(True)
        elif token[0] == "end":
            if token[1] == "tr":
                return self._leave_row(False)
            if token[1] == "table":
                return self._leave_row(True)
            if token[1] in ("tbody", "tfoot", "thead"):
                return self._leave_row(True) if self.in_table_scope((token[1],)) else False
            if token[1] in TABLE_PARTS or token[1] in ("body", "html"):
                return False
        return self.in_table(token)

    def _leave_row(self, again: bool) -> bool:
        if not self.in_table_scope(("tr",)):
            return False
        self._clear_to(("tr", "html"))
        self.stack.pop()
        self.mode = self.in_tbody
        return again

    def _close_cell(self) -> None:
        self.implied_ends()
        self.pop_until(("td", "th"))
        self.clear_active()
        self.mode = self.in_row

    def in_cell(self, token: tuple) -> bool:
        if token[0] == "end":
            if token[1] in ("td", "th"):
                if self.in_table_scope((token[1],)):
                    self._close_cell()
                return False
            if token[1] in ("body", "caption", "col", "colgroup", "html"):
                return False
            if token[1] in ("table", "tbody", "tfoot", "thead", "tr"):
                if self.in_table_scope((token[1],)):
                    self._close_cell()
                    return True
                return False
        elif token[0] == "start" and token[1] in TABLE_PARTS:
            if self.in_table_scope(("td", "th")):
                self._close_cell()
                return True
            return False
        return self.in_body(token)

    def in_select(self, token: tuple) -> bool:
        kind = token[0]
        if kind == "text":
            self.text(token)
        elif kind == "comment":
            self.put(Comment())
        elif kind == "start":
            if token[1] in ("option", "optgroup"):
                if self.current.name == "option":
                    self.stack.pop()
                if token[1] == "optgroup" and self.current.name == "optgroup":
                    self.stack.pop()
                self.element(token[1], token[2])
            elif token[1] in ("select", "input", "keygen", "textarea") or token[1] in TABLE_PARTS or token[1] == "table":
                self.pop_until(("select",))
                self.reset()
                return token[1] != "select"
            elif token[1] in ("script", "template"):
                self._open_head(token[1], token[2])
        elif token[1] == "select":
            self.pop_until(("select",))
            self.reset()
        elif token[1] in ("option", "optgroup", "script", "template"):
            if token[1] == "optgroup" and self.current.name == "option":
                self.stack.pop()
            if self.current.name == token[1]:
                self.stack.pop()
        return False

    def after_body(self, token: tuple) -> bool:
        if token[0] == "comment":
            self.root.append(Comment())
            return False
        if token[0] == "end" and token[1] == "html":
            return False
        if token[0] == "text" and not token[1].strip(" \t\n\f\r"):
            return self.in_body(token)
        if token[0] == "start" and token[1] == "html":
            return self.in_body(token)
        self.mode = self.in_body
        return True

    def reset(self) -> None:
        """The mode that the open elements call for."""
        for node in reversed(self.stack):
            mode = {
                "td": self.in_cell, "th": self.in_cell, "tr": self.in_row, "tbody": self.in_tbody, "thead": self.in_tbody, "tfoot": self.in_tbody,
                "caption": self.in_caption, "colgroup": self.in_colgroup, "table": self.in_table, "body": self.in_body, "select": self.in_select,
            }.get(node.name)
            if mode:
                self.mode = mode
                return
        self.mode = self.in_body


def parse(source: str) -> Node:
    """The ``html`` element of a document."""
    b = _Builder()
    for token in tokens(source):
        while b.mode(token):
            pass
    for mode in (b.before_head, b.in_head, b.after_head):  # a document has a head and a body, whatever it lacks
        if b.mode == mode:
            b.mode(("end", "body"))
    return b.root
