"""Made pages for training the page model of problem 1, labelled by how they are made.

Words are syllables drawn at random in several scripts, and layouts vary in
their elements, nesting, class names and order; so the model learns from them
what a body looks like in any language, and nothing of wording.
"""

from __future__ import annotations

import random

_SCRIPTS = [
    ("b d f g h k l m n p r s t v z br st tr".split(), "a e i o u".split()),
    ("b č d ď g h j k ł m ń p ř s š t w ż".split(), "a ą e ě i o ó u y".split()),
    ("h j k l m n p r s t v".split(), "a aa e i ii o u ä ää ö y".split()),
    ("б в г д ж з к л м н п р с т ч ш".split(), "а е и о у ы я".split()),
    ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε η ι ο υ ω".split()),
]
#: Usual names of parts of pages; half of the pages have meaningless ones instead.
_CLASSES = {
    "body": "content main post story text entry article page-body copy".split(),
    "top": "top menu nav header topbar bar site-head links".split(),
    "side": "side sidebar related more box widget rail also".split(),
    "foot": "foot footer bottom legal base credits".split(),
    "note": "notice banner cookie consent alert".split(),
    "tool": "share tools meta byline info social".split(),
}


class _Maker:
    def __init__(self, r: random.Random):
        self.r = r
        self.lines: list[tuple[str, bool]] = []
        self.consonants, self.vowels = r.choice(_SCRIPTS)
        self.plain = r.random() < 0.5
        self.short = [self.word(1) for _ in range(12)]

    def word(self, syllables: int | None = None) -> str:
        n = syllables or self.r.choices((1, 2, 3, 4), (2, 5, 4, 1))[0]
        w = "".join(self.r.choice(self.consonants) + self.r.choice(self.vowels) for _ in range(n))
        return w[: self.r.randint(1, 3)] if syllables == 1 else w

    def phrase(self, low: int, high: int) -> str:
        words = [self.r.choice(self.short) if self.r.random() < 0.3 else self.word() for _ in range(self.r.randint(low, high))]
        words = [w.capitalize() if self.r.random() < 0.12 else w for w in words]
        return (words[0].capitalize() + " " + " ".join(words[1:])).strip()

    def sentence(self) -> str:
        s = self.phrase(7, 24)
        words = s.split(" ")
        for _ in range(self.r.randint(0, 2)):
            k = self.r.randrange(len(words) - 1)
            words[k] = words[k].rstrip(",") + ","
        if self.r.random() < 0.15:
            words.insert(self.r.randrange(1, len(words)), str(self.r.randint(3, 2_030)))
        return " ".join(words) + self.r.choices((".", "!", "?"), (18, 1, 1))[0]

    def prose(self, most: int = 4) -> str:
        s = [self.sentence() for _ in range(self.r.randint(1, most))]
        text = " ".join(s)
        if self.r.random() < 0.2:  # a link or stress within
            w = text.split(" ")
            k = self.r.randrange(len(w))
            w[k] = f'<a href="/{k}">{w[k]}</a>' if self.r.random() < 0.6 else f"<b>{w[k]}</b>"
            text = " ".join(w)
        return text

    def name(self, part: str) -> str:
        if self.plain:
            return f' class="{self.r.choice(_CLASSES[part])}"'
        return self.r.choice(["", f' class="{"".join(self.r.choices("abcdefghxyz", k=self.r.randint(2, 5)))}{self.r.randint(1, 99)}"'])

    def put(self, text: str, body: bool = False) -> None:
        self.lines.append((text, body))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.phrase(low, high)}</a>'

    def menu(self, part: str, tag: str) -> None:
        self.put(f"<{tag}{self.name(part)}>")
        n = self.r.randint(3, 9)
        how = self.r.random()
        if self.r.random() < 0.3:
            self.put(f"<div>{self.link()}</div>")
        if how < 0.5:
            self.put("<ul>")
            for _ in range(n):
                self.put(f"<li>{self.link()}</li>")
            self.put("</ul>")
        elif how < 0.8:
            self.put(self.r.choice((" ", " | ", " - ", " &gt; ", " / ")).join(self.link() for _ in range(n)))
        else:
            for _ in range(n):
                self.put(self.link() + self.r.choice(("", "<br>")))
        self.put(f"</{tag}>")

    def box(self) -> None:
        tag = self.r.choice(("aside", "div", "section", "div"))
        self.put(f"<{tag}{self.name('side')}>")
        head = self.r.choice(("h2", "h3", "h4", "b", "strong", "p", "div"))
        self.put(f"<{head}>{self.phrase(1, 4)}</{head}>")
        listed = self.r.random() < 0.6
        if listed:
            self.put("<ul>")
        for _ in range(self.r.randint(2, 7)):
            self.put(f"<li>{self.link(2, 7)}</li>" if listed else f"{self.link(2, 7)}<br>" if self.r.random() < 0.5 else f"<div>{self.link(2, 7)}</div>")
        if listed:
            self.put("</ul>")
        self.put(f"</{tag}>")

    def notice(self) -> None:
        self.put(f"<div{self.name('note')}>")
        self.put(f"<{(tag := self.r.choice(('p', 'span', 'div')))}>{self.prose(2)}</{tag}>")
        for _ in range(self.r.randint(1, 3)):
            self.put(f"<button>{self.phrase(1, 3)}</button>" if self.r.random() < 0.7 else self.link())
        self.put("</div>")

    def tools(self) -> None:
        tag = self.r.choice(("div", "p", "span", "ul"))
        if tag == "ul":
            self.put("<ul>" + "".join(f"<li>{self.link(1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
        elif self.r.random() < 0.5:
            self.put(f"<{tag}{self.name('tool')}>{self.phrase(2, 5)}, {self.r.randint(1, 31)}.{self.r.randint(1, 12)}.{self.r.randint(1_990, 2_030)}</{tag}>")
        else:
            self.put(f"<{tag}{self.name('tool')}>" + " ".join(f"<button>{self.phrase(1, 2)}</button>" if self.r.random() < 0.4 else self.link(1, 2) for _ in range(self.r.randint(1, 5))) + f"</{tag}>")

    def content(self) -> None:
        tags = [self.r.choice(("article", "main", "section", "div", "div"))] + ["div"] * self.r.randint(0, 2)
        for t in tags:
            self.put(f"<{t}{self.name('body')}>")
        self.put(f"<h1>{self.phrase(2, 8)}</h1>", True)
        if self.r.random() < 0.4:
            self.tools()
        prose = self.r.choices(("p", "div", "br"), (8, 2, 1))[0]
        n = self.r.choices((2, 3, 4, 6, 9, 14), (3, 3, 3, 2, 1, 1))[0]
        for k in range(n):
            at = self.r.random()
            if k and at < 0.12:
                h = self.r.choice(("h2", "h3", "h2"))
                self.put(f"<{h}>{self.phrase(1, 6)}</{h}>", True)
            elif k and at < 0.18:
                self.put(f"<blockquote>{self.sentence()}</blockquote>", True)
            elif k and at < 0.24:
                self.put("<ul>")
                for _ in range(self.r.randint(2, 6)):
                    self.put(f"<li>{self.phrase(3, 12)}{self.r.choice(('.', ''))}</li>", True)
                self.put("</ul>")
            elif k and at < 0.27:
                self.box()
            elif k and at < 0.29:
                self.tools()
            text = self.prose()
            if prose == "br":
                self.put(text + "<br><br>", True)
            elif self.r.random() < 0.1 and " " in text:  # over two lines
                a, _, b = text.partition(". ")
                self.put(f"<{prose}>{a}.", True)
                self.put(f"{b or self.sentence()}</{prose}>", True)
            else:
                self.put(f"<{prose}>{text}</{prose}>", True)
        if self.r.random() < 0.3:
            self.tools()
        for t in reversed(tags):
            self.put(f"</{t}>")

    def foot(self) -> None:
        tag = self.r.choice(("footer", "div", "footer"))
        self.put(f"<{tag}{self.name('foot')}>")
        if self.r.random() < 0.6:
            inner = self.r.choice(("p", "small", "div"))
            self.put(f"<{inner}>{self.r.choice(('© ', '', ''))}{self.phrase(2, 7)} {self.r.choice(('', str(self.r.randint(1_999, 2_030))))}{self.r.choice(('', '.'))}</{inner}>")
        if self.r.random() < 0.6:
            self.put(self.r.choice((" | ", " - ", " ", "<br>")).join(self.link() if self.r.random() < 0.6 else self.phrase(1, 3) for _ in range(self.r.randint(2, 6))))
        self.put(f"</{tag}>")

    def page(self) -> tuple[str, set[int]]:
        self.put(f"<html><head><title>{self.phrase(2, 6)}</title></head><body>")
        if self.r.random() < 0.3:
            self.notice()
        wrapped = self.r.random() < 0.4
        if wrapped:
            self.put("<div>")
        if self.r.random() < 0.9:
            tag = self.r.choice(("nav", "header", "div", "div"))
            self.menu("top", tag)
        if self.r.random() < 0.2:
            self.put(f"<div{self.name('top')}>" + self.r.choice((" &gt; ", " / ", " » ")).join(self.link() for _ in range(self.r.randint(2, 4))) + "</div>")
        if self.r.random() < 0.2:
            self.box()
        self.content()
        for _ in range(self.r.choices((0, 1, 2), (3, 4, 1))[0]):
            self.box()
        if self.r.random() < 0.9:
            self.foot()
        if self.r.random() < 0.15:
            self.notice()
        if wrapped:
            self.put("</div>")
        self.put("</body></html>")
        return "\n".join(t for t, _ in self.lines), {k for k, (_, body) in enumerate(self.lines) if body}


def made_pages(n: int, seed: int = 7) -> list[tuple[str, set[int]]]:
    """Pages and the numbers of the lines of their bodies."""
    r = random.Random(seed)
    return [_Maker(random.Random(r.random())).page() for _ in range(n)]
