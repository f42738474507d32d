"""Problem 4: template residue and error-page text.

Fields.  A field is a name set off by signs, or a name no word of prose looks
like.  Texts of the same template are aligned by the words around a field: they
are a frame, and other sentences show what stands in that frame, be it one word
or many.  Where they have ordinary words, the frame is a slot and the field in
it was not filled.  A frame that holds a field nearly whenever it occurs, in
several distinct sentences, belongs to sentences that describe fields.  Slots
also teach which notations are those of fields: a field that stands alone, or
in a frame of its own, counts if its notation was left in several slots.

Error pages.  The lines repeated on a host are set aside.  Of the pages of
which little is left, the whole lines are aligned across hosts: a line that
comes back on pages of several hosts with other lines around it, or as all of
the page, but for its numbers, addresses, codes and at most one word, is a
template of error pages.  A page is a case if all its lines but a title are
such templates.

Filler.  A text without a title is filler if few words come back again and
again and yet never in the same order, as in text drawn at random: this needs
no words of any language, and prose of any language isn't like that.

Phrases and notations of the usual kind support this where a table is too small
to show templates; ``support=False`` leaves them out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.llm.common import cut, maybe_broadcast, table
from nearpress.llm.sitelines import MIN_DOCS, MIN_SHARE, hashed_lines, looked_up, often_lines, placed_texts

#: Distinct sentences with a field from which a frame is aligned, and from which
#: it can be judged to describe fields; the share of its sentences that must hold
#: a field for that.
ALIGNED_SENTENCES = 2
DESCRIBED_SENTENCES = 3
DESCRIBED_SHARE = 0.9
#: Slots and texts in which a notation has to be left to be known as one of fields.
NOTATION_SLOTS = 2
NOTATION_TEXTS = 3
#: Least and most bits of the filter of frames, and bits for each frame; a hit is checked exactly.
FILTER_BITS = 1 << 22
MOST_FILTER_BITS = 1 << 27
BITS_A_FRAME = 64
SLICE_BYTES = 4_000_000

#: Words a page may have left to be aligned as a whole page, words of a line of it, and of a title.
PAGE_WORDS = 60
LINE_WORDS = 25
TITLE_WORDS = 7
#: Pages that must share a line for it to be a template; they are of two hosts at least.
TEMPLATE_PAGES = 3
#: Words of a line from which one of them may differ between the pages, and up to which that is looked for.
SLOT_WORDS = (4, 15)
#: Share of a host's texts from which a line is a rare line of the site, and words
#: of such lines up to which they are set aside in a text.
RARE_SHARE = 0.01
RARE_WORDS = 20
#: Words and distinct words from which the order of a text is judged; distinct words by the root
#: of all words, and distinct pairs of neighbours by those of a random order, within which it is filler.
FILLER_WORDS = 20
FILLER_DISTINCT = 8
FILLER_RICHNESS = ((3.85, 0.9), (4.4, 0.98))

_NAME = r"[A-Za-z][\w.\-]*(?: [A-Za-z][\w.\-]*){0,3}"
#: A name set off by two signs or a brace on either side, or by one other sign if it is no plain word.
_ENCLOSED = r"(?:[$#%@]?\{{1,3}|<%|\{%|\[\[|%%|@@|__|%\()[=\-#/^&!>]? ?" + _NAME + r" ?-?(?:\}{1,3}|%>|%\}|\]\]|%%|@@|__|\)[sdf]\b)"
_BRACKETED = r"\[" + _NAME.replace("{0,3}", "{1,3}") + r"\]|\[[A-Z][A-Z_]+\]|<[a-z]+(?:[ _][a-z]+)*>"
_BARE = r"\b[A-Z][A-Z]*(?:_[A-Z]+)+\b|\b[A-Z]{3,}: ?[a-z]+(?: (?:name|title|date|count))?|\b[a-z]+(?:_[a-z]+)+\b"
#: Blanks and defaults: only where the frame itself is a slot.
_BLANK = r"_{3,}|(?<!\S)N/A(?!\w)|(?<!\S)\{\d\}|(?<!\S)%[sd]\b|(?<!\S)undefined(?!\w)"
FIELD = re.compile("|".join((_ENCLOSED, _BRACKETED, _BARE, _BLANK)))
_MAY_HAVE = re.compile(r"[{\[<%@_]|[A-Z]{3}: ?[a-z]|N/A|undefined")
_IS_BLANK = re.compile(_BLANK)
_TOKEN = "␟"

#: Notations of fields which support those that slots teach.
FIELD_NOTATIONS = re.compile(
    r"\{\{\{?[#/^&!>]? ?" + _NAME + r" ?\}\}\}?|<%[=\-]? ?" + _NAME + r" ?-?%>|\{%[=\-]? ?" + _NAME + r" ?-?%\}|[$#]\{ ?" + _NAME + r" ?\}|%\(" + _NAME + r"\)[sdf]|"
    r"%%" + _NAME + r"%%|@@" + _NAME + r"@@|\[\[ ?" + _NAME + r" ?\]\]|__[A-Za-z][A-Za-z_]*[A-Za-z]__|\[(?:[Ii]nsert|[Yy]our|INSERT|YOUR|[Ee]nter|[Aa]dd) [^\]\n]{1,40}\]|"
    r"<(?:first|last|your|site|page|item|author|release|user|company|insert)[ _]?[a-z_]* ?[a-z_]*>|<(?:city|price|summary|section|name|date|author|email|country)>|"
    r"\{[A-Za-z_][A-Za-z_.]{1,40}\}|TODO: ?[a-z]+(?: (?:name|title|date|count))?|[A-Z][A-Z_]*_GOES_HERE")  # fmt: skip

#: Words by which a sentence speaks of templates, in a frame that is too rare to be judged.
DESCRIBES = re.compile(
    r"\b(?:placeholders?|templat\w*|syntax|variables?|manual|guide|notes?|documentation|merge fields?|curly|brackets?|tutorial|tokens? like|literal(?:ly)?|"
    r"modèle|manuel|syntaxe|platzhalter|vorlage|handbuch|plantilla|marcador|шаблон\w*|справочник\w*)\b", re.I)  # fmt: skip

_NOUN = r"(?:page|document|file|story|item|article|listing|video|resource|address|content|site|fiche|seite|adresse|página|dirección|страница|адрес)"
#: Whole sentences and heads of error pages which support the templates found.
MESSAGE = re.compile(
    r"^(?:(?:http|error|erreur|fehler|ошибка|status|code)\W? ?)*[45]\d\d\b.{0,40}$|^(?:http )?(?:error|erreur|fehler|ошибка|status)(?: code)? ?\d+\b|"
    r"^" + _NOUN + r" (?:not found|introuvable|nicht gefunden|no encontrad[ao]|no disponible|не найдена?)\b|^not found\b|\bpage (?:introuvable|a disparu)\b|"
    r"\b(?:cannot|can't|could not|couldn't) find (?:that|this|the) " + _NOUN + r"\b|\b" + _NOUN + r" you (?:asked for|requested|are looking for)\b|"
    r"^(?:the|la|die|das|le)? ?(?:requested )?" + _NOUN + r" /\S* (?:does not exist|was not found|n'existe pas|gibt es nicht|no existe|не найдена?)|\bthis " + _NOUN + r" is no longer (?:available|here)\b|"
    r"^(?:адрес|страница) \S+ не найден|"
    r"^(?:access|permission) (?:denied|refused|forbidden)\b|^accès (?:refusé|interdit)\b|^acceso (?:denegado|prohibido)\b|^zugriff (?:verweigert|verboten)\b|^доступ (?:закрыт|запрещ)|"
    r"\byou (?:do not|don't) have permission to (?:open|view|access)\b|^(?:internal server error|bad gateway|bad request|gateway time-?out|service (?:temporarily )?unavailable|down for maintenance)\b|"
    r"^service (?:momentanément|temporairement) indisponible\b|^dienst nicht verfügbar\b|^servicio no disponible\b|^сервис недоступен\b|^database connection failed\b|\bupstream host did not answer\b|"
    r"^too many requests\b|^session expired\b|^log in again to\b|^(?:please )?(?:try again|retry|reload) in \d+|^réessayez dans \d|^inténtalo de nuevo en \d|^bitte in \d+ \w+ erneut versuchen|^повторите (?:через|попытку)|"
    r"^please go back or try\b|^(?:retournez à l'accueil|zurück zur startseite|vuelve (?:al|a la) inicio|вернитесь на главную)|^(?:(?:request )?reference|incident|ray|vorgang|code de suivi|referencia|kennung|folio|код) [0-9a-f]{3,}\b|"
    r"^(?:something went wrong|w?h?oops!?$|sorry!$|oups, cette page|vaya, aquí no hay|hoppla, )|\bour (?:team|staff) has been told\b|^we'?ll be right back|^checking your browser|\b(?:confirm|prove) that you are human\b|"
    r"\b(?:enable|allow|activate|turn on|switch on|need to enable|requires?|without|blocks?) (?:javascript|js|scripts?|scripting)\b|^(?:javascript|js|scripts?|scripting) (?:is|are|seems? to be) (?:disabled|off|blocked)|^noscript: |"
    r"\b(?:activer|activa|habilita|habilite|включите) javascript\b|\bjavascript (?:einschalten|aktivieren)\b|\bbesoin de scripts\b|\bnecesita scripts\b|^ohne skripte\b|^turn (?:them|it) on in your browser|^some parts cannot be shown|"
    r"^loading(?:\.\.\.|…)|^chargement(?: en cours)?(?:\.\.\.|…)|^wird geladen|^cargando(?:\.\.\.|…)|^загрузка(?:\.\.\.|…)|^please wait(?:\.\.\.|…)?$|^if nothing happens, check", re.I)  # fmt: skip

#: Sentences that stand in for text, which support the test of order.
FILLER = re.compile(
    r"^(?:lorem ipsum\b|(?:coming soon|bientôt disponible|demnächst|próximamente|скоро будет)\b.{0,30}$|placeholder (?:text|paragraph)|your (?:text|content) here|(?:text|content) (?:to be added|goes here)|"
    r"(?:sample|dummy) (?:text|content)|to be (?:added|written|announced)\W*$|tbd\W*$|tba\W*$|(?:page )?under construction|en construction|beispieltext|texto de (?:ejemplo|relleno)|texte (?:à venir|d'exemple)|пример текста|"
    r"(?:(?:test|asdf|qwer|qwerty|blah|xxx)\W+)+$)", re.I)  # fmt: skip

_FINAL = re.compile(r"[.!?…:]\W*$")
_WORDY = re.compile(r"\w")
_EDGES = ".,;:!?…\"'“”„«»‘’()[]{}<>|•*·-–—/\\#=+~_@$%&^0123456789"


def _matches(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


# whole pages


def line_key(line: str) -> str:
    """A line without what differs between pages of one template: case, numbers, codes, addresses."""
    line = re.sub(r"(?<!\S)/\S*", "/", " ".join(line.lower().split()))
    return re.sub(r"\d+", "0", re.sub(r"\b(?=[a-f]*\d)[0-9a-f]{6,}\b", "0", line))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def page_units(lines: list[tuple[str, bool, bool]]) -> list[dict]:
    """What a short page is aligned by: a row for each line with its keys.

    ``heads`` and ``tails`` are those of its two parts, wherever it is parted.
    ``lines`` are the lines left with whether they are rare lines of the site
    and whether they can be a title.  ``keys`` are those of the whole line, its
    first the line itself and the others with one word left open; ``parts`` of
    its sentences.  ``beside`` stands for the other lines of the page.
    """
    keys = [line_key(line) for line, _, _ in lines]
    whole = _hash("\n".join(keys))
    out = []
    for (line, rare, title), key in zip(lines, keys):
        words = key.split()
        sentences = [x for x in re.split(r"(?<=[.!?…])\s+", line.strip()) if x]
        slots = [" ".join([*words[:i], "\x1f", *words[i + 1 :]]) for i in range(len(words))] if SLOT_WORDS[0] <= len(words) <= SLOT_WORDS[1] else []
        quoted = any(q in line for q in "[\"“”„«»")
        said = [not quoted and bool(MESSAGE.search(x) or FILLER.search(x)) for x in (" ".join(y.lower().split()) for y in sentences)]
        out.append({
            "keys": [_hash(k) for k in (key, *slots)] if len(words) <= LINE_WORDS else [], "parts": [_hash(line_key(x)) for x in sentences] if len(sentences) > 1 else [],
            "heads": [_hash(" ".join(words[:i])) for i in range(1, len(words))] if len(words) <= LINE_WORDS else [], "tails": [_hash(" ".join(words[i:])) for i in range(1, len(words))] if len(words) <= LINE_WORDS else [],
            "beside": whole ^ _hash(key) if len(keys) > 1 else 0, "alone": len(keys) == 1, "rare": rare, "title": title, "n_words": len(words), "said": said,
        })
    return out


_UNIT = pa.struct([
    ("keys", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64())), ("beside", pa.int64()), ("alone", pa.bool_()), ("rare", pa.bool_()), ("title", pa.bool_()), ("n_words", pa.int32()), ("said", pa.list_(pa.bool_())),
])
_UNIT_SQL = "struct<keys: array<long>, parts: array<long>, heads: array<long>, tails: array<long>, beside: long, alone: boolean, rare: boolean, title: boolean, n_words: int, said: array<boolean>>"


def is_filler(doc: np.ndarray, codes: np.ndarray, n_docs: int) -> np.ndarray:
    """Texts whose words come back without an order; ``codes`` are the words of all texts one after another."""
    n = np.bincount(doc, minlength=n_docs).astype(float)
    distinct = np.bincount(np.unique(doc << 32 | codes) >> 32, minlength=n_docs).astype(float)
    rich = distinct / np.sqrt(np.maximum(n, 1))
    out = (n >= 3) & (distinct * 3 <= n) & (n < FILLER_WORDS)  # a word or two said again and again
    may_be = (n >= FILLER_WORDS) & (distinct >= FILLER_DISTINCT) & (rich <= max(r for r, _ in FILLER_RICHNESS)) & (distinct * 1.35 <= n)
    if may_be.any():
        at = np.flatnonzero(may_be[doc[:-1]] & (doc[1:] == doc[:-1]))
        pairs = np.unique(np.stack([doc[at], codes[at] << 32 | codes[at + 1]]), axis=1)[0]
        different = np.bincount(pairs, minlength=n_docs)
        room = np.maximum(distinct, 1) ** 2
        random = room * -np.expm1(-np.maximum(n - 1, 0) / room)  # distinct pairs in a random order
        for most, order in FILLER_RICHNESS:
            out |= may_be & (rich <= most) & (different >= order * random)
    return out


def _frame(before: str, after: str) -> int:
    return xxhash.xxh3_64_intdigest(before + "\n" + after) >> 1


def _mark(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % MOST_FILTER_BITS


def _bit(before, after, bits: int):
    return (before * 31 + after) % bits


def _beside(words: list[str], at: range) -> str:
    """The next word; a sign that only stands beside the field is passed over."""
    for k in at:
        if _WORDY.search(words[k]) or words[k] == _TOKEN:
            return "" if words[k] == _TOKEN else words[k]
        if _FINAL.search(words[k]):
            break
    return ""


def notation(field: str) -> str:
    """The signs of a field, with what its name looks like in place of the name."""
    inner = re.search(r"[A-Za-z](?:.*[A-Za-z0-9])?", field)
    if inner is None or _IS_BLANK.fullmatch(field):
        return field
    name = inner.group()
    if field[: inner.start()] == "" and ":" in name:  # a word of capitals before a name
        return name.split(":")[0] + ": a"
    look = "A_A" if name.isupper() and "_" in name else "a_a" if re.search(r"[_.]|[a-z][A-Z]", name) else "A" if name.isupper() else "a a" if " " in name else "a"
    return re.sub(r"\s", "", field[: inner.start()]) + look + re.sub(r"\s", "", field[inner.end() :])


def fields_of(body: str) -> list[tuple]:
    """``frame, before, after, sentence, tells, notation, listed, blank`` of each field.

    The frame and marks of its words, a hash of its sentence and whether that
    speaks of templates, a hash of the notation and whether it is one of the
    usual ones, and whether it is a blank or default.  A field at the edge of
    its line, at the end of its sentence, or beside another, has no frame: 0,
    and -1 for the words.
    """
    if not _MAY_HAVE.search(body):
        return []
    out = []
    for line in body.split("\n"):
        found = FIELD.findall(line) if _MAY_HAVE.search(line) else []
        if not found:
            continue
        words = FIELD.sub(f" {_TOKEN} ", line).lower().split()
        k = -1
        for i, w in enumerate(words):
            if w != _TOKEN:
                continue
            k += 1
            before, after = _beside(words, range(i - 1, -1, -1)), _beside(words, range(i + 1, len(words)))
            frame = (_frame(before, after), _mark(before), _mark(after)) if before and after else (0, -1, -1)
            first = next((j + 1 for j in range(i - 1, -1, -1) if _FINAL.search(words[j])), 0)
            last = next((j for j in range(i + 1, len(words)) if _FINAL.search(words[j])), len(words))
            sentence = words[first : last + 1]
            said = " ".join(sentence)
            field = found[k]
            tells = sentence.count(_TOKEN) == 1 and bool(DESCRIBES.search(said))
            out.append((*frame, _hash(said), tells, _hash(notation(field)), bool(FIELD_NOTATIONS.fullmatch(field)), bool(_IS_BLANK.fullmatch(field))))
    return out


_FIELD_TYPE = pa.struct([("frame", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("sentence", pa.int64()), ("tells", pa.bool_()), ("notation", pa.int64()), ("listed", pa.bool_()), ("blank", pa.bool_())])
_FOUND = f"id long, filler boolean, units array<{_UNIT_SQL}>, fields array<struct<frame: long, before: long, after: long, sentence: long, tells: boolean, notation: long, listed: boolean, blank: boolean>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts that are filler or short pages, and those with fields."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield _read_slice(batch.slice(a, b - a))


def _marked(numbers: pa.Array, starts: np.ndarray, n: int) -> np.ndarray:
    """A mask of the lines a list column names by text."""
    out = np.zeros(n, bool)
    of = pc.list_parent_indices(numbers).to_numpy(zero_copy_only=False)
    out[starts[of] + numbers.flatten().to_numpy(zero_copy_only=False)] = True
    return out


def _read_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    bodies = batch.column(1).cast(pa.string())
    n_docs = len(bodies)
    parts = pc.split_pattern(bodies, "\n")
    lines, text = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(n_lines) - n_lines
    aside, rare = (_marked(batch.column(k), starts, len(lines)) for k in (2, 3))
    split = pc.utf8_split_whitespace(lines)
    line_of, words = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64), split.flatten()
    there = pc.not_equal(pc.binary_length(words), 0)
    words, line_of = words.filter(there), line_of[there.to_numpy(zero_copy_only=False)]
    n_words = np.bincount(line_of, minlength=len(lines))
    left = ~aside & (n_words > 0)
    rare &= left
    # rare lines of the site are set aside unless they have as many words as content has
    spent = np.bincount(text[rare], n_words[rare], minlength=n_docs)
    content = left & ~(rare & (spent <= RARE_WORDS)[text])
    first = np.full(n_docs, -1)
    at = np.flatnonzero(content)
    first[text[at][::-1]] = at[::-1]
    heads = first[(first >= 0) & (n_words[np.maximum(first, 0)] <= TITLE_WORDS)] if len(lines) else first[:0]
    title = np.zeros(len(lines), bool)
    title[heads[~_matches(lines.take(pa.array(heads, pa.int64())), r"[.!?…:][^\p{L}\p{N}]*$")]] = True
    total = np.bincount(text[content], n_words[content], minlength=n_docs)
    short = (np.bincount(text[left], minlength=n_docs) > 0) & (total <= PAGE_WORDS)
    # words of the texts without their titles
    body = (content & ~title)[line_of]
    bare = pc.utf8_trim(pc.utf8_lower(words.filter(pa.array(body))), _EDGES)
    full = pc.not_equal(pc.binary_length(bare), 0)
    coded = bare.filter(full).dictionary_encode()
    doc = text[line_of[body]][full.to_numpy(zero_copy_only=False)]
    filler = is_filler(doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), n_docs)
    may_have = _matches(bodies, _MAY_HAVE.pattern)
    out: list[list] = [[], [], [], []]
    ids = batch.column(0)
    for k in np.flatnonzero(short | filler | may_have).tolist():
        fields = fields_of(bodies[k].as_py()) if may_have[k] else []
        units = []
        if short[k]:
            here = np.flatnonzero(left[starts[k] : starts[k] + n_lines[k]]) + starts[k]
            units = page_units([(lines[i].as_py(), bool(rare[i]), bool(title[i])) for i in here.tolist()])
        if units or fields or filler[k]:
            for column, value in zip(out, (ids[k].as_py(), bool(filler[k]), units, [dict(zip(_FIELD_TYPE.names, f)) for f in fields])):
                column.append(value)
    types = [pa.int64(), pa.bool_(), pa.list_(_UNIT), pa.list_(_FIELD_TYPE)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["id", "filler", "units", "fields"])


def templates(pages: DataFrame) -> DataFrame:
    """``key`` of the lines that are templates of error pages.

    ``pages`` has ``id, site, units``.  Only smallest and largest values are
    kept of hosts and neighbours, so a line of any number of pages is counted
    without gathering them.
    """
    units = pages.select("id", "site", F.explode("units").alias("u"))
    keyed = units.select("id", "site", "u.beside", "u.alone", F.posexplode("u.keys").alias("slot", "key"), "u.n_words")
    one = keyed.groupBy("key", "id").agg(F.min("site").alias("site"), F.min("beside").alias("least"), F.max("beside").alias("most"), F.max("alone").alias("alone"), F.min("slot").alias("slot"), F.max("n_words").alias("n_words"))
    seen = one.groupBy("key").agg(
        F.count("*").alias("n"), F.min("site").alias("s0"), F.max("site").alias("s1"), F.min("least").alias("b0"), F.max("most").alias("b1"), F.max("alone").alias("alone"), F.max("n_words").alias("n_words")
    )
    return seen.where((F.col("n") >= TEMPLATE_PAGES) & (F.col("s0") != F.col("s1")) & ((F.col("b0") != F.col("b1")) | (F.col("alone") & (F.col("n_words") <= LINE_WORDS / 2)))).select("key")


def message_pages(pages: DataFrame, support: bool = True) -> DataFrame:
    """``id`` of the short pages of which all lines but a title are templates of error pages.

    A line also counts if it is two templates in a row, or if each of its
    sentences is a template or (``support``) one of the usual phrases.
    """
    known = cut(templates(pages))
    n = known.count()
    units = pages.select("id", F.posexplode("units").alias("no", "u"))
    kinds = [("keys", "whole"), ("parts", "part"), ("heads", "head"), ("tails", "tail")]
    each = [units.select("id", "no", F.lit(kind).alias("kind"), F.posexplode(f"u.{c}").alias("at", "key")) for c, kind in kinds]
    hits = reduce(DataFrame.unionByName, each).join(maybe_broadcast(known, n), "key", "left_semi").groupBy("id", "no")
    at = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("at")))
    hits = hits.agg(F.max(F.col("kind") == "whole").alias("whole"), at("part").alias("parts"), F.arrays_overlap(at("head"), at("tail")).alias("joined"))
    judged = units.join(hits, ["id", "no"], "left")
    phrase = lambda i: F.get("u.said", i) if support else F.lit(False)
    n_sentences = F.greatest(F.size("u.said"), F.lit(1))
    each = F.forall(F.sequence(F.lit(0), n_sentences - 1), lambda i: F.coalesce(F.array_contains("parts", i), F.lit(False)) | F.coalesce(phrase(i), F.lit(False)))
    ok = F.coalesce("whole", F.lit(False)) | F.coalesce("joined", F.lit(False)) | each
    judged = judged.select("id", ok.alias("ok"), "u.rare", "u.title", "u.n_words")
    open_ = ~F.col("ok")
    spent = F.sum(F.when(open_ & F.col("rare"), F.col("n_words")).otherwise(0))
    left = F.count_if(open_ & ~F.col("rare") & ~F.col("title"))
    out = judged.groupBy("id").agg(F.max("ok").alias("said"), spent.alias("spent"), left.alias("left"))
    return out.where(F.col("said") & (F.col("left") == 0) & (F.col("spent") <= RARE_WORDS)).select("id")


def _word_frames(filters: dict[str, bytes], n_bits: int):
    """Frames filled by ordinary words which pass the filters, with the hashes of their sentences."""

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = {k: np.unpackbits(np.frombuffer(zlib.decompress(v), np.uint8), bitorder="little").astype(bool) for k, v in filters.items()}
        before, after = (bits.pop(k, np.zeros(n_bits, bool)) for k in ("before", "after"))
        level = np.full(n_bits, -1, np.int8)
        for k in sorted(bits, key=int):
            level[bits[k]] = int(k)
        for batch in batches:
            values = batch.column(0).cast(pa.string())
            size = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), len(values)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    frames, sentences = _fills_in(values.slice(a, b - a), before, after, level)
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.int64()), pa.array(sentences, pa.int64())], names=["frame", "sentence"])

    return op


def _fills_in(values: pa.Array, before: np.ndarray, after: np.ndarray, level: np.ndarray) -> tuple[list[int], list[int]]:
    """Frames and sentences in which ordinary words of one sentence, however many, fill the frame.

    ``before`` and ``after`` tell the marks of the words of frames; ``level`` has
    by the bit of a frame the power of two up to which its sentences are
    counted.  Of more, those of least hash are kept, so that the union over all
    slices holds that many too.
    """
    lines = pc.list_flatten(pc.split_pattern(values, "\n"))
    split = pc.utf8_split_whitespace(pc.utf8_lower(lines))
    line, words = pc.list_parent_indices(split), split.flatten()
    there = pc.not_equal(pc.binary_length(words), 0)
    coded = words.filter(there).dictionary_encode()
    codes, line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), line.filter(there).to_numpy(zero_copy_only=False)
    names = coded.dictionary.to_pylist()
    final = np.array([bool(_FINAL.search(w)) for w in names], bool)
    sign = np.array([bool(re.search(r"[{}\[\]<>%@_$#]", w)) for w in names], bool)  # of a field, or like one
    kept = (np.array([bool(_WORDY.search(w)) for w in names], bool) | final | sign)[codes]
    codes, line = codes[kept], line[kept]
    n = len(codes)
    if n < 3:
        return [], []
    fills = ~final & ~sign
    marks = np.array([_mark(w) for w in names], np.int64)
    starts = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | final[codes[:-1]])))
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    place = (np.arange(n) - starts[sentence]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)
    said = (np.add.reduceat(hashes[codes] * place, starts) >> np.uint64(1)).astype(np.int64)
    bits = len(level)
    opens, closes, fills = before[marks % bits][codes], after[marks % bits][codes], fills[codes]
    at = np.flatnonzero(opens)
    # from the next occurrence of the word before on, the frame begins there
    order = at[np.argsort(codes[at], kind="stable")]
    stop = np.full(n, n, np.int64)
    again = np.flatnonzero(codes[order[1:]] == codes[order[:-1]])
    stop[order[again]] = order[again + 1] + 1
    to = at + 1
    found: list[np.ndarray] = []
    while len(at):
        alive = to < np.minimum(n - 1, stop[at])
        at, to = at[alive], to[alive]
        alive = fills[to] & (line[to] == line[at])
        at, to = at[alive], to[alive] + 1
        hit = closes[to] & (line[to] == line[at])
        if hit.any():
            pair = codes[at[hit]] << 32 | codes[to[hit]]
            may_be = level[_bit(marks[pair >> 32], marks[pair & 0xFFFFFFFF], bits)] >= 0
            found.append(np.stack([pair[may_be], said[sentence[at[hit][may_be] + 1]]]))
    if not found:
        return [], []
    pair, said = np.unique(np.concatenate(found, axis=1), axis=1)
    first = np.concatenate(([True], pair[1:] != pair[:-1]))
    rank = np.arange(len(pair)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    least = rank < np.left_shift(1, level[_bit(marks[pair >> 32], marks[pair & 0xFFFFFFFF], bits)].astype(np.int64))
    return [_frame(names[p >> 32], names[p & 0xFFFFFFFF]) for p in pair[least].tolist()], said[least].tolist()


def _filters(frames: DataFrame, bits: int) -> dict[str, bytes]:
    """Bitmaps of the words before and after, and of the frames of each level."""
    of = lambda c: F.pmod(c, F.lit(bits)) + 1
    frame = F.col("before") * 31 + F.col("after")
    marked = F.array(*(F.struct(kind.alias("kind"), of(at).alias("bit")) for kind, at in ((F.lit("before"), F.col("before")), (F.lit("after"), F.col("after")), (F.col("level").cast("string"), frame))))
    marked = frames.select(F.explode(marked).alias("m")).select("m.kind", "m.bit")
    pieces = marked.select("kind", F.bitmap_bucket_number("bit").alias("piece"), F.bitmap_bit_position("bit").alias("at"))
    rows = pieces.groupBy("kind", "piece").agg(F.bitmap_construct_agg("at").alias("bits")).collect()  # of bounded size
    size = 4_096
    out = {r.kind: bytearray(bits // 8) for r in rows}
    for r in rows:
        out[r.kind][(r.piece - 1) * size : r.piece * size] = bytes(r.bits)
    return {k: zlib.compress(bytes(v), 1) for k, v in out.items()}


def aligned(fields: DataFrame, base: DataFrame) -> DataFrame:
    """``frame, described``: the frames of fields that were aligned, cut.

    Those with ordinary words are slots (``described`` is false); those that
    hold a field nearly always, in enough distinct sentences, describe fields.
    """
    framed = fields.where("before >= 0").groupBy("frame", "before", "after").agg(F.countDistinct("sentence").alias("n")).where(F.col("n") >= ALIGNED_SENTENCES)
    most = F.floor(F.col("n") * (1 - DESCRIBED_SHARE) / DESCRIBED_SHARE + 1e-9)
    # one sentence beyond the most that are allowed has to be counted
    framed = cut(framed.select("frame", "before", "after", "n", most.alias("most"), F.ceil(F.log2(most + 1)).alias("level")))
    bits = FILTER_BITS
    while bits < min(MOST_FILTER_BITS, BITS_A_FRAME * framed.count()):
        bits *= 2
    in_words = base.select("body").mapInArrow(_word_frames(_filters(framed, bits), bits), "frame long, sentence long")
    in_words = in_words.distinct().groupBy("frame").agg(F.count("*").alias("n_filled"))
    seen = framed.select("frame", "n", "most").join(in_words, "frame", "left").withColumn("slot", F.coalesce("n_filled", F.lit(0)) > F.col("most"))
    return cut(seen.where(F.col("slot") | (F.col("n") >= DESCRIBED_SENTENCES)).select("frame", (~F.col("slot")).alias("described")))


def left_over(fields: DataFrame, base: DataFrame, support: bool = True, align: bool = True) -> DataFrame:
    """``id, n_left``: how many fields of a text were not filled.

    In a slot any field was left over, in a frame that describes fields none.
    Elsewhere a field counts if its notation was left in slots of several
    texts, or (``support``) is one of the usual ones and its sentence doesn't
    speak of templates; blanks and defaults count in slots only.
    """
    if not align:
        return fields.where("listed and not blank and not tells").groupBy("id").agg(F.count("*").alias("n_left"))
    seen = aligned(fields, base)
    judged = cut(fields.join(maybe_broadcast(seen, seen.count()), "frame", "left").select("id", "frame", "described", "tells", "notation", "listed", "blank"))
    # of a notation only as many slots and texts as are asked for need be counted
    taught = judged.where("not described and not blank").select("notation", "frame", "id").distinct().groupBy("notation")
    taught = taught.agg(F.countDistinct("frame").alias("slots"), F.countDistinct("id").alias("texts")).where((F.col("slots") >= NOTATION_SLOTS) & (F.col("texts") >= NOTATION_TEXTS))
    taught = cut(taught.select("notation", F.lit(True).alias("taught")))
    judged = judged.join(maybe_broadcast(taught, taught.count()), "notation", "left")
    usual = F.coalesce("taught", F.lit(False)) | (F.col("listed") if support else F.lit(False))
    elsewhere = usual & ~F.col("blank") & (~F.col("tells") if support else F.lit(True))
    counts = F.when(F.col("described").isNotNull(), ~F.col("described")).otherwise(elsewhere)
    return judged.where(counts).groupBy("id").agg(F.count("*").alias("n_left"))


def residue(texts: DataFrame, entries: DataFrame, support: bool = True, align: bool = True) -> DataFrame:
    """``id, only_message, filler, n_fields, n_left``: texts with a message, filler or fields.

    ``texts`` has ``text_id, filepath, body``, ``entries`` has ``filepath,
    url``; other columns are ignored.  A text is a case if ``only_message`` or
    ``filler`` or ``n_left > 0``.  Null bodies and ids and empty bodies are left
    out.  A text whose path has no entry has no repeated lines, and counts as
    of no host.  Ids are taken to be unique; of rows given twice one counts.
    ``support`` and ``align`` turn off the fixed phrases and the alignment, to
    see what each decides.
    """
    placed = placed_texts(texts, entries)
    often = often_lines(hashed_lines(texts), placed, MIN_DOCS, RARE_SHARE)
    lines = looked_up(often, MIN_DOCS, RARE_SHARE).groupBy(F.col("text_id").alias("id")).agg(
        F.collect_set(F.when(F.col("share") >= MIN_SHARE - 1e-9, F.col("line_no"))).alias("repeated"), F.collect_set("line_no").alias("rare")
    )
    base = texts.select(F.col("text_id").cast("long").alias("id"), "body").where("id is not null and body is not null")
    none = F.array().cast("array<long>")
    with_lines = base.join(lines, "id", "left").select("id", "body", F.coalesce("repeated", none).alias("repeated"), F.coalesce("rare", none).alias("rare"))
    read = cut(with_lines.mapInArrow(_read, _FOUND))
    fields = read.select("id", F.explode("fields").alias("f")).select("id", "f.*")
    left = left_over(fields, base, support, align)
    pages = read.where("size(units) > 0").select("id", "units").join(placed.select(F.col("text_id").alias("id"), "site"), "id", "left")
    pages = cut(pages.select("id", F.coalesce("site", F.lit(0)).alias("site"), "units"))
    said = message_pages(pages, support).withColumn("only_message", F.lit(True))
    out = read.select("id", "filler", F.size("fields").alias("n_fields")).join(left, "id", "left").join(said, "id", "left")
    out = out.select("id", F.coalesce("only_message", F.lit(False)).alias("only_message"), "filler", "n_fields", F.coalesce("n_left", F.lit(0)).alias("n_left"))
    return out.where("only_message or filler or n_fields > 0")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the texts that are template residue, error pages or filler."""
    found = residue(table(spark, sf_dir, "page_texts"), table(spark, sf_dir, "entries"))
    return found.where("only_message or filler or n_left > 0").select(F.col("id").alias("text_id")).distinct()


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a message, filler or fields, and what was found."""
    return residue(table(spark, sf_dir, "page_texts"), table(spark, sf_dir, "entries")).withColumnRenamed("id", "text_id")
