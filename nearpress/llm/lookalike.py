"""Problem 5: one consistent form for text that looks the same.

The method is columnar: a batch of texts is exploded to one flat array of
positioned code points, the decomposition and look-alike tables (bounded by
Unicode itself, a few thousand entries) are joined on by array lookup, the
combining marks of each run are ordered by class, composed again with their
base, and the texts are rebuilt from the surviving code points.  Nothing is
shuffled: position and text number travel in the arrays.

What counts as looking the same: characters that show nothing, spaces of other
widths, full- and half-width forms, ligatures, composed and combining accents,
hyphens and letters of another script with the same shape.  A missing accent,
another digit, word or case, or another number of spaces or line breaks stays
different.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.llm.common import cut, key128, table, words_expr

#: Letters of other scripts and the Latin letter of the same shape.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ӏ": "l", "ѵ": "v", "ү": "y",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J",
    "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y", "Ӏ": "I",
    # Greek
    "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "χ": "x",
    "α": "a", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Տ": "S", "Օ": "O", "Լ": "L",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I",
    "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S",
    "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    # Latin letters drawn like others, and phonetic forms
    "ɑ": "a", "ɡ": "g", "ı": "i", "ſ": "s",
    # hyphens and marks drawn alike
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-",
    "˗": "-", "·": "·", " ": " ",
    ";": ";", "·": "·", "․": ".", "ꓸ": ".",
    "‘": "'", "’": "'", "ʼ": "'", "ʹ": "'", "′": "'",
    "⁄": "/", "∕": "/", "∶": ":", "ː": ":",
}

#: Compatibility forms which look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>")

#: Code points a chunk may hold; bounds the memory of the flat arrays.
CHUNK_CODE_POINTS = 1_000_000

_TOP = 0x110000


def _candidates():
    """Code points that can have a decomposition, a class, or no shape."""
    yield from range(0x00, 0x3400)
    yield from range(0xA000, 0xAC00)
    yield from range(0xF900, 0x10000)
    yield from range(0x10000, 0x12000)
    yield from range(0x1B000, 0x20000)
    yield from range(0x2F800, 0x2FA20)
    yield from range(0xE0000, 0xE0200)


@lru_cache(maxsize=1)
def _tables():
    """Lookup tables by code point: pieces (start, length, flat), class, pairs."""
    like = {ord(k): ord(v) for k, v in LOOKALIKES.items()}

    def expand(cp: int, depth: int = 0) -> list[int]:
        d = unicodedata.decomposition(chr(cp))
        if not d or depth > 8:
            return [like.get(cp, cp)]
        parts = d.split()
        if parts[0].startswith("<"):
            pieces = [int(x, 16) for x in parts[1:]]
            # a spacing accent is not a space with an accent
            if parts[0] not in SAME_LOOK or (pieces[0] == 0x20 and len(pieces) > 1):
                return [like.get(cp, cp)]
        else:
            pieces = [int(x, 16) for x in parts]
        return [y for x in pieces for y in expand(x, depth + 1)]

    start = np.zeros(_TOP, np.int32)
    length = np.ones(_TOP, np.uint8)
    start[:] = -1
    flat: list[int] = []
    ccc = np.zeros(_TOP, np.uint8)
    pairs: dict[int, int] = {}
    for cp in _candidates():
        ch = chr(cp)
        category = unicodedata.category(ch)
        ccc[cp] = unicodedata.combining(ch)
        control = category == "Cc" and cp not in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
        hidden = category == "Cf" or control or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        if hidden or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
            length[cp] = 0
            continue
        pieces = expand(cp)
        if pieces != [cp]:
            start[cp] = len(flat)
            length[cp] = len(pieces)
            flat += pieces
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split())
            if a not in like and cp not in like:  # what is left after mapping is composed
                pairs[a << 21 | b] = cp
    keys = np.array(sorted(pairs), np.int64)
    values = np.array([pairs[k] for k in keys.tolist()], np.int64)
    return start, length, np.array(flat, np.uint32), ccc, keys, values


def _compose(cps: np.ndarray, text: np.ndarray, ccc_of: np.ndarray, keys, values):
    """Orders each run of marks by class and composes it with its base.

    Marks never join a base of another text.  Returns the code points and a
    mask of those which are left.
    """
    keep = np.ones(len(cps), bool)
    ccc = ccc_of[cps]
    at = np.flatnonzero(ccc)
    if not len(at):
        return cps, keep
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])
    run = np.cumsum(fresh) - 1
    order = np.lexsort((at, ccc[at], run))
    cps[at] = cps[at[order]]
    ccc = ccc_of[cps]
    first = at[fresh]
    base = first - 1
    usable = (base >= 0) & (text[np.maximum(base, 0)] == text[first])
    rank = at - first[run]
    last = np.zeros(len(first), np.int32)
    for r in range(int(rank.max()) + 1 if len(rank) else 0):
        here = (rank == r) & usable[run]
        marks, runs = at[here], run[here]
        if not len(marks):
            continue
        bases = base[runs]
        pair = cps[bases].astype(np.int64) << 21 | cps[marks].astype(np.int64)
        found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        free = (last[runs] == 0) | (last[runs] < ccc[marks])
        joined = (keys[found] == pair) & free
        cps[bases[joined]] = values[found[joined]]
        keep[marks[joined]] = False
        last[runs[~joined]] = ccc[marks[~joined]]
    return cps, keep


def _without_returns(cps: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A mask without the carriage returns right before a line feed, which show nothing.

    Looked for among what is left of a text, so that a hidden sign between
    makes no difference.
    """
    shown = np.ones(len(cps), bool)
    cr = cps == 13
    if cr.any():
        at = np.where(cr, len(cps), np.arange(len(cps)))
        after = np.minimum.accumulate(at[::-1])[::-1]  # the next sign that is no carriage return
        i = np.flatnonzero(cr & (after < len(cps)))
        shown[i[(cps[after[i]] == 10) & (text[after[i]] == text[i])]] = False
    return shown


#: First code points and numbers of the parts of Hangul syllables, which are composed by rule.
_SYLLABLES, _LEADS, _VOWELS, _TAILS = (0xAC00, 11_172), (0x1100, 19), (0x1161, 21), (0x11A7, 28)


def _compose_hangul(cps: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the parts of Hangul syllables; returns the code points and a mask of those left."""
    keep = np.ones(len(cps), bool)

    def parts(of: tuple[int, int], first: int = 0) -> np.ndarray:
        return (cps >= of[0] + first) & (cps < of[0] + of[1])

    vowel, tail = parts(_VOWELS), parts(_TAILS, 1)
    if not (vowel.any() or tail.any()):
        return cps, keep
    same = np.concatenate(([False], text[1:] == text[:-1]))
    v = np.flatnonzero(vowel & same)
    v = v[parts(_LEADS)[v - 1]]
    cps[v - 1] = _SYLLABLES[0] + ((cps[v - 1] - _LEADS[0]) * _VOWELS[1] + (cps[v] - _VOWELS[0])) * _TAILS[1]
    keep[v] = False
    # the sign a tail joins: the one before, or before the vowel that was just joined
    t = np.flatnonzero(tail & same)
    base = np.where(keep[t - 1], t - 1, t - 2)
    open_ = parts(_SYLLABLES)[base] & ((cps[base] - _SYLLABLES[0]) % _TAILS[1] == 0)
    t, base = t[open_], base[open_]
    cps[base] += cps[t] - _TAILS[0]
    keep[t] = False
    return cps, keep


def _form_chunk(values: pa.Array) -> pa.Array:
    start, length, flat, ccc_of, keys, composed = _tables()
    sizes = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(values.to_pylist())
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    reps = length[cps].astype(np.int64)
    source = start[cps]
    if (reps != 1).any() or (source >= 0).any():
        text = np.repeat(text, reps)
        ends = np.cumsum(reps)
        within = np.arange(len(text), dtype=np.int64) - np.repeat(ends - reps, reps)
        source = np.repeat(source, reps)
        cps = np.where(source >= 0, flat[np.maximum(source, 0) + np.where(source >= 0, within, 0)], np.repeat(cps, reps))
    else:
        cps = cps.copy()
    shown = _without_returns(cps, text)
    cps, text = cps[shown], text[shown]
    cps, keep = _compose(cps, text, ccc_of, keys, composed)
    cps, text = cps[keep], text[keep]
    cps, keep = _compose_hangul(cps, text)
    cps, text = cps[keep], text[keep]
    wide = np.ones(len(cps), np.int64)
    for edge in (0x80, 0x800, 0x10000):
        wide += cps >= edge
    offsets = np.zeros(len(sizes) + 1, np.int64)
    offsets[1:] = np.cumsum(np.bincount(text, weights=wide, minlength=len(sizes)).astype(np.int64))
    data = cps.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def form_array(values: pa.Array) -> pa.Array:
    """The consistent form of each string of an Arrow array; null stays null.

    Texts of plain ASCII without control signs are returned as they are.
    """
    values = values.cast(pa.string())
    plain = pc.and_(pc.string_is_ascii(values), pc.invert(pc.match_substring_regex(values, r"[\x00-\x08\x0d-\x1f\x7f]")))
    todo = np.flatnonzero(~pc.fill_null(plain, True).to_numpy(zero_copy_only=False))
    if not len(todo):
        return values
    sizes = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)[todo]
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // CHUNK_CODE_POINTS)) + 1
    done = pa.concat_arrays([_form_chunk(values.take(pa.array(part))) for part in np.split(todo, cuts) if len(part)])
    mask = np.zeros(len(values), bool)
    mask[todo] = True
    return pc.replace_with_mask(values, pa.array(mask), done)


@lru_cache(maxsize=1)
def _form_udf():
    @F.arrow_udf("string")
    def consistent_form(values: pa.Array) -> pa.Array:
        return form_array(values)

    return consistent_form


def consistent_form(col: Column | str) -> Column:
    """The consistent form of a string column.

    Null gives null and the empty text the empty text; texts of any length are
    handled whole.
    """
    return _form_udf()(F.col(col) if isinstance(col, str) else col)


def same_look_pairs(df: DataFrame, id_col: str, value_col: str, form: Column, min_words: int = 0) -> DataFrame:
    """Pairs of rows whose values look the same but differ as stored.

    Returns ``id_a, id_b`` with the smaller id first.  Rows with a null id or
    value have no pair; rows listed twice give one pair.  Ids are taken to be
    unique; other columns are ignored, whatever their names.

    Only hashes are shuffled.  A form with one stored spelling drops out by a
    map-side combined aggregate, so a group of exact copies, however large, is
    never joined with itself; pairs are built between spellings and expanded to
    their rows, so that no more is touched than comes out.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(value_col).alias("value"))
    rows = rows.where(F.col("id").isNotNull() & F.col("value").isNotNull()).withColumn("form", form)
    if min_words:
        rows = rows.where(words_expr("form") >= min_words)
    keyed = cut(rows.select("id", key128("form").alias("f"), key128("value").alias("v")))  # the form is worked out once
    varied = keyed.groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("f")
    keyed = keyed.join(varied, "f", "left_semi")
    spellings = keyed.select("f", "v").distinct()
    left = spellings.select("f", F.col("v").alias("v_a"))
    right = spellings.select("f", F.col("v").alias("v_b"))
    pairs = left.join(right, "f").where("v_a <> v_b")
    a = keyed.select("f", F.col("v").alias("v_a"), F.col("id").alias("id_a"))
    b = keyed.select("f", F.col("v").alias("v_b"), F.col("id").alias("id_b"))
    out = pairs.join(a, ["f", "v_a"]).join(b, ["f", "v_b"]).where("id_a < id_b")
    return out.select("id_a", "id_b").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-alike pairs of bodies (at least 40 words) and of file paths."""
    texts, entries = table(spark, sf_dir, "page_texts"), table(spark, sf_dir, "entries")
    value = consistent_form("value")
    bodies = same_look_pairs(texts, "text_id", "body", value, 40).select(F.lit("body").alias("field_kind"), "id_a", "id_b")
    paths = same_look_pairs(entries, "entry_id", "filepath", value).select(F.lit("path").alias("field_kind"), "id_a", "id_b")
    return bodies.unionByName(paths)


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each body and file path with its consistent form."""
    texts, entries = table(spark, sf_dir, "page_texts"), table(spark, sf_dir, "entries")
    bodies = texts.select(F.lit("body").alias("field_kind"), F.col("text_id").alias("id"), consistent_form("body").alias("form"))
    paths = entries.select(F.lit("path").alias("field_kind"), F.col("entry_id").alias("id"), consistent_form("filepath").alias("form"))
    return bodies.unionByName(paths)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The form in SQL, for the signs that occur in the test data: composed letters of other scripts are named one by one."""
    ligatures = {chr(cp): unicodedata.normalize("NFKD", chr(cp)) for cp in range(0xFB00, 0xFB07)}
    out = f"replace({column}, chr(13) || chr(10), chr(10))"
    for k, v in ligatures.items():
        out = f"replace({out}, '{k}', '{v}')"
    wide = "".join(map(chr, range(0xFF01, 0xFF5F)))
    plain = "".join(chr(ord(c) - 0xFEE0) for c in wide)
    spaces = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
    hidden = "".join(map(chr, [0xAD, 0x061C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF]))
    like = {k: v for k, v in LOOKALIKES.items() if k != v and k not in spaces} | {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}
    old, new = wide + spaces + "".join(like) + hidden, plain + " " * len(spaces) + "".join(like.values())
    return f"nfc_normalize(translate({out}, {_quoted(old)}, {_quoted(new)}))"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[\\s\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"


_VALUES_SQL = f"""v AS (SELECT 'body' AS field_kind, text_id AS id, body AS value FROM page_texts UNION ALL SELECT 'path', entry_id, filepath FROM entries),
f AS (SELECT field_kind, id, value, {form_sql("value")} AS form FROM v)"""

ORACLE = {
    "p5_found": f"""WITH {_VALUES_SQL}, g AS (SELECT * FROM f WHERE field_kind = 'path' OR len({words_sql("form")}) >= 40)
SELECT a.field_kind, a.id AS id_a, b.id AS id_b FROM g a JOIN g b ON a.field_kind = b.field_kind AND a.form = b.form AND a.id < b.id AND a.value <> b.value""",
    "p5_forms": f"WITH {_VALUES_SQL} SELECT field_kind, id, form FROM f",
}
