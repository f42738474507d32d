"""Problem 8: keyword-stuffed pages and link lists.

What the words of sentences are is learned from the table itself: a word that
stands in enough documents, and more often in segments shaped like sentences
than in others (titles, lists, tags), tells prose; the other words of that many
documents are known to name things.  No list of any language is used, and a
text of whose words none is known isn't judged by them.

A text is cut into segments (sentences and lines).  Within a text the words
are held against themselves at each lag of a window: a content word that comes
back within the window counts as recurring, and the share of recurring words
is the autocorrelation of the text summed over the lags.  Prose comes back to
its subject about once a sentence; key words come back every few words.

Key words dressed up as longer sentences come back evenly over the whole text:
the gaps between the occurrences of a content word vary little, or the text
equals itself at one lag of up to some tens of words, again and again.  Words
found by either count as recurring too.

A segment is stuffing if most of its content words recur; if it is a list, not
a sentence, of names and nouns with next to no words of prose; or if it is a
link or a tag with no more around it.  A text is flagged if more than half of
its words stand in such segments.  Everything is worked out in flat arrays over
a batch of texts; only counts of words are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.llm.common import cut, table

#: Lags of the window in which a word counts as coming back.
LAGS = 6
#: Share of recurring words from which a segment is stuffing.
RECURRING = 0.4
#: Lags (about the length of a long sentence; a paragraph said again isn't key words) up to which
#: a text is held against itself for even repetition, the share of its content words that must
#: equal the one a lag on, and how many lags of them.
LONG_LAGS = 30
SAME_SHARE = 0.6
SAME_TIMES = 5
#: Gaps of a word from which they can be judged, and the deviation by their mean up to which they are even.
EVEN_GAPS = 6
EVEN_DEVIATION = 0.35
#: Share of a segment's content words that must come back evenly.
EVEN_SHARE = 0.6
#: Documents, as a share of all and at least so many, in which a word is known; how many times more
#: often it stands in sentences than elsewhere to be a word of prose; signs it may have.
KNOWN_SHARE = 0.002
KNOWN_DOCS = 3
PROSE_RATIO = 2.0
WORD_SIGNS = 30
#: Words from which a segment with a final sign is a sentence.
SENTENCE_WORDS = 4
#: Share of words of prose below which a segment is a list, and share of known words of its text
#: from which that can be told; both for a segment shaped like a sentence, which has more words.
LIST_PROSE, LIST_KNOWN = 0.1, 0.15
LONG_LIST_WORDS, LONG_LIST_PROSE, LONG_LIST_KNOWN = 8, 0.05, 0.3
#: Share of a text's words from which it is flagged, and words from which lists alone do that: a title is less.
STUFFED_SHARE = 0.5
STUFFED_WORDS = 8
#: Bytes of text taken at once.
SLICE_BYTES = 4_000_000

_CUT = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+|[\r\n]+")
_SENTENCE = r"[.!?…][\"”’»)]*\s*$"
_EDGES = ".,;:!?…\"'“”„«»‘’()[]{}<>|•*·-–—/\\#=+~_@"
#: Stands for the address of a link.
_LINK = "\ue000"


def segments(text: str) -> list[str]:
    """Sentences and lines of a text, without empty ones."""
    return [s for s in _CUT.split(text) if s.strip()]


class Words:
    """The words of some texts in flat arrays."""

    def __init__(self, texts: pa.Array):
        bare = pc.replace_substring_regex(texts, r"<[aA]\s[^<>]*>|\]\([^\s()]+\)|(?:https?://|www\.)\S+", f" {_LINK} ")
        bare = pc.replace_substring_regex(bare, r"</?[A-Za-z][^<>]{0,200}>", " ")
        cut_ = [segments(t) for t in bare.to_pylist()]
        self.n_docs = len(cut_)
        self.doc_of = np.repeat(np.arange(len(cut_)), [len(c) for c in cut_])
        flat = pa.array([s.lower() for c in cut_ for s in c], pa.string())
        final = pc.match_substring_regex(flat, _SENTENCE).to_numpy(zero_copy_only=False)
        # commas, bars and apostrophes without a space part words too
        flat = pc.replace_substring_regex(flat, r"[,;|/’']+", " ")
        split = pc.utf8_split_whitespace(flat)
        self.segment, words = pc.list_parent_indices(split).to_numpy(zero_copy_only=False).astype(np.int64), split.flatten()
        tag = pc.match_substring_regex(words, r"^#[^#]").to_numpy(zero_copy_only=False)
        words = pc.utf8_trim(words, _EDGES)
        there = pc.not_equal(pc.binary_length(words), 0)
        mask = there.to_numpy(zero_copy_only=False)
        coded = words.filter(there).dictionary_encode()
        self.segment, self.tag = self.segment[mask], tag[mask]
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = self.doc_of[self.segment] if len(self.segment) else np.zeros(0, np.int64)
        self.n_segments = len(flat)
        self.count = np.bincount(self.segment, minlength=self.n_segments)
        self.sentence = final & (self.count >= SENTENCE_WORDS)

    def are_in(self, values: pa.Array) -> np.ndarray:
        """Whether each word is one of some."""
        if not len(self.codes):
            return np.zeros(0, bool)
        return pc.is_in(self.names, value_set=values).to_numpy(zero_copy_only=False)[self.codes]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word in sentences and elsewhere, and its documents."""
    for _, texts in _slices(batches):
        w = Words(texts)
        n = len(w.names)
        sentence = w.sentence[w.segment] if len(w.segment) else np.zeros(0, bool)
        inside, outside = np.bincount(w.codes[sentence], minlength=n), np.bincount(w.codes[~sentence], minlength=n)
        docs = np.bincount(np.unique(w.codes << 32 | w.doc) >> 32, minlength=n)
        short = pc.and_(pc.less_equal(pc.utf8_length(w.names), WORD_SIGNS), pc.match_substring_regex(w.names, r"^[^\d" + _LINK + r"]+$"))
        made = pa.RecordBatch.from_arrays([w.names.cast(pa.string()), pa.array(inside), pa.array(outside), pa.array(docs)], names=["word", "inside", "outside", "docs"]).filter(short)
        # the totals of all words, long ones included, under the empty word
        total = pa.RecordBatch.from_arrays([pa.array([""]), pa.array([int(inside.sum())]), pa.array([int(outside.sum())]), pa.array([w.n_docs])], names=made.schema.names)
        yield made
        yield total


def learned(df: DataFrame, id_col: str, text_col: str) -> tuple[list[str], list[str]]:
    """The words of prose, and the other known words.

    Their number is bounded: a document has a few hundred distinct words, so
    no more than that by ``KNOWN_SHARE`` can be in that share of all.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = cut(rows.mapInArrow(_counted, "word string, inside long, outside long, docs long").groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"), F.sum("docs").alias("docs")))
    total = counts.where("word = ''").first()
    if total is None:
        return [], []
    known = counts.where((F.col("word") != "") & (F.col("docs") >= max(KNOWN_DOCS, KNOWN_SHARE * total.docs)))
    # one that stands in sentences only is a word of prose, however small the table
    ratio = (F.col("inside") / max(total.inside, 1)) / F.greatest(F.col("outside") / max(total.outside, 1), F.lit(1e-12))
    prose: tuple[list[str], list[str]] = [], []
    for r in known.select("word", (ratio >= PROSE_RATIO).alias("prose")).toLocalIterator():
        prose[0 if r.prose else 1].append(r.word)
    return sorted(prose[0]), sorted(prose[1])


def _recurring(words: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Content words that come back, or have come before, within the lags."""
    out = np.zeros(len(words), bool)
    for lag in range(1, LAGS + 1):
        if len(words) <= lag:
            break
        same = (words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag]) & content[lag:]
        out[lag:] |= same
        out[:-lag] |= same
    return out


def _even_gaps(words: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Content words whose occurrences over the whole text stand at even gaps."""
    out = np.zeros(len(words), bool)
    at = np.flatnonzero(content)
    if not len(at):
        return out
    key = doc[at] << 32 | words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.cumsum(new) - 1
    gaps, of = np.diff(at)[~new[1:]].astype(float), group[1:][~new[1:]]
    n = np.bincount(of, minlength=group[-1] + 1)
    mean = np.bincount(of, weights=gaps, minlength=len(n)) / np.maximum(n, 1)
    spread = np.bincount(of, weights=(gaps - mean[of]) ** 2, minlength=len(n)) / np.maximum(n, 1)
    even = (n >= EVEN_GAPS) & (mean <= LONG_LAGS) & (np.sqrt(spread) <= EVEN_DEVIATION * mean)
    out[at] = even[group]
    return out


def _same_again(words: np.ndarray, content: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Content words of texts which equal themselves at one lag beyond the window, at that lag."""
    out = np.zeros(len(words), bool)
    n_content = np.bincount(doc[content], minlength=n_docs)
    for lag in range(LAGS + 1, min(LONG_LAGS, len(words) - 1) + 1):
        at = np.flatnonzero((words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag]) & content[lag:])
        n = np.bincount(doc[at], minlength=n_docs)
        # of a lag only some words are content: the same share of it is asked for
        whole = np.bincount(doc, minlength=n_docs)
        again = (n >= SAME_SHARE * n_content) & (n * whole >= SAME_TIMES * lag * n_content) & (n > 0)
        at = at[again[doc[at]]]
        out[at] = out[at + lag] = True
    return out


#: What a text is measured by.
MEASURES = "n_words n_stuffed n_recurring n_even n_list n_link".split()


def stuffed(texts: pa.Array, prose: pa.Array, known: pa.Array) -> list[np.ndarray]:
    """Of each text the words, those in stuffing, and those in segments of each kind.

    A segment counts for the first kind it is of: recurring, even, link, list.
    """
    w = Words(texts)
    of_prose = w.are_in(prose)
    content = ~of_prose
    n = w.n_segments
    back = _recurring(w.codes, content, w.doc)
    evenly = _even_gaps(w.codes, content, w.doc) | _same_again(w.codes, content, w.doc, w.n_docs)
    link = w.tag | w.are_in(pa.array([_LINK]))
    in_segment = lambda mask: np.bincount(w.segment[mask], minlength=n)
    in_doc = lambda values: np.bincount(w.doc_of, weights=values, minlength=w.n_docs)
    n_prose = in_segment(of_prose)
    total = in_doc(w.count)
    known_share = np.bincount(w.doc[of_prose | w.are_in(known)], minlength=w.n_docs) / np.maximum(total, 1)
    known_share = known_share[w.doc_of]
    recurs = in_segment(back) >= RECURRING * w.count
    even = (in_segment(back | evenly) >= EVEN_SHARE * np.maximum(w.count - n_prose, 1)) & (in_segment(evenly) >= 2)
    linked = (in_segment(link) > 0) & (n_prose < LIST_PROSE * w.count)
    plain = ~w.sentence & (n_prose < LIST_PROSE * w.count) & (known_share >= LIST_KNOWN)
    long = w.sentence & (w.count >= LONG_LIST_WORDS) & (n_prose < LONG_LIST_PROSE * w.count) & (known_share >= LONG_LIST_KNOWN)
    kinds, taken = [], np.zeros(n, bool)
    for mask in (recurs, even, linked, plain | long):
        kinds.append(in_doc(w.count * (mask & ~taken)))
        taken |= mask
    recurring, even_, link_, list_ = kinds
    return [x.astype(np.int64) for x in (total, in_doc(w.count * taken), recurring, even_, list_, link_)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts in slices of bounded size; nulls are left out."""
    for batch in batches:
        ids, values = batch.column(0), batch.column(1).cast(pa.string())
        ok = pc.and_(pc.is_valid(ids), pc.is_valid(values))
        ids, values = ids.filter(ok), values.filter(ok)
        size = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield ids.slice(a, b - a), values.slice(a, b - a)


def _scores(prose: list[str], known: list[str]):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = pa.array(prose, pa.string()), pa.array(known, pa.string())
        for ids, texts in _slices(batches):
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *map(pa.array, stuffed(texts, *sets))], names=["id", *MEASURES])

    return op


def stuffing(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n_words, n_stuffed, n_recurring, n_even, n_list, n_link, flagged`` of each text.

    Null ids and texts are left out; the empty text has no words and isn't
    flagged.  Rows given twice come out twice; other columns are ignored.  Words
    are learned from the table when this is called.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scores(*learned(df, id_col, text_col)), "id long, " + ", ".join(f"{m} long" for m in MEASURES))
    # a title alone is no list
    enough = (F.col("n_stuffed") >= STUFFED_WORDS) | (F.col("n_stuffed") - F.col("n_list") > F.col("n_words") * STUFFED_SHARE)
    return out.withColumn("flagged", (F.col("n_stuffed") > F.col("n_words") * STUFFED_SHARE) & enough)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the stuffed documents."""
    return stuffing(table(spark, sf_dir, "documents"), "doc_id", "text").where("flagged").select(F.col("id").alias("doc_id")).distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and stuffed words of each document."""
    return stuffing(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
