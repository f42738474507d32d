"""Problem 2: near copies with small edits, by a chosen-path join.

A document is the set of its runs of words; equal documents are joined to one
class beforehand.  Each class gets a signature of ``COORDS`` tokens sampled by
minwise hashing.  A run starts with all classes in one bucket; a bucket that is
too large for brute force is split: the path so far chooses some coordinates,
so many that a pair at the threshold is expected to share more than one of
them, and a class goes on into one bucket for each, named by the path, the
coordinate and the sampled token.  Buckets of at most ``leaf`` classes are
compared pair by pair with a packed sketch, and what may reach the threshold
is checked on the whole sets, in cells to which each set goes once.  Runs are
repeated until the target recall at the threshold is reached, at whatever depth
buckets end; above the threshold recall is higher.

A bucket that splitting doesn't shrink (its classes are alike throughout) is
compared at once in blocks, so no bucket is cut off and none is held in one
task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.llm.common import cut, maybe_broadcast, table
from nearpress.llm.lookalike import form_array, form_sql, words_sql

COORDS = 64
#: Coordinates a pair at the threshold shares on average of those a path chooses: above 1, or deep paths die out.
SHARED = 1.2
#: Classes up to which a bucket is compared pair by pair.
LEAF = 64
#: A bucket is stuck if it keeps this share of the bucket it comes from.
STUCK = 0.6
MAX_DEPTH = 24
#: Rounds in which components have to settle; they need about the logarithm of the longest path.
MAX_ROUNDS = 100
#: Rows of a block in which large groups are compared.
BLOCK = 1_000
#: Runs of words of the sets of a cell in which pairs are checked, about; a set of more is one in a cell of its own.
CELL_RUNS = 250_000
#: Bytes of text taken at once in a Python worker.
SLICE_BYTES = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    parts = pc.utf8_split_whitespace(texts)
    flat, parents = parts.flatten(), pc.list_parent_indices(parts)
    there = pc.not_equal(pc.binary_length(flat), 0)
    flat, parents = flat.filter(there), parents.filter(there)
    coded = flat.dictionary_encode()
    of = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    counts = np.bincount(parents.to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64)
    return (of[codes] if len(codes) else np.zeros(0, np.uint64)), counts


def _runs(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words, and the number of runs of each text."""
    n = np.maximum(counts - size + 1, 0)
    starts = np.repeat(np.cumsum(counts) - counts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    h = np.zeros(len(starts), np.uint64)
    for k in range(size):
        h = (h ^ words[starts + k]) * _MIX
        h ^= h >> np.uint64(29)
    return h, n


def _slices(batches: Iterator[pa.RecordBatch], lower: bool = True):
    """Ids and consistent forms, in slices of bounded size; null texts are left out."""
    for batch in batches:
        ids, values = batch.column(0), batch.column(1).cast(pa.string())
        ok = pc.and_(pc.is_valid(ids), pc.is_valid(values))
        ids, values = ids.filter(ok), values.filter(ok)
        size = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                form = form_array(values.slice(a, b - a))
                yield ids.slice(a, b - a), pc.utf8_lower(form) if lower else form


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(1, 2**63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, COORDS, np.uint64)


def _signatures(min_words: int, run_words: int, short: bool):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers()
        for ids, forms in _slices(batches):
            words, counts = _words(forms)
            ok = counts >= max(min_words, run_words)
            if short and not ok.all():
                yield _unsigned(ids.filter(pa.array(~ok)), forms.filter(pa.array(~ok)))
            if not ok.any():
                continue
            runs, n = _runs(words, counts, run_words)
            n = n[ok]  # texts that are left out have runs too: those are dropped here
            runs = runs[np.repeat(ok, np.maximum(counts - run_words + 1, 0))]
            starts = np.cumsum(n) - n
            sig = np.empty((len(n), COORDS), np.uint32)
            for k in range(COORDS):
                sig[:, k] = np.minimum.reduceat(((runs * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
            mixed = sig * np.uint32(0x85EBCA6B)
            two = ((mixed >> np.uint32(30)) & np.uint32(3)).astype(np.uint64)
            shift = np.arange(32, dtype=np.uint64) * np.uint64(2)
            sketch = [(two[:, h : h + 32] << shift).sum(axis=1, dtype=np.uint64).view(np.int64) for h in (0, 32)]
            f0, f1 = _keys(forms.filter(pa.array(ok)))
            low = (mixed >> np.uint32(14)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.filter(pa.array(ok)).cast(pa.int64()),
                    f0,
                    f1,
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * COORDS), len(n), [None, pa.py_buffer(np.ascontiguousarray(low).tobytes())]).cast(pa.binary()),
                    pa.array(sketch[0]),
                    pa.array(sketch[1]),
                ],
                names=["id", "f0", "f1", "sig", "s0", "s1"],
            )

    return op


def _keys(forms: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Both halves of a 128-bit hash of each form."""
    keys = [xxhash.xxh3_128_intdigest(f) for f in forms.to_pylist()]
    return tuple(pa.array(np.array(half, np.uint64).view(np.int64)) for half in ([k & (2**64 - 1) for k in keys], [k >> 64 for k in keys]))


def _unsigned(ids: pa.Array, forms: pa.Array) -> pa.RecordBatch:
    """Texts too short to be compared: they have equals only."""
    f0, f1 = _keys(forms)
    none = pa.nulls(len(ids), pa.int64())
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), f0, f1, pa.nulls(len(ids), pa.binary()), none, none], names=["id", "f0", "f1", "sig", "s0", "s1"])


def _sets(run_words: int):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, forms in _slices(batches):
            runs, n = _runs(*_words(forms), run_words)
            ends = np.cumsum(n)
            sets = [np.unique(runs[e - k : e]).view(np.int64) for e, k in zip(ends, n)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "runs"])

    return op


def branches(threshold: float) -> int:
    """Coordinates a path chooses."""
    if not 0.05 <= threshold <= 1:
        raise ValueError(f"a threshold is 0.05 to 1, not {threshold}")
    return math.ceil(SHARED / threshold - 1e-9)


def survival(threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold shares a path of that depth in one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - threshold * q) ** branches(threshold)
    return q


def runs_needed(threshold: float, recall: float, depth: int | None = None) -> int:
    """Runs for the recall at the threshold, for buckets that end at the deepest level if none is given."""
    missed = 1 - survival(threshold, MAX_DEPTH if depth is None else depth)
    return 1 if missed <= 1 - recall else math.ceil(math.log(1 - recall) / math.log(missed))


def least_matches(threshold: float) -> int:
    """Equal coordinates of the sketch below which a pair at the threshold doesn't fall, at four deviations."""
    p = threshold + (1 - threshold) / 4
    return max(0, math.floor(COORDS * p - 4 * math.sqrt(COORDS * p * (1 - p))))


def _equal_coords() -> Column:
    def differ(x: str) -> Column:
        d = F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return F.lit(COORDS) - differ("s0") - differ("s1")


def _children(rows: DataFrame, n: int) -> DataFrame:
    """The buckets a row goes on into: ``id, path, from_n, s0, s1``."""
    i = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDS))
    by = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(COORDS // 2)) * 2 + 1  # odd, so that no coordinate comes twice
    at = [F.pmod(i + by * k, F.lit(COORDS)).cast("int") for k in range(n)]
    step = lambda c: F.xxhash64("path", c, F.substring("sig", c * 2 + 1, F.lit(2)))
    return rows.select("id", F.explode(F.array(*map(step, at))).alias("path"), "from_n", "s0", "s1")


def block_pairs(rows: DataFrame, key: list[str], size: str, keep: list[str], block: int = BLOCK) -> DataFrame:
    """All pairs ``id_a < id_b`` within each key, in blocks of about ``block`` rows.

    ``size`` is a column with the rows of the key.  A group in one block is
    joined as it is; a larger one is spread over the cells of its blocks, so no
    task holds more than two blocks of it.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(n, F.lit(1))).cast("int"))
    names = ["id", *keep]
    left = rows.select(*key, "own", F.explode(F.sequence("own", F.greatest("blocks", F.lit(1)) - 1)).alias("other"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = rows.select(*key, F.col("own").alias("other"), F.explode(F.sequence(F.lit(0), "own")).alias("own"), *[F.col(c).alias(f"{c}_b") for c in names])
    both = left.join(right, [*key, "own", "other"])
    return both.where((F.col("own") < F.col("other")) | (F.col("id_a") < F.col("id_b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def candidate_pairs(classes: DataFrame, threshold: float, recall: float, leaf: int = LEAF) -> DataFrame:
    """Pairs of ids whose sketches may reach the threshold, each once.

    ``classes`` has ``id, sig, s0, s1`` and should be cut before.
    """
    enough = _equal_coords() >= least_matches(threshold)
    runs = F.explode(F.array(*[F.xxhash64(F.lit(r), F.lit("run")) for r in range(runs_needed(threshold, recall))]))
    rows = classes.select("id", "sig", runs.alias("path"), F.lit(classes.count()).cast("long").alias("from_n"), "s0", "s1")
    found = []
    for depth in range(1, MAX_DEPTH + 1):
        buckets = _children(rows, branches(threshold))
        if depth > 1:  # later levels are small beside the first; the first is cheaper made anew than kept
            buckets = cut(buckets)
        counts = buckets.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > leaf)
        counts = cut(counts)
        n_large = counts.count()
        large = maybe_broadcast(counts, n_large)
        small = buckets.join(large.select("path"), "path", "left_anti") if n_large else buckets
        a = small.select("path", *[F.col(c).alias(f"{c}_a") for c in ("id", "s0", "s1")])
        b = small.select("path", *[F.col(c).alias(f"{c}_b") for c in ("id", "s0", "s1")])
        found.append(cut(_ordered(a.join(b, "path").where("id_a < id_b").where(enough)).distinct()))
        if not n_large:
            break
        rest = buckets.join(large, "path")
        is_stuck = (F.col("n") >= STUCK * F.col("from_n")) if depth < MAX_DEPTH else F.lit(True)
        if counts.join(buckets.select("path", "from_n").dropDuplicates(["path"]), "path").where(is_stuck).limit(1).count():
            stuck = block_pairs(rest.where(is_stuck), ["path"], "n", ["s0", "s1"]).where(enough)
            found.append(cut(_ordered(stuck).distinct()))
        onward = rest.where(~is_stuck).select("id", "path", F.col("n").alias("from_n"))
        rows = onward.join(classes, "id")
    return reduce(DataFrame.unionByName, found).distinct()


def _similar(left: pa.Table, right: pa.Table) -> pa.Table:
    """Similarities of the pairs of a cell; ``right`` has each set of the cell once."""
    names = ["id_a", "id_b", "similarity"]
    if not left.num_rows or not right.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    runs = right.column("runs").combine_chunks()
    flat, offsets = runs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))]).astype(np.int64)
    at = {k: i for i, k in enumerate(right.column("id").to_pylist())}
    out = []
    for a, b in zip(left.column("id_a").to_pylist(), left.column("id_b").to_pylist()):
        x, y = (flat[offsets[at[k]] : offsets[at[k] + 1]] for k in (a, b))
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both))
    return pa.table([left.column("id_a").combine_chunks(), left.column("id_b").combine_chunks(), pa.array(out, pa.float64())], names=names)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``id_a, id_b, similarity`` of pairs of ids whose sets are in ``id, runs``.

    Pairs are put into cells by the hash of their ends; a cell whose sets would
    be more than ``CELL_RUNS`` is split by the hash of its pairs.  A set goes to
    each of its cells once, however many pairs it has there, and an id with
    many pairs is spread over cells.
    """
    sizes = sets.select("id", F.size("runs").alias("n")).distinct()
    side = max(1, math.ceil(math.sqrt((sizes.agg(F.sum("n")).first()[0] or 0) / CELL_RUNS)))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(side)).cast("int")
    of = lambda c: sizes.select(F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"))
    placed = pairs.select("id_a", "id_b").join(of("a"), "id_a").join(of("b"), "id_b")
    placed = placed.select("id_a", "id_b", (part("id_a") * side + part("id_b")).alias("cell"), (F.col("n_a") + F.col("n_b")).alias("n"))
    weight = placed.groupBy("cell").agg(F.ceil(F.sum("n") / CELL_RUNS).alias("split"))
    placed = placed.join(maybe_broadcast(weight, side * side), "cell")
    placed = cut(placed.select("id_a", "id_b", "cell", F.pmod(F.xxhash64("id_a", "id_b"), F.col("split")).alias("sub")))
    ends = placed.select("cell", "sub", F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    there = ends.join(sets, "id").select(F.col("cell").alias("c"), F.col("sub").alias("s"), F.col("id").alias("id"), F.col("runs").alias("runs"))
    return placed.groupBy("cell", "sub").cogroup(there.groupBy("c", "s")).applyInArrow(_similar, "id_a long, id_b long, similarity double")


def near_copies(
    texts: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, run_words: int = 5, min_words: int = 0, recall: float = 0.99, leaf: int = LEAF, all_texts: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Members of the classes of equal texts, and the links between classes.

    Texts are compared in their consistent form and in lower case, whole, by
    the share of distinct runs of ``run_words`` words that are in both of those
    in either.  Returns ``id, class_id, class_n`` (the class of equal forms is
    named by its least id) and ``id_a, id_b, similarity`` of class ids: nothing is lost,
    as equal texts have the same links.  Null ids are in neither.  Null texts
    and texts of fewer words than ``min_words`` or ``run_words`` have no links
    and are no members, unless ``all_texts`` asks for them: then equal short
    texts are one class, and a null text is one of its own.  Ids are taken to be unique (a row
    given twice counts twice, and is no pair with itself); other columns are
    ignored, empty tables give empty results.
    """
    base = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, f0 long, f1 long, sig binary, s0 long, s1 long"
    signed = cut(base.mapInArrow(_signatures(min_words, run_words, all_texts), schema))
    same = signed.groupBy("f0", "f1").agg(F.min("id").alias("class_id"), F.count("*").alias("class_n"))
    many = cut(same.where("class_n > 1"))
    copies = signed.join(maybe_broadcast(many, many.count()), ["f0", "f1"]).select("id", "class_id", "class_n")
    copies = cut(copies)
    spare = copies.where("id <> class_id").select("id")
    classes = signed.join(maybe_broadcast(spare, spare.count()), "id", "left_anti").where("sig is not null").select("id", "sig", "s0", "s1")
    pairs = cut(candidate_pairs(classes, threshold, recall, leaf))
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    chosen = base.join(maybe_broadcast(ids, pairs.count() * 2), "id", "left_semi")
    sets = cut(chosen.mapInArrow(_sets(run_words), "id long, runs array<long>"))
    links = similarities(pairs, sets).where(F.col("similarity") >= threshold - 1e-12)
    members = signed.select("id").join(spare, "id", "left_anti")
    members = members.join(copies, "id", "left_anti").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_n"))
    members = members.unionByName(copies)
    if all_texts:
        members = members.unionByName(base.where("id is not null and text is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_n")))
    return members, cut(links)


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs of documents: within the classes and across linked ones.

    Only for results that are defined as pairs; use members and links else.
    """
    many = members.where("class_n > 1")
    inside = _ordered(block_pairs(many, ["class_id"], "class_n", []))
    a = members.select(F.col("class_id").alias("ca"), F.col("id").alias("id_1"))
    b = members.select(F.col("class_id").alias("cb"), F.col("id").alias("id_2"))
    across = links.select(F.col("id_a").alias("ca"), F.col("id_b").alias("cb")).join(a, "ca").join(b, "cb")
    return inside.unionByName(_ordered(across.select(F.col("id_1").alias("id_a"), F.col("id_2").alias("id_b")))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (its least id) of all ids of ``id_a, id_b``.

    Large-star and small-star by turns: each step is a map-side combined
    minimum and a join, so that a star's centre is never gathered anywhere.
    """
    links = cut(edges.select(F.greatest("id_a", "id_b").alias("u"), F.least("id_a", "id_b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        links = cut(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't settled after {MAX_ROUNDS} rounds")
    top = links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = top.select(F.col("component").alias("id"), "component").distinct()
    return top.unionByName(roots).distinct()


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, group_id, class_id, n_links``: one row for each document.

    ``group_id`` is the least id of the group of linked documents, ``class_id``
    that of the equal ones, ``n_links`` the number of classes linked to it.
    """
    ends = links.select(F.explode(F.array("id_a", "id_b")).alias("class_id"))
    degree = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    of = components(links).select(F.col("id").alias("class_id"), "component")
    out = members.join(degree, "class_id", "left").join(of, "class_id", "left")
    return out.select("id", F.coalesce("component", "class_id").alias("group_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: The measure of problem 2: three-word runs, similarity 0.6, at least 40 words.
P2 = {"threshold": 0.6, "run_words": 3, "min_words": 40}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of near copies among the bodies."""
    pairs = expand_pairs(*near_copies(table(spark, sf_dir, "page_texts"), "text_id", "body", **P2))
    return pairs.select(F.col("id_a").alias("text_id_a"), F.col("id_b").alias("text_id_b"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of each body of at least 40 words."""
    return groups(*near_copies(table(spark, sf_dir, "page_texts"), "text_id", "body", **P2)).withColumnRenamed("id", "text_id")


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each document at the common measure: five-word runs, 0.8."""
    return groups(*near_copies(table(spark, sf_dir, "documents"), "doc_id", "text", all_texts=True)).withColumnRenamed("id", "doc_id")


ORACLE = {
    "p2_found": f"""WITH f AS (SELECT text_id AS id, {words_sql("lower(" + form_sql("body") + ")")} AS w FROM page_texts WHERE body IS NOT NULL),
s AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM f WHERE len(w) >= 40),
u AS (SELECT id, unnest(s) AS x FROM s), n AS (SELECT id, len(s) AS n FROM s),
c AS (SELECT a.id AS i, b.id AS j, count(*) AS hit FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
SELECT i AS text_id_a, j AS text_id_b FROM c JOIN n a ON i = a.id JOIN n b ON j = b.id WHERE hit >= 0.6 * (a.n + b.n - hit) - 1e-9"""
}
