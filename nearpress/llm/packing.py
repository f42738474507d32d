"""Problem 6: filling containers of fixed capacity, by bounded-space best fit.

Texts are packed as they are read.  A task holds a fixed number of open
containers for each capacity, in a bitset keyed by free space: an item goes
into the one with the least space that holds it, and when there are too many
open ones the fullest closes.  Only a text larger than the capacity is split:
into full containers and a rest that is packed like any other item.

Containers a task leaves open and not nearly full are packed again, whole, in
groups of a bounded number of tasks.  A group passes on at most as many open
containers as a task, the emptiest; so no task ever holds more than
``FAN_IN * OPEN_BINS`` of a capacity, however many tasks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpress.llm.common import cut, maybe_broadcast, table
from nearpress.llm.tokens import TOKENIZER, token_count

#: Open containers of each capacity in a task.
OPEN_BINS = 64
#: Tasks whose open containers are packed again in one group.
FAN_IN = 32
#: Share of the capacity from which an open container is full enough to be left as it is.
FULL = 0.95
MOST_PARTITIONS = 2_000


class BestFit:
    """Bounded-space online best fit for one capacity."""

    def __init__(self, capacity: int, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.bits, self.by_free, self.n_open, self.made = 0, {}, 0, 0

    def _push(self, name: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(name)
        self.bits |= 1 << free
        self.n_open += 1

    def _pop(self, free: int) -> int:
        names = self.by_free[free]
        name = names.pop()
        if not names:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return name

    def add(self, size: int) -> int:
        """Number of the container the item goes into; ``size`` is at most the capacity."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            name = self._pop(free)
        else:
            if self.n_open >= self.limit:  # the fullest closes
                self._pop((self.bits & -self.bits).bit_length() - 1)
            name, free = self.made, self.capacity
            self.made += 1
        if free > size:
            self._push(name, free - size)
        return name

    def open(self) -> list[tuple[int, int]]:
        """The open containers and their free space."""
        return [(name, free) for free, names in sorted(self.by_free.items()) for name in names]


def parts(size: int, capacity: int) -> list[tuple[int, int]]:
    """Start and size of the parts of an item: one, unless it exceeds the capacity."""
    if size <= capacity:
        return [(0, size)]
    return [(a, min(capacity, size - a)) for a in range(0, size, capacity)]


_PACKED = "container_kind string, task int, bin long, doc_id long, part_no int, first_token long, n_tokens long, free long"


def _pack(kinds: list[tuple[str, int]], limit: int):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        fits = {k: BestFit(c, limit) for k, c in kinds}
        for batch in batches:
            out: list[tuple] = []
            for doc, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, capacity in kinds:
                    for no, (first, n) in enumerate(parts(size, capacity)):
                        out.append((kind, task, fits[kind].add(n), doc, no, first, n, None))
            yield _batch(out)
        # what is still open: a row without a document
        yield _batch([(kind, task, name, None, 0, 0, 0, free) for kind, f in fits.items() for name, free in f.open()])

    return op


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["container_kind", "task", "bin", "doc_id", "part_no", "first_token", "n_tokens", "free"]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def repacked(rows: list[tuple[str, int]], capacity: int, limit: int) -> list[tuple[str, str, int, bool]]:
    """``name, top, size, goes_on`` for open containers packed as items.

    ``rows`` are names and sizes; ``top`` names the container one goes into and
    ``size`` is what that holds.  Of what isn't full the ``limit`` emptiest go on.
    """
    fit, first, used, into = BestFit(capacity, max(1, len(rows))), {}, {}, []
    for name, size in sorted(rows, key=lambda r: (-r[1], r[0])):
        at = fit.add(size)
        into.append((name, first.setdefault(at, name)))
        used[first[at]] = used.get(first[at], 0) + size
    low = sorted((size, top) for top, size in used.items() if size < FULL * capacity)[:limit]
    on = {top for _, top in low}
    return [(name, top, used[top], top in on) for name, top in into]


_STEP = "container_kind string, name string, top string, size long, goes_on boolean"


def _repack(capacity: dict[str, int], limit: int):
    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, int], list] = {}
        for batch in batches:
            for kind, group, name, size in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault((kind, group), []).append((name, size))
        for (kind, _), rows in groups.items():
            names, tops, sizes, on = zip(*repacked(rows, capacity[kind], limit))
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(tops, pa.string()), pa.array(sizes, pa.int64()), pa.array(on, pa.bool_())],
                names=["container_kind", "name", "top", "size", "goes_on"],
            )

    return op


def packed_again(level: DataFrame, capacity: dict[str, int], tasks: int, limit: int) -> DataFrame:
    """``name, top``: where open containers (``container_kind, name, size``) go."""
    moved, n = None, tasks
    while True:
        n = -(-n // FAN_IN)
        # a group has the open containers of about FAN_IN tasks, by the hash of their names
        level = level.select("container_kind", F.pmod(F.xxhash64("name"), F.lit(n)).alias("group"), "name", "size")
        step = cut(level.repartition(min(n * len(capacity), MOST_PARTITIONS), "container_kind", "group").mapInArrow(_repack(capacity, limit), _STEP))
        hop = step.select("name", "top")
        moved = hop if moved is None else moved.join(hop.select(F.col("name").alias("top"), F.col("top").alias("next")), "top", "left").select("name", F.coalesce("next", "top").alias("top"))
        if n == 1:
            return cut(moved.where("name <> top"))
        level = step.where("goes_on").select("container_kind", F.col("top").alias("name"), "size").distinct()


def pack(items: DataFrame, containers: DataFrame, limit: int = OPEN_BINS) -> DataFrame:
    """``container_kind, container_id, doc_id, part_no, first_token, n_tokens``.

    ``items`` has ``doc_id, n_tokens``; rows with a null in either are left
    out, an empty text takes part with 0 tokens, rows given twice are packed
    twice.  ``containers`` has ``container_kind, capacity_tokens``: a table of
    kinds, which has to be small (at most 1,000); kinds that are null or of no
    capacity are left out, of kinds given twice the largest counts.  Every
    item is assigned once for each kind.  Without kinds the result is empty.
    """
    usable = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("c")).where("container_kind is not null and c > 0")
    found = usable.groupBy("container_kind").agg(F.max("c").alias("c")).orderBy("container_kind").limit(1_001).collect()
    if len(found) > 1_000:
        raise ValueError("containers is a table of kinds; it has more than 1,000")
    kinds = [(r[0], r[1]) for r in found]
    items = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"))
    packed = cut(items.where("doc_id is not null and n_tokens is not null").mapInArrow(_pack(kinds, limit), _PACKED))
    packed = packed.withColumn("name", F.concat_ws("-", "container_kind", "task", "bin"))
    capacity = dict(kinds)
    of_kind = F.create_map(*[F.lit(x) for k, c in kinds for x in (k, c)]) if kinds else None
    opened = packed.where("doc_id is null")
    if of_kind is None:
        return packed.select("container_kind", F.col("name").alias("container_id"), "doc_id", "part_no", "first_token", "n_tokens").where("doc_id is not null")
    level = opened.select("container_kind", "name", (of_kind[F.col("container_kind")] - F.col("free")).alias("size"))
    level = level.where(F.col("size") < of_kind[F.col("container_kind")] * FULL)
    moved = packed_again(level, capacity, packed.rdd.getNumPartitions(), limit)
    rows = packed.where("doc_id is not null").join(maybe_broadcast(moved, moved.count()), "name", "left")
    return rows.select("container_kind", F.coalesce("top", "name").alias("container_id"), "doc_id", "part_no", "first_token", "n_tokens")


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of the documents with a text."""
    return documents.where("text is not null").select("doc_id", token_count("text", tokenizer).alias("n_tokens"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text assigned to containers of each capacity."""
    return pack(token_sizes(table(spark, sf_dir, "documents")), table(spark, sf_dir, "containers"))


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``container_kind, capacity_tokens, n_containers, n_tokens, fill`` of what ``pack`` returns.

    Of a kind given twice the largest capacity counts, as in ``pack``.
    """
    out = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    kinds = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    out = out.join(kinds, "container_kind")
    return out.select("container_kind", "capacity_tokens", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used of each kind, tokens in them and the share of room filled."""
    return fill(p6_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def p6_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packing by words, which SQL can count: texts, parts, words and overfull containers of each kind."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    items = docs.select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("n_tokens"))
    containers = table(spark, sf_dir, "containers")
    packed = cut(pack(items, containers))
    room = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n")).join(containers, "container_kind")
    over = room.groupBy("container_kind").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_over"))
    texts = packed.groupBy("container_kind").agg(F.countDistinct("doc_id").alias("n_texts"), F.count("*").alias("n_parts"), F.sum("n_tokens").alias("n_words"))
    return texts.join(over, "container_kind")


ORACLE = {
    "p6_words": """WITH s AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL)
SELECT container_kind, count(*) AS n_texts, CAST(sum(greatest(1, (n + capacity_tokens - 1) // capacity_tokens)) AS BIGINT) AS n_parts, CAST(sum(n) AS BIGINT) AS n_words, 0::BIGINT AS n_over
FROM s, containers GROUP BY container_kind"""
}
