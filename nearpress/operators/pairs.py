"""Distances of pairs of texts.

A pair operator takes two sides with ``id`` and ``text``.  Both are cut into
blocks, the blocks meet in cells by an equi-join, and a cell is worked on as a
whole: a Python worker gets each text of a cell once, not once a pair.  Blocks
are as large as the pairs allow while every core still has cells to work on,
and never of more than a number of bytes, so a large job moves each text less
often and memory stays bounded.  Sizes of single texts are worked out before,
once for each distinct text, or taken from a cache.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearpress.codecs import Spec
from nearpress.functions.distance import Cache, compressed_size, distance, pair_size, sizes_of
from nearpress.session import cut, small, spread

#: Least and most rows of a block, bytes of one, and cells for each core.
BLOCK = 32
MOST_ROWS = 512
BLOCK_BYTES = 32 << 20
CELLS_A_CORE = 16
#: Rows of a block where no text is held.
TOKEN_BLOCK = 512
#: Pairs of a cell where the pairs are given.
CELL_PAIRS = 4_096

_PAIR_NAMES = ["i", "j", "c_i", "c_j", "c_ij"]
_PAIRS = "i long, j long, c_i long, c_j long, c_ij long"


def _blocked(df: DataFrame, blocks: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))


def _measured(df: DataFrame) -> tuple[int, int]:
    """Rows of a side, and bytes of its texts."""
    size = F.sum(F.octet_length("text")) if "text" in df.columns else F.lit(0)
    n, size = df.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return n, size


def block_rows(n_pairs: int, cores: int) -> int:
    """Rows of a block, so that the cells of all pairs occupy the cores."""
    return int(min(MOST_ROWS, max(BLOCK, math.sqrt(n_pairs / (CELLS_A_CORE * max(1, cores))))))


def _blocks(n: int, size: int, rows: int) -> int:
    return max(1, math.ceil(n / rows), math.ceil(size / BLOCK_BYTES))


def _cells(left: DataFrame, right: DataFrame, block: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``lb, rb``, each row in every cell of its block; parted by cells."""
    (n, size), (m, other) = _measured(left), _measured(right)
    rows = block or block_rows(n * m, left.sparkSession.sparkContext.defaultParallelism)
    n_left, n_right = _blocks(n, size, rows), _blocks(m, other, rows)
    left = _blocked(left, n_left, "lb").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    right = _blocked(_fresh(right), n_right, "rb").withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    return tuple(spread(x, "lb", "rb", groups=n_left * n_right) for x in (left, right))


def cell_sides(left: DataFrame, right: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides, with ``id, text``, in cells ``lb, rb`` for operators of other modules."""
    return _cells(left, right, block)


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns as new ones: a table may meet itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _half_cells(df: DataFrame, block: int | None) -> tuple[DataFrame, DataFrame]:
    """A table with itself in the cells ``lb <= rb``."""
    n, size = _measured(df)
    n = _blocks(n, size, block or block_rows(n * n // 2, df.sparkSession.sparkContext.defaultParallelism))
    left = _blocked(df, n, "lb").withColumn("rb", F.explode(F.sequence(F.col("lb"), F.lit(n - 1))))
    right = _blocked(_fresh(df), n, "rb").withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("rb"))))
    return tuple(spread(x, "lb", "rb", groups=n * (n + 1) // 2) for x in (left, right))


def _cell_distances(codec: Spec, half: bool):
    def op(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # a side without rows has no columns either
            return pa.table([pa.array([], pa.int64())] * 5, names=_PAIR_NAMES)
        size = pair_size(codec)
        a = list(zip(*(left.column(c).to_pylist() for c in ("id", "text", "c"))))
        b = [(j, u.encode(), cj) for j, u, cj in zip(*(right.column(c).to_pylist() for c in ("id", "text", "c")))]
        own = half and left.num_rows and left.column("lb")[0].as_py() == left.column("rb")[0].as_py()
        out: list[list[int]] = [[], [], [], [], []]
        for i, t, ci in a:
            x = t.encode()
            for j, y, cj in b:
                if own and j < i:
                    continue
                row = (i, j, ci, cj, size(x, y)) if not half or i <= j else (j, i, cj, ci, size(x, y))
                for column, value in zip(out, row):
                    column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=_PAIR_NAMES)

    return op


def _rows(df: DataFrame, codec: Spec, cache: bool | Cache) -> DataFrame:
    return sizes_of(df.select(F.col("id").cast("long").alias("id"), "text").where("id is not null and text is not null"), "text", codec, cache=cache)


def _finished(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("d", distance("c_i", "c_j", "c_ij"))


def _in_cells(a: DataFrame, b: DataFrame, op) -> DataFrame:
    return a.groupBy("lb", "rb").cogroup(b.groupBy("lb", "rb")).applyInArrow(op, _PAIRS)


def cross_distances(left: DataFrame, right: DataFrame, codec: Spec, block: int | None = None, cache: bool | Cache = True) -> DataFrame:
    """``i, j, c_i, c_j, c_ij, d`` of every row of one side with every row of the other.

    Meant for a stated set against a table.  Rows with a null id or text have
    no pair.  ``cache`` is that of ``sizes_of``.
    """
    a, b = _cells(cut(_rows(left, codec, cache)), cut(_rows(right, codec, cache)), block)
    return _finished(_in_cells(a, b, _cell_distances(codec, False)))


def self_distances(df: DataFrame, codec: Spec, block: int | None = None, cache: bool | Cache = True) -> DataFrame:
    """``i, j, c_i, c_j, c_ij, d`` of every unordered pair ``i <= j``, each with itself included."""
    a, b = _half_cells(cut(_rows(df, codec, cache)), block)
    return _finished(_in_cells(a, b, _cell_distances(codec, True)))


def _listed(codec: Spec):
    def op(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names=_PAIR_NAMES)
        size = pair_size(codec)
        of = {k: (t.encode(), c) for k, t, c in zip(*(right.column(x).to_pylist() for x in ("id", "text", "c")))}
        out: list[list[int]] = [[], [], [], [], []]
        for i, j in zip(left.column("i").to_pylist(), left.column("j").to_pylist()):
            (x, ci), (y, cj) = of[i], of[j]
            for column, value in zip(out, (i, j, ci, cj, size(x, y))):
                column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=_PAIR_NAMES)

    return op


def listed_distances(listed: DataFrame, texts: DataFrame, codec: Spec, cache: bool | Cache = True) -> DataFrame:
    """``i, j, c_i, c_j, c_ij, d`` of the pairs ``i, j`` that are listed, of one table of texts.

    Nothing else is compressed together.  Pairs are put into cells by the hash
    of their ends, a cell of too many is split by the hash of its pairs, and a
    text goes to each of its cells once.  Pairs of which an end has no text
    drop out.
    """
    rows = cut(_rows(texts, codec, cache))
    listed = listed.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct()
    for end in ("i", "j"):
        listed = listed.join(rows.select(F.col("id").alias(end)), end, "left_semi")
    listed = cut(listed)
    n = listed.count()
    cell_pairs = min(CELL_PAIRS, max(1, n // (CELLS_A_CORE * listed.sparkSession.sparkContext.defaultParallelism)))
    side = max(1, math.ceil(math.sqrt(n / cell_pairs)))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side)).cast("int")
    placed = listed.withColumn("cell", part("i") * side + part("j"))
    weight = placed.groupBy("cell").agg(F.ceil(F.count("*") / cell_pairs).alias("parts"))
    placed = cut(placed.join(small(weight, side * side), "cell").select("i", "j", "cell", F.pmod(F.xxhash64("i", "j"), F.col("parts")).alias("sub")))
    ends = placed.select(F.col("cell").alias("c_cell"), F.col("sub").alias("c_sub"), F.explode(F.array("i", "j")).alias("id")).distinct()
    there = ends.join(rows, "id")
    placed, there = spread(placed, "cell", "sub", groups=side * side).groupBy("cell", "sub"), spread(there, "c_cell", "c_sub", groups=side * side).groupBy("c_cell", "c_sub")
    return _finished(placed.cogroup(there).applyInArrow(_listed(codec), _PAIRS))


def mirrored(pairs: DataFrame) -> DataFrame:
    """The full square of a half: pairs off the diagonal a second time, turned."""
    turned = pairs.where("i <> j").select(*[F.col(b).alias(a) for a, b in _turn(pairs.columns)])
    return pairs.unionByName(turned)


def _turn(columns: list[str]) -> list[tuple[str, str]]:
    swap = {"i": "j", "j": "i", "c_i": "c_j", "c_j": "c_i"}
    return [(c, swap.get(c, c)) for c in columns]


def tokens(text: Column | str) -> Column:
    """Distinct pieces between single spaces."""
    return F.array_distinct(F.filter(F.split(F.col(text) if isinstance(text, str) else text, " "), lambda t: t != ""))


def hashed_tokens(text: Column | str) -> Column:
    """The distinct pieces by their hashes, which are smaller to move and to compare."""
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def token_distances(left: DataFrame, right: DataFrame, block: int = TOKEN_BLOCK) -> DataFrame:
    """``i, j, c_i, c_j, c_ij, d`` by the stand-in codec, without Python."""
    a, b = (cut(d.select(F.col("id").cast("long").alias("id"), hashed_tokens("text").alias("t")).where("id is not null and t is not null")) for d in (left, right))
    a, b = _cells(a, b, block)
    pairs = a.select("lb", "rb", F.col("id").alias("i"), F.col("t").alias("t_i")).join(b.select("lb", "rb", F.col("id").alias("j"), F.col("t").alias("t_j")), ["lb", "rb"])
    sized = pairs.select("i", "j", F.size("t_i").cast("long").alias("c_i"), F.size("t_j").cast("long").alias("c_j"), F.size(F.array_intersect("t_i", "t_j")).alias("both"))
    return _finished(sized.withColumn("c_ij", F.col("c_i") + F.col("c_j") - F.col("both")).drop("both"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest others of each ``i``, of ties the least ``j``; ``rank`` from 1.

    A rank limit of a window: the planner keeps the best ``k`` of each ``i`` in
    every task before the exchange.
    """
    order = Window.partitionBy("i").orderBy("d", "j")
    ranked = pairs.where("i <> j and d is not null").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("i", "j", "d", "rank")


def _nearest_of_cell(codec: Spec, k: int):
    def op(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            size = pair_size(codec)
            b = [(u.encode(), cj, ids) for u, cj, ids in zip(*(right.column(c).to_pylist() for c in ("text", "c", "ids")))]
            for i, t, ci in zip(*(left.column(c).to_pylist() for c in ("id", "text", "c"))):
                x = t.encode()
                found: list[tuple[float, int]] = []
                for y, cj, ids in b:
                    low, high, both = min(ci, cj), max(ci, cj), size(x, y)
                    d = 0.0 if both < low or high == 0 else (both - low) / high
                    found += [(d, j) for j in ids]
                out += [(i, j, d) for d, j in heapq.nsmallest(k + 1, found)]
        i, j, d = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(d, pa.float64())], names=["i", "j", "d"])

    return op


def nearest_texts(left: DataFrame, right: DataFrame, codec: Spec, k: int) -> DataFrame:
    """``nearest`` of ``cross_distances``, of which only the nearest leave a cell.

    Equal texts are measured once.  Of the ids of a text the least ``k + 1``
    are looked at: one may be the query itself, and of ties the least count.
    """
    key = ["h0", "h1"]
    keyed = lambda df: df.select(F.col("id").cast("long").alias("id"), "text", F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(7), "text").alias("h1")).where("id is not null and text is not null")
    asked, rows = keyed(left), keyed(right)
    firsts = rows.select(*key, "id").withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("r") <= k + 1)
    ids = firsts.groupBy(*key).agg(F.collect_list("id").alias("ids"))
    once = lambda df: df.groupBy(*key).agg(F.min("id").alias("id"), F.min_by("text", "id").alias("text")).withColumn("c", compressed_size("text", codec))
    queries = cut(once(asked))
    a, b = _cells(queries.select("id", "text", "c"), cut(once(rows).join(ids, key).select("id", "text", "c", "ids")), None)
    near = a.groupBy("lb", "rb").cogroup(b.groupBy("lb", "rb")).applyInArrow(_nearest_of_cell(codec, k), "i long, j long, d double")
    of = asked.select("id", *key).join(queries.select(*key, F.col("id").alias("rep")), key).select("id", "rep")
    return nearest(near.join(of, F.col("i") == F.col("rep")).select(F.col("id").alias("i"), "j", "d"), k)


def wide(pairs: DataFrame) -> DataFrame:
    """``i, d``: the row of each ``i`` as an array in the order of ``j``.

    For matrices to be looked at: a row is held whole.
    """
    return pairs.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "d"))).alias("r")).select("i", F.transform("r", lambda x: x["d"]).alias("d"))


def labelled(pairs: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Heatmap data: ``i, j, row_label, col_label, d``; both tables have ``id, label``."""
    r = rows.select(F.col("id").alias("i"), F.col("label").alias("row_label"))
    c = columns.select(F.col("id").alias("j"), F.col("label").alias("col_label"))
    return pairs.join(r, "i").join(c, "j").select("i", "j", "row_label", "col_label", "d")
