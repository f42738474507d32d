import random

import pytest

from nearpress.llm import packing as P
from nearpress.llm import tokens as T
from nearpress.llm.common import table

from ..conftest import SF, rows


def pack(spark, sizes, kinds, parts=1, **kw):
    items = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "doc_id long, n_tokens long").repartition(parts)
    containers = spark.createDataFrame(kinds, "container_kind string, capacity_tokens long")
    return P.pack(items, containers, **kw).collect()


def check(out, sizes, kinds):
    room, seen = {}, {}
    for r in out:
        room[r.container_kind, r.container_id] = room.get((r.container_kind, r.container_id), 0) + r.n_tokens
        seen.setdefault((r.container_kind, r.doc_id), []).append((r.part_no, r.first_token, r.n_tokens))
    capacity = dict(kinds)
    assert all(n <= capacity[k] for (k, _), n in room.items())
    assert len(seen) == len(sizes) * len(kinds)
    for (kind, doc), got in seen.items():
        got.sort()
        assert len(got) == max(1, -(-sizes[doc] // capacity[kind])) and [g[0] for g in got] == list(range(len(got)))
        assert sum(g[2] for g in got) == sizes[doc] and all(g[1] == sum(x[2] for x in got[:k]) for k, g in enumerate(got))
    return {k: sum(n for (kk, _), n in room.items() if kk == k) / (capacity[k] * sum(kk == k for kk, _ in room)) for k in capacity}


@pytest.mark.parametrize("parts", [1, 7])
def test_every_item_once_within_capacity(spark, parts):
    r = random.Random(1)
    sizes = [min(5_000, int(r.expovariate(1 / 300))) for _ in range(3_000)]
    kinds = [("s", 512), ("l", 2_048)]
    fill = check(pack(spark, sizes, kinds, parts), sizes, kinds)
    assert fill["s"] > 0.95 and fill["l"] > 0.97


def test_open_containers_are_packed_again(spark, monkeypatch):
    monkeypatch.setattr(P, "FAN_IN", 2)
    sizes, kinds = [30] * 40, [("s", 100)]
    out = pack(spark, sizes, kinds, 9)
    check(out, sizes, kinds)
    assert len({r.container_id for r in out}) <= 20


def test_groups_stay_bounded_however_many_tasks(spark, monkeypatch):
    """The open containers of 2,048 tasks: no group has more than those of its tasks, and few go on."""
    r = random.Random(3)
    bins = [("s", f"s-{t}-{b}", r.randint(1, 900)) for t in range(2_048) for b in range(8)]
    kept = []
    monkeypatch.setattr(P, "cut", lambda df: kept.append(df.cache()) or kept[-1])
    level = spark.createDataFrame(bins, "container_kind string, name string, size long")
    moved = P.packed_again(level, {"s": 1_000}, 2_048, 8)
    steps = kept[:-1]
    assert len(steps) == 3
    sizes = [s.count() for s in steps]
    assert sizes[0] == len(bins) and sizes[1] <= 64 * 8 and sizes[2] <= 2 * 8
    size = {n: x for _, n, x in bins}
    into = {x.name: x.top for x in moved.collect()}
    room = {}
    for n in size:
        room[into.get(n, n)] = room.get(into.get(n, n), 0) + size[n]
    assert max(room.values()) <= 1_000 and len(room) < 0.75 * len(bins)
    assert all(t not in into for t in into.values())


def test_best_fit_equals_search_of_all_open():
    r = random.Random(7)
    for limit in (1, 3, 50):
        fit, bins, made = P.BestFit(100, limit), {}, 0
        for _ in range(500):
            size = r.randint(0, 100)
            fits = sorted((free for free in bins.values() if free >= size))
            got = fit.add(size)
            if fits:
                assert bins[got] == fits[0]
                bins[got] -= size
            else:
                if len(bins) >= limit:
                    least = min(bins.values())
                    gone = next(k for k in sorted(bins, reverse=True) if bins[k] == least and k not in dict(fit.open()))
                    del bins[gone]
                assert got == made
                made += 1
                bins[got] = 100 - size
            bins = {k: f for k, f in bins.items() if f > 0}
            assert dict(fit.open()) == bins and fit.n_open <= limit


def test_edges(spark):
    assert pack(spark, [], [("s", 10)]) == []
    assert pack(spark, [1, 2], []) == []
    out = pack(spark, [0, 0, 10, 25], [("s", 10), (None, 5), ("s", 4), ("zero", 0), ("none", None)])
    assert {r.container_kind for r in out} == {"s"} and sorted((r.doc_id, r.n_tokens) for r in out) == [(0, 0), (1, 0), (2, 10), (3, 5), (3, 10), (3, 10)]
    items = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (None, 5, "b"), (2, None, "c")], "doc_id long, n_tokens int, bin string")
    kinds = spark.createDataFrame([("s", 10)], "container_kind string, capacity_tokens int")
    assert [r.doc_id for r in P.pack(items, kinds).collect()] == [1, 1]
    twice = spark.createDataFrame([("s", 5), ("s", 20), ("s", 10)], "container_kind string, capacity_tokens int")
    got = P.fill(P.pack(items, twice), twice).first()
    assert (got.capacity_tokens, got.n_containers, got.n_tokens, got.fill) == (20, 1, 10, 0.5)


def test_tokens(spark):
    df = spark.createDataFrame([("Hello world, it's 2024!",), ("",), (None,), ("a" * 100_000,)], "t string")
    counts = {}
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"):
        counts[name] = [r.n for r in df.select(T.token_count("t", f"/opt/tokenizers/{name}").alias("n")).collect()]
        assert counts[name][1:3] == [0, None]
    assert counts["byte_bpe_50k.tiktoken"] == counts["byte_bpe_50k.json"]


def test_queries(spark):
    docs = table(spark, SF, "documents").where("text is not null").count()
    out = P.p6_packed(spark, SF)
    assert out.select("container_kind", "doc_id").distinct().count() == 4 * docs
    fill = {r.container_kind: r.fill for r in P.p6_fill(spark, SF).collect()}
    assert set(fill) == {"s", "m", "l", "xl"} and fill["s"] > 0.9


def test_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "containers"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(P.ORACLE["p6_words"])
    assert rows(P.p6_words(spark, SF).select(*want.columns)) == sorted((tuple(r) for r in want.fetchall()), key=repr)
