import itertools
import random

import pytest
from pyspark.sql import functions as F

from nearpress.codecs import Spec
from nearpress.functions.distance import pair_size
from nearpress.operators import analytics, pairs, search, triangle
from nearpress.session import cut, ordinal, scratch


def texts(n, seed=3):
    r = random.Random(seed)
    return [(i, " ".join(r.choices("a b c d e f g h i j k l".split(), k=r.randint(1, 12)))) for i in range(n)]


def token_distance(a, b):
    x, y = set(a.split()), set(b.split())
    return max(len(x - y), len(y - x)) / max(len(x), len(y))


def square(df):
    return {(r.i, r.j): r.d for r in df.collect()}


@pytest.mark.parametrize("block", [3, 64])
def test_self_and_cross(spark, block):
    data = texts(10) + [(10, None)]
    df = spark.createDataFrame(data, "id long, text string")
    spec = Spec("tokenset")
    half = square(pairs.self_distances(df, spec, block))
    want = {(i, j): token_distance(a, b) for (i, a), (j, b) in itertools.combinations_with_replacement(data[:-1], 2)}
    assert half == pytest.approx(want)
    full = square(pairs.mirrored(pairs.self_distances(df, spec, block)))
    assert len(full) == 100 and full[(3, 7)] == full[(7, 3)]
    left = df.where("id < 3")
    assert square(pairs.cross_distances(left, df, spec, block)) == pytest.approx({k: v for k, v in full.items() if k[0] < 3})
    assert square(pairs.token_distances(left, df, block)) == pytest.approx({k: v for k, v in full.items() if k[0] < 3})


def test_real_codec_pairs(spark):
    data = [(i, t * 20) for i, t in texts(5)]
    df = spark.createDataFrame(data, "id long, text string")
    got = square(pairs.self_distances(df, Spec("brotli"), 2))
    of, both = Spec("brotli").make().size, pair_size(Spec("brotli"))
    for (i, j), d in got.items():
        a, b = data[i][1].encode(), data[j][1].encode()
        low, high = sorted((of(a), of(b)))
        assert d == pytest.approx(max(0.0, (both(a, b) - low) / high))


def test_empty_sides(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert pairs.self_distances(df, Spec("tokenset")).count() == 0
    assert pairs.token_distances(df, df).count() == 0


def test_nearest_and_matrix(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.9), (2, 1, 0.5)], "i long, j long, d double")
    got = [(r.i, r.j, r["rank"]) for r in pairs.nearest(df, 2).orderBy("i", "rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2), (2, 1, 1)]
    assert [r.d for r in pairs.wide(df).orderBy("i").collect()] == [[0.0, 0.5, 0.5, 0.9], [0.5]]
    names = spark.createDataFrame([(k, f"n{k}") for k in range(1, 5)], "id long, label string")
    assert pairs.labelled(df, names, names).where("row_label = 'n1' and col_label = 'n4'").first().d == 0.9


def test_nearest_limits_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("i"), F.col("id").alias("j"), F.rand(1).alias("d"))
    plan = pairs.nearest(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("group", [[], ["g"]])
def test_ordinal(spark, group):
    data = [(i % 3, (i * 7) % 100) for i in range(100)]
    df = spark.createDataFrame(data, "g int, v int")
    got = sorted((r.g, r.v, r.n) for r in ordinal(df, ["v"], group, "n").collect())
    seen, want = {}, []
    for g, v in sorted(data, key=lambda x: (x[0], x[1]) if group else x[1]):
        k = g if group else 0
        want.append((g, v, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + 1
    assert got == sorted(want)


def test_triangles(spark):
    edges = [(1, 2, 0.1), (2, 3, 0.1), (1, 3, 0.9), (1, 4, 0.2), (2, 4, 0.2), (3, 4, 0.2), (5, 6, 1.0)]
    df = spark.createDataFrame(edges + [(j, i, d) for i, j, d in edges] + [(1, 1, 0.0)], "i long, j long, d double")
    got = {tuple(r) for r in triangle.triangle_violations(df).collect()}
    want = set()
    side = {(i, j): d for i, j, d in edges}
    for a, b, c in itertools.combinations(range(1, 7), 3):
        if (a, b) in side and (a, c) in side and (b, c) in side:
            x, y, z = side[a, b], side[a, c], side[b, c]
            if 2 * max(x, y, z) > x + y + z + 1e-12:
                want.add((a, b, c, x, y, z))
    assert got == want and len(want) == 2
    with pytest.raises(ValueError, match="triangle"):
        triangle.triangle_violations(df, strict=True)
    assert triangle.triangle_violations(df.where("d < 0.3"), strict=True).count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.3, 0.6, 1.0])
def test_search_by_pivots_equals_brute_force(spark, tolerance):
    data = texts(40, 9)
    d = spark.createDataFrame([(q, x, token_distance(a, b)) for (q, a), (x, b) in itertools.product(data, data)], "q long, x long, d double")
    brute = search.first_match(d, tolerance)
    want = {}
    for q, a in data:
        hits = [x for x, b in data if round(token_distance(a, b) * 10000) <= round(tolerance * 10000)]
        want[q] = (hits[0], hits[0] + 1) if hits else (None, 40)
    assert {r.q: (r.first_x, r.calls) for r in brute.collect()} == want
    chosen = search.pivot_positions(40, 4)
    tab = search.pivot_table(d.where(F.col("q").isin(chosen)))
    left = search.prune(tab.withColumnRenamed("x", "q"), tab, tolerance)
    hits = search.range_search(d.join(left, ["q", "x"], "left_semi"), tolerance)
    assert {tuple(r) for r in hits.collect()} == {tuple(r) for r in search.range_search(d, tolerance).collect()}
    diverged = search.divergence(brute, hits)
    assert diverged.where("mismatch").count() == 0
    calls = left.groupBy("q").agg((F.count("*") + 4).alias("calls"))
    s = search.search_summary(brute, calls, diverged).first()
    assert s.queries == 40 and s.mismatches == 0 and s.avg_brute_calls == sum(v[1] for v in want.values()) // 40
    lost = search.divergence(brute, hits.where("q <> x and q > 1000")).where("mismatch").count()
    assert lost == sum(v[0] is not None for v in want.values())


def test_split_histogram_median(spark):
    m = spark.createDataFrame([(0, 0, 0.1), (0, 1, 1.0), (1, 0, 0.2), (1, 1, 0.3), (0, 2, 1.01), (1, 2, 0.555), (2, 2, -0.1)], "i long, j long, d double")
    s = analytics.related_split(m)
    assert s.count() == 6
    h = {(r.grp[0], r.bin): r.n for r in analytics.histogram(s).collect()}
    assert h == {("S", 10): 1, ("S", 30): 1, ("S", -1): 1, ("D", 99): 1, ("D", 100): 1, ("D", 55): 1}
    got = {r.grp: (r.median, r.label) for r in analytics.group_median(s, [analytics.SAME, analytics.DIFFERENT, "none"]).collect()}
    assert got == {analytics.SAME: (0.1, "0.100"), analytics.DIFFERENT: (1.0, "1.000"), "none": (0.0, "0.000")}
    topics = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id long, topic string")
    by = analytics.split_by_topic(m.where("i = 0"), topics, topics)
    assert by.where("grp = 'Same Subject'").count() == 1


def test_median_with_ties_and_many(spark):
    r = random.Random(5)
    data = [(g, round(r.random(), 2)) for g in ("a", "b", "c") for _ in range({"a": 501, "b": 500, "c": 1}[g])]
    got = {x.grp: x.median for x in analytics.group_median(spark.createDataFrame(data, "grp string, d double")).collect()}
    for g in "abc":
        v = sorted(d for k, d in data if k == g)
        assert got[g] == pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)


def test_best_options_takes_the_first_of_ties(spark):
    rows = [(1, 10, 1, 0.5), (1, 11, 1, 0.9), (2, 10, 1, 0.9), (2, 11, -1, 0.9)]
    best = analytics.best_options(spark.createDataFrame(rows, "quality int, lg_window_size int, sign int, d double")).first()
    assert (best.quality, best.lg_window_size) == (1, 11)


def test_sweep(spark):
    one = spark.createDataFrame([("x", "a b c " * 50)], "name string, text_a string").withColumn("text_b", F.col("text_a"))
    out = analytics.sweep(one, analytics.grid(spark, range(3, 5), range(20, 23))).collect()
    assert len(out) == 6 and all(0 <= r.distance < 0.6 and r.duration_s > 0 for r in out)


def test_topic_pairs(spark):
    four = spark.createDataFrame([(s, s) for s in ("w1", "g1", "w2", "g2")], "slot string, text string")
    got = {(r.text_a, r.text_b): r.sign for r in analytics.topic_pairs(four).collect()}
    assert got == {("w1", "g1"): -1, ("w2", "g2"): -1, ("w1", "w2"): 1, ("g1", "g2"): 1, ("w1", "g2"): 1, ("g1", "w2"): 1}


@pytest.mark.parametrize("tolerance", [0.0, 0.4, 0.8])
def test_indexed_search_measures_only_what_pivots_leave(spark, tolerance):
    data = texts(40, 9)
    pages = spark.createDataFrame(data, "x long, text string")
    asked = pages.where("x % 3 = 0")
    hits, calls = search.indexed_search(pages, asked, Spec("tokenset"), tolerance, 4)
    want = {(q, x) for (q, a), (x, b) in itertools.product(data, data) if q % 3 == 0 and round(token_distance(a, b) * 10000) <= round(tolerance * 10000)}
    assert {(r.q, r.x) for r in hits.collect()} == want
    pivots = search.pivot_positions(40, 4)
    far = {x: [round(token_distance(data[p][1], t) * 10000) for p in pivots] for x, t in data}
    left = {q: sum(all(abs(a - b) <= round(tolerance * 10000) + 1 for a, b in zip(far[q], far[x])) for x in far) for q in far if q % 3 == 0}
    assert {r.q: r.calls for r in calls.collect()} == left
    assert tolerance > 0.5 or sum(left.values()) < 40 * len(left)
    none, no_calls = search.indexed_search(pages.limit(0), pages.limit(0), Spec("tokenset"), tolerance)
    assert none.count() == 0 and no_calls.count() == 0


@pytest.mark.parametrize("cell", [3, 4_096])
def test_listed_pairs(spark, cell, monkeypatch):
    monkeypatch.setattr(pairs, "CELL_PAIRS", cell)
    data = texts(30)
    df = spark.createDataFrame([*data, (50, None)], "id long, text string")
    listed = [(0, k) for k in range(30)] + [(k, 7) for k in range(30)] + [(1, 50), (99, 1), (0, 3)]
    got = square(pairs.listed_distances(spark.createDataFrame(listed, "i long, j long"), df, Spec("tokenset")))
    assert got == pytest.approx({(i, j): token_distance(data[i][1], data[j][1]) for i, j in listed[:60]})


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_texts_are_those_of_all_pairs(spark, k, monkeypatch):
    """Ties, equal texts, nulls and several cells; each two texts are measured once."""
    data = texts(25) + [(30 + n, "a b c") for n in range(6)] + [(40, ""), (41, ""), (42, None), (None, "x")]
    df = spark.createDataFrame(data, "id long, text string")
    asked = df.where("id % 3 = 0 or id > 39")
    want = {tuple(r) for r in pairs.nearest(pairs.cross_distances(asked, df, Spec("brotli")), k).collect()}
    monkeypatch.setattr(pairs, "cross_distances", None)
    monkeypatch.setattr(pairs, "block_rows", lambda n, cores: 5)
    got = pairs.nearest_texts(asked, df, Spec("brotli"), k)
    assert {tuple(r) for r in got.collect()} == want and len(want) == k * len({i for i, t in data if i is not None and t is not None and (i % 3 == 0 or i > 39)})
    assert pairs.nearest_texts(asked.limit(0), df, Spec("brotli"), k).count() == 0 and pairs.nearest_texts(asked, df.limit(0), Spec("brotli"), k).count() == 0


@pytest.mark.parametrize("name", ["nearest_texts_zstd"])
def test_registered_nearest_make_no_list_of_pairs(spark, tmp_path, name, monkeypatch):
    """The nearest by zstd of equal, empty and null pages; of ties the least id."""
    from nearpress.codecs import Zstd
    from nearpress.plans import registry

    data = [(k, None if k == 7 else "" if k == 9 else f"<p>page {k % 6} of words {k % 4}</p>") for k in range(41)]
    spark.createDataFrame(data, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    size, text = Zstd(18).size, {k: t.encode() for k, t in data if t is not None}
    want = set()
    for i in (0, 20, 40):
        found = []
        for j in text:
            low, high = sorted((size(text[i]), size(text[j])))
            both = min(size(text[i] + text[j]), size(text[j] + text[i]))
            found += [(0.0 if both < low else (both - low) / high, j)] * (i != j)
        want.add((i, min(found)[1], min(found)[0]))
    monkeypatch.setattr(pairs, "cross_distances", None)
    assert {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("quality, window", [(0, 18), (1, 10), (5, 21), (9, 16), (10, 22), (11, 24)])
def test_one_call_of_brotli_gives_the_size_of_a_stream(quality, window):
    r = random.Random(quality)
    codec = Spec("brotli", quality=quality, lg_window_size=window).make()
    data = [b"", b"a", r.randbytes(5), r.randbytes(3_000), r.randbytes(59_000), b"ab" * 30_000, b"<p>x</p>" * 9_000]
    data += [bytes(r.choices(b"abcdefgh <>", k=r.randint(1, 4_000))) for _ in range(20)]
    assert [codec.size(d) for d in data] == [codec._streamed(d) for d in data]


def test_blocks_grow_with_the_pairs_and_not_with_the_bytes(spark):
    assert pairs.block_rows(1_000, 8) == 32 and pairs.block_rows(10**12, 8) == 512 and 32 < pairs.block_rows(1_000_000, 8) < 512
    assert pairs._blocks(100, 0, 64) == 2 and pairs._blocks(100, 10 * pairs.BLOCK_BYTES, 64) == 10


class Counted:
    """A cache that counts what it is asked."""

    def __init__(self):
        self.asked, self.kept = [], None

    def known(self, spark, codec):
        self.asked.append(codec.name)
        return self.kept

    def store(self, sizes, codec):
        self.kept = sizes if self.kept is None else self.kept.unionByName(sizes)


def test_caches_on_pair_operators(spark, tmp_path):
    from nearpress.functions.distance import ParquetCache

    df = spark.createDataFrame(texts(12) + [(12, "a b"), (13, "a b")], "id long, text string")
    want = square(pairs.self_distances(df, Spec("brotli"), cache=False))
    own = Counted()
    for _ in range(2):
        assert square(pairs.self_distances(df, Spec("brotli"), cache=own)) == want
    n = df.select("text").distinct().count()
    assert own.asked == ["brotli", "brotli"] and own.kept.count() == n
    kept = ParquetCache(str(tmp_path / "sizes"))
    assert square(pairs.cross_distances(df.where("id < 3"), df, Spec("brotli"), cache=kept)) == pytest.approx({k: v for k, v in square(pairs.mirrored(pairs.self_distances(df, Spec("brotli")))).items() if k[0] < 3})
    assert kept.known(spark, Spec("brotli")).select("h0", "h1").distinct().count() == n
    assert kept.known(spark, Spec("zstd")) is None


def test_divergence_counts_without_gathering(spark):
    brute = spark.createDataFrame([(1, 3, 4), (2, None, 9), (3, 5, 6), (4, None, 9)], "q long, first_x long, calls long")
    hits = spark.createDataFrame([(1, 3, 1), (1, 8, 1), (3, 9, 2), (4, 1, 1)], "q long, x long, d_scaled long")
    got = {r.q: (r.brute_x, r.in_pruned, r.n_pruned, r.mismatch) for r in search.divergence(brute, hits).collect()}
    assert got == {1: (3, True, 2, False), 2: (None, False, 0, False), 3: (5, False, 1, True), 4: (None, False, 1, True)}


def test_scratch_removes_its_checkpoints(spark):
    import os

    root = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(root))
    with scratch():
        made = cut(spark.range(10).select((F.col("id") * 2).alias("x")))
        assert set(os.listdir(root)) - before and made.count() == 10
    assert not set(os.listdir(root)) - before
    kept = cut(spark.range(3).toDF("y"))
    assert kept.count() == 3 and set(os.listdir(root)) - before
