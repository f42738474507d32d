import pickle
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearpress.codecs import Brotli, Spec, TokenSet, Zstd, register_codec
from nearpress.functions import distance as D
from nearpress.functions.distance import pair_size


def plain(a: str, b: str, spec: Spec) -> float:
    x, y = a.encode(), b.encode()
    low, high = sorted((spec.make().size(x), spec.make().size(y)))
    both = pair_size(spec)(x, y)
    return 0.0 if both < low or not high else (both - low) / high


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))


def test_edge_sizes():
    assert Zstd(18).size(b"") == 9
    assert Brotli(5, 21).size(b"") == 1 and Brotli(5, 10).size(b"") == 2
    assert TokenSet().size(b"a  b a") == 2


def test_brotli_window_and_long_input():
    data = (words(1, 4_000) * 2).encode()
    assert Brotli(5, 24).size(data) < Brotli(5, 10).size(data)
    assert Brotli(1, 10).size(random.Random(0).randbytes(300_000)) > 290_000


@pytest.mark.parametrize("bad", [("zstd", {"quality": 23}), ("brotli", {"quality": 12}), ("brotli", {"lg_window_size": 9}), ("gone", {})])
def test_wrong_parameters(bad):
    with pytest.raises(ValueError):
        Spec(bad[0], **bad[1])


@pytest.mark.parametrize("name", ["zstd_recommended", "brotli_recommended"])
def test_self_and_other_distance(name):
    spec, a, b = Spec(name), words(1, 400), words(2, 400)
    assert plain(a, a, spec) < 0.1
    assert plain(a, b, spec) > 0.8
    assert plain(a, a.replace("a", "a", 1) + " x", spec) < 0.15


def test_spec_travels():
    spec = pickle.loads(pickle.dumps(Spec("brotli_max")))
    assert spec.params == {"quality": 11, "lg_window_size": 24} and spec.make().size(b"abc") > 0


class Half:
    def size(self, data: bytes) -> int:
        return len(data) // 2


def test_own_codec(spark):
    register_codec("half", Half)
    df = spark.createDataFrame([("abcd",), (None,)], "t string")
    assert [r.c for r in df.select(D.compressed_size("t", Spec("half")).alias("c")).collect()] == [2, None]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.text(max_size=200))
def test_symmetric_and_not_negative(a, b):
    for spec in (Spec("zstd", quality=3), Spec("brotli"), Spec("tokenset")):
        assert plain(a, b, spec) == plain(b, a, spec) >= 0


def test_columns_agree_with_plain(spark):
    rows = [(words(i, 60), words(i % 3, 60)) for i in range(6)] + [("", ""), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    for spec in (Spec("brotli"), Spec("zstd"), Spec("tokenset")):
        got = [r.d for r in df.select(D.ncd("a", "b", spec).alias("d")).collect()]
        want = [None if a is None else plain(a, b, spec) for a, b in rows]
        assert got == pytest.approx(want) if None not in want else [g is None or round(g, 9) for g in got] == [w is None or round(w, 9) for w in want]


def test_distance_from_sizes(spark):
    df = spark.createDataFrame([(10, 20, 25), (10, 20, 5), (0, 0, 0), (10, 20, 45), (None, 1, 1)], "a long, b long, ab long")
    assert [r.d for r in df.select(D.distance("a", "b", "ab").alias("d")).collect()] == [0.75, 0.0, 0.0, 1.75, None]


def test_sizes_once_each(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id int, t string")
    for cache in (True, False):
        out = {r.id: r.c for r in D.sizes_of(df, "t", Spec("tokenset"), cache=cache).collect()}
        assert out == {1: 2, 2: 2, 3: 1, 4: None}
    stats = D.cache_stats(df, "t").first()
    assert (stats.lookups, stats.misses, stats.hits) == (3, 2, 1)
    assert tuple(D.cache_stats(df.limit(0), "t").first()) == (0, 0, 0)
