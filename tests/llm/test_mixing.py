import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearpress.llm import mixing as M

from ..conftest import SF, rows

DOCS = "doc_id long, source string, n_tokens long"
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def test_water_filling():
    assert M.water_fill({"a": 0.5, "b": 0.5}, {"a": 100, "b": 1000}, 400) == {"a": 100.0, "b": 300.0}
    assert M.water_fill({"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 10, "b": 30, "c": 1000}, 200) == {"a": 10.0, "b": 30.0, "c": 160.0}
    assert M.water_fill({"a": 1.0}, {"a": 5}, 100) == {"a": 5.0}
    assert M.water_fill({}, {}, 10) == {}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0.01, 1), st.floats(0, 1000)), min_size=1), st.floats(0, 5000))
def test_water_filling_is_feasible_and_fair(sources, total):
    w, cap = {s: x for s, (x, _) in sources.items()}, {s: c for s, (_, c) in sources.items()}
    got = M.water_fill(w, cap, total)
    assert all(got[s] <= cap[s] + 1e-6 for s in w)
    assert sum(got.values()) == pytest.approx(min(total, sum(cap.values())), abs=1e-6)
    open_ = [s for s in w if got[s] < cap[s] - 1e-6]
    level = [got[s] / w[s] for s in open_]
    if level:
        assert max(level) == pytest.approx(min(level), abs=1e-6)
        assert all(got[s] / w[s] <= max(level) + 1e-6 for s in w)


def docs(n=4_000, seed=2):
    r = random.Random(seed)
    return [(k, r.choices(["hot", "mid", "tiny"], [30, 9, 1])[0], r.randint(1, 200)) for k in range(n)]


def report(spark, mixed, targets):
    return {(r.mix_name, r.source): r for r in M.mix_report(mixed, targets).collect()}


def test_shares_and_caps(spark):
    d = spark.createDataFrame(docs(), DOCS)
    t = spark.createDataFrame([("m", "hot", 0.5, 1), ("m", "mid", 0.4, 2), ("m", "tiny", 0.1, 4), ("n", "mid", 0.5, 1), ("n", "tiny", 0.5, 3)], TARGETS)
    out = M.mix(d, t).cache()
    got = report(spark, out, t)
    for key, r in got.items():
        assert r.reached_share == pytest.approx(r.target_share, abs=0.005), key
        assert r.most_repeats <= {("m", "hot"): 1, ("m", "mid"): 2, ("m", "tiny"): 4, ("n", "mid"): 1, ("n", "tiny"): 3}[key]
    assert out.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0
    again = M.mix(d.repartition(7), t)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in out.collect()}
    other = M.mix(d, t, seed=1)
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in out.collect()}


def test_given_total_clamps(spark):
    d = spark.createDataFrame([(k, "a" if k < 10 else "b", 100) for k in range(110)], DOCS)
    t = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 1)], TARGETS)
    got = report(spark, M.mix(d, t, 8_000), t)
    assert got["m", "a"].n_tokens == 2_000 and got["m", "a"].most_repeats == 2 and got["m", "b"].n_tokens == 6_000
    all_ = report(spark, M.mix(d, t, 10**9), t)
    assert all_["m", "b"].n_tokens == 10_000


def test_edges(spark):
    d = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, None, 5), (None, "a", 5), (3, "a", None), (4, "a", 0), (5, "c", 7)], DOCS)
    t = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "gone", 0.5, 1), (None, "a", 1.0, 1), ("m", None, 0.1, 1), ("z", "a", None, 1), ("m", "a", 0.1, 3)], TARGETS)
    out = M.mix(d, t).collect()
    assert sorted((r.mix_name, r.doc_id, r.repeats) for r in out) == [("m", 1, 1), ("m", 1, 1)]
    r = report(spark, M.mix(d, t), t.where("mix_name = 'm' and max_repeats = 1 and source is not null"))
    assert r["m", "gone"].n_tokens == 0 and r["m", "a"].reached_share == 1.0
    none = spark.createDataFrame([], DOCS)
    assert M.mix(none, t).count() == 0 and M.mix(d, t.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a", 10, 3, "x", 1.0)], DOCS + ", place int, part string, rest double")
    assert M.mix(clash, t).count() == 1


def test_one_place_for_many(spark):
    """Ties of size and a source of one row."""
    d = spark.createDataFrame([(k, "a", 1) for k in range(1_000)] + [(5_000, "b", 100)], DOCS)
    t = spark.createDataFrame([("m", "a", 0.9, 1), ("m", "b", 0.1, 1)], TARGETS)
    got = report(spark, M.mix(d, t), t)
    assert got["m", "a"].n_tokens == 900 and got["m", "b"].n_tokens == 100


def test_queries(spark):
    got = M.p7_report(spark, SF).collect()
    assert len(got) == 17 and all(0 <= r.reached_share <= 1 for r in got)


def test_mixes_as_large_as_their_sources(spark):
    got = M.p7_filled(spark, SF).collect()
    assert len(got) == 17 and any(r.reached_share < r.target_share - 0.02 for r in got) and any(r.reached_share > r.target_share + 0.02 for r in got)
    caps = {(r.mix_name, r.source): r.max_repeats for r in M.table(spark, SF, "mix_targets").collect()}
    assert all(r.most_repeats <= caps[r.mix_name, r.source] for r in got)


def test_amounts_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "mix_targets"):
        con.sql(f"create view {t} as select * from read_parquet('{SF.replace('0.001', '0.01')}/{t}.parquet')")
    want = con.sql(M.ORACLE["p7_amounts"])
    out = M.p7_amounts(spark, SF.replace("0.001", "0.01"))
    assert rows(out.select(*want.columns)) == sorted((tuple(r) for r in want.fetchall()), key=repr)
    assert out.where("clamped").count() > 0 and out.where("not clamped").count() > 0


def test_targets_that_do_not_count_take_no_room(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_TARGETS", 2)
    d = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], DOCS)
    t = spark.createDataFrame([("m", f"x{k}", 0.0, 1) for k in range(9)] + [("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], TARGETS)
    assert {r.doc_id for r in M.mix(d, t).collect()} == {1, 2}
