import random

import pytest

from nearpress.llm import nearcopies as N
from nearpress.llm.common import table
from nearpress.llm.lookalike import form_array

from ..conftest import SF

import pyarrow as pa


def brute(rows, threshold, run_words, min_words):
    """All pairs by their sets of runs."""
    sets = {}
    for i, text in rows:
        if i is None or text is None:
            continue
        w = form_array(pa.array([text]))[0].as_py().lower().split()
        if len(w) >= max(min_words, run_words):
            sets[i] = {tuple(w[k : k + run_words]) for k in range(len(w) - run_words + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-12}


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc long, body string")
    return {(r.id_a, r.id_b) for r in N.expand_pairs(*N.near_copies(df, "doc", "body", **kw)).collect()}


def text(r, n=60):
    return " ".join("".join(r.choices("abcdefghijkl", k=5)) for _ in range(n))


def edited(r, base, edits):
    w = base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = "zz" + str(r.randrange(999))
    return " ".join(w)


def test_given_texts_equal_brute_force(spark):
    rows = [(r.text_id, r.body) for r in table(spark, SF, "page_texts").collect()]
    assert found(spark, rows, **N.P2) == brute(rows, 0.6, 3, 40)
    assert {(r.text_id_a, r.text_id_b) for r in N.p2_found(spark, SF).collect()} == brute(rows, 0.6, 3, 40)


@pytest.mark.parametrize("leaf", [2, 64])
def test_groups_larger_than_a_leaf(spark, leaf, monkeypatch):
    """A third of the rows are copies of one text with small edits; buckets split, stick and are cut in blocks."""
    monkeypatch.setattr(N, "BLOCK", 7)
    r = random.Random(4)
    base = text(r, 80)
    rows = [(k, edited(r, base, r.randrange(4))) for k in range(40)] + [(100 + k, text(r)) for k in range(80)] + [(300, base), (301, base)]
    want = brute(rows, 0.6, 3, 0)
    got = found(spark, rows, threshold=0.6, run_words=3, recall=0.999, leaf=leaf)
    assert not got - want
    assert len(want & got) >= 0.99 * len(want) and len(want) > 700


def test_recall_just_above_the_threshold(spark):
    r = random.Random(8)
    rows = []
    for k in range(150):
        base = text(r, 90)
        rows += [(2 * k, base), (2 * k + 1, edited(r, base, 6))]
    want = brute(rows, 0.6, 3, 0)
    got = found(spark, rows, threshold=0.6, run_words=3, leaf=8)
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 100


def test_order_and_insertions_do_not_hide_copies(spark):
    r = random.Random(2)
    parts = [text(r, 30) for _ in range(4)]
    rows = [(1, " ".join(parts)), (2, " ".join(reversed(parts))), (3, " ".join(parts + ["and one more line"])), (4, text(r, 100))]
    assert found(spark, rows) == brute(rows, 0.8, 5, 0) == {(1, 2), (1, 3)}


def test_edges(spark):
    r = random.Random(1)
    base = text(r, 50)
    very_long = " ".join([base] * 2_000)
    rows = [(None, base), (1, None), (2, ""), (3, "two words"), (4, base), (5, base), (5, base), (6, base.upper() + "  "), (7, very_long), (8, very_long + " end")]
    assert found(spark, rows) == {(4, 5), (4, 6), (5, 6), (4, 7), (5, 7), (6, 7), (4, 8), (5, 8), (6, 8), (7, 8)} & brute([(i, t) for i, t in rows if i is not None], 0.8, 5, 0)
    assert found(spark, []) == set()
    df = spark.createDataFrame([(1, base, 0, "x"), (2, base, 0, "y")], "doc long, body string, id int, path string").withColumnRenamed("path", "class_id")
    members, links = N.near_copies(df, "doc", "body")
    assert {tuple(x) for x in members.collect()} == {(1, 1, 2), (2, 1, 2)} and links.count() == 0


def test_groups_and_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (3, 4), (4, 5), (20, 5), (9, 8)], "id_a long, id_b long")
    got = {tuple(x) for x in N.components(edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (20, 1), (7, 7), (8, 7), (9, 7)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "id_a long, id_b long")
    assert {x.component for x in N.components(chain).collect()} == {0}
    out = N.p2_groups(spark, SF)
    assert out.columns == ["text_id", "group_id", "class_id", "n_links"] and out.where("group_id > class_id").count() == 0


def test_number_of_runs():
    assert N.runs_needed(0.6, 0.99, 4) == 5 and N.runs_needed(0.9, 0.99, 4) < 5
    assert 0.6 < N.survival(0.6, 4) < 0.7
    # at whatever depth buckets end, and below a half too
    for t in (0.1, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0):
        assert 1 - (1 - N.survival(t, N.MAX_DEPTH)) ** N.runs_needed(t, 0.99) >= 0.99 and N.runs_needed(t, 0.99) < 20
    with pytest.raises(ValueError):
        N.branches(0.01)


def test_low_thresholds(spark):
    r = random.Random(5)
    rows = []
    for k in range(60):
        base = text(r, 60)
        rows += [(2 * k, base), (2 * k + 1, edited(r, base, 14))]
    want = brute(rows, 0.3, 3, 0)
    got = found(spark, rows, threshold=0.3, run_words=3, leaf=4)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 30


def test_cells_are_split(spark, monkeypatch):
    """One text linked to all others, and cells of few runs: every pair is checked once."""
    monkeypatch.setattr(N, "CELL_RUNS", 200)
    sets = spark.createDataFrame([(k, list(range(k, k + 50))) for k in range(80)], "id long, runs array<long>")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 80)] + [(k, k + 1) for k in range(1, 79)], "id_a long, id_b long")
    got = {(r.id_a, r.id_b): r.similarity for r in N.similarities(pairs, sets).collect()}
    assert len(got) == 157 and all(x == max(0, 50 - b + a) / (50 + min(50, b - a)) for (a, b), x in got.items())
    assert N.similarities(pairs.limit(0), sets.limit(0)).count() == 0


def test_every_document_has_a_group(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "two words"), (5, "Two  words".replace("  ", " ")), (6, "a b c d e f"), (7, "A b c d e f"), (8, None), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc long, body string")
    got = {r.id: r.group_id for r in N.groups(*N.near_copies(df, "doc", "body", all_texts=True)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    docs = table(spark, SF, "documents").count()
    assert N.p2_documents(spark, SF).count() == docs
