import duckdb
import pytest

from nearpress.llm import sitelines as S

from ..conftest import SF, rows


@pytest.mark.parametrize("name", sorted(S.ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("page_texts", "entries"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(S.ORACLE[name])
    got = getattr(S, name)(spark, SF).select(*want.columns)
    assert rows(got) == sorted((tuple(r) for r in want.fetchall()), key=repr)


def make(spark, texts, entries):
    t = spark.createDataFrame(texts, "text_id long, filepath string, body string, host string, line string, n int")
    e = spark.createDataFrame(entries, "filepath string, url string, body string")
    return t, e


def case(n=6):
    notice = ["Page 1 of Site", "page  2 OF site", "PAGE 33 of site\t", "page 4 of site", "Page 5 of site ", "Page 6 of site"]
    texts = [(k, f"f{k}", f"own text {chr(97 + k)}\n{notice[k % 6]}\n\n{notice[k % 6]}", "x", "y", 1) for k in range(n)]
    return texts, [(f"f{k}", f"https://{'A' if k % 2 else 'a'}.Example/p/{k}", "b") for k in range(n)]


def test_variants_of_a_line_are_one(spark):
    texts, entries = case()
    found = rows(S.repeated_occurrences(*make(spark, texts, entries)))
    assert found == sorted((k, n) for k in range(6) for n in (1, 3))
    clean = {r.text_id: r.body for r in S.remove_lines(make(spark, texts, entries)[0], S.repeated_occurrences(*make(spark, texts, entries))).collect()}
    assert clean[2] == "own text c\n"


def test_thresholds(spark):
    texts, entries = case(4)
    assert rows(S.repeated_occurrences(*make(spark, texts, entries))) == []
    assert len(rows(S.repeated_occurrences(*make(spark, texts, entries), min_docs=4))) == 8
    texts, entries = case(6)
    more = [(100 + k, f"g{k}", f"other {chr(97 + k % 26)}{chr(97 + k // 26)}", "", "", 0) for k in range(114)]
    args = make(spark, texts + more, entries + [(f"g{k}", "http://a.example/", "") for k in range(114)])
    assert len(rows(S.repeated_occurrences(*args))) == 12  # 6 of 120 is five in a hundred
    args = make(spark, texts + more + [(900, "h", "last", "", "", 0)], entries + [(f"g{k}", "http://a.example/", "") for k in range(114)] + [("h", "http://a.example/x", "")])
    assert rows(S.repeated_occurrences(*args)) == []


def test_a_line_said_often_in_few_texts_is_not_repeated(spark):
    texts = [(k, f"f{k}", "same\n" * 9, "", "", 0) for k in range(4)] + [(9, "f9", "other", "", "", 0)]
    assert rows(S.repeated_occurrences(*make(spark, texts, [(f"f{k}", "http://a.example/", "") for k in (0, 1, 2, 3, 9)]))) == []


def test_edges(spark):
    texts, entries = case()
    odd = [(50, None, "x\nPage 1 of Site", "", "", 0), (51, "none", "Page 1 of Site", "", "", 0), (52, "f52", None, "", "", 0), (53, "f53", "", "", "", 0), (None, "f54", "Page 1 of site", "", "", 0)]
    entries = entries + entries + [(None, "http://a.example/", ""), ("f52", "http://a.example/", ""), ("f53", None, ""), ("f53", "no url", "")]
    t, e = make(spark, texts + texts[:1] + odd, entries)
    found = S.repeated_occurrences(t, e)
    assert rows(found) == sorted((k, n) for k in range(6) for n in (1, 3))
    kept = {r.text_id: r.body for r in S.remove_lines(t, found).collect()}
    assert kept[52] is None and kept[53] == "" and kept[51] == "Page 1 of Site"
    t, e = make(spark, [], [])
    assert rows(S.repeated_occurrences(t, e)) == []
    big = [(k, f"f{k}", "z" * 300_000 + f"\nPage {k} of site", "", "", 0) for k in range(6)]
    assert len(rows(S.repeated_occurrences(*make(spark, big, entries)))) == 12


def test_ids_far_apart_and_a_hot_host(spark):
    texts = [(k * 40_000 - 100_000, f"f{k}", f"mine {chr(97 + k % 26)}{chr(97 + k // 26)}\nall the same", "", "", 0) for k in range(300)]
    t, e = make(spark, texts, [(f"f{k}", "http://hot.example/", "") for k in range(300)])
    assert len(rows(S.repeated_occurrences(t, e))) == 300


def test_bitmaps_stay_small_however_far_apart_the_ids_are(spark):
    """300 hosts of 10 texts whose ids are a million apart: some bytes a line, not a piece of 4 KB."""
    texts = [(((k * 7_919) % 3_000) * 1_000_000, f"f{k}", "all the same\nmine " + f"{k:b}".translate({48: "a", 49: "b"}), "", "", 0) for k in range(3_000)]
    t, e = make(spark, texts, [(f"f{k}", f"http://h{k % 300}.example/", "") for k in range(3_000)])
    often = S.often_lines(S.hashed_lines(t), S.placed_texts(t, e), S.MIN_DOCS, S.MIN_SHARE)
    held = S.repeated_lines(often, S.MIN_DOCS, S.MIN_SHARE).selectExpr("count(*) n", "sum(length(bits)) size").first()
    assert held.n == 300 and held.size <= 600
    assert S.repeated_occurrences(t, e).count() == 3_000


def test_bitmaps_of_many_pieces(spark):
    ids = spark.range(0, 200_000, 3).selectExpr("'s' as site", "id as at")
    held = S.bitmaps(ids, ["site"], "at").collect()
    assert len(held) == 7 and sum(int.from_bytes(r.bits, "big").bit_count() for r in held) == 66_667
    few = spark.createDataFrame([("s", 32_767), ("s", 32_768), ("s", 40_000), ("s", 0)], "site string, at long")
    assert sorted((r.piece, r.low, len(r.bits)) for r in S.bitmaps(few, ["site"], "at").collect()) == [(1, 0, 4_096), (2, 0, 905)]
