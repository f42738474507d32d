import re
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from nearpress.llm import lookalike as L

from ..conftest import SF, rows


def plain(text):
    """The same form, sign by sign, by the standard library."""
    out = []
    for ch in text:
        cp, cat = ord(ch), unicodedata.category(ch)
        if cat == "Cf" or (cat == "Cc" and ch not in "\t\n\x0b\x0c\r\x85") or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F:
            continue
        todo = [ch]
        while todo:
            c = todo.pop(0)
            d = unicodedata.decomposition(c).split()
            if d and d[0][0] == "<" and (d[0] not in L.SAME_LOOK or (d[1] == "0020" and len(d) > 2)):
                d = []
            if d:
                todo = [chr(int(x, 16)) for x in d if x[0] != "<"] + todo
            else:
                out.append(L.LOOKALIKES.get(c, c))
    # what is left counts: a hidden sign may stand between a carriage return and its line feed
    return unicodedata.normalize("NFC", re.sub("\r+\n", "\n", "".join(out)))


def form(*texts):
    return L.form_array(pa.array(list(texts), pa.string())).to_pylist()


def test_examples():
    assert form("café", "café", "ﬁne", "Ｆｕｌｌ　ｗ", "a​b­", "q̣̇", None, "") == ["café", "café", "fine", "Full w", "ab", "q̣̇", None, ""]
    assert form("Мoре")[0] == form("Mopе")[0]
    a, b, c = form("cafe", "café", "cafés")
    assert len({a, b, c}) == 3
    assert form("a  b") != form("a b") and form("a\n\nb") != form("a\nb") and form("a\r\nb") == form("a\nb")
    assert form("²", "½", "¨") == ["²", "½", "¨"]


def test_returns_styles_and_hangul():
    assert form("a\r\x1f\nb", "a\r\r\nb", "a\rb", "\r") == ["a\nb", "a\nb", "a\rb", "\r"]
    assert form("\u13aa\u13f4\u13df", "ꓮꓐꓚ", "ⒶⒷ") == ["ABC", "ABC", "ⒶⒷ"]
    assert form("𝐇𝐞𝐥𝐥𝐨 ℝ", "a\u1680b") == ["Hello R", "a b"]
    assert form("\u1112\u1161\u11ab\uae00", "\ud558\u11ab", "\ud55c\u11ab", "\u1161\u11ab") == ["한글", "한", "한\u11ab", "\u1161\u11ab"]
    assert form("\u1112", "\u1161") == ["\u1112", "\u1161"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="\u1100\u1112\u1161\u1175\u11a7\u11a8\u11c2\uac00\uac01\ud55c\u0301a\r\n", max_size=12), max_size=5))
def test_hangul_equals_sign_by_sign(texts):
    assert form(*texts) == [plain(t) for t in texts]


def test_marks_do_not_join_another_text():
    assert form("e", "́", "e") == ["e", "́", "e"]


SIGNS = "aeoZ 1-\n\ŗ̣́̈̂éüññﬁﬀ​­﻿ 　Ａｂ１АеоЖйЁіοΒ´²ỆÅﬆ‐한"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=SIGNS, max_size=30) | st.none(), max_size=8))
def test_equals_sign_by_sign(texts):
    assert form(*texts) == [None if t is None else plain(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_of_a_form_is_itself(text):
    text = text.encode("utf-8", "ignore").decode()
    once = form(text)[0]
    assert form(once)[0] == once


def test_chunks(monkeypatch):
    monkeypatch.setattr(L, "CHUNK_CODE_POINTS", 10)
    texts = ["é" * 25, "a", "ｂ" * 9, None, "", "ñ"]
    assert form(*texts) == ["é" * 25, "a", "b" * 9, None, "", "ñ"]


def pairs(spark, data, schema="k long, v string", words=0):
    df = spark.createDataFrame(data, schema)
    return {tuple(r) for r in L.same_look_pairs(df, "k", "v", L.consistent_form("value"), words).collect()}


def test_pairs(spark):
    data = [(1, "café x"), (2, "café x"), (3, "café x"), (4, "cafe x"), (5, None), (None, "café x"), (6, ""), (7, ""), (8, "​"), (2, "café x")]
    assert pairs(spark, data) == {(1, 2), (2, 3), (6, 8), (7, 8)}
    assert pairs(spark, data, words=3) == set()
    assert pairs(spark, []) == set()
    clash = [(1, "a​", "f", 1, "v"), (2, "a", "f", 2, "v")]
    assert pairs(spark, clash, "k long, v string, form string, id int, value string") == {(1, 2)}


def test_many_equal_ones_and_one_other(spark):
    data = [(k, "a b c") for k in range(2_000)] + [(5_000, "a b c"), (5_001, "x" * 200_000 + "é"), (5_002, "x" * 200_000 + "é")]
    got = pairs(spark, data)
    assert len(got) == 2_001 and (5_001, 5_002) in got


def test_queries(spark):
    out = L.p5_found(spark, SF)
    assert out.columns == ["field_kind", "id_a", "id_b"] and out.where("id_a >= id_b").count() == 0
    assert L.p5_forms(spark, SF).count() > 0
    texts = spark.createDataFrame([(k, "w " * 39 + x) for k, x in ((1, "é"), (2, "é"), (3, ""))], "text_id long, body string")
    assert rows(L.same_look_pairs(texts, "text_id", "body", L.consistent_form("value"), 40)) == [(1, 2)]
