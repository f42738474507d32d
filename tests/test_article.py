import pytest

from nearpress.functions import article
from nearpress.functions.article import GROK, WIKI, article_content, clean_text


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ('He said " hello " .', 'He said "hello".'),
        ("John's book [1] is it's", "John's book is it's"),
        ("dogs' tails", "dogs'tails"),
        ('( see "x" )', '(see "x")'),
        ("do n't", "don't"),
        ("a [b [c] d] e", "a d] e"),
        ("a [never closed", "a [never closed"),
        ("  a\n\tb   c  ", "a b c"),
        ("", ""),
        ("one , two . three ; four : five ! six ? (seven )", "one, two. three; four: five! six? (seven)"),
        ("she 's and they 're", "she's and they're"),
    ],
)
def test_clean_text(raw, clean):
    assert clean_text(raw) == clean


SEVEN = "one two three four five six seven"
EIGHT = SEVEN + " eight"


def test_paragraphs_of_a_wiki_page():
    page = f"""<body><p>{EIGHT} outside</p><div id="bodyContent"><p>{EIGHT}<b> nine</b></p><p>{SEVEN}</p><table><tr><td><p>{EIGHT} in table</p></table>
    <div class="infobox x"><p>{EIGHT} in box</p></div><ul class="toc"><li><p>{EIGHT} in toc</p></ul><aside><p>{EIGHT} aside</p></aside>
    <div id="references"><p>{EIGHT} refs</p></div><span id="references"><p>{EIGHT} kept</p></span></div></body>"""
    assert article_content(page, *WIKI) == f"{EIGHT} nine\n\n{EIGHT} kept"


def test_container_order_and_none():
    assert article_content(f"<main><p>{EIGHT} m</p></main><article><p>{EIGHT} a</p></article>", *WIKI) == f"{EIGHT} a"
    assert article_content("<p>short</p>", *WIKI) is None
    assert article_content("", *WIKI) is None
    assert article_content(f"<p>{EIGHT}</p>", ("div#none",), "p") is None


def test_nested_spans_repeat():
    page = f"<article><span>{EIGHT} <span>{EIGHT} inner</span></span></article>"
    assert article_content(page, *GROK) == f"{EIGHT} {EIGHT} inner\n\n{EIGHT} inner"


def test_bad_selector():
    with pytest.raises(ValueError):
        article_content("<p>", ("a > b",), "p")


def test_columns(spark):
    df = spark.createDataFrame([(f"<article><p>{EIGHT}</p><span>{EIGHT} s</span></article>", k) for k in ("wiki", "grok", "user", None)] + [(None, "wiki")], "h string, k string")
    out = [r.c for r in df.select(article.content_by_type("h", "k").alias("c")).collect()]
    assert out == [EIGHT, f"{EIGHT} s", None, None, None]
    both = df.select(article.wiki_content("h").alias("w"), article.grok_content("h").alias("g")).first()
    assert (both.w, both.g) == (EIGHT, f"{EIGHT} s")


def test_basic_steps_agree_without_quotes(spark):
    raw = "a [1] b\n c , d . (e ) f : g ; h ! i ?"
    df = spark.createDataFrame([(raw,)], "t string")
    r = df.select(article.clean_text_basic("t").alias("b"), article.clean("t").alias("c")).first()
    assert r.b == r.c == "a b c, d. (e) f: g; h! i?"
