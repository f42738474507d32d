import pytest
from pyspark.sql import functions as F

from nearpress.sources import manifest, urls


def one(spark, column, *values, schema="v string"):
    df = spark.createDataFrame([values], schema) if schema else values
    return df.select(column.alias("out")).first().out


# Urls and the paths they must give.
@pytest.mark.parametrize(
    ("url", "path"),
    [
        ("https://en.wikipedia.org/wiki/Abbasiya", "wiki/Abbasiya.html"),
        ("http://en.wikipedia.org/wiki/Cretaceous", "wiki/Cretaceous.html"),
        ("https://en.wikipedia.org/wiki/Category:Jurassic_crustaceans", "wiki/Category:Jurassic_crustaceans.html"),
        ("https://en.wikipedia.org/wiki/User:Lavalizard101", "wiki/User:Lavalizard101.html"),
        ("https://en.wikipedia.org/wiki/", "wiki/index.html"),
        ("https://example.com", ""),
        ("https://www.amazon.com/s?k=gaming", "s?k=gaming.html"),
    ],
)
def test_file_path(spark, url, path):
    assert one(spark, urls.url_file_path("v"), url) == path


# Urls and the names they must give.
@pytest.mark.parametrize(
    ("url", "stem"),
    [
        ("https://grokipedia.com/page/Appin%2C_New_South_Wales", "page/Appin,_New_South_Wales"),
        ("https://www.amazon.com/s?k=cleaning+tools", "s?k=cleaning+tools"),
        ("https://example.com", None),
        ("example.com/x", None),
        ("https://a.b/x%zz", "x%zz"),
        ("https://a.b/x%ff", None),
        ("https://a.b/", ""),
        (None, None),
    ],
)
def test_stem(spark, url, stem):
    assert one(spark, urls.url_stem("v"), url) == stem


def test_domain_keeps_port(spark):
    assert one(spark, urls.url_domain("v"), "https://u@a.b:8080/x") == "u@a.b:8080"


def test_parse_line(spark):
    parse = manifest.parse_line("v")
    assert tuple(one(spark, parse, '"https://e.org/wiki/Appin,_New_South_Wales", "wiki"')) == ("https://e.org/wiki/Appin", "_New_South_Wales")
    assert tuple(one(spark, parse, ' "https://e.org/t/?ref_=x", "movie" ')) == ("https://e.org/t/?ref_=x", "movie")
    assert one(spark, parse, "") is None
    assert one(spark, parse, None) is None


@pytest.fixture
def dataset(tmp_path):
    root = tmp_path / "data"
    (root / "wiki" / "Dir").mkdir(parents=True)
    (root / "wiki" / "A.html").write_text("<p>a</p>")
    (root / "wiki" / "A.txt").write_text("second")
    (root / "wiki" / "B,C.txt").write_text("b")
    (root / "wiki" / "Dir" / "index.html").write_text("dir")
    (root / "wiki" / "Empty").mkdir()
    (root / "plain").write_text("plain")
    (tmp_path / "secret.txt").write_text("no")
    lines = ["url, type", '"https://e.org/wiki/A", "wiki"', "", '"https://e.org/wiki/B%2CC", "grok"', '"https://e.org/wiki/Dir", "user"', '"https://e.org/wiki/Empty", "user"', '"https://e.org/../secret", "user"', '"https://e.org/plain", "tag"', '"https://e.org/wiki/A", "wiki"', '"https://e.org/x,y", "wiki"']
    (root / "dataset.csv").write_text("\r\n".join(lines))
    return str(root)


def test_manifest_to_files(spark, dataset):
    rows = manifest.read_manifest(spark, dataset)
    assert [r.pos for r in rows.orderBy("pos").collect()] == [0, 2, 3, 4, 5, 6, 7, 8]
    found = manifest.resolve(rows, manifest.list_files(spark, dataset)).orderBy("pos").collect()
    assert [(r.pos, r.filepath) for r in found] == [(0, "wiki/A.html"), (2, "wiki/B,C.txt"), (3, "wiki/Dir/index.html"), (6, "plain"), (7, "wiki/A.html")]
    quoted = manifest.read_manifest(spark, dataset, "csv").where("pos = 8").first()
    assert (quoted.url, quoted.page_type) == ("https://e.org/x,y", "wiki")
    with pytest.raises(ValueError):
        manifest.read_manifest(spark, dataset, "other")


def test_first_by_url_and_content(spark, dataset):
    rows = manifest.read_manifest(spark, dataset)
    first = {r.url: r.pos for r in manifest.first_by_url(rows).collect()}
    assert first["https://e.org/wiki/A"] == 0
    texts = {r.filepath: r.content for r in manifest.read_texts(spark, dataset).collect()}
    assert texts["wiki/A.html"] == "<p>a</p>"


def test_write_new_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "filepath string, n int")
    out = str(tmp_path / "out")
    manifest.write_new(df, out)
    manifest.write_new(df.unionByName(spark.createDataFrame([("c", 3)], df.schema)), out)
    assert sorted(r.filepath for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_topic(spark):
    assert one(spark, urls.topic("v"), "https://e.org/wiki/Halophila%20x") == "halophila x"
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_a_manifest_is_read_in_pieces(spark, tmp_path):
    """Lines keep their order and numbers however the file is cut."""
    root = tmp_path / "many"
    root.mkdir()
    lines = [f'"http://a.example/{k}", "t{k}"' if k % 7 else "" for k in range(5_000)]
    (root / "dataset.csv").write_text("url, type\r\n" + "\r\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [(r.pos, r.url, r.page_type) for r in manifest.read_manifest(spark, str(root)).orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(k, f"http://a.example/{k}", f"t{k}") for k in range(5_000) if k % 7]


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "good.txt").write_text("é")
    assert [tuple(r) for r in manifest.read_texts(spark, str(tmp_path)).collect()] == [("good.txt", "é")]
    (tmp_path / "bad.txt").write_bytes(b"a\xff")
    with pytest.raises(Exception, match="UTF"):
        manifest.read_texts(spark, str(tmp_path)).collect()
    assert {r.filepath: r.content for r in manifest.read_texts(spark, str(tmp_path), "replace").collect()} == {"good.txt": "é", "bad.txt": "a�"}
    assert {r.filepath: r.content for r in manifest.read_texts(spark, str(tmp_path), "null").collect()} == {"good.txt": "é", "bad.txt": None}
