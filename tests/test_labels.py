import pytest

from nearpress.functions import distance, labels


def label(spark, url, kind, **kw):
    return spark.createDataFrame([(url, kind)], "u string, k string").select(labels.page_label("u", "k", **kw).alias("l")).first().l


def test_labels(spark):
    # fixed values: urls and the labels they must give
    assert label(spark, "https://en.wikipedia.org/wiki/Cretaceous", "article") == "/wiki/Cretaceous 📄"
    assert label(spark, "https://en.wikipedia.org/wiki/Pseudastacus", " Article ") == "/wiki/Pseudastac… 📄"
    assert label(spark, "no scheme", "") == "/ "
    assert label(spark, "https://e.org/x", "unheard of") == "/x "
    assert label(spark, None, "wiki") is None


def test_unknown_type_strict(spark):
    with pytest.raises(Exception, match="unknown page type"):
        label(spark, "https://e.org/x", "unheard of", strict=True)


def test_short_label(spark):
    assert spark.createDataFrame([("/a/b 📄",)], "l string").select(labels.short_label("l").alias("s")).first().s == "b 📄"


def test_buckets_and_scale(spark):
    q = spark.createDataFrame([(k,) for k in (0, 2, 3, 5, 6, 8, 9, 22, None)], "q int")
    assert [r.b for r in q.select(labels.quality_bucket("q").alias("b")).collect()] == ["0-2", "0-2", "3-5", "3-5", "6-8", "6-8", "9+", "9+", None]
    d = spark.createDataFrame([(0.00005,), (0.12344,), (1.5,), (None,)], "d double")
    assert [r.s for r in d.select(distance.scaled("d").alias("s")).collect()] == [1, 1234, 15000, None]


def test_hover(spark):
    r = spark.createDataFrame([(5, 21), (3, None)], "quality int, w int").select(labels.hover_text("w", "quality").alias("h")).collect()
    assert [x.h for x in r] == ["lg_window: 21, quality: 5", "lg_window: -, quality: 3"]
