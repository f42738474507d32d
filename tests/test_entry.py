"""All queries against DuckDB on a small scale, streams, SQL functions and the command line."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from nearpress import cli, datasets
from nearpress.codecs import Spec
from nearpress.functions.sqlfuncs import register_all
from nearpress.plans import oracles, registry
from nearpress.streaming import measurements

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def canon(df: pd.DataFrame, columns):
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(value(x.item() if hasattr(x, "item") else x) for x in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got, list(want.columns)) == canon(want, list(want.columns))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(oracles.ORACLES)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    out = __spark_entry__.entry(spark).collect()
    assert out and {r["rank"] for r in out} <= {1, 2, 3, 4, 5}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sql_functions(spark):
    names = register_all(spark)
    assert "ncd_distance_zstd" in names
    r = spark.sql("select ncd_distance_tokenset('a b', 'b c') d, ncd_size_tokenset('a a b') c, html_structure('<p id=x>t') h, clean_text('a , b') t, html_distance('<p>a', '<p>b') z, wiki_content(null) w").first()
    assert (r.d, r.c, r.h, r.t, r.w) == (0.5, 2, '<html><head /><body><p id="x"></p></body></html>', "a, b", None)
    assert 0 <= r.z < 0.2


EIGHT = "one two three four five six seven eight"


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "twin"
    for kind, tag in (("wiki", "p"), ("page", "span")):
        (root / kind).mkdir(parents=True)
        for t in ("Alpha", "Beta", "Gamma"):
            (root / kind / f"{t}.html").write_text(f"<html><body><article><{tag} class='{t}'>{t} {EIGHT} {t * 5}</{tag}></article></body></html>")
    lines = ["url, type"] + [f'"https://e.org/{k}/{t}", "{"wiki" if k == "wiki" else "grok"}"' for k in ("wiki", "page") for t in ("Alpha", "Beta", "Gamma")]
    (root / "dataset.csv").write_text("\n".join(lines))
    return str(root)


def test_command_line(spark, corpus, capsys):
    assert cli.heatmap(spark, corpus, Spec("brotli")).count() == 36
    assert cli.triangle_inequality(spark, corpus, Spec("tokenset")).count() == 0
    m = cli.wiki_vs_grok(spark, corpus)
    assert m.count() == 9 and m.columns == ["i", "j", "wiki_label", "grok_label", "d"]
    h, med = cli.distribution(m)
    assert h.agg({"n": "sum"}).first()[0] == 6 and med.count() == 2
    s = cli.bk_tree(spark, corpus, 0.25, Spec("tokenset")).first()
    assert s.queries == 6 and s.mismatches == 0
    assert cli.bk_tree(spark, corpus).first().queries == 6
    four = [f"{corpus}/{k}/{t}.html" for t in ("Alpha", "Beta") for k in ("wiki", "page")]
    best = cli.optimal_opts(spark, *four).first()
    assert 1 <= best.quality <= 11 and 10 <= best.lg_window_size <= 22
    cli.main(["same-page", four[0]])
    assert "lg_window_size" in capsys.readouterr().out
    dropped = datasets.extracted(datasets.load(spark, corpus).withColumn("page_type", datasets.F.lit("user")), "drop")
    assert dropped.count() == 0
    with pytest.raises(Exception, match="no article text"):
        datasets.extracted(datasets.load(spark, corpus).withColumn("page_type", datasets.F.lit("user"))).collect()


def test_commands_take_the_usual_datasets_and_codec(monkeypatch):
    seen = []
    monkeypatch.setattr(cli, "heatmap", lambda s, f, **kw: seen.append(f) or s.range(1))
    cli.main(["--base", "/data", "heatmap"])
    assert seen == ["/data/euronews.com", "/data/amazon", "/data/imdb", "/data/wikipedia"]
    assert cli.CODEC == "brotli_recommended"


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    table = spark.read.parquet(f"{SF}/pivot_distances.parquet")
    table.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(table.schema).parquet(src)
    key = ["page_id", "pivot_id", "codec", "quality", "lg_window_size", "measured_at"]
    assert drain(spark, measurements.new_measurements(stream, "3650 days"), "new_rows").count() == table.select(key).distinct().count()
    counts = drain(spark, measurements.window_counts(stream, late="0 seconds"), "windows", "complete")
    assert counts.agg({"n": "sum"}).first()[0] == table.count()
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.write.parquet(str(tmp_path / "pages"))
    sized = drain(spark, measurements.page_sizes(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "pages")), Spec("brotli")), "sized")
    assert sized.count() == pages.count()
