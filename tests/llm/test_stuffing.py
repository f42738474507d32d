import pyarrow as pa
from pyspark.sql import functions as F

from nearpress.llm import stuffing as S

from ..conftest import SF

#: Words are learned from the table: the cases stand among these documents.
AROUND = "/root/testdata/sf0.01/documents.parquet"

PROSE = "The remote harbour belongs to sailors who restored the quiet library in the winter. Most readers remember how Elskara formally funded its sensor and the shrine. After the war, villages slowly painted every bridge around the lake. "


def measured(spark, texts):
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in enumerate(texts)], "doc_id long, text string, id int, n_words string")
    around = spark.read.parquet(AROUND).select((-F.col("doc_id") - 1).alias("doc_id"), "text", F.lit(0).alias("id"), F.lit("").alias("n_words"))
    return {r.id: r for r in S.stuffing(df.unionByName(around), "doc_id", "text").where("id >= 0").collect()}


def flagged(spark, texts):
    return {k for k, r in measured(spark, texts).items() if r.flagged}


SPAM = [
    "public choir offer | public choir online | best public choir | public choir | online public choir | public choir sale",
    "#AmberFestivalDamp #OnlineFree-shippingPaintedStadium #CheapDiscount #Furnace #WovenVelmira #BestFurnace #Near-me #Electric #Turbine",
    "Beetle M vivid SKU27046 || pottery L forgotten No14309 662.99 || harvest 38 mm vivid SKU51134 307.99 || sonata copper No46180",
    "\n".join(f"VIVID CANAL NEAR {x}" for x in "ELROTH ZEVKU ORLESK ELLENIS QUILDREK".split()),
    "Buy steep molecule today. Our steep molecule is the best steep molecule for masons. This steep molecule beats any steep molecule in Elba. Order steep molecule, get steep molecule.",
    "Clinic Northern\nDunbo Terrace Sturdy\nElskan Top Lumron Saddle\nSteep\nSculpture Hybrid Online",
    "Tags: hondo taller, rural faro, hondo tallers, hondo taller comprar, rural faro en-línea, rural faro nuevo",
    "best deal - https://shop.a1.example/x cheap - https://shop.b2.example/y/z price Karrisk pont - http://c.example/ new - http://d.example/",
    "<a href=\"http://a.example/x\">bright fossil</a>\n<a href='http://b.example/'>cheap Karrisk canal</a> <a href=\"https://c.example/y\">Ordreth</a>",
    "#Amber #Furnace #Best",
    "council layered lattice folded regiment new hollow bridge near-me library layered lattice tunnel layered lattice",
]


def test_spam(spark):
    texts = [*SPAM, *(t.upper() for t in SPAM)]
    assert flagged(spark, [*texts, PROSE]) == set(range(len(texts)))


OTHERS = [
        PROSE, None, "", "Title Only", "Lonely",
        "Kot śpi na płocie obok domu. Dzieci wracają ze szkoły późnym popołudniem. Rzeka płynie powoli przez miasto. Wieczorem zapalają się lampy.",
        "Kissa nukkuu aidalla talon vieressä. Lapset palaavat koulusta iltapäivällä. Joki virtaa hitaasti kaupungin läpi.",
        "Śpij, kochany, noc już blisko\nKsiężyc patrzy w okno twe\nCicho szumi stara rzeka\nWiatr kołysze senne mgły",
        "The Old Harbour Library of the North\nBridge",
        "Critics of Mardok Jorllen argued that no lantern should be founded without tailors.",
        "Glossary\nLantern: Local printers say the lantern was replaced twice, first for its antenna, then for a festival.\nShrine: What Brigalo called a protein is rarely described as a amber festival today.",
        "We sail the long and empty sea until the light is gone.\n" * 2 + "And nobody who left the bay came back before the dawn.\n" + "We sail the long and empty sea until the light is gone.\n" * 2,
        PROSE + "\n- vineyard: ancient\n- engine: municipal\n- kettle: modest",
        "Critics of the coastal turbine argued that no academy should be auctioned without visitors. Visitors reach the coastal turbine through a valley which they mapped. The coastal turbine differs from the academy since surveyors rebuilt it.",
]


def test_not_spam(spark):
    assert flagged(spark, OTHERS) == set()


def test_more_than_half_counts(spark):
    keys = "public choir offer | best public choir | public choir online | "
    assert flagged(spark, [PROSE * 3 + "\n" + keys, PROSE + "\n" + keys * 12]) == {1}


def test_even_repetition_in_long_sentences(spark):
    flights = "Get cheap flights to Rome from us in one click. "
    twice = "With a cheap fare to the city you can book the cheap room in Elba at once. "
    varied = "".join(f"Get cheap flights to {x} from us in one {y} click. " for x, y in zip("Rome Elba Oslo Bonn Lyon Kyiv Cork Bari Nice Graz".split(), "fast easy safe good calm neat free kind warm cool".split()))
    song = "".join(f"{v}\nWe sail the long and empty sea until the light is gone.\n" for v in [
        "Nobody who left the bay came back before the dawn.", "My father built a boat of oak and painted it in green.", "The lantern on the northern rock was lit by older hands.",
        "They sold the nets and mended ropes beside the harbour wall.", "A letter came from distant shores when winter was near."])
    polish = "Tani nocleg blisko morza czeka tutaj na ciebie i na twoje dzieci latem. "
    got = measured(spark, [flights * 50, twice * 30, varied, polish * 30, song, PROSE * 2])
    assert all(got[k].n_stuffed == got[k].n_words for k in range(4))
    assert all(got[k].n_stuffed * 2 <= got[k].n_words for k in (4, 5))


def test_slices_and_long_texts(spark, monkeypatch):
    long = "public choir offer | " * 60_000
    assert flagged(spark, [long, PROSE * 5_000]) == {0}
    total, bad, *_ = S.stuffed(pa.array([PROSE, "", SPAM[0]]), pa.array("the to in who how its and after every around".split()), pa.array([], pa.string()))
    assert total[1] == 0 and bad[0] == 0 and bad[2] == total[2]


def test_slices_learn_the_same(spark):
    docs = spark.read.parquet(AROUND)
    want = S.learned(docs, "doc_id", "text")
    assert S.learned(docs.repartition(7).withColumn("word", F.lit("x")), "doc_id", "text") == want
    assert {"the", "and", "und", "les", "los"} <= {*want[0]} and not {"lantern", "puente"} & {*want[0]}


def test_edges(spark):
    assert flagged(spark, []) == set()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.learned(empty, "doc_id", "text") == ([], []) and S.stuffing(empty, "doc_id", "text").count() == 0
    df = spark.createDataFrame([(None, SPAM[0]), (1, SPAM[0]), (1, SPAM[0])], "doc_id long, text string")
    assert S.stuffing(df, "doc_id", "text").count() == 2
    assert S.p8_found(spark, SF).columns == ["doc_id"]
    assert S.p8_scores(spark, SF).count() > 50
