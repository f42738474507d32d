from nearpress.llm import residue as R

from ..conftest import SF

LINE = "The old harbour belongs to sailors who restored it for {} years."


def found(spark, bodies, entries=None):
    t = spark.createDataFrame([(k, f"f{k}", b, "x", True) for k, b in bodies.items()], "text_id long, filepath string, body string, frames string, only boolean")
    e = spark.createDataFrame(entries if entries is not None else [(f"f{k}", "http://a.example/") for k in bodies], "filepath string, url string")
    return {r.id for r in R.residue(t, e).where("only_message or filler or n_left > 0").collect()}


PROSE = {100 + k: f"Title {k}\nThe {w} lies beside a garden that {w} people visited during the winter." for k, w in enumerate("alpha beta gamma delta epsilon zeta".split())}


MESSAGES = [
        "404 Not Found", "Some Title\nInternal server error", "Title\nYou need to enable JavaScript to run this app.", "Loading...", "Fehler 503\nBitte in 5 Minuten erneut versuchen.",
        "Title\nTest test test.", "blah blah blah.", " ".join(f"Tivesa {a} lortibior {b} vedus quaor {c} {a}. Quaor {b} quaor pelummendus {c} tivesa culniqua." for a, b, c in ("mentur lorsamen or".split(), "lorsamen um mentur".split(), "um or lorsamen".split())), "Page introuvable La page /a/b n'existe pas ou plus. Retournez à l'accueil.",
        "Страница не найдена", "Coming soon.", "Title\r\nAccess denied\r",
]


def test_messages_and_filler(spark):
    assert found(spark, {**dict(enumerate(MESSAGES)), **PROSE}) == set(range(len(MESSAGES)))


OTHERS = [
        None, "", "\n \n", "Just A Title", "Title\nThe words \"404 Not Found\" puzzled the authors of the study, as they wrote later in a letter.",
        "Team loses again\nThe keeper made an error in the final minute.\nThe coach said sorry to the fans.\nHis robot friend was loading the bus.",
        "Stary most\nKot śpi na płocie obok domu. Dzieci wracają ze szkoły późnym popołudniem. Rzeka płynie powoli przez miasto. Wieczorem zapalają się lampy.",
        "Vanha silta\nKissa nukkuu aidalla talon vieressä. Lapset palaavat koulusta iltapäivällä. Joki virtaa hitaasti kaupungin läpi.",
        "Tivesa mentur lortibior lorsamen vedus quaor. Quaor quaor pelummendus tivesa culniqua.",
        "\n".join(["Sail on, sail on, the sea is wide", "And home is far behind us now", "The wind is cold, the night is long"] * 4 + ["Sail on, sail on, the sea is wide"]),
        "This app needs JavaScript.\nTitle\nThe portable harbour belongs to sailors who restored it for years and years.",
        "The manual writes {{ page.city }} where the garden later prints a value, and explains each step.",
]


def test_not_cases(spark):
    assert found(spark, {**dict(enumerate(OTHERS)), **PROSE}) == set()


FIELDS = ["{{name}}", "{{ page.city }}", "<%= page.title %>", "${price}", "%(page.summary)s", "__ITEM_COUNT__", "[[CITY]]", "#{section}", "@@first_name@@", "%%RELEASE_DATE%%", "{city}", "<first name>", "[insert price here]", "[Your summary]", "TODO: city", "PRICE_GOES_HERE", "{%= siteName %}"]


def test_unfilled_fields(spark):
    left = {k: f"Title\nThe {f} lies beside a garden that many people visited during the winter." for k, f in enumerate(FIELDS)}
    alone = {500 + k: f"{f}\nThe harbour lies beside a garden that many people visited during the winter." for k, f in enumerate(FIELDS)}
    assert found(spark, {**left, **alone, **PROSE}) == {*left, *alone}


def test_frames_tell_described_fields(spark):
    """A frame that always holds a field, in several texts, is a sentence about fields."""
    bodies = {k: f"Her pages print {f} where the {w} later gives a value." for k, (f, w) in enumerate([("{{a}}", "x"), ("${b}", "y"), ("@@c@@", "z")])}
    assert found(spark, bodies) == set()
    assert found(spark, {**bodies, 9: "Her pages print colour where the wall stands."}) == {0, 1, 2}
    assert found(spark, {0: bodies[0]}) == {0}


def test_frames_with_fills_of_several_words_are_slots(spark):
    left = {k: f"Visitors reach {f} through a valley that the {w} mapped." for k, (f, w) in enumerate([("{{a}}", "x"), ("${b}", "y"), ("@@c@@", "z")])}
    filled = {10 + k: f"Visitors reach {name} through a valley that many people mapped." for k, name in enumerate(["Dunbo Terrace", "the old and very quiet Harbour of Elroth"])}
    assert found(spark, {**left, 10: filled[10]}) == found(spark, {**left, 11: filled[11]}) == set(left)
    signs = {k: b.replace(" through", ", through") for k, b in left.items()}
    assert found(spark, {**signs, 10: filled[10].replace(" through", ", through")}) == set(signs)


def test_frames_count_distinct_sentences_and_shares(spark):
    copies = {k: "Her pages print {{a}} where the wall later gives a value." for k in range(4)}
    assert found(spark, copies) == set(copies)
    told = {k: f"Her pages print {{{{a{k}}}}} where the wall number {k} later gives a value." for k in range(20)}
    plain = {100 + k: f"Her pages print the colour where wall {k} stands." for k in range(3)}
    assert found(spark, {**told, 100: plain[100], 101: plain[101]}) == set()
    assert found(spark, {**told, **plain}) == set(told)
    # copies of an ordinary sentence are one
    assert found(spark, {**told, **{200 + k: plain[100] for k in range(9)}}) == set()


def test_fills_end_with_the_sentence(spark):
    told = {k: f"Her pages print {f} where the {w} later gives a value." for k, (f, w) in enumerate([("{{a}}", "x"), ("${b}", "y"), ("@@c@@", "z")])}
    assert found(spark, {**told, 9: "The pages print the colour. Nobody knows where the wall stands."}) == set()
    assert found(spark, {**told, 9: "print print print print where the wall stands", 10: "print " * 50_000 + "where it stands"}) == set(told)


def test_lines_of_the_site_are_set_aside(spark):
    bodies = {k: f"Shared by the site today\nThe {w} lies beside a garden that people visited in {w}." for k, w in enumerate("a b c d e f".split())}
    bodies[50] = "Shared by the site today\nTitle Here\nService temporarily unavailable"
    assert found(spark, bodies) == {50}
    assert found(spark, {50: "Shared by the site today.\nTitle\nService temporarily unavailable"}) == set()


def test_copied_and_refrained_content_is_not_set_aside(spark):
    """Lines of copied texts below the share of repeated ones, and lines said again in one text."""
    prose = "The old harbour belongs to sailors who restored it for many years, and the town thanks them for it every winter."
    others = {1000 + k: f"Title\nThe lantern number {'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]} lies beside a garden that people visited." for k in range(96)}
    copies = {k: f"Title {w}\n{prose}\nThe other bank has mills and a road.\nThis site needs JavaScript." for k, w in enumerate("mills farms ponds walls barns".split())}
    refrain = {50: "\n".join(["We sail the long and empty sea until the light is gone."] * 5 + ["This site needs JavaScript."])}
    few = {60 + k: f"Support the writers of the site\nThe {w} stands beside a field that nobody sold." for k, w in enumerate("inn mill barn wall".split())}
    stub = {70: "Support the writers of the site\nTitle Here\nService temporarily unavailable\n"}
    assert found(spark, {**others, **copies, **refrain, **few, **stub}) == {70}


def test_edges(spark):
    assert found(spark, {}, []) == set()
    assert found(spark, {1: "404 Not Found"}, []) == {1}
    long = "word " * 200_000
    assert found(spark, {1: long, 2: long + "{{name}} is here."}) == {2}
    df = spark.createDataFrame([(None, "f", "404 Not Found"), (1, None, "404 Not Found"), (1, None, "404 Not Found")], "text_id long, filepath string, body string")
    out = R.residue(df, spark.createDataFrame([], "filepath string, url string"))
    assert {r.id for r in out.collect()} == {1}


def test_queries(spark):
    assert R.p4_found(spark, SF).columns == ["text_id"]
    assert R.p4_reasons(spark, SF).columns == ["text_id", "only_message", "filler", "n_fields", "n_left"]


def pages(spark, bodies, hosts, **kw):
    t = spark.createDataFrame([(k, f"f{k}", b) for k, b in bodies.items()], "text_id long, filepath string, body string")
    e = spark.createDataFrame([(f"f{k}", f"http://{hosts[k % len(hosts)]}.example/") for k in bodies], "filepath string, url string")
    return {r.id for r in R.residue(t, e, **kw).where("only_message or filler or n_left > 0").collect()}


def test_error_templates_need_no_phrases(spark):
    """A line that comes back on short pages of several hosts, but for numbers, addresses and one word, in any language."""
    tell = "Mulingat ta opol /{}/x weg kod {}."
    stubs = {k: f"Title {w}\n" + tell.format(w, 400 + k) for k, w in enumerate("alpha beta gamma delta".split())}
    joined = {10: "Nazat bo weg " + tell.format("z", 9)} | {11 + k: f"Head {w}\nNazat bo weg" for k, w in enumerate("eins zwei drei".split())}
    slot = {20 + k: f"Top {w}\nHin {w} zalo nemin troka." for k, w in enumerate("mapo sapo tapo".split())}
    full = {30: tell.format("y", 7) + "\n" + "\n".join(f"The {w} lies beside a garden that people of {w} visited during the winter of their lives." for w in "alpha beta gamma delta".split())}
    bodies = stubs | joined | slot | full
    assert pages(spark, bodies, ["a", "b"], support=False) == {*stubs, *joined, *slot}
    # on one host it may be what a catalogue says of its things
    assert pages(spark, bodies, ["a"], support=False) == set()


def test_copies_of_a_short_text_are_no_template(spark):
    copies = {k: "The Mill\nThe mill was built by two brothers from the north.\nIt burned down in 1870." for k in range(6)}
    assert pages(spark, copies, ["a", "b"], support=False) == set()


def test_slots_teach_notations(spark):
    """A notation that no list has, left in two slots of three texts, is one of fields wherever it stands."""
    left = {k: f"Visitors reach @{{site.Name}} through a valley that the {w} mapped." for k, w in enumerate("x y z".split())}
    left |= {3 + k: f"Critics of @{{site.Name}} argued that the {w} is closed." for k, w in enumerate("x y".split())}
    plain = {20: "Visitors reach Dunbo through a valley that we mapped.", 21: "Critics of Dunbo argued that it is closed."}
    alone = {30: "@{city.Name}\nThe old harbour lies beside a garden."}
    assert pages(spark, left | plain | alone, ["a"], support=False) == {*left, 30}
    assert pages(spark, alone | plain, ["a"], support=False) == set()


def test_blanks_and_defaults_count_in_slots_only(spark):
    for blank in ("____", "N/A", "%s", "{0}"):
        left = {k: f"Visitors reach {blank} through a valley that the {w} mapped." for k, w in enumerate("x y".split())}
        plain = {20: "Visitors reach Dunbo through a valley that we mapped.", 30: f"The answer is {blank} in both of these cases."}
        assert pages(spark, left | plain, ["a"]) == set(left)
