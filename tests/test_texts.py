import pytest
from pyspark.sql import functions as F

from clausemill.functions import text as X
from clausemill.functions.scoring import token_set_ratio_of
from clausemill.sources import pages, recorded, trackers


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="Data-Protection 数据保护 A_1 中") == ["data-protection", "a_1", "数据", "据保", "保护", "中"]


def test_objects_in_answers(spark):
    get = lambda t: one(spark, X.lenient_object(F.col("t")), t=t)
    assert get('{"a": 1}') == '{"a": 1}'
    assert get('said:\n```json\n{"a": 1}\n```\nso') == '{"a": 1}'
    assert get('so {"a": {"b": 2}} it is') == '{"a": {"b": 2}}'
    assert get("[1, 2]") is None and get("nothing") is None


def test_numbers_are_held_against_the_text(spark):
    df = spark.createDataFrame([("No. 119 of 1988", "Act 119, 1988", True), ("Act 5", "none", False), ("none", "5", False)], "v string, t string, want boolean")
    assert df.where(X.printed_numbers(F.col("v"), F.col("t")) != F.col("want")).count() == 0
    df = spark.createDataFrame([("Act 46 of 2024", "Savings Act 2001", False), ("Act 709", "Data Act 2010", True), ("Act 26 of 2012", "Data Act 2012", True)], "n string, t string, want boolean")
    assert df.where(X.year_agrees(F.col("n"), F.col("t")) != F.col("want")).count() == 0
    assert one(spark, X.principal_number(F.col("t")), t="LEGISLATIVE HISTORY\nnote\n1. Act 26  of 2012 — X\n2. Act 40 of 2020") == "Act 26 of 2012"


@pytest.mark.parametrize(
    "title, text, want",
    [
        ("Data Act 2010  Current version as at 1 Jan", "", "Data Act 2010"),
        ("act709_final.pdf", "x\nAct 709\nPERSONAL DATA\nPROTECTION ACT 2010\nmore", "Personal Data Protection Act 2010"),
        ("09. Data Act (KU) final.pdf", "", "Data Act"),
        ("Act 709", "", "Act 709"),
        ("Rules (1) Act 2010", "", "Rules (1) Act 2010"),
    ],
)
def test_names(spark, title, text, want):
    assert one(spark, X.resolved_name(F.col("a"), F.col("b")), a=title, b=text) == want


def test_rationale(spark):
    say = lambda most: X.template_rationale(F.lit("Section 1"), F.lit("P6-I1"), F.lit("Ban"), F.array(F.lit("Transfer"), F.lit("none"), F.lit("abroad")), F.lit("transfer it abroad"), most)
    assert one(spark, say(1000)) == "Section 1 maps to P6-I1 (Ban). Indicator concept(s) present: 'Transfer'; 'abroad'."
    assert one(spark, say(75)) == "Section 1 maps to P6-I1 (Ban). Indicator concept(s) present: 'Transfer'."
    assert one(spark, say(40)) == "Section 1 maps to P6-I1 (Ban)."


def test_copying_is_noticed(spark):
    words = F.split(F.lit("a b c d e f g"), " ")
    assert one(spark, X.copies(words, F.lit("so B C D E F G it"))) and not one(spark, X.copies(words, F.lit("a b c d e")))


def test_prompts_put_the_catalogue_first(spark):
    p = one(spark, X.clause_prompt(F.lit("- a"), F.lit("S 1"), F.lit(" x\ny "), 2))
    assert p == "INDICATORS:\n- a\n\nCLAUSE (S 1):\nx  …"


def test_token_sets():
    assert token_set_ratio_of("data act 2010", "the data act 2010") == 100.0
    assert token_set_ratio_of("a b", "") == 0.0
    assert 50 < token_set_ratio_of("data protection act", "data protection order") < 100


def test_pages(spark):
    frame = lambda texts: spark.createDataFrame([("d", k, t) for k, t in enumerate(texts)], "document_id string, page_number int, text string")
    of = lambda df: [r.text for r in df.orderBy("page_number").collect()]
    kept = lambda texts: of(pages.joined(pages.without_running(pages.lines_of(frame(texts)))))
    body = ["Running Title %d\nAct 762\n%s\nlast words of page %d here.\nAnd more text.\n%d" % (i, "Some body %s" % chr(97 + i), i, i) for i in range(5)]
    assert all("Running" not in p and "Act 762" not in p and "Some body" in p for p in kept(body))
    assert kept(body[:3]) == body[:3]
    assert of(pages.without_tail(frame(["Text ends.", "Rest.\nPRINTED BY X", "", "List of amendments"]))) == ["Text ends.", "Rest.", "", ""]
    lines = spark.createDataFrame([("Section 7", True), ("Part 2  Rules", True), ("Part 2—Rules", False)], "line string, want boolean")
    assert lines.where(pages.navigation_header(F.col("line")) != F.col("want")).count() == 0


def test_reading_order_keeps_columns():
    boxes = [(0, 0, 40, 10, "a", 1), (60, 1, 90, 11, "n", 1), (0, 20, 40, 30, "b", 1), (60, 21, 90, 31, "m", 1)]
    assert [b[4] for b in pages.reading_order(boxes)] == ["a", "b", "n", "m"]
    assert pages.reading_order([]) == []


def test_blank_pages_are_filled(spark):
    class Engine:
        name = "fake+gpu"

        def pages(self, body, languages):
            return [(2, body.decode(), 0.9)]

    p = spark.createDataFrame([("d", 1, "text"), ("d", 2, " "), ("e", 1, "whole")], "document_id string, page_number int, text string")
    b = spark.createDataFrame([("d", bytearray(b"seen")), ("e", bytearray(b"never"))], "document_id string, body binary")
    got = pages.filled(p, b, Engine, ["en"]).orderBy("document_id", "page_number").collect()
    assert [(r.text, r.ocr_confidence) for r in got] == [("text", None), ("seen", 0.9), ("whole", None)]


def test_cleaned_pages_have_offsets(spark):
    p = spark.createDataFrame([("d", 2, "b"), ("d", 1, "aa")], "document_id string, page_number int, text string")
    got = pages.cleaned(p).orderBy("page_number").collect()
    assert [(r.char_start, r.char_end) for r in got] == [(0, 2), (4, 5)]


def test_recorded_answers(spark):
    rec = recorded.fixtures(spark, [{"method": "GET", "url": "http://a/1", "status": 200, "body": "x"}])
    asked = spark.createDataFrame([("get", "http://a/1"), ("GET", "http://a/2")], "method string, url string")
    got = {r.url: (r.status, r.miss) for r in recorded.replay(asked, rec).collect()}
    assert got == {"http://a/1": (200, False), "http://a/2": (504, True)}


def test_attempts():
    tries = iter([OSError(), recorded.Answer(500, ""), recorded.Answer(200, "ok")])

    def ask(url):
        a = next(tries)
        if isinstance(a, OSError):
            raise a
        return a

    assert recorded.attempts(ask, "u").body == "ok"
    assert recorded.attempts(lambda u: recorded.Answer(403, ""), "u", lambda u: recorded.Answer(200, "seen", "browser")).via == "browser"
    assert recorded.attempts(lambda u: recorded.Answer(404, ""), "u").status == 404


def test_trackers(spark):
    js = spark.createDataFrame([('var countries = {"sg": [1, 0], "my": [9]};',)], "text string")
    got = trackers.code_map(js, {0: ("P7-I1", "P7-I4"), 1: ("P7-I2",)}, {1: "yes", 0: "no"}, "T").collect()
    assert sorted((r.economy, r.indicator, r.presence) for r in got) == [("MY", "P7-I1", "unknown"), ("MY", "P7-I4", "unknown"), ("SG", "P7-I1", "yes"), ("SG", "P7-I2", "no"), ("SG", "P7-I4", "yes")]
    prose = spark.createDataFrame([("SG", "The Personal Data Protection Act 2012 applies. See the Personal Data Protection Act 2012 and Cybersecurity Act.")], "economy string, text string")
    laws = trackers.named_laws(prose, "economy")
    assert sorted(r.law for r in laws.collect()) == ["Cybersecurity Act", "Personal Data Protection Act 2012"]
    trackers.source("ok")(lambda s, o: trackers.law_signals(laws, ["P7-I1"], "ok"))
    trackers.source("bad")(lambda s, o: 1 / 0)
    signals, failed = trackers.gathered(spark, ["ok", "bad"], {})
    assert signals.count() == 2 and list(failed) == ["bad"] and trackers.seeds(signals).count() == 2


def test_settings(tmp_path, monkeypatch):
    from clausemill import settings

    f = tmp_path / ".env"
    f.write_text("# no\nexport A='x y'\nB=2 # two\n9C=no\nD\n")
    assert settings.env_file(f) == {"A": "x y", "B": "2"} and settings.env_file(tmp_path / "none") == {}
    monkeypatch.setenv("B", "env")
    assert settings.setting("B", [f]) == "env" and settings.setting("A", [f]) == "x y" and settings.setting("Z", [f], "d") == "d"
    assert [settings.economy(x) for x in ("SG", " Singapore ", "Singapre", "malaysa")] == ["sg", "sg", "sg", "my"]
    with pytest.raises(ValueError, match="unknown economy"):
        settings.economy("Atlantis")


def test_worksheets_and_strategies(spark):
    from clausemill.operators import portals

    text = ["rubric", "## Act A", "### P6-I1", "VERDICT: KEEP", "NOTE: fine", "### P6-I2", "VERDICT: KEEP / DROP", "## Act B", "DROP-ALL", "### P6-I1", "verdict = drop"]
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(text)], "sheet string, ord int, line string")
    got = portals.worksheet(lines).orderBy("ord").collect()
    assert [(r.instrument, r.indicator, r.verdict, r.note) for r in got] == [("Act A", "P6-I1", "KEEP", "fine"), ("Act A", "P6-I2", "", ""), ("Act B", "P6-I1", "DROP-ALL", "")]
    hosts = spark.createDataFrame([("www.law.gov.sg",), ("x.org",)], "host string")
    known = spark.createDataFrame([("gov.sg", 0, "a"), ("law", 1, "b")], "needle string, ord int, strategy string")
    assert {r.host: r.strategy for r in portals.strategy_for(hosts, known).collect()} == {"www.law.gov.sg": "a", "x.org": None}


def test_console(spark):
    from clausemill.sources import console

    c = spark.createDataFrame([("SG", "Data <Act>", "S 1", "P6-I1", "q & a", "why", "javascript:x", "VERIFIED", "CURRENT", "NEW")], "economy string, law_name string, article string, indicator_id string, quote string, rationale string, source_url string, review_status string, currency_status string, discovery_tag string")
    page = console.page(c, "T")
    assert "Data &lt;Act&gt;" in page and "q &amp; a" in page and "javascript:x" not in page and 'data-economy="SG"' in page
    assert '"citations": 1' in console.report(c, {"at": "now"})


def test_command_line(capsys):
    from clausemill.__main__ import main

    assert main(["list"]) == 0 and "bm25_topk_clauses" in capsys.readouterr().out
