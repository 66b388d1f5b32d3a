from pyspark.sql import functions as F

from clausemill.operators import citations, currency, discovery, extraction, merge, reports, rules
from clausemill.sources import catalogue, html, sinks


def test_blocks_are_innermost_and_offsets_join():
    page = "<html><body><nav><p>menu</p></nav><div id=a><p>One  two</p><ul><li><p>in item</p></li></ul></div><p id=z>End<br>it</p><script>x</script></body></html>"
    got = html.blocks_of(page)
    assert [b["text"] for b in got] == ["One two", "in item", "End it"]
    whole = "\n\n".join(b["text"] for b in got)
    assert all(whole[b["char_start"] : b["char_end"]] == b["text"] for b in got)
    assert got[0]["dom_anchor"].startswith("#a p:nth(") and got[2]["dom_anchor"] == "#z"


def test_page_without_blocks():
    assert html.blocks_of("<body>just <b>text</b></body>")[0]["dom_anchor"] == "body"
    assert html.blocks_of("") == []


def test_links_and_context():
    got = html.links_of('<ul><li>Data Act <a href="/a">read</a></li></ul><a>none</a>', "http://h/x")
    assert [(g["href"], g["anchor_text"], g["context"]) for g in got] == [("http://h/a", "read", "Data Act read")]


def test_boundary_rules(spark):
    rows = [
        ("6.1", "must not transfer abroad unless prescribed", False),
        ("6.1", "in the prescribed form", True),
        ("6.4", "must not transfer data overseas", False),
        ("6.4", "must not transfer overseas without given consent", True),
        ("7.3", "shall cease to retain", False),
        ("7.3", "cease to retain but keep at least a year", True),
        ("9.9", "anything", True),
    ]
    df = spark.createDataFrame(rows, "i string, t string, want boolean")
    assert df.where(rules.admits(F.col("i"), F.col("t")) != F.col("want")).count() == 0


def test_or_whole(spark):
    df = spark.range(5)
    assert rules.or_whole(df, F.col("id") > 2).count() == 2
    assert rules.or_whole(df, F.col("id") > 9).count() == 5


def test_instructions_and_substitution(spark):
    text = (
        "Section 6 of the principal Act is repealed and the following substituted: x. Section 7 of the principal Act is deleted. "
        'inserting after section 8 the following. substituting for the words "data user" wherever appearing the words "data controller".'
    )
    got = currency.instructions(spark.createDataFrame([("k", text)], "key string, text string")).orderBy("ord").collect()
    assert [(r.op, r.target_section) for r in got] == [("rename", ""), ("substitute", "6"), ("delete", "7"), ("insert", "8")]
    assert (got[0].old_term, got[0].new_term) == ("data user", "data controller")


def test_chain_drops_blank_twins(spark):
    rows = [("k", 2020, "", "t", "registry", 1), ("k", 2020, "Act 1", "t", "corpus", 2), ("k", 2021, "", "t", "portal", 3)]
    got = currency.chain(spark.createDataFrame(rows, "key string, year int, amending_id string, title string, detected_by string, ord int")).collect()
    assert sorted((r.year, r.amending_id) for r in got) == [(2020, "Act 1"), (2021, "")]


def test_judge_is_asked_for_misses_only(spark):
    clauses = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "de")], "id int, text string")
    stored = citations.verdict_keys(clauses.where("id = 3"), "m", "f").select("key").withColumn("verdict", F.array(F.lit("S")))

    def judge(texts):
        assert texts == ["abc"]
        return [["J"]]

    got = {r.id: r.verdict for r in citations.judged(clauses, judge, stored, "m", "f").collect()}
    assert got == {1: ["J"], 2: ["J"], 3: ["S"]}


def test_degraded_documents_fall_back(spark):
    j = spark.createDataFrame([("a", "I1", 0.9), ("b", "I1", 0.9)], "doc string, indicator string, confidence double")
    r = spark.createDataFrame([("b", "I2", 0.8), ("b", "I3", 0.5)], "doc string, indicator string, confidence double")
    d = spark.createDataFrame([("a", False), ("b", True)], "doc string, degraded boolean")
    got = citations.with_fallback(j, r, d, "doc").collect()
    assert sorted((x.doc, x.indicator, x.lane) for x in got) == [("a", "I1", "JUDGED"), ("b", "I2", "DEGRADED")]


def test_known_names(spark):
    c = spark.createDataFrame([(1, "Data Protection Act 2010"), (2, "Fisheries Order"), (3, "Data Protection Act 1999")], "id int, title string")
    k = spark.createDataFrame([(0, "Data Protection Act 2010")], "ord int, name string")
    got = {r.id: r.tag for r in discovery.tagged(c, k).collect()}
    assert got == {1: "KNOWN", 2: "NEW", 3: "NEW"}


def test_running_lines_go(spark):
    rows = [("b", p, k, line) for p in range(5) for k, line in enumerate([f"Running Title {p}", "body text %d" % (p * 7 + 1)])]
    lines = spark.createDataFrame(rows, "book string, page int, ord int, line string")
    left = extraction.without_running_lines(lines.where("ord = 0"), "book", "page")
    assert left.count() == 0


def test_unique_ids(spark):
    df = spark.createDataFrame([("d", "x", 1), ("d", "x", 2), ("d", "y", 3)], "d string, id string, ord int")
    assert sorted(r.id for r in merge.unique_ids(df, ["d"], "id", ["ord"]).collect()) == ["x", "x~2", "y"]


def test_name_gaps(spark):
    w = spark.createDataFrame([("Personal Data Act",), ("Data",), ("Fish Law",)], "n string")
    h = spark.createDataFrame([("data act",)], "h string")
    assert [r.n for r in reports.name_gaps(w, h, "n", "h").collect()] == ["Fish Law"]


def test_catalogue_and_resume(spark, tmp_path):
    y = tmp_path / "i.yaml"
    y.write_text("pillars:\n- pillar: 6\n  indicators:\n  - {rdtii_id: '6.1', submission_id: P6-I1, name: ' a  b '}\n- pillar: 1\n  indicators:\n  - {rdtii_id: '1.1', submission_id: P1-I1}\n")
    assert [(r.rdtii_id, r.name) for r in catalogue.indicators(spark, str(y)).collect()] == [("6.1", "a b")]
    assert catalogue.indicators(spark, str(y), None).count() == 2
    j = tmp_path / "r.jsonl"
    j.write_text('{"id": "a", "v": 1}\nbroken\n{"id": "a", "v": 2}\n{"id": "b", "v": 3}\n')
    got = catalogue.resumed(spark, str(j), "id string, v int", "id").collect()
    assert sorted((r.id, r.v) for r in got) == [("a", 2), ("b", 3)]


def test_csv_has_a_mark(spark):
    assert sinks.csv_with_bom(spark.createDataFrame([("x", None)], "a string, b string")) == b"\xef\xbb\xbfa,b\r\nx,\r\n"


def test_line_starts_across_blocks(spark):
    from clausemill.operators.retrieval import line_clauses

    text = "\n".join("x" * (i % 7) for i in range(1000))
    got = line_clauses(spark.createDataFrame([("c", 1, text), ("c", 2, ""), ("c", 3, None)], "source string, doc_id long, text string"), "source").collect()
    assert len(got) == sum(i % 7 > 0 for i in range(1000))
    assert all(text[r.char_start : r.char_end] == r.text for r in got)
