"""Steps that SQL can't express, and edges of those that it can."""

import random
import time

import pytest
from pyspark.sql import functions as F

from clausemill.functions.scoring import _indel, token_set_ratio_of
from clausemill.operators import citations, currency, discovery, retrieval, rules, structure
from clausemill.plans import lanes
from clausemill.session import shared_dir, small
from clausemill.sources import files, pages, trackers

SF = "/root/testdata/sf0.001"


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_matches_plain_table():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(2))
        assert abs(_indel(a, b) - (200 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9


def test_names_without_a_common_word_are_compared(spark):
    c = spark.createDataFrame([(1, "datas protections"), (2, "xyz"), (3, None), (4, "")], "id int, title string")
    k = spark.createDataFrame([(0, "data protection"), (1, "fish")], "ord int, name string")
    got = {r.id: (r.tag, r.matched) for r in discovery.tagged(c, k).collect()}
    assert got == {1: ("KNOWN", "data protection"), 2: ("NEW", None), 3: ("NEW", None), 4: ("NEW", None)}
    assert discovery.tagged(c, k.limit(0)).where("ratio > 0").count() == 0


def test_blocks_of_names_give_the_same(spark, monkeypatch):
    want = sorted(map(tuple, lanes.known_by_name(spark, SF).collect()))
    monkeypatch.setattr(discovery, "NAMES_MOST", 2)
    assert sorted(map(tuple, lanes.known_by_name(spark, SF).collect())) == want


def test_known_names_match_brute_force(spark):
    p = spark.read.parquet(f"{SF}/part.parquet").collect()
    first = {}
    for r in p:
        if r.p_brand == "Brand#2":
            first["the " + r.p_name] = min(first.get("the " + r.p_name, 10**9), r.p_partkey)
    ratio = lambda a, b: token_set_ratio_of(" ".join(dict.fromkeys(a.split())), " ".join(dict.fromkeys(b.split())))
    got = {r.id: r for r in lanes.known_by_name(spark, SF).collect()}
    for r in p:
        title = f"{r.p_name} {r.p_type.lower()}"
        best, _, name = max((round(ratio(title, n), 6), -o, n) for n, o in first.items())
        assert abs(got[r.p_partkey].ratio - best) < 1e-5
        assert got[r.p_partkey].tag == ("KNOWN" if best >= 80 else "NEW" if best < 55 else "")
        assert got[r.p_partkey].matched in (name if best >= 80 else "", "") or best >= 80


def test_attribution_matches_brute_force(spark):
    rng = random.Random(2)
    words = ["data", "datas", "privacy", "act", "telecom", "telecoms", "order", "2010"]
    hits = [(i, " ".join(rng.sample(words, 3))) for i in range(60)]
    hints = [(f"I{i}", " ".join(rng.sample(words, 2))) for i in range(12)]
    got = discovery.attributed(spark.createDataFrame(hits, "id int, title string"), spark.createDataFrame(hints, "indicator string, phrase string")).collect()
    want = {i: sorted({n for n, p in hints if token_set_ratio_of(t, p) >= 80}) for i, t in hits}
    assert {r.id: r.indicators for r in got} == want and any(want.values())


def plain_running(texts):
    """Furniture by the stated rules, line by line."""
    split = [t.split("\n") for t in texts]
    norm = lambda x: "".join(c for c in x if not c.isdigit()).strip().lower()
    need = max(3, int(0.4 * len(texts)))
    edges = []
    for lines in split:
        full = [i for i, x in enumerate(lines) if norm(x)]
        edges.append(set(full[:2] + full[-2:]) if len(full) > 4 else set())
    held = lambda n, at: sum(any(norm(x) == n and (not at or i in e) for i, x in enumerate(lines)) for lines, e in zip(split, edges))
    out = []
    for lines, e in zip(split, edges):
        runs = [bool(norm(x)) and len(texts) >= 4 and ((len(norm(x)) >= 10 and held(norm(x), False) >= need) or (i in e and held(norm(x), True) >= need)) for i, x in enumerate(lines)]
        gone = list(runs)
        for i, x in enumerate(lines):
            short = len(x.strip()) <= 12 and (x.strip().isdigit() and len(x.strip()) <= 4 or (norm(x) and len(texts) >= 4 and held(norm(x), False) >= need))
            if not gone[i] and short and ((i and gone[i - 1]) or (i + 1 < len(lines) and runs[i + 1])):
                gone[i] = True
        out.append([x for x, g in zip(lines, gone) if not g])
    return out


def test_running_lines_match_plain_rules(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for d in range(25):
        texts = []
        for _ in range(rng.randrange(2, 8)):
            texts.append("\n".join(rng.choice(["Laws of the Realm 12", "short run", "7", "12", "", "body %d" % rng.randrange(9), "some other sentence", "ab"]) for _ in range(rng.randrange(1, 9))))
        rows += [(str(d), k, t) for k, t in enumerate(texts)]
        want |= {(str(d), k): lines for k, lines in enumerate(plain_running(texts))}
    lines = pages.without_running(pages.lines_of(spark.createDataFrame(rows, "document_id string, page_number int, text string"))).collect()
    got = {k: [] for k in want}
    for r in sorted(lines, key=lambda r: r.ord):
        if not r.gone:
            got[r.document_id, r.page_number].append(r.line)
    assert got == want


def test_tail_is_cut_from_the_first_of_the_last_pages(spark):
    rows = [("a", 0, "Not printed by X\nbody"), ("a", 1, "Text; more.  \nPrinted by X\nrest"), ("a", 2, " "), ("a", 3, "By authority"), ("b", 0, "no marks"), ("c", 0, None)]
    got = pages.cleaned(spark.createDataFrame(rows, "document_id string, page_number int, text string")).collect()
    assert {(r.document_id, r.page_number): r.text for r in got} == {("a", 0): "Not printed by X\nbody", ("a", 1): "Text; more.", ("a", 2): "", ("a", 3): "", ("b", 0): "no marks", ("c", 0): ""}


def test_islands_of_introducing_lines_match_walking_back():
    rng = random.Random(3)
    for _ in range(300):
        lines = [rng.choice(["PART 4", "", "  ", "Some heading", "an operative line.", "(2) sub", "[40/2020]", "12"]) for _ in range(12)]
        text = "\n".join(lines) + "\n"
        known = structure.Lines(text)
        for i in range(len(lines)):
            at = sum(len(x) + 1 for x in lines[:i])
            want, k = at, i - 1
            while k >= 0 and (not lines[k].strip() or structure.leads_in(lines[k].strip())):
                if lines[k].strip():
                    want = sum(len(x) + 1 for x in lines[:k])
                k -= 1
            assert known.pulled(at, 0) == want
            assert known.pulled(at, want) == want


def test_parts_take_the_last_heading():
    text = "Schedule 1—Forms .... 12\n1. A.\nSchedule 1—Forms\n1. B.\nSECOND SCHEDULE\n1. C.\nSECOND SCHEDULE — continued\n2. D.\n"
    assert [(n, text[a:b].split("\n")[0]) for n, a, b in structure.parts(text)] == [(None, "Schedule 1—Forms .... 12"), ("1", "Schedule 1—Forms"), ("2", "SECOND SCHEDULE")]
    assert structure.parts("") == [(None, 0, 0)] and structure.parts("Schedule 2—X\n") == [("2", 0, 13)]


def test_files_are_ingested_by_content(spark, tmp_path):
    for name, body in (("b.pdf", b"one"), ("a.pdf", b"one"), ("sub/c.pdf", b"two"), ("d.txt", b"three")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    got = files.ingested(spark, str(tmp_path), "SG", "local", pattern="*.pdf").collect()
    assert sorted((r.title, r.document_id[:3], r.http_status) for r in got) == [("a", "sg:", 200), ("c", "sg:", 200)]
    parser = lambda: lambda body: [body.decode(), ""] if body != b"two" else 1 / 0
    read = files.text_pages(spark.createDataFrame(got).select("document_id", "content"), parser).collect()
    assert sorted((r.page_number or 0, r.text or r.reason or "") for r in read) == [(0, "parse-ZeroDivisionError"), (1, "one"), (2, "")]


def test_catalogues_in_files(spark, tmp_path):
    y = tmp_path / "s.yaml"
    y.write_text("sources:\n- {key: a, name: A, pillars: [6], indicators: [P6-I1], tier: 2}\n- {key: b, name: B}\n")
    assert [(r.key, r.pillars, r.tier) for r in files.secondary_sources(spark, str(y)).orderBy("key").collect()] == [("a", [6], 2), ("b", [], 1)]
    j = tmp_path / "v.json"
    j.write_text('{"values": {"sg": {"a": 0.0, "b": 0.5}}}')
    got = files.restrictiveness(spark, str(j), "P6-I1", "idx")
    assert got.schema.names == trackers.SIGNAL.replace(" string", "").split(", ")
    assert sorted((r.economy, r.presence) for r in got.collect()) == [("SG", "no"), ("SG", "yes")]


def test_judges_by_option():
    assert citations.judge_of(None) is None and citations.judge_of("none") is None
    assert citations.judge_of("rules")(["a", "b"]) == [[], []]
    assert citations.judge_of(lambda texts: 1 / 0)(["a", "b"]) == [None, None]
    with pytest.raises(ValueError):
        citations.judge_of("model")


def test_failing_passes_keep_the_attribution(spark):
    laws = spark.createDataFrame([(1, "x" * 500), (2, "short")], "id int, text string").withColumn("indicators", F.array(F.lit("I1")))
    assert {tuple(r.subset) for r in citations.relevant(laws, [lambda t: 1 / 0], ["id"]).collect()} == {("I1",)}
    got = {r.id: r.subset for r in citations.relevant(laws, [lambda t: [["I2"]] * len(t), lambda t: 1 / 0], ["id"]).collect()}
    assert got == {1: ["I2"], 2: ["I1"]}


def test_models_are_made_once():
    made = []
    assert retrieval.once("m", lambda: made.append(1) or "x") == retrieval.once("m", lambda: made.append(1) or "y") == "x" and made == [1]


def test_reranking_never_gives_fewer_than_asked(spark):
    rows = [("g", "q", f"t{i}", float(i), i) for i in range(10)]
    hits = spark.createDataFrame(rows, "g string, query string, text string, score double, i int")
    out = retrieval.reranked(hits, lambda: lambda q, ts: [-float(t[1:]) for t in ts], ["g"], [F.col("i")], 8, 3, blend=False)
    assert [r.i for r in out.orderBy("rank").collect()] == [2, 3, 4, 5, 6, 7, 8, 9]


def test_only_small_frames_are_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" in small(spark.range(3))._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small(spark.range(30), 20)._jdf.queryExecution().analyzed().toString() and plan(small(spark.range(3)))


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_empty_tables(spark):
    none = spark.createDataFrame([], "document_id string, page_number int, text string")
    assert pages.cleaned(none).count() == 0
    ops = currency.instructions(spark.createDataFrame([], "key string, text string"))
    cites = spark.createDataFrame([("c", "k", "1", True)], "citation string, key string, section string, commenced boolean")
    assert [r.status for r in currency.adjudicated(cites, ops).collect()] == ["CURRENT"]
    assert [r.rename_note for r in currency.renamed(cites.withColumn("quote", F.lit(None).cast("string")), ops, F.lit("x")).collect()] == [""]
    assert rules.tidy_names(spark.createDataFrame([], "g int, name string, ord int"), ["g"]).count() == 0


def test_renames_of_one_term_cost_no_search_each(spark):
    """A law with 40,000 renames of two terms: the first that the quote has counts, and a quote isn't searched for each of them."""
    k = F.col("id")
    ops = spark.range(40_000).select(
        F.lit(1).alias("key"), (50_000 - k).alias("ord"), F.lit("GLOBAL_RENAME").alias("kind"),
        F.when(k % 4 == 0, "Zebra").when(k % 4 == 1, "zEBRA").when(k % 4 == 2, "Gnu").otherwise("").alias("old_term"), k.cast("string").alias("new_term"),
    )
    quotes = ["", "a ZEBRA ", "gnus and zebras ", "none", "gnu"] * 20
    cites = spark.createDataFrame([(i, 1 if i < 99 else 2, q + "x" * 20_000) for i, q in enumerate(quotes)], "citation int, key int, quote string")
    began = time.perf_counter()
    got = [r.rename_note for r in currency.renamed(cites, ops, F.lit("Act 9")).orderBy("citation").collect()]
    assert time.perf_counter() - began < 60
    zebra, gnu = 'term "zEBRA" renamed to "39997" by Act 9', 'term "Gnu" renamed to "39998" by Act 9'
    assert got == (["", zebra, gnu, "", gnu] * 20)[:99] + [""]


def test_first_rename_of_a_quote_by_order_then_term(spark):
    rows = [(1, 2, "a B", "late"), (1, 1, "Q", "first"), (1, 2, "A b", "early"), (1, 1, "a c", None), (1, None, "z", "unplaced"), (2, 1, "q", "other law")]
    ops = spark.createDataFrame(rows, "key int, ord int, old_term string, new_term string").withColumn("kind", F.lit("GLOBAL_RENAME"))
    cites = spark.createDataFrame([(0, 1, "A B"), (1, 1, "a b q"), (2, 1, "A C, q"), (3, 1, "z q"), (4, 2, "Q"), (5, None, "q"), (6, 1, None)], "citation int, key int, quote string")
    got = [r.rename_note for r in currency.renamed(cites, ops, F.lit("x")).orderBy("citation").collect()]
    told = [("A b", "early"), ("Q", "first"), None, ("z", "unplaced"), ("q", "other law"), None, None]  # a term whose new one is unknown gives no note
    assert got == ['term "{}" renamed to "{}" by x'.format(*t) if t else "" for t in told]


def test_judge_with_stored_verdicts_and_fallback(spark):
    from clausemill.plans.verbs import cite

    sections = "".join(f"{i}. The data of the users shall be kept by the provider {i}.\n" for i in range(1, 9))
    docs = spark.createDataFrame([("good", sections), ("bad", sections.replace("users", "owners"))], "document_id string, text string").select(
        "*", F.lit("Data Act 2001").alias("title"), F.lit("http://x").alias("source_url"), F.lit("SG").alias("economy"), F.lit(True).alias("primary"), F.lit("UNKNOWN").alias("status")
    )
    catalogue = spark.createDataFrame([("I1", "users provider"), ("I2", "owners provider")], "indicator string, query string")
    judge = lambda texts: [None if "owners" in t else ["I1"] for t in texts]
    got = cite(docs, catalogue, judge, 3, 0.0, 0.0).collect()
    assert {(r.document_id, r.lane) for r in got} <= {("good", "JUDGED"), ("bad", "DEGRADED")} and ("good", "JUDGED") in {(r.document_id, r.lane) for r in got}
    assert cite(docs, catalogue, "none", 3, 0.0, 0.0).select("lane").distinct().collect()[0].lane == "RANKED"


def test_attempts_of_a_model():
    from clausemill.operators import models

    assert [(a.json_mode, round(a.temperature, 1)) for a in models.plan(6)] == [(True, 0.0), (False, 0.0), (False, 0.2), (False, 0.4), (False, 0.6), (False, 0.6)]
    assert models.object_of('x {"a": {"b": 1}} y') == {"a": {"b": 1}} and models.object_of("[1]") is None and models.object_of("") is None
    tried = []
    got = models.ask(lambda s, u, a: tried.append(a) or ("talk", 1, 0, 1), "s", "u", 3)
    assert got["content"] is None and got["error"] == "NoObject" and len(tried) == 3 and got["prompt_tokens"] == 3


def test_an_engine_that_fails_hands_over_once():
    class Engine:
        def __init__(self, name, works):
            self.name, self.works = name, works

        def pages(self, body, languages):
            if not self.works:
                raise RuntimeError("out of memory")
            return [(1, self.name, 1.0)]

    both = pages.Retried(lambda: Engine("gpu", False), lambda: Engine("cpu", True))
    assert both.name == "gpu" and both.pages(b"", []) == [(1, "cpu", 1.0)]
    assert pages.Retried(lambda: 1 / 0, lambda: Engine("cpu", True)).name == "cpu"
    with pytest.raises(RuntimeError):
        pages.Retried(lambda: Engine("a", False), lambda: Engine("b", False)).pages(b"", [])
