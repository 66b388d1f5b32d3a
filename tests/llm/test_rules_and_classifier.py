import re

from pyspark.sql import functions as F

from clausemill.llm import quality_classifier as qc
from clausemill.llm import quality_rules as qr
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
CLEAN = " ".join(["the committee of the house was asked to look for a way that is open to all"] + [f"word{i} and the thing{i} of it" for i in range(20)])
EDGE = [
    (1, None, "en"),
    (2, "", None),
    (3, " \n\t ", "en"),
    (4, "a b c a b c", "en"),
    (5, "x\nx\n\nx", "en"),
    (6, CLEAN, "en"),
    (6, CLEAN, "en"),
    (None, "$ # | word", "en"),
    (7, "the same line here\n" * 3000, "en"),
    (8, "é" * 200_000, "fr"),
]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def frame(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string")


def test_measures_match_brute_force(spark):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = qr.judge(frame(spark), ["doc_id", "text"]).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert tuple(r[n] for n in names) == brute(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert {r.kept for r in got if r.doc_id == 6} == {True}
    assert not any(r.kept for r in got if r.doc_id != 6)


def test_empty_table_and_clashing_names(spark):
    assert qr.judge(frame(spark).limit(0), ["doc_id"]).count() == 0
    clash = frame(spark).withColumn("n_words", F.lit("mine")).withColumn("_words", F.lit(1)).withColumn("kept", F.lit(3))
    assert qr.judge(clash, ["doc_id"]).count() == len(EDGE)


def test_rules_match_sql_and_stay_native(spark):
    df = qr.op1_quality_rules(spark, SF)
    assert_same(df, qr.ORACLE_SQL["op1_quality_rules"], SF)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Exchange", plan.split("Physical Plan")[-1])


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = qc.op3_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    right = sum(r.predicted == r.quality for r in got) / len(got)
    assert right >= 0.97
    assert all(r.predicted for r in got if r.quality == 1)


def test_held_out_rows_are_never_learnt(spark):
    import zlib

    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1)], "doc_id long, quality int")
    learnt = {r.doc_id for r in qc.learnable(labels).collect()}
    assert learnt == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_scores_without_classes(spark):
    stats = qc.statistics(frame(spark), ["doc_id"])
    none = qc.fit(stats.withColumn("label", F.lit(1)).limit(0))
    assert {r.s for r in stats.select(none.score().alias("s")).collect()} == {0.5}
    one = qc.fit(stats.withColumn("label", F.lit(1)))
    assert {r.s for r in stats.select(one.score().alias("s")).collect()} == {1.0}


def test_scores_are_finite_at_the_edges(spark):
    stats = qc.statistics(frame(spark), ["doc_id", "text"])
    model = qc.fit(stats.withColumn("label", F.when(F.col("doc_id") == 6, 1).otherwise(0)))
    got = stats.select("doc_id", model.score().alias("s")).collect()
    assert len(got) == len(EDGE) and all(0 <= r.s <= 1 for r in got)


def test_score_matches_numpy(spark):
    """Means, shrinkage, factors and scores anew from the statistics alone."""
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stats = qc.statistics(docs, ["doc_id"]).join(qc.learnable(spark.read.parquet(f"{SF}/labels.parquet")), "doc_id")
    rows = stats.withColumn("s", qc.fit(stats).score()).collect()
    x = np.array([[r[f"f_{k}"] for k in qc.FEATURES] for r in rows])
    label = np.array([r.label for r in rows])

    def density(c):
        own = x[label == c]
        cov = np.cov(own.T, bias=True)
        cov = (1 - qc.SHRINKAGE) * cov + qc.SHRINKAGE * np.diag(np.maximum(np.diag(cov), qc.FLOOR)) + qc.FLOOR * np.eye(len(qc.FEATURES))
        gap = x - own.mean(0)
        return np.log(len(own) / len(x)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)

    want = 1 / (1 + np.exp(-np.clip(density(1) - density(0), -700, 700)))
    assert np.allclose(want, [r.s for r in rows], atol=1e-6)


def test_stage_keeps_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    for name in ("f_marks", "_words", "_n", "_lines", "_text", "_document", "label"):
        docs = docs.withColumn(name, F.lit("mine"))
    kept = qc.stage_quality(spark, docs, SF)
    assert kept.columns == docs.columns and kept.select("label").distinct().collect() == [("mine",)]
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").join(kept, "doc_id", "left_anti")
    assert bad.count() == 0


def test_stage_judges_each_row_for_itself(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    good = known.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").first().text
    junk = "$ # | " * 40
    rows = [(None, good, "x"), (None, junk, "x"), (-1, good, "x"), (-1, good, "x"), (-1, junk, "x"), (-2, None, "x"), (-2, "", "x"), (-3, "word " * 200_000, "x")]
    every = qc.stage_quality(spark, spark.createDataFrame(rows, known.schema).unionByName(known), SF).where("doc_id is null or doc_id < 0").collect()
    assert sorted((r.doc_id or 0) for r in every if r.text == good) == [-1, -1, 0]
    assert not any(r.text == junk for r in every)


def test_learning_rows_are_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)], "doc_id long, quality int")
    few = qc.learnable(labels, 40).collect()
    assert len(few) == 40 and {r.label for r in few} == {0, 1} and few == qc.learnable(labels, 40).collect()
