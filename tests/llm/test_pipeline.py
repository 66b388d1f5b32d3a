import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clausemill.llm import registry

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == first
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] <= counts[5]
    again = corpus_pipeline.run(spark, SF)
    assert again.count() == counts[5]
    pack = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pack(again) == pack(docs)


ROWS = [(None, "one clean text of its own", "x"), (None, None, None), (1, "", "x"), (1, "another text, of the same id", "x"), (1, "another text, of the same id", "x"), (2, "long " * 30_000, "x")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_table(spark, name, stage):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    for c in ("_key", "_row", "key", "fp", "root", "seed", "f_marks", "part", "length", "spans"):
        docs = docs.withColumn(c, F.lit("mine"))
    got, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == got.columns
    if name == "packing":
        assert got.where("piece = 0").count() == len(ROWS)
        return
    assert got.columns == docs.columns and got.select("fp").distinct().count() <= 1
    texts = [r.text for r in got.collect()]
    if name != "quality classifier":
        assert None in texts or "" in texts  # these are copies of each other, no more
        assert "one clean text of its own" in texts and "another text, of the same id" in texts and ROWS[-1][1] in texts


def test_native_operators_import_no_python_functions():
    """Of the marked operators: nothing that runs Python on executors."""
    import ast
    from pathlib import Path

    from clausemill.llm import chat_format, licenses, quality_rules, sharding

    banned = {"pandas_udf", "udf", "mapInArrow", "mapInPandas", "applyInPandas", "rdd", "arrow_udf", "udtf"}
    for module in (quality_rules, licenses, chat_format, sharding):
        tree = ast.parse(Path(module.__file__).read_text())
        used = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)} | {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)}
        assert not used & banned
