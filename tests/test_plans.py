"""The cascades, suggestions, evaluations and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from termweave.operators.clustering import ClusterConfig
from termweave.operators.encoders import HashedGrams
from termweave.plans import evaluate, ontology, schema, suggest
from termweave.sources.settings import Settings
from termweave.storage import written
from termweave.streaming.micro_batch import map_stream


@pytest.fixture
def corpus(spark):
    return spark.createDataFrame([("Lung Adenocarcinoma", "C1"), ("Lung Cancer", "C2"), ("Breast Cancer", "C3")], "label string, code string")


@pytest.fixture
def asked(spark):
    rows = [(1, "lung cancer", "Lung Cancer"), (2, "LUAD", "Lung Adenocarcinoma"), (3, "Breast Cancers", "Breast Cancer"), (4, "xqzw", "Not In Corpus")]
    return spark.createDataFrame(rows, "qid long, text string, curated string")


def best(results):
    return {r["qid"]: (r["label"], r["stage"]) for r in results.filter("rank = 1").collect()}


def test_ontology_stages(spark, corpus, asked):
    names = spark.createDataFrame([("LUAD", "Lung Adenocarcinoma")], "code string, name string")
    mapper = ontology.OntologyMapper(corpus, ontology.gram_search(corpus), abbreviations=names, cut=written)
    found = mapper.run(asked.select("qid", "text"))
    b = best(found)
    assert b[1] == ("Lung Cancer", 1.0) and b[2] == ("Lung Adenocarcinoma", 2.0) and b[3] == ("Breast Cancer", 2.0)
    assert 4 not in b
    assert found.groupBy("qid", "rank").count().filter("count > 1").count() == 0
    assert {r["stage"]: r["queries"] for r in ontology.stage_counts(found).collect()} == {1.0: 1, 2.0: 2}
    view = {r["query"]: r for r in ontology.finished(found, asked, asked, 2).collect()}
    assert view["lung cancer"]["match_level"] == 1 and view["LUAD"]["match1_score"] == "1.0000"


def test_rewriting_and_reranking(spark, corpus, asked):
    rewrite = lambda low: low.select("qid", F.lit(1).cast("long").alias("rank"), F.lit("Breast Cancer").alias("label"), F.lit(0.99).alias("score"))
    seen = ontology.vector_search(corpus, HashedGrams(128))
    from termweave.operators.topk import token_overlap

    mapper = ontology.OntologyMapper(corpus, seen, search3=seen, scorer=token_overlap, rewrite=rewrite, cut=written, settings=Settings(s4_threshold=0.3))
    b = best(mapper.run(asked.select("qid", "text")))
    assert b[4] == ("Breast Cancer", 4.0) and b[1][1] == 1.0 and b[3][0] == "Breast Cancer"


def test_strategies_stop_when_settled(spark):
    rows = lambda score: lambda c: c.select("col", F.lit(1).cast("long").alias("rank"), F.lit("f").alias("field"), F.lit(score).alias("score"), F.lit("").alias("source"))
    asked: list[int] = []

    def third(c):
        asked.append(c.count())
        return rows(0.9)(c)

    cols = spark.createDataFrame([("a",)], "col string")
    found = schema.cascade(cols, [schema.Strategy("one", rows(0.3), 0.9), schema.Strategy("two", rows(0.95), 0.9), schema.Strategy("three", third, 0.5)], written)
    assert [(r["method"], r["score"]) for r in found.collect()] == [("two", 0.95)] and asked == [0]
    tied = schema.cascade(cols, [schema.Strategy("one", rows(0.3), 0.9), schema.Strategy("two", rows(0.3), 0.9)], written)
    assert [r["method"] for r in tied.collect()] == ["one"]


def test_model_replaces_only_weak_columns(spark):
    target = spark.createDataFrame([("patient_age", "yes", 0), ("sex", "", 1)], "field_name string, is_numeric_field string, ord long")
    cells = spark.createDataFrame([(0, "sex", "m"), (0, "qqq", "x"), (1, "patient_id", "7")], "row_id long, col string, cell string")
    llm = lambda c: c.select("col", F.lit(1).cast("long").alias("rank"), F.lit("sex").alias("field"), F.lit(0.9).alias("score"))
    found = schema.SchemaMapper(target, llm=llm, drop_invalid=True, cut=written).run(cells)
    assert {r["col"]: (r["stage"], r["field"]) for r in found.filter("rank = 1").collect()} == {"sex": ("stage1", "sex"), "qqq": ("stage4", "sex"), "patient_id": ("invalid", None)}
    assert "match2_source" in schema.wide(found, 2).columns


def test_suggestions(spark):
    names = ["ajcc_clinical_stage", "ajcc_pathologic_stage", "ajcc_clinical_t_stage", "ajcc_pathologic_t_stage", "smoker", "zqx"]
    cols = spark.createDataFrame([(n,) for n in names], "col string")
    cells = spark.createDataFrame([(i, n, f"v{i % 3}") for n in names for i in range(5)], "row_id long, col string, cell string")
    found = suggest.suggest(cols, HashedGrams(), cells, config=ClusterConfig(threshold=0.75)).collect()
    top = max(found, key=lambda r: len(r["source_columns"]))
    assert {"ajcc_clinical_stage", "ajcc_pathologic_stage"} <= set(top["source_columns"]) and "stage" in top["suggested_field"]
    assert top["sample_values"]["ajcc_clinical_stage"] == ["v0", "v1", "v2"]
    assert suggest.suggest(spark.createDataFrame([], "col string"), HashedGrams()).count() == 0


def test_unmapped(spark):
    cols = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "col string")
    results = spark.createDataFrame([("a", "stage1", 1, 1.0), ("b", "stage3", 1, 0.2), ("c", "invalid", 1, None)], "col string, stage string, rank int, score double")
    assert {r[0] for r in suggest.unmapped(cols, results).collect()} == {"b", "d"}


def test_paired_test():
    assert evaluate.mcnemar(0, 0)[2] == "no discordant pairs"
    assert evaluate.mcnemar(3, 9)[1] == pytest.approx(0.1459961)
    stat, p, how = evaluate.mcnemar(30, 10)
    assert (stat, how) == (9.025, "chi-squared") and p == pytest.approx(0.002663, abs=1e-6)


def test_stream_gives_the_same_as_a_batch(spark, corpus, asked, tmp_path):
    asked.select("qid", "text").write.parquet(str(tmp_path / "in"))
    mapper = ontology.OntologyMapper(corpus, ontology.gram_search(corpus), cut=written)
    stream = spark.readStream.schema("qid long, text string").parquet(str(tmp_path / "in"))
    map_stream(stream, mapper.run, str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mapper.run(asked.select("qid", "text")).collect()))


def test_described_sends_no_column_to_one_task(spark):
    rows = [(i, c, v) for i in range(4) for c, v in (("n", str(i)), ("t", "x" * 40 + str(i)), ("u", f"v{i}"))]
    cells = spark.createDataFrame(rows, "row_id long, col string, cell string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = suggest.described(cells.select("col").distinct(), cells)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert all("BroadcastHashJoin" in line for line in plan.splitlines() if "Join" in line and "LeftAnti" in line)
        assert {tuple(r) for r in df.collect()} == {("n", "n"), ("t", "t: " + "x" * 30), ("u", "u: v0, v1, v2, v3")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
