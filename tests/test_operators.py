"""Joins, fusions, votes, corpora, taxonomies and model answers on small cases."""

from __future__ import annotations

import json

import holding
import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import callables, clustering, corpus, exact, fusion, taxonomy, topk, votes
from termweave.operators.encoders import HashedGrams, Model, Precomputed, check_dimension, encode_cached


@pytest.fixture
def aliases(spark):
    rows = [("age", "patient_age", 0), ("tumour size", "tumor_size", 1), ("sample type", "sample_type", 2), ("AGE", "age_at_dx", 3)]
    return spark.createDataFrame(rows, "source string, field_name string, ord int")


def test_standard_and_alias_exact(spark, aliases):
    schema = spark.createDataFrame([("patient_age", 0), ("tumor_size", 1), ("tumor-size", 2)], "field_name string, ord int")
    cols = spark.createDataFrame([("PATIENT_AGE",), ("tumor-size",), ("Age",), ("zzz_xyz",)], "col string")
    assert {tuple(r) for r in exact.standard_exact(cols, schema).collect()} == {("PATIENT_AGE", "patient_age", 1.0, ""), ("tumor-size", "tumor-size", 1.0, "")}
    assert {tuple(r) for r in exact.alias_exact(cols, aliases).collect()} == {("Age", "patient_age", 1.0, "age"), ("Age", "age_at_dx", 1.0, "age")}


def test_vector_topk_against_numpy(spark):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(40, 8)), rng.normal(size=(90, 8))
    c[7] = c[3]  # a tie
    frame = lambda m, n: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{n} long, embedding array<double>")
    got = holding.of(topk.vector_topk(frame(q, "qid"), frame(c, "cid"), 5, block=16).select("qid", "rank", "cid"))
    s = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 6)
    wanted = [(int(j), i, r + 1) for i in range(len(q)) for r, j in enumerate(sorted(range(len(c)), key=lambda j: (-s[i, j], j))[:5])]
    assert got == sorted(wanted, key=repr)


@pytest.mark.parametrize("block", (3, 8192))
def test_vector_topk_of_equal_and_odd_vectors(spark, block):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(300, [0.0, 1.0]), (301, [float("nan"), 1.0]), (302, [0.0, 0.0]), (303, None), (304, [float("inf"), 1.0])]
    e = spark.createDataFrame(rows, "qid long, embedding array<float>").repartition(3)
    found = {}
    for r in topk.vector_topk(e, e.withColumnRenamed("qid", "cid"), 3, block=block, exclude_same=True).collect():
        found.setdefault(r["qid"], {})[r["rank"]] = (r["cid"], r["score"])
    least = lambda q: dict(enumerate([i for i in range(300) if i != q][:3], 1))
    assert set(found) == {*range(301), 302}
    assert all({r: c for r, (c, s) in found[q].items()} == least(q) for q in found)
    assert all(s == (1.0 if q < 300 else 0.0) for q in found for _, s in found[q].values())


def test_k_of_a_query_are_kept_over_all_blocks():
    rng = np.random.default_rng(2)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    q, c = unit(rng.normal(size=(700, 4))), unit(rng.normal(size=(900, 4)))
    best = topk._Best(np.arange(700), q, 5, True)
    for i in range(0, 900, 50):
        best.meet(np.arange(i, i + 50), c[i : i + 50])
    found = best.rows()
    s = np.round(q @ c.T, topk.DIGITS)
    s[np.arange(700), np.arange(700)] = -np.inf
    assert found.num_rows == 700 * 5
    assert np.array_equal(found.column(2).to_numpy().reshape(700, 5), -np.sort(-s, axis=1)[:, :5])


def test_topk_of_nothing(spark):
    none = spark.createDataFrame([], "qid long, embedding array<float>")
    assert topk.vector_topk(none, none.withColumnRenamed("qid", "cid"), 3).count() == 0
    one = spark.createDataFrame([(1, None)], "qid long, embedding array<float>")
    assert topk.vector_topk(one, one.withColumnRenamed("qid", "cid"), 3).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid long, rank long, label string, score double")


def test_max_merge_ties_go_to_the_first_list(spark):
    a, b = ranked(spark, [(1, 1, "x", 0.5), (1, 2, "y", 0.4)]), ranked(spark, [(1, 1, "z", 0.5), (1, 2, "y", 0.9)])
    assert [(r["label"], r["rank"]) for r in fusion.max_merge(2, a, b).orderBy("rank").collect()] == [("y", 1), ("x", 2)]


def test_reciprocal_ranks(spark):
    a, b = ranked(spark, [(1, 1, "x", 0.5), (1, 2, "y", 0.4)]), ranked(spark, [(1, 1, "y", 0.7)])
    rows = fusion.reciprocal_ranks(a, b, 5).orderBy("rank").collect()
    assert [r["label"] for r in rows] == ["y", "x"] and rows[0]["score"] == 0.4
    assert rows[0]["rrf"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-8)


def test_boost_needs_a_better_first(spark):
    two = ranked(spark, [(1, 1, "x", 0.5), (2, 1, "x", 0.95), (3, 1, "x", 0.5)])
    syn = ranked(spark, [(1, 1, "y", 0.8), (2, 1, "y", 0.99), (3, 1, "y", 0.4)])
    found = {(r["qid"], r["rank"]): (r["label"], r["stage"]) for r in fusion.synonym_boost(two, syn, 5).collect()}
    assert found[(1, 1)] == ("y", 2.5) and found[(2, 1)] == ("x", 2.0) and found[(3, 1)] == ("x", 2.0)


def test_replacement_needs_an_answer(spark):
    old = ranked(spark, [(1, 1, "x", 0.1), (2, 1, "x", 0.1)]).withColumn("stage", F.lit(2.0).cast("double"))
    new = ranked(spark, [(1, 1, "N/A", 0.0), (2, 1, "z", 0.9)])
    assert {(r["qid"], r["label"], r["stage"]) for r in fusion.replace_by_stage(old, new, 4.0).collect()} == {(1, "x", 2.0), (2, "z", 4.0)}


def test_padded_and_wide(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    rows = topk.padded(ranked(spark, [(1, 1, "x", 0.12345)]), q, 2)
    found = {r["qid"]: r for r in topk.wide(rows, 2).collect()}
    assert (found[1]["match1"], found[1]["match1_score"], found[1]["match2"], found[1]["match2_score"]) == ("x", "0.1235", None, "0.0000")
    assert found[2]["match1"] is None


def test_match_levels(spark):
    truth = spark.createDataFrame([(1, " Lung Cancer"), (2, "Other")], "qid long, curated string")
    rows = ranked(spark, [(1, 1, "x", 0.9), (1, 2, "lung cancer", 0.8), (2, 1, "x", 0.9)])
    assert {tuple(r) for r in topk.match_level(rows, truth).collect()} == {(1, 2), (2, 99)}


def cells(spark, **columns):
    return spark.createDataFrame([(i, c, v) for c, vs in columns.items() for i, v in enumerate(vs)], "row_id long, col string, cell string")


def test_numeric_columns(spark):
    c = cells(spark, most=["1"] * 19 + ["x"], half=["1", "x"], edge=["1"] * 9 + ["x"], split=["1;2", "3"])
    assert {r["col"]: r["is_numeric"] for r in votes.numeric_columns(c).collect()} == {"most": True, "half": False, "edge": True, "split": True}


def test_too_many_values_dont_vote(spark):
    c = cells(spark, many=[f"v{i}" for i in range(51)], few=["a", "b", "A"])
    assert {r["col"] for r in votes.weighted(votes.cell_values(c)).collect()} == {"few"}


def test_invalid_columns(spark):
    c = cells(spark, patient_id=["x"], grade=["Stage IIIC", "Stage II", None], bid=["x"], **{"total mutation counts": ["1"]})
    assert {r["col"]: r["reason"] for r in votes.invalid_columns(c).collect()} == {"patient_id": "id_column", "total mutation counts": "count_column", "grade": "stage_column", "bid": None}


def test_corpus_normalising(spark):
    rows = [("Lung", "NCIT:C1"), ("Lung", "NCIT:C1"), ("obsolete_x", "NCIT:C2"), (None, "NCIT:C3"), ("Skin", "UBERON:1")]
    t = spark.createDataFrame(rows, "label string, obo_id string")
    assert {tuple(r) for r in corpus.normalize_corpus(t).collect()} == {("Lung", "C1"), ("Skin", "UBERON_1")}
    assert corpus.normalize_corpus(t, False).count() == 3
    with pytest.raises(ValueError):
        corpus.normalize_corpus(spark.createDataFrame([("x",)], "other string"))


def test_corpus_hash_ignores_order_not_content(spark):
    rows = [("C1", "A"), ("C2", "B"), ("C3", "C")]
    h = lambda r: corpus.corpus_hash(spark.createDataFrame(r, "clean_code string, official_label string")).first()["hash"]
    assert h(rows) == h(rows[::-1]) and len(h(rows)) == 8
    assert h(rows) != h([("C1", "a"), *rows[1:]])


def test_single_source(spark):
    codes = lambda *c: spark.createDataFrame([(x,) for x in c], "clean_code string")
    assert corpus.single_source(codes("C1", "C2", "COB_1")) == "ncit"
    for bad in (codes("C1", "UBERON_1"), codes("COB_1")):
        with pytest.raises(ValueError):
            corpus.single_source(bad)


def test_taxonomy_with_cycle_and_diamond(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("z",)], "root string")
    assert {tuple(r) for r in taxonomy.descendants(e, roots).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3), ("z", "z", 0)}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert {tuple(r)[:2] for r in taxonomy.descendants(ring, spark.createDataFrame([("a",)], "root string")).collect()} == {("a", "a"), ("a", "b")}


def test_answers(spark):
    fields = spark.createDataFrame([("sex",), ("age",)], "field_name string")
    body = json.dumps([{"field": "age", "confidence": 0.4}, {"field": "sex", "confidence": "0.9"}, {"field": "no", "confidence": 1}, {"field": "age", "confidence": 2}])
    a = spark.createDataFrame([("x", f"```json\n{body}\n```"), ("y", "sorry"), ("z", None)], "col string, answer string")
    assert [tuple(r) for r in callables.parse_fields(a, fields, 3).orderBy("rank").collect()] == [("x", 1, "sex", 0.9), ("x", 2, "age", 0.4)]
    t = spark.createDataFrame([(1, '["a", " ", {"term": "b"}]'), (2, "nothing")], "qid long, answer string")
    assert [r["term"] for r in callables.parse_terms(t).orderBy("pos").collect()] == ["a", "b"]


def test_calls_survive_failures(spark):
    def load():
        def model(prompt):
            if prompt == "bad":
                raise RuntimeError
            return prompt.upper()

        return model

    asked = spark.createDataFrame([("a",), ("bad",), ("a",)], "prompt string")
    assert sorted(map(tuple, callables.call(asked, load, 2).collect()), key=repr) == [("a", "A"), ("a", "A"), ("bad", None)]


def test_encoders(spark):
    df = spark.createDataFrame([("lung",), ("lung",), (None,)], "text string")
    v = [r["embedding"] for r in HashedGrams(32).encode(df).collect()]
    assert v[0] == v[1] and np.linalg.norm(v[0]) == pytest.approx(1, abs=1e-6)
    model = Model(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), "length")
    assert np.linalg.norm(model.encode(df).first()["embedding"]) == pytest.approx(1, abs=1e-6)
    pre = Precomputed(spark.createDataFrame([("lung", [1.0])], "key string, embedding array<float>"))
    assert pre.encode(df).filter("embedding IS NULL").count() == 1
    _, new = encode_cached(df, None, HashedGrams(32))
    texts, again = encode_cached(df, new, HashedGrams(32))
    assert again.count() == 0 and texts.filter("size(embedding) = 32").count() == 2
    with pytest.raises(Exception, match="dimensions"):
        check_dimension(HashedGrams(32).encode(df), 64).collect()


def test_levenshtein_and_linkage():
    assert clustering.levenshtein("kitten", "sitting") == 3 and clustering.levenshtein("", "ab") == 2
    rng = np.random.default_rng(42)
    tight = rng.normal(size=64)
    cloud = tight + rng.normal(size=(10, 64)) * 0.01
    names = [f"n{i}" for i in range(10)]
    assert [len(c) for c in clustering.coherent_clusters(names, cloud)] == [10]
    two = np.vstack([cloud, -tight + rng.normal(size=(10, 64)) * 0.01])
    found = clustering.coherent_clusters([f"n{i}" for i in range(20)], two)
    assert sorted(i for c in found for i in c) == list(range(20)) and len(found) == 2
    assert sorted(map(len, clustering.refine([list(range(20))], two))) == [10, 10]
    assert clustering.coherent_clusters([], np.zeros((0, 4))) == []


def test_entities_join_clusters():
    v = np.array([[1, 0.0], [1, 0.1], [0.9, 0.1], [0, 1.0]])
    tags = [["drug"], [], ["drug"], ["drug"]]
    assert sorted(map(sorted, clustering.merge_by_entity([[0, 1], [2], [3]], tags, v))) == [[0, 1, 2], [3]]


def test_average_linkage_against_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    groups, wanted = [[i] for i in range(12)], []
    while len(groups) > 1:
        a, b = min(((a, b) for i, a in enumerate(groups) for b in groups[:i]), key=lambda p: d[np.ix_(*p)].mean())
        groups = [g for g in groups if g is not a and g is not b] + [a + b]
        wanted.append(sorted(a + b))
    leaves = {i: [i] for i in range(12)}
    for i, (a, b) in enumerate(clustering.average_linkage(d)):
        leaves[12 + i] = leaves[a] + leaves[b]
        assert sorted(leaves[12 + i]) == wanted[i]


def test_tables_are_counted_as_their_cells_are(spark):
    from termweave.sources.tables import to_cells

    table = spark.sql("SELECT * FROM VALUES (1L, 0.0D, 1.5F, 'a; b', timestamp'2020-01-01', true, 1.50, cast(null as int)), (2L, -0.0D, -0.0F, ' b::NA;<', timestamp'2020-01-01 00:00:00.5', false, 1.50, null), (3L, double('nan'), float('inf'), null, null, null, null, null), (4L, 1e20D, 1.5F, 'NA', timestamp'2020-01-01', true, 0.00, null), (-5L, -0.0D, 0.0F, '', null, null, null, null) AS t(k, d, f, s, t, b, n, e)")
    wide = table.select("k", *(F.col(c).cast("string").alias(c) for c in table.columns if c != "k"))
    cells = to_cells(wide.withColumn("_k", F.col("k")), "_k")
    said = lambda df: sorted(map(str, df.collect()))
    assert said(votes.counted_tables([(table, "k")])) == said(votes.counted_cells(cells))
    assert "-0.0" in {r["value"] for r in votes.counted_tables([(table, "k")]).collect()}


def test_values_of_a_cell_with_and_without_marks(spark):
    from termweave.functions import text as tx

    cells = {None: None, "": [], " ": [], "NA": [], " na ": [], "<": [], ">": [], " a b ": ["a b"], "a;b": ["a", "b"], "a<;>b": ["a", "b"], "a::b": ["a", "b"], "a:b": ["a:b"], "::": [], ";": [], "x;NA": ["x"], "a<b": ["a<b"]}
    df = spark.createDataFrame([(c,) for c in cells], "cell string")
    # As every cell was split before.
    parts = F.transform(F.split("cell", ";|<;>|::"), lambda x: F.trim(x))
    before = F.filter(parts, lambda x: (x != "") & (F.lower(x) != "na") & ~x.isin("<", ">"))
    rows = df.select("cell", tx.valid_values(F.col("cell")).alias("v"), before.alias("w")).collect()
    assert all(r["v"] == r["w"] for r in rows)
    assert {r["cell"]: r["v"] for r in rows if r["cell"] != "a<;>b"} == {c: v for c, v in cells.items() if c != "a<;>b"}
    names = spark.createDataFrame([(x,) for x in ("A_b--C", " é1\t", "😀x😀", "", "K İ")], "x string")
    old = F.trim(F.regexp_replace(F.lower(F.regexp_replace("x", "[^a-zA-Z0-9]", " ")), r"\s+", " "))
    assert all(r[0] == r[1] for r in names.select(tx.normalize(F.col("x")), old).collect())
