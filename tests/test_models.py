"""Model stages, rerankers, connectors, stores and corpora against what they were given."""

from __future__ import annotations

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.__main__ import main
from termweave.operators import callables, clustering, fusion, rerank, taxonomy, topk
from termweave.plans import corpus, models, ontology, schema
from termweave.sources import remote, stores


def table(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


# --- rerankers --------------------------------------------------------------------


def test_lists_longer_than_a_model_sees():
    labels = [f"l{i:02d}" for i in range(45)]
    asked = []

    def model(query, some):
        asked.append(len(some))
        return " ".join(str(some.index(x)) for x in sorted(some, reverse=True))

    found = rerank.put_in_order(model, "q", labels)
    ahead = [x for i in (0, 20, 40) for x in sorted(labels[i : i + 20], reverse=True)[:5]]
    assert asked == [20, 20, 5] and found == ahead + [x for x in labels if x not in ahead]
    asked.clear()
    rerank.put_in_order(model, "q", [f"l{i:03d}" for i in range(101)])
    assert asked == [20] * 5 + [1, 26]


@pytest.mark.parametrize(("answer", "order"), [("2, 0", [2, 0, 1]), ("1 1 7 x", [1, 0, 2]), (None, [0, 1, 2]), ("99999999999999", [0, 1, 2])])
def test_order_of_an_answer(answer, order):
    assert rerank.parse_order(answer, 3) == order


def test_true_share():
    assert rerank.true_share([2.0], [0.0])[0] == pytest.approx(np.exp(2) / (np.exp(2) + 1))


# --- model stages -----------------------------------------------------------------


def test_context_columns(spark):
    df = table(spark, [("a", "b", "c")], "site string, note string, curated_ontology string")
    seen = []

    def model(prompt):
        seen.append(prompt)
        return ["no list", '["site", "nowhere"]', '```json\n["site", "curated_ontology"]\n```'][len(seen) - 1]

    assert models.context_columns(df, model) == ["site"]
    assert "curated" not in seen[0] and len(seen) == 3
    assert models.context_columns(df, lambda p: 1 / 0) == ["site", "note"]


def test_variants_and_modes(spark):
    terms = table(spark, [("lung", 0), ("liver", 60)], "canonical string, ord long")
    load = lambda: lambda prompt: json.dumps({"lung": ["Lungs", " "], "heart": ["x"]}) if "lung" in prompt else "none"
    assert [tuple(r) for r in models.variants(terms, load).collect()] == [("Lungs", "lung")]
    assert models.mode_of(table(spark, [(None,)], "curated_ontology string")) == "prod"
    assert models.mode_of(table(spark, [("x",)], "curated_ontology string")) == "test"
    assert models.mode_of(table(spark, [("x",)], "other string")) == "prod"


def test_aliases_of_nothing_are_an_error(spark):
    fields = table(spark, [("a", 0)], "field_name string, ord long")
    with pytest.raises(ValueError, match="no answer"):
        models.alias_dictionary(fields, lambda: lambda p: "nobody,x,yes")


def test_rewriter(spark):
    queries = table(spark, [(1, "breast ca"), (2, "?")], "qid long, text string")
    load = lambda: lambda prompt: '["breast cancer", "cancer"]' if "breast" in prompt else "sorry"
    search = lambda q, k: q.select("qid", F.lit(1).cast("long").alias("rank"), F.upper("text").alias("label"), F.lit(0.5).alias("score"))
    found = models.rewriter(search, load, 5)(queries).orderBy("rank").collect()
    assert [(r["qid"], r["rank"], r["label"]) for r in found] == [(1, 1, "BREAST CANCER"), (1, 2, "CANCER")]


def test_field_prompts_hold_values(spark):
    cells = table(spark, [(i, "c", f"v{i % 12:02d}") for i in range(40)], "row_id long, col string, cell string")
    fields = table(spark, [("a", 0), ("b", 1)], "field_name string, ord long")
    load = lambda: lambda prompt: json.dumps([{"field": "b" if "v09" in prompt and "v10" not in prompt and "a, b" in prompt else "a", "confidence": 0.5}])
    assert [r["field"] for r in models.schema_model(fields, load, 3, cells)(cells.select("col")).collect()] == ["b"]


def test_judges():
    assert models.model_coherence(lambda: lambda p: "about 0.75")(["a", "b"]) == 0.75
    assert models.model_coherence(lambda: lambda p: 1 / 0)(["a"]) == 0.0
    veto = models.model_veto(lambda: lambda p: "No." if "A: x, y" in p else "yes", ["x", "y", "z"])
    assert veto([0, 1], [2]) and not veto([0], [1, 2])


def test_a_judge_decides_on_clusters():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 0.01, (50, 4)) + [1, 0, 0, 0], rng.normal(0, 0.01, (50, 4)) + [0, 1, 0, 0]])
    names = [f"a{i}" for i in range(50)] + [f"b{i}" for i in range(50)]
    seen = []

    def judge(some):
        seen.append(len(some))
        return 1.0 if len({n[0] for n in some}) == 1 else 0.2

    clusters = clustering.coherent_clusters(names, v, clustering.ClusterConfig(threshold=0.9), judge)
    assert sorted(map(len, clusters)) == [50, 50] and seen == [30, 30, 30]
    both = [list(range(100))]
    assert len(clustering.refine(both, v)) == 2 and clustering.refine(both, v, veto=lambda a, b: True) == both


def test_calls_wait_as_they_are_told(spark, monkeypatch):
    assert remote.back_off(2, 7.0) == 7.0 and remote.back_off(0, busy=False) == 0.0 and 2.0 <= remote.back_off(2) <= 4.0
    load = lambda: iter([ValueError("x")]).throw  # noqa: E731 - any failure
    df = table(spark, [("p",)], "prompt string")
    assert callables.call(df, lambda: lambda p: 1 / 0).first()["answer"] is None and load


# --- services ---------------------------------------------------------------------


def test_pages_go_on_to_the_last(spark):
    def load():
        book = {"k": {"_embedded": {"terms": [{"label": "a", "obo_id": "X:1"}]}, "_links": {"next": {"href": "k2"}}}, "k2": {"_embedded": {"terms": [{"label": "", "obo_id": "X:2"}, {"label": "b", "obo_id": "X:3"}]}}}
        return lambda key: (200, json.dumps(book[key]), None) if key in book else (404, None, None)

    pages = remote.fetch_pages(table(spark, [("k",), ("k",), (None,)], "key string"), remote.Service("t", 1000), load)
    assert sorted((r["key"], r["obo_id"], r["label"]) for r in remote.page_terms(pages).collect()) == [("k", "X:1", "a"), ("k", "X:3", "b")]
    with pytest.raises(Exception, match="can't be had"):
        remote.fetch_pages(table(spark, [("no",)], "key string"), remote.Service("t", 1000), load).collect()


def test_versions_and_first_hits(spark):
    bodies = [("a", '{"version": "1", "config": {"title": "A"}}'), ("b", '{"config": {"versionIri": "http://x/releases/2024-01-02/b.owl"}}'), ("c", "broken")]
    found = {r["ontology"]: r["version"] for r in remote.ontology_versions(table(spark, bodies, "key string, body string")).collect()}
    assert found == {"a": "1", "b": "2024-01-02", "c": None}
    hits = table(spark, [("x", '{"concepts": [{"code": "C1", "name": "one"}, {"code": "C2"}]}'), ("y", '{"concepts": []}')], "key string, body string")
    assert sorted(tuple(r) for r in remote.first_hits(hits).collect()) == [("x", "C1", "one"), ("y", None, None)]


# --- stores -----------------------------------------------------------------------


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "kb.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE terms (code TEXT, n INTEGER, score REAL)")
    rows = [(f"C{i}", i, i / 2) if i % 7 else (None, None, None) for i in range(500)]
    con.executemany("INSERT INTO terms VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE empty (a TEXT)")
    con.commit()
    con.close()
    df = stores.sqlite_table(spark, path, "terms", step=60)
    assert df.dtypes == [("code", "string"), ("n", "bigint"), ("score", "double")]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)
    assert stores.sqlite_table(spark, path, "empty").count() == 0
    with pytest.raises(ValueError):
        stores.sqlite_table(spark, path, "nothing")


def test_vector_store(spark, tmp_path):
    v = np.arange(40, dtype=np.float32).reshape(10, 4)
    np.save(tmp_path / "v.npy", v)
    (tmp_path / "m.csv").write_text("text,normalized_text,model_name,source\n" + "".join(f'"T, {i}",t {i},m,s\n' for i in range(10)))
    df = stores.vector_store(spark, str(tmp_path / "v.npy"), str(tmp_path / "m.csv"), step=3)
    assert {r["text"]: r["embedding"] for r in df.collect()} == {f"T, {i}": v[i].tolist() for i in range(10)}
    assert stores.keyed(df).count() == 10
    (tmp_path / "short.csv").write_text("text\na\n")
    with pytest.raises(ValueError):
        stores.vector_store(spark, str(tmp_path / "v.npy"), str(tmp_path / "short.csv"))


def test_command_line(tmp_path, capsys):
    (tmp_path / "kb" / "terms").mkdir(parents=True)
    (tmp_path / "kb" / "terms" / "a.txt").write_text("x")
    box = str(tmp_path / "kb.tgz")
    assert main(["export", str(tmp_path / "none"), box]) == 2
    assert main(["export", str(tmp_path / "kb"), box]) == 0
    assert main(["import", box, str(tmp_path / "new")]) == 0
    assert main(["import", box, str(tmp_path / "new")]) == 4 and "is there already" in capsys.readouterr().err
    assert main(["import", box, str(tmp_path / "new"), "--force"]) == 0


# --- corpora and taxonomies ---------------------------------------------------------


def test_corpus_resolution(spark, tmp_path):
    own = table(spark, [("a", "C1")], "label string, code string")
    path = str(tmp_path / "c.csv")
    assert corpus.resolve(spark, "x", "y", own)[1] == "provided"
    assert corpus.resolve(spark, "disease", "ncit", cached=path, build=lambda: own)[1] == "built"
    again, how = corpus.resolve(spark, "disease", "ncit", cached=path)
    assert how == "cached" and again.first()[:] == ("a", "C1")
    for category, name in (("disease", "uberon"), ("treatment", "chebi"), ("disease", "mondo")):
        with pytest.raises(ValueError):
            corpus.resolve(spark, category, name)


def test_branches(spark):
    edges = table(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("x", "c")], "parent string, child string")
    labels = table(spark, [(c, c.upper()) for c in "rabcx"], "code string, label string")
    roots = table(spark, [("r",), ("a",)], "root string")
    assert {r["code"]: (r["parents"], r["children"]) for r in corpus.branch(edges, labels, roots).collect()} == {"b": (["R"], ["C"]), "c": (["A", "B", "X"], [])}
    assert {r["code"] for r in corpus.branch(edges, labels, table(spark, [("r",)], "root string"), "children").collect()} == {"a", "b"}
    found = {r["code"]: r["service"] for r in corpus.routed(table(spark, [("NCIT:C1",), ("MONDO:1",), ("ODD:1",)], "code string")).collect()}
    assert found == {"NCIT:C1": "nci", "MONDO:1": "ols", "ODD:1": None}


def test_deep_and_wide_taxonomies(spark):
    """A chain of sixty levels and two dozen diamonds: nodes count, not paths, and depth has no bound."""
    chain = [(f"n{i}", f"n{i + 1}") for i in range(60)]
    diamonds = [e for i in range(24) for e in ((f"d{i}", f"l{i}"), (f"d{i}", f"r{i}"), (f"l{i}", f"d{i + 1}"), (f"r{i}", f"d{i + 1}"))]
    edges = table(spark, chain + diamonds, "parent string, child string")
    found = {(r["root"], r["code"]): r["depth"] for r in taxonomy.descendants(edges, table(spark, [("n0",), ("d0",)], "root string")).collect()}
    assert found["n0", "n60"] == 60 and found["d0", "d24"] == 48 and len(found) == 61 + 73


# --- what was lost --------------------------------------------------------------------


def test_queries_that_no_search_finds_stay(spark):
    base = table(spark, [("lung cancer", 1), ("skin cancer", 2)], "label string, code long")
    asked = table(spark, [(1, "lung cancer"), (2, "skin cancers"), (3, "qqqq")], "qid long, text string")
    seen = []

    def rewrite(low):
        seen.extend(r["qid"] for r in low.collect())
        return low.filter("qid = 3").select("qid", F.lit(1).cast("long").alias("rank"), F.lit("skin cancer").alias("label"), F.lit(0.9).alias("score"))

    mapper = ontology.OntologyMapper(base, ontology.gram_search(base), rewrite=rewrite)
    found = {r["qid"]: r["stage"] for r in mapper.run(asked).filter("rank = 1").collect()}
    assert 3 in seen and found[3] == 4.0 and set(found) == {1, 2, 3}
    plain = ontology.OntologyMapper(base, ontology.gram_search(base)).run(asked)
    view = {r["query"]: r for r in ontology.finished(plain, asked, None, 2).collect()}
    assert set(view) == {"lung cancer", "skin cancers", "qqqq"} and view["qqqq"]["match1"] is None and view["qqqq"]["match1_score"] == "0.0000"
    assert {r["qid"] for r in fusion.low_confidence(plain, 0.5, asked).collect()} == {3}


def test_no_strategy_runs_those_before_it_again(spark):
    """What each strategy is given is a written table: plans stay small."""
    from termweave.storage import written

    plans = []

    def strategy(name):
        def run(c):
            plans.append(c._jdf.queryExecution().optimizedPlan().toString().count("Join"))
            return c.select("col", F.lit(1).cast("long").alias("rank"), F.col("col").alias("field"), F.lit(0.1).alias("score"), F.lit("").alias("source"))

        return schema.Strategy(name, run, 0.9)

    columns = table(spark, [("a",), ("b",)], "col string")
    found = schema.cascade(columns, [strategy(f"s{i}") for i in range(6)], written)
    assert plans == [0] * 6 and {r["method"] for r in found.collect()} == {"s0"}


def test_splits_start_alike_at_all_sizes():
    rng = np.random.default_rng(0)
    for n in (40, 700):
        v = np.concatenate([rng.normal(0, 0.1, (n, 3)), rng.normal(3, 0.1, (n, 3))])
        label = clustering.two_means(v)
        assert len(set(label[:n])) == len(set(label[n:])) == 1 and label[0] != label[-1]


def test_coherence_of_one_and_of_zero_vectors(spark):
    rows = [("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 0.0]), ("b", "y", [0.0, 1.0]), ("b", "z", [0.0, 0.0])]
    found = {r["cluster"]: r["scs"] for r in clustering.coherence(table(spark, rows, "cluster string, name string, embedding array<double>")).collect()}
    assert found == {"a": 1.0, "b": 0.5}


@pytest.mark.parametrize("block", (3, 1024))
def test_blocks_of_any_size_give_the_same(spark, block):
    words = ["lung cancer", "cancer of lung", "skin", "skin tumor", "aa", "lung", None, ""]
    q = table(spark, [(f"q{i}", w) for i, w in enumerate(words)], "qid string, text string")
    c = table(spark, [(i, w) for i, w in enumerate(words)], "cid long, text string")
    found = topk.gram_topk(q, c, 2, block=block).collect()

    def grams(t):
        t = f" {t} "
        return [t[i : i + 3] for i in range(max(1, len(t) - 2))]

    wanted = set()
    for i, a in enumerate(words):
        scores = []
        for j, b in enumerate(words):
            if a is not None and b is not None:
                x, y = grams(a), grams(b)
                dot = sum(x.count(g) * y.count(g) for g in set(x))
                if dot:
                    scores.append((-round(dot / (sum(x.count(g) ** 2 for g in set(x)) * sum(y.count(g) ** 2 for g in set(y))) ** 0.5, 6), j))
        wanted |= {(f"q{i}", j, -s, r) for r, (s, j) in enumerate(sorted(scores)[:2], 1)}
    assert {(r["qid"], r["cid"], r["score"], r["rank"]) for r in found} == wanted
    near = topk.token_topk(table(spark, [("q", "lung cancer")], "qid string, text string"), c, 5, 92.0, block=block).collect()
    assert [(r["cid"], r["score"]) for r in near] == [(0, 100.0)]
