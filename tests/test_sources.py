"""Readers, settings, services and the knowledge base."""

from __future__ import annotations

import io
import json
import tarfile

import pytest

from termweave.sources import remote, tables
from termweave.sources.knowledge import KnowledgeBase, KnowledgeError, bootstrap, export_archive, import_archive
from termweave.sources.settings import Settings


def test_text_tables_have_texts(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("id\tage\n01\t7\n")
    (tmp_path / "a.csv").write_text('id,"a,ge"\n01,"say ""x"""\n')
    assert tables.read_text_table(spark, str(tmp_path / "a.tsv")).collect()[0].asDict() == {"id": "01", "age": "7"}
    assert tables.read_text_table(spark, str(tmp_path / "a.csv")).collect()[0].asDict() == {"id": "01", "a,ge": 'say "x"'}


def test_typed_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\ny,oops\n")
    found = tables.read_typed(spark, str(tmp_path / "a.csv"), "name string, n int, more double").collect()
    assert [tuple(r) for r in found] == [("x", 1, None), ("y", None, None)]


def test_cells_of_awkward_names(spark):
    df = spark.createDataFrame([(1, "a", None)], "id int, `x.y` string, `z z` string")
    assert {(r["row_id"], r["col"], r["cell"]) for r in tables.to_cells(df, "id").collect()} == {(1, "x.y", "a"), (1, "z z", None)}


def test_value_dictionary(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"sex": ["Male", " Female ", "", "Unknown"], "other": ["x"]}))
    fields = spark.createDataFrame([("sex",)], "field_name string")
    found = tables.read_value_dictionary(spark, str(tmp_path / "v.json"), fields)
    assert {(r["field"], r["value"]) for r in found.collect()} == {("sex", "Male"), ("sex", "Female")}
    assert tables.read_value_dictionary(spark, "", fields) is None
    assert tables.read_value_dictionary(spark, str(tmp_path / "missing.json"), fields) is None
    assert tables.read_value_dictionary(spark, str(tmp_path / "v.json"), spark.createDataFrame([("age",)], "field_name string")) is None


def test_envelope_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"v": 1}, "terms": [{"label": "A", "obo_id": "X:1", "synonyms": ["b"]}, {"label": "B"}]}))
    terms = tables.read_envelope(spark, str(tmp_path / "c.json"))
    assert {r["label"] for r in terms.collect()} == {"A", "B"}
    tables.write_envelope(terms, str(tmp_path / "out"), {"source": "test"})
    assert spark.read.json(str(tmp_path / "out/terms")).count() == 2


def test_descendants_hold_their_root(spark):
    rows = spark.createDataFrame([(json.dumps({"C1": ["C2", "C3"], "C9": ["C8"]}),)], "value string")
    assert {tuple(r) for r in tables.descendants(rows, ["C1", "C5"]).collect()} == {("C1", "C1"), ("C1", "C2"), ("C1", "C3"), ("C5", "C5")}


def test_names_are_guarded():
    assert tables.corpus_path("d", "disease", "ncit", "_ab1") == "d/ncit_disease_corpus_ab1"
    for bad in ("A", "a-b", "../x", ""):
        with pytest.raises(ValueError):
            tables.identifier(bad)
    with pytest.raises(ValueError):
        tables.corpus_path("d", "disease", "ncit", "x")


def test_settings_order(tmp_path, monkeypatch):
    (tmp_path / "termweave.toml").write_text("top_k = 7\nfuzzy_thresh = 80\n")
    monkeypatch.setenv("FUZZY_THRESH", "85")
    s = Settings.resolve(str(tmp_path), numeric_thresh=0.1)
    assert (s.top_k, s.fuzzy_thresh, s.numeric_thresh, s.s4_threshold) == (7, 85.0, 0.1, 0.6)
    with pytest.raises(TypeError):
        Settings.resolve(str(tmp_path), nothing=1)


def test_resolve_prefers_the_user(tmp_path):
    (a := tmp_path / "a").mkdir()
    (b := tmp_path / "b").mkdir()
    (b / "x").write_text("b")
    assert tables.resolve("x", str(a), str(b)) == str(b / "x")
    (a / "x").write_text("a")
    assert tables.resolve("x", str(a), str(b)) == str(a / "x")
    with pytest.raises(FileNotFoundError):
        tables.resolve("y", None, str(b))


def test_attempts():
    said = iter([(429, None, 0.5), (503, None, None), (200, "ok", None)])
    waits: list[float] = []
    assert remote.attempt(lambda k: next(said), "k", 3, waits.append) == "ok"
    assert waits[0] == 0.5 and len(waits) == 2
    assert remote.attempt(lambda k: (404, None, None), "k", 3, waits.append) is None and len(waits) == 2

    def broken(key):
        raise OSError

    assert remote.attempt(broken, "k", 2, waits.append) is None


def test_pace_falls_and_recovers():
    now = [0.0]
    p = remote.Pace(10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(11):
        p.wait()
    assert now[0] == pytest.approx(1.0)
    p.failed()
    assert p.rate == pytest.approx(7)
    for _ in range(50):
        p.went_well()
    assert p.rate == 10


def test_fetching_asks_each_key_once(spark):
    keys = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "key string")
    load = lambda: lambda key: (200, key * 2, None) if key == "a" else (404, None, None)
    found = remote.fetch_all(keys, remote.Service("t", 1000, partitions=2), load)
    assert sorted(map(tuple, found.collect())) == [("a", "aa"), ("b", None)]


@pytest.fixture
def base(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    rows = spark.createDataFrame([("lung ca", "Lung Cancer", "C1"), ("lc", "Lung Cancer", "C1"), ("lc", "Lung Cancer", "C1")], "synonym string, official_label string, code string")
    kb.append("synonyms", "ncit_disease", rows)
    return kb


def test_append_ignores_what_is_there(spark, base):
    more = spark.createDataFrame([("lc", "Lung Cancer", "C1"), ("bc", "Breast Cancer", "C2")], "synonym string, official_label string, code string")
    base.append("synonyms", "ncit_disease", more)
    assert tuple(base.stats("ncit_disease").first()) == (3, 2, 2)
    codes = spark.createDataFrame([("C1",), ("C7",)], "code string")
    assert [r[0] for r in base.missing("synonyms", "ncit_disease", codes).collect()] == ["C7"]
    assert base.consistent("synonyms", "ncit_disease", 3)
    base.append("synonyms", "ncit_disease", more, rebuild=True)
    assert tuple(base.stats("ncit_disease").first()) == (2, 2, 2)
    base.drop("synonyms", "ncit_disease")
    assert not base.has("synonyms", "ncit_disease")


def test_archive_round_trip(spark, base, tmp_path):
    archive = str(tmp_path / "kb.tar.gz")
    manifest = export_archive(base.folder, archive)
    assert manifest["files"] and all(len(f["sha256"]) == 64 for f in manifest["files"])
    names = import_archive(archive, str(tmp_path / "new"))
    assert len(names) == len(manifest["files"])
    assert KnowledgeBase(spark, str(tmp_path / "new")).read("synonyms", "ncit_disease").count() == 2
    with pytest.raises(KnowledgeError) as e:
        import_archive(archive, str(tmp_path / "new"))
    assert e.value.code == 4
    assert import_archive(archive, str(tmp_path / "new"), force=True) == names


def _archive(path, files: dict[str, bytes]):
    with tarfile.open(path, "w:gz") as out:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            out.addfile(info, io.BytesIO(body))
    return str(path)


@pytest.mark.parametrize(
    ("files", "code"),
    [
        ({"manifest.json": b'{"kb_format_version": 9, "files": []}'}, 3),
        ({"a": b"x"}, 2),
        ({"../evil": b"x"}, 5),
        ({"a": b"x", "manifest.json": b'{"kb_format_version": 1, "files": [{"path": "a", "sha256": "0"}]}'}, 5),
    ],
)
def test_bad_archives(tmp_path, files, code):
    with pytest.raises(KnowledgeError) as e:
        import_archive(_archive(tmp_path / "x.tar.gz", files), str(tmp_path / "kb"))
    assert e.value.code == code
    assert not (tmp_path / "kb" / "a").exists() and not (tmp_path / "evil").exists()


def test_missing_archive(tmp_path):
    with pytest.raises(KnowledgeError) as e:
        import_archive(str(tmp_path / "none"), str(tmp_path))
    assert e.value.code == 2
    with pytest.raises(KnowledgeError) as e:
        export_archive(str(tmp_path / "none"), str(tmp_path / "x"))
    assert e.value.code == 2


def test_bootstrap_copies_once(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_text("1")
    assert bootstrap(str(tmp_path / "a"), str(tmp_path / "b"), ["x", "y"]) == ["x"]
    assert bootstrap(str(tmp_path / "a"), str(tmp_path / "b"), ["x"]) == []
    assert bootstrap(str(tmp_path / "a"), str(tmp_path / "b"), ["x"], force=True) == ["x"]
