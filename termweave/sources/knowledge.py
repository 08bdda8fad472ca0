"""The knowledge base: Parquet tables in a folder, appended to by key, exported and imported as an archive.

Tables: ``synonyms`` (synonym, official_label, code), ``contexts`` (term, code,
context), ``terms`` (term), ``embeddings`` (key, text, normalized_text, model_name,
source, embedding). A vector lives beside its row: there is no index to drift.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import tarfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import table_stats
from ..operators.exact import append_missing
from .tables import exists, identifier

KEYS = {"synonyms": ["code", "synonym"], "contexts": ["code"], "terms": ["term"], "embeddings": ["key"], "concepts": ["code"]}
FORMAT = 1


class KnowledgeError(Exception):
    """code: 2 something is missing, 3 another format, 4 it is there already, 5 it is damaged."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


class KnowledgeBase:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, kind: str, name: str) -> str:
        return f"{self.folder}/{kind}/{identifier(name)}"

    def has(self, kind: str, name: str) -> bool:
        return exists(self.spark, self.path(kind, name))

    def read(self, kind: str, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(kind, name))
        return df.withColumnRenamed("nci_code", "code") if "nci_code" in df.columns and "code" not in df.columns else df

    def append(self, kind: str, name: str, rows: DataFrame, rebuild: bool = False) -> None:
        """Add the rows whose key isn't there; or replace the table."""
        if rebuild or not self.has(kind, name):
            fresh = append_missing(rows.limit(0), rows, KEYS[kind])
            fresh.write.mode("overwrite").parquet(self.path(kind, name))
        else:
            append_missing(self.read(kind, name), rows, KEYS[kind]).select(*self.read(kind, name).columns).write.mode("append").parquet(self.path(kind, name))

    def missing(self, kind: str, name: str, codes: DataFrame) -> DataFrame:
        """The codes (code) that the table lacks."""
        return codes.distinct() if not self.has(kind, name) else codes.distinct().join(self.read(kind, name).select("code"), "code", "left_anti")

    def stats(self, name: str) -> DataFrame:
        return table_stats(self.read("synonyms", name))

    def consistent(self, kind: str, name: str, count: int) -> bool:
        return self.has(kind, name) and self.read(kind, name).count() == count

    def drop(self, kind: str, name: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(kind, name))
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# --- archives (files of a local folder) ---------------------------------------


def _digest(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def export_archive(folder: str, archive: str, names: list[str] | None = None, version: str = "1") -> dict:
    """Pack a knowledge base (all tables, or those named) with a manifest of digests."""
    root = Path(folder)
    if not root.is_dir():
        raise KnowledgeError(2, f"there is no knowledge base at {folder}")
    wanted = [p for p in sorted(root.rglob("*")) if p.is_file() and (not names or len(p.relative_to(root).parts) > 1 and p.relative_to(root).parts[1] in names)]
    if not wanted:
        raise KnowledgeError(2, "there is nothing to export")
    files = [{"path": str(p.relative_to(root)), "sha256": _digest(p), "bytes": p.stat().st_size} for p in wanted]
    manifest = {"kb_format_version": FORMAT, "package_version": version, "created_utc": datetime.now(UTC).isoformat(), "category_filter": names, "files": files}
    with tarfile.open(archive, "w:gz") as out:
        note = root / ".manifest.json"
        note.write_text(json.dumps(manifest))
        out.add(note, "manifest.json")
        note.unlink()
        for p in wanted:
            out.add(p, str(p.relative_to(root)))
    return manifest


def import_archive(archive: str, folder: str, force: bool = False) -> list[str]:
    """Unpack an archive after checking its format, paths and digests; what is there stays unless forced."""
    if not Path(archive).is_file():
        raise KnowledgeError(2, f"there is no archive {archive}")
    root = Path(folder).resolve()
    stage = root.parent / f".{root.name}.import"
    shutil.rmtree(stage, ignore_errors=True)
    try:
        with tarfile.open(archive) as box:
            for m in box.getmembers():
                if not (stage / m.name).resolve().is_relative_to(stage.resolve()) or not (m.isfile() or m.isdir()):
                    raise KnowledgeError(5, f"{m.name} would be written elsewhere")
            box.extractall(stage, filter="data")
        if not (stage / "manifest.json").is_file():
            raise KnowledgeError(2, "the archive has no manifest")
        manifest = json.loads((stage / "manifest.json").read_text())
        if manifest.get("kb_format_version") != FORMAT:
            raise KnowledgeError(3, f"format {manifest.get('kb_format_version')} isn't {FORMAT}")
        names = [f["path"] for f in manifest["files"]]
        for f in manifest["files"]:
            p = (stage / f["path"]).resolve()
            if not p.is_relative_to(stage.resolve()) or not p.is_file() or _digest(p) != f["sha256"]:
                raise KnowledgeError(5, f"{f['path']} is damaged")
        if not force and (there := [n for n in names if (root / n).exists()]):
            raise KnowledgeError(4, f"{there[0]} is there already")
        for n in names:
            (root / n).parent.mkdir(parents=True, exist_ok=True)
            (stage / n).replace(root / n)
        return names
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def bootstrap(source: str, target: str, names: list[str], force: bool = False) -> list[str]:
    """Copy the files that aren't there yet."""
    done = []
    for n in names:
        a, b = Path(source) / n, Path(target) / n
        if a.is_file() and (force or not b.exists()):
            b.parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(a, b)
            done.append(n)
    return done
