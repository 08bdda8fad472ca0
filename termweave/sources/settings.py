"""Settings: argument, else environment, else project file, else default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    fuzzy_thresh: float = 92.0
    numeric_thresh: float = 0.6
    field_alias_thresh: float = 0.5
    value_dict_thresh: float = 0.85
    value_unique_cap: int = 50
    value_percentage_thresh: float = 0.2
    llm_threshold: float = 0.5
    synonym_below: float = 0.9
    s3_threshold: float = 0.9
    s4_threshold: float = 0.6
    top_k: int = 5
    data_dir: str = ""
    schema: str = "gdc"

    @classmethod
    def resolve(cls, project: str | None = None, **given) -> Settings:
        """A snapshot; names in the environment are upper case, with or without TERMWEAVE_."""
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"no such settings: {sorted(unknown)}")
        found = _project(project)
        out = {}
        for f in fields(cls):
            value = given.get(f.name)
            for name in (f"TERMWEAVE_{f.name}".upper(), f.name.upper()):
                if value is None and os.environ.get(name):
                    value = os.environ[name]
            if value is None:
                value = found.get(f.name, f.default)
            out[f.name] = type(f.default)(value)
        return cls(**out)


def _project(path: str | None) -> dict:
    here = Path(path or ".")
    for name, keys in (("termweave.toml", ()), ("pyproject.toml", ("tool", "termweave"))):
        if (file := here / name).is_file():
            data = tomllib.loads(file.read_text())
            for k in keys:
                data = data.get(k, {})
            if data:
                return data
    return {}
