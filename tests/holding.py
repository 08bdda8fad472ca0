"""Rows of two results, made comparable."""

from __future__ import annotations

import math
from decimal import Decimal


def plain(value):
    if isinstance(value, Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns: list[str], values) -> list[tuple]:
    """Rows with their columns in the order of their names, sorted."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def of(df) -> list[tuple]:
    return rows(df.columns, df.collect())


def of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows(names, found.fetchall())
