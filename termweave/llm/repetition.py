"""Quality rules by repetition coverage.

For every document, with rolling hashes over its words in numpy:

* ``top_chars_n`` (n = 2, 3, 4): characters in all occurrences of the repeated
  n-gram that covers the most,
* ``dup_chars_n`` (n = 5..10): characters inside n-grams that occur more than
  once, each character once,
* ``dup_lines`` / ``dup_line_chars``: lines equal to an earlier line of the same
  document, and their characters.

Characters are those of words. A document is kept if no share of its
characters (lines) is above its threshold. Only the n-grams whose (n-1)-gram
repeats can repeat, so each length looks at what is left by the one before.

Defined cases: null, empty and wordless texts have zeros and ``keep = false``;
repeated rows give repeated results; a null id stays null; an empty table gives
an empty result; other columns are ignored (stage: passed on untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE2, Rolling, Words, mix, pieces, small_batches, two

#: Largest allowed share in percent.
TOP = {2: 20, 3: 18, 4: 16}
DUP = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINES, LINE_CHARS = 30, 20

COLUMNS = ["n_words", "n_chars", "n_lines", *(f"top_chars_{n}" for n in TOP), *(f"dup_chars_{n}" for n in DUP), "dup_lines", "dup_line_chars"]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how many are equal to it, and the number of its group."""
    order = np.argsort(keys)
    s = keys[order]
    new = np.empty(len(s), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    return np.bincount(group)[group] if len(s) else group, group


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text (null as empty)."""
    w = Words(texts)
    docs = len(texts)
    by_doc = lambda of, amount: np.bincount(w.doc[of], weights=amount, minlength=docs).astype(np.int64)
    everything = np.arange(len(w.doc))
    out = {"n_words": np.diff(w.first), "n_chars": by_doc(everything, w.chars)}
    salt = mix(w.doc.astype(np.uint64) + np.uint64(1))
    roll, left = Rolling(w.hash), w.left()
    length = np.concatenate([[0], np.cumsum(w.chars)])
    at = everything
    for n in range(2, max(DUP) + 1):
        at = at[left[at] >= n]
        count, group = _groups(roll.of(at, at + n) ^ salt[at])
        twice = count > 1
        at, count, group = at[twice], count[twice], group[twice]
        if n in TOP:
            best = np.zeros(docs, np.int64)
            np.maximum.at(best, w.doc[at], count * (length[at + n] - length[at]))
            out[f"top_chars_{n}"] = best
        if n in DUP:
            depth = np.zeros(len(w.doc) + 1, np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + n, -1)
            inside = np.flatnonzero(np.cumsum(depth)[:-1] > 0)
            out[f"dup_chars_{n}"] = by_doc(inside, w.chars[inside])
    # Lines: words between line ends.
    ends = np.union1d(np.flatnonzero(w.data == 10), w.off)
    first = np.unique(np.searchsorted(w.start, ends))
    first = first[first < len(w.doc)]
    stop = np.append(first[1:], len(w.doc))[: len(first)]
    doc = w.doc[first]
    key = roll.of(first, stop) ^ salt[first]
    _, seen = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[seen] = False
    out["n_lines"] = np.bincount(doc, minlength=docs)
    out["dup_lines"] = np.bincount(doc[again], minlength=docs)
    out["dup_line_chars"] = np.bincount(doc[again], weights=(length[stop] - length[first])[again], minlength=docs).astype(np.int64)
    return out


def decide(m: dict[str, np.ndarray]) -> np.ndarray:
    chars, keep = m["n_chars"], m["n_words"] > 0
    for name, most in [*((f"top_chars_{n}", p) for n, p in TOP.items()), *((f"dup_chars_{n}", p) for n, p in DUP.items()), ("dup_line_chars", LINE_CHARS)]:
        keep &= m[name] * 100 <= most * chars
    return keep & (m["dup_lines"] * 100 <= LINES * m["n_lines"])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts, _ in pieces(batches):
        m = measure(texts)
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(m[c], pa.int64()) for c in COLUMNS), pa.array(decide(m))], ["doc_id", *COLUMNS, "keep"])


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measures and ``keep``. One pass, no shuffle."""
    return two(docs, id_col, text_col).mapInArrow(_run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", keep boolean")


def _keeps(texts: pa.Array) -> pa.Array:
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    found = [decide(measure(t)) for _, t, _ in pieces(iter([batch]))]
    return pa.array(np.concatenate(found) if found else np.zeros(0, bool))


def keeps(text: Column) -> Column:
    """True for texts that pass every rule; false for null."""
    small_batches(SparkSession.active())
    return F.arrow_udf(_keeps, "boolean")(text.cast("string"))


def _sql() -> str:
    grams = range(2, max(DUP) + 1)
    parts = []
    for n in grams:
        parts.append(
            f"SELECT k, i, {n} AS n, l, count(*) OVER (PARTITION BY k, g) AS c FROM ("
            f"SELECT k, i, array_to_string(ws[i:i+{n - 1}], ' ') AS g, list_sum(list_transform(ws[i:i+{n - 1}], lambda x: length(x))) AS l FROM w WHERE i + {n - 1} <= len(ws))"
        )
    tops = ", ".join(f"coalesce(max(CASE WHEN n = {n} AND c > 1 THEN c * l END), 0) AS t{n}" for n in TOP)
    covered = " UNION ALL ".join(f"SELECT DISTINCT k, {n} AS n, i + o AS i FROM g, range({n}) r(o) WHERE n = {n} AND c > 1" for n in DUP)
    dups = ", ".join(f"coalesce(sum(CASE WHEN n = {n} THEN length(ws[i]) END), 0) AS d{n}" for n in DUP)
    checks = [f"t{n} * 100 <= {p} * chars" for n, p in TOP.items()] + [f"d{n} * 100 <= {p} * chars" for n, p in DUP.items()] + [f"lc * 100 <= {LINE_CHARS} * chars", f"dl * 100 <= {LINES} * lines", "words > 0"]
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lower(coalesce(text, '')) AS x FROM documents),
a AS MATERIALIZED (SELECT k, doc_id, x, regexp_extract_all(x, '{WORD_RE2}') AS ws FROM d),
w AS (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM a),
g AS MATERIALIZED ({' UNION ALL '.join(parts)}),
top AS (SELECT k, {tops} FROM g GROUP BY k),
cov AS ({covered}),
dup AS (SELECT k, {dups} FROM cov JOIN a USING (k) GROUP BY k),
l0 AS (SELECT k, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM a),
l1 AS (SELECT k, i, array_to_string(regexp_extract_all(line, '{WORD_RE2}'), ' ') AS line, list_sum(list_transform(regexp_extract_all(line, '{WORD_RE2}'), lambda x: length(x))) AS c FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY k, line ORDER BY i) AS r FROM l1 WHERE line <> ''),
ln AS (SELECT k, count(*) AS lines, count(*) FILTER (r > 1) AS dl, coalesce(sum(c) FILTER (r > 1), 0) AS lc FROM l2 GROUP BY k),
m AS (SELECT doc_id, len(ws) AS words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS chars, coalesce(lines, 0) AS lines, coalesce(dl, 0) AS dl, coalesce(lc, 0) AS lc,
  {', '.join(f'coalesce(t{n}, 0) AS t{n}' for n in TOP)}, {', '.join(f'coalesce(d{n}, 0) AS d{n}' for n in DUP)}
  FROM a LEFT JOIN top USING (k) LEFT JOIN dup USING (k) LEFT JOIN ln USING (k))
SELECT doc_id, words::BIGINT AS n_words, chars::BIGINT AS n_chars, lines::BIGINT AS n_lines,
  {', '.join(f't{n}::BIGINT AS top_chars_{n}' for n in TOP)}, {', '.join(f'd{n}::BIGINT AS dup_chars_{n}' for n in DUP)},
  dl::BIGINT AS dup_lines, lc::BIGINT AS dup_line_chars, {' AND '.join(checks)} AS keep
FROM m"""


SQL = _sql()
