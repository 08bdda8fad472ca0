"""Repeated passages: a most-significant-digit radix sort of suffixes, WINDOW words deep.

Two suffixes begin with the same window of WINDOW words if their digits are equal: the
hash of the first DIGIT words, and that of the other words of the window. The first
pass groups suffixes by the first digit and drops those that are alone; the second
refines each group by the second digit, where the first pass left it, without moving a
row. The groups of more than one place are exactly the repeated windows (up to
collisions of both 64-bit digits).

Before the first pass, suffixes without a partner are left out by winnowing: a window
can only repeat if each DIGIT-word run in it does, the one with the least hash among
them, too. So only those runs, about 2 in WINDOW - DIGIT positions, are sent and
counted, and a suffix goes to the passes if the least run of its window repeats.

Texts that are equal are one text to the passes, that of their least doc_id: all windows
of the others repeat, and none of theirs is first. Runs and digits are counted by sums
that are combined before the shuffle; a digit with more than HOT suffixes (a license
line in a large part of all documents) isn't grouped in one task, but by such sums, too.

Result: maximal runs of repeated windows, (doc_id, start_token, end_token,
is_first); is_first marks those whose windows are the first of their group by
(doc_id, position).

Defined cases: null, empty and short texts (below WINDOW words) have no window;
rows with a null id are left out (stage: passed on); rows with one id are one
document, so that repeated rows are no repetition; a text of any length is read whole
(its suffixes are found in stretches of STRETCH words); an empty table gives an empty
result; other columns are ignored (stage: passed on untouched).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _Q2, Rolling, Words, pieces, two, written

WINDOW, DIGIT = 50, 25
_LOW = np.uint64((1 << 24) - 1)
#: Positions among which least runs are sought at once; with a window they must fit into _LOW.
STRETCH = 1 << 20
#: Suffixes of one digit, or places of one run, that are grouped in one task.
HOT = 100_000


def windows(w: Words, window: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of all windows, the least run in each, hashes of the runs)."""
    at = np.flatnonzero(w.left() >= window)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    runs = np.arange(len(w.hash) - digit + 1)
    h = Rolling(w.hash).of(runs, runs + digit)
    reach, least = window - digit + 1, np.empty(len(at), np.int64)
    for base in range(0, len(runs), STRETCH):
        i, j = np.searchsorted(at, (base, base + STRETCH))
        if i == j:
            continue
        part = h[base : base + STRETCH + reach - 1]
        m, wide, here = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64), 1, at[i:j] - base
        while 2 * wide <= reach:
            m, wide = np.minimum(m[:-wide], m[wide:]), 2 * wide
        least[i:j] = base + (np.minimum(m[here], m[here + reach - wide]) & _LOW).astype(np.int64)
    return at, least, h


def _anchors(window: int, digit: int):
    """The least runs of each text, and a row with how many words it has (below 0) if it has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, _ in pieces(batches):
            w = Words(texts)
            _, least, h = windows(w, window, digit)
            least = np.unique(least)
            doc = w.doc[least]
            long = np.flatnonzero(np.diff(w.first) >= window)
            key = rows.column(0).take(pa.array(np.concatenate([doc, long])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h[least].view(np.int64), np.zeros(len(long), np.int64)])), key, pa.array(np.concatenate([least - w.first[doc], -np.diff(w.first)[long]]).astype(np.int32))], ["h", "t", "pos"]
            )

    return run


def _suffixes(window: int, digit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, _ in pieces(batches):
            w = Words(texts)
            at, least, h = windows(w, window, digit)
            lists = rows.column(2)
            again = np.zeros(len(w.hash), bool)
            where = lists.flatten().to_numpy() + np.repeat(w.first[:-1], pc.list_value_length(lists).to_numpy())
            bound = np.repeat(w.first[1:], pc.list_value_length(lists).to_numpy())
            again[where[where < bound]] = True
            at = at[again[least]]
            doc = w.doc[at]
            rest = Rolling(w.hash, _Q2).of(at + digit, at + window) if window > digit else np.zeros(len(at), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(rest.view(np.int64)), rows.column(0).take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32))], ["d1", "d2", "doc_id", "pos"])

    return run


def _places(df: DataFrame, by: list[str], of: str) -> DataFrame:
    """Groups with more than one place (of, pos), and how many rows; combined before the shuffle."""
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("a", F.min), ("z", F.max)) for c in (of, "pos")]
    found = df.groupBy(*by).agg(F.count("*").alias("n"), *ends)
    return found.filter((F.col(f"a_{of}") != F.col(f"z_{of}")) | (F.col("a_pos") != F.col("z_pos"))).select(*by, "n")


def _radix(suffixes: DataFrame, most: int) -> DataFrame:
    """suffixes (d1, d2, doc_id, pos) -> (doc_id, pos, is_first) of those in a group of more than one place."""
    place = F.struct("doc_id", "pos")
    digits = _places(suffixes, ["d1"], "doc_id")
    hot = written(digits.filter(F.col("n") > most).select("d1"))
    # First pass: groups of one go. Second pass: the rows lie by d1 already, each group is refined by d2.
    group = Window.partitionBy("d1", "d2")
    many = (F.min("doc_id").over(group) != F.max("doc_id").over(group)) | (F.min("pos").over(group) != F.max("pos").over(group))
    left = suffixes.join(digits.filter(F.col("n") <= most).select("d1"), "d1")
    found = left.select("doc_id", "pos", many.alias("again"), (F.min(place).over(group) == place).alias("is_first")).filter("again").select("doc_id", "pos", "is_first")
    if hot.isEmpty():
        return found
    those = suffixes.join(hot, "d1", "left_semi")
    firsts = those.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("d1", "d2", "first")
    return found.unionAll(those.join(firsts, ["d1", "d2"]).select("doc_id", "pos", (F.col("first") == place).alias("is_first")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digit: int = DIGIT, hot: int = HOT) -> DataFrame:
    """Maximal runs of repeated windows as word ranges [start_token, end_token)."""
    keys = [F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("t2")]
    own = two(docs, id_col, text_col).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = own.select("doc_id", *keys)
    # Equal texts: the least id stands for all.
    one = written(texts.groupBy("t", "t2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")))
    runs = written(own.select(keys[0], "text").mapInArrow(_anchors(window, digit), "h long, t long, pos int"))
    again = _places(runs.filter("pos >= 0"), ["h"], "t").select("h")
    kept = runs.filter("pos >= 0").join(again, "h", "left_semi").groupBy("t").agg(F.collect_set("pos").alias("at"))
    asked = one.join(kept, "t").select(F.col("rep").alias("doc_id"), "t", "t2", "at")
    suffixes = own.select("doc_id", "text", *keys).join(asked, ["doc_id", "t", "t2"]).select("doc_id", "text", "at").mapInArrow(_suffixes(window, digit), "d1 long, d2 long, doc_id long, pos int")
    found = _radix(written(suffixes), hot)
    run = F.col("pos") - F.dense_rank().over(Window.partitionBy("doc_id", "is_first").orderBy("pos"))
    # Windows at places start to last.
    part = found.select("doc_id", "is_first", "pos", run.alias("run")).groupBy("doc_id", "is_first", "run").agg(F.min("pos").cast("long").alias("start"), F.max("pos").cast("long").alias("last")).drop("run")
    sizes = runs.filter("pos < 0").groupBy("t").agg((-F.min("pos")).cast("long").alias("words"))
    copied = written(one.filter("rep <> most").join(sizes, "t"))
    ends = F.col("start").alias("start_token"), (F.col("last") + window).alias("end_token"), "is_first"
    if copied.isEmpty():
        return part.select("doc_id", *ends)
    part = written(part)
    reps = copied.groupBy(F.col("rep").alias("doc_id")).agg((F.max("words") - window).alias("stop"))
    others = texts.join(copied.select("t", "t2", "rep", "words"), ["t", "t2"]).filter("doc_id <> rep").groupBy("doc_id").agg(F.max("words").alias("end_token"))
    # Of the text that stands for its copies all windows repeat; those that aren't first are known, the others are first.
    later = part.filter("NOT is_first").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "last"))).alias("l"))
    filled = reps.join(later, "doc_id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<start:long,last:long>>")))
    edge = F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).cast("long").alias("last"))
    close = F.struct((F.col("stop") + 1).alias("start"), F.col("stop").alias("last"))
    gaps = F.zip_with(F.concat(F.array(edge), "l"), F.concat("l", F.array(close)), lambda a, b: F.struct((a["last"] + 1).alias("start"), (b["start"] - 1).alias("last")))
    first = filled.select("doc_id", F.explode(F.filter(gaps, lambda g: g["start"] <= g["last"])).alias("g")).select("doc_id", "g.start", "g.last", F.lit(True).alias("is_first"))
    rest = part.join(reps.select("doc_id", F.lit(True).alias("whole")), "doc_id", "left").filter("whole IS NULL OR NOT is_first").select("doc_id", "start", "last", "is_first")
    done = rest.unionByName(first).select("doc_id", *ends)
    return done.unionByName(others.select("doc_id", F.lit(0).cast("long").alias("start_token"), "end_token", F.lit(False).alias("is_first")))


def without(texts: pa.Array, spans: pa.Array) -> list[str | None]:
    """Each text without its word ranges; None if no word is left of one that is cut."""
    out: list[str | None] = []
    batch = pa.RecordBatch.from_arrays([texts, spans], ["text", "spans"])
    for rows, block, null in pieces(iter([batch])):
        w = Words(block, hashes=False)
        for d, (text, cut) in enumerate(zip(block.to_pylist(), rows.column(1).to_pylist())):
            if not cut:
                out.append(text)
                continue
            a, b = w.first[d], w.first[d + 1]
            keep, gone, at, base = [], np.zeros(b - a, bool), 0, w.char_at[w.off[d]]
            for span in sorted(cut, key=lambda s: s["start"]):
                lo, hi = span["start"], min(span["end"], b - a)
                if lo >= hi:
                    continue
                gone[lo:hi] = True
                first, last = int(w.char_at[w.start[a + lo]] - base), int(w.char_at[w.stop[a + hi - 1]] - base)
                keep.append(text[at : max(at, first)])
                at = max(at, last)
            keep.append(text[at:])
            out.append(None if gone.all() else "".join(keep))
    return out


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array(without(texts, spans), pa.string())


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", window: int = WINDOW, digit: int = DIGIT) -> DataFrame:
    """docs with every repeated passage left in its first place only.

    chars_col, if docs has it, becomes the new length. A document of which no word
    is left goes. All other columns stay.
    """
    later = repeated_spans(docs, id_col, text_col, window, digit).filter("NOT is_first")
    spans = written(later.groupBy(F.col("doc_id").alias("k")).agg(F.collect_list(F.struct(F.col("start_token").alias("start"), F.col("end_token").alias("end"))).alias("spans")))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("k"))
    joined = rows.join(spans, "k", "left")
    whole = joined.filter("spans IS NULL").select("row")
    text = F.col("row").getField(text_col).cast("string")
    cut = joined.filter("spans IS NOT NULL").select("row", F.arrow_udf(_cut, "string")(text, F.col("spans")).alias("cut"), text.isNull().alias("none")).filter("none OR cut IS NOT NULL")
    field = F.col("row").withField(text_col, F.col("cut").cast(docs.schema[text_col].dataType))
    if chars_col and chars_col in docs.columns:
        field = field.withField(chars_col, F.length("cut").cast(docs.schema[chars_col].dataType))
    return whole.unionAll(cut.select(field.alias("row"))).select("row.*")
