"""Similarities of texts, sets and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of a label that fit the bits of a long without its sign and carry.
BITS = 62


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(c), r"\s+"), lambda t: t != "")), " ")


def letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def letter_masks(label: Column) -> Column:
    """For each letter of the label, a long with a bit for each of its places. Made once for each label."""
    all_ = letters(label)
    places = F.sequence(F.lit(1), F.length(label))

    def mask(letter: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda m, j: m.bitwiseOR(F.when(F.substring(label, j, F.lit(1)) == letter, F.call_function("shiftleft", F.lit(1).cast("long"), j - 1)).otherwise(F.lit(0).cast("long"))))

    pairs = F.transform(F.array_distinct(all_), lambda x: F.struct(x, mask(x)))
    return F.when(F.length(label).between(1, BITS), F.map_from_entries(pairs))


def lcs(text: Column, label: Column, masks: Column) -> Column:
    """Length of the longest common subsequence.

    Bit-parallel over a long where the label's masks exist (one step for each
    letter of text); longer labels take the table of lengths.
    """
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(label)) - F.lit(1).cast("long")

    def step(s: Column, letter: Column) -> Column:
        u = s.bitwiseAND(F.coalesce(masks[letter], F.lit(0).cast("long")))
        return (s + u).bitwiseOR(s - u).bitwiseAND(full)

    rest = F.aggregate(letters(text), full, step)
    fast = F.bit_count(full.bitwiseXOR(rest))
    return F.when(masks.isNotNull(), fast).otherwise(_lcs_table(text, label)).cast("long")


def _lcs_table(a: Column, b: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(b))

    def row(before: Column, letter: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            hit = F.substring(b, j, F.lit(1)) == letter
            return F.array_append(now, F.when(hit, before[j - 1] + 1).otherwise(F.greatest(before[j], now[j - 1])))

        return F.aggregate(places, F.array(F.lit(0)), cell)

    table = F.aggregate(letters(a), F.array_repeat(F.lit(0), F.length(b) + 1), row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(table, -1))


def indel_ratio(common: Column, a: Column, b: Column) -> Column:
    """200 * LCS / (both lengths), 100 for two empty texts."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 100.0).otherwise(F.lit(200.0).cast("double") * common / both)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of names without separators, by the longer one."""
    a, b = (F.regexp_replace(F.lower(x), "[_ ]", "") for x in (a, b))
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 0.0).otherwise(F.levenshtein(a, b) / most)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """What share of the smaller set is in the other; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector by its length."""
    size = F.sqrt(dot(v, v)) + 1e-12
    return F.transform(v, lambda x: x.cast("double") / size)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def grams(c: Column, n: int = 3) -> Column:
    """The character n-grams of a text between spaces, with repeats."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1))), lambda i: F.substring(padded, i, F.lit(n)))


def partial_ratio(needle: str, text: Column) -> Column:
    """Best indel ratio of a fixed needle with the windows of a text (and with all of it where it is shorter)."""
    n = len(needle)
    label = F.lit(needle)
    masks = letter_masks(label)

    def score(w: Column) -> Column:
        return indel_ratio(lcs(w, label, masks), w, label)

    # Windows of the needle's length, and the shorter ones at both ends.
    starts = F.sequence(F.lit(2 - n), F.greatest(F.lit(1), F.length(text)))
    windows = F.transform(starts, lambda i: F.substring(text, F.greatest(i, F.lit(1)), F.least(F.lit(n), i + (n - 1))))
    return F.when(F.length(text) >= n, F.array_max(F.transform(windows, score))).otherwise(score(text))
