"""Documents with everything that can go wrong."""

from __future__ import annotations

import random

import pytest

#: Columns of the input whose names the operators use inside.
CLASHING = ("h", "key", "node", "print", "u", "v", "k", "t", "row", "none", "n", "l", "id", "r", "g", "a", "b", "ord", "chunk", "recipe", "text_key", "keep_id", "copies", "spans", "cut", "at", "pos", "again", "start", "end", "shard", "bin", "piece", "group_id", "is_first", "keep", "h1", "h2", "one", "sub", "_k")

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees near river bends and count every silver fish that swims below moonlit stones after midnight rain has fallen softly upon sleeping villages where lanterns flicker along narrow lanes until morning bells call bakers back to warm ovens".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """(doc_id, text, lang, source, n_chars, and clashing columns): nulls, empty, huge, repeated and tied rows."""
    long = prose(9, 40_000)
    same = prose(1, 80)
    rows = [
        (1, same, "en", "a"),
        (2, same, "en", "a"),
        (2, same, "en", "a"),
        (None, same, None, None),
        (3, None, "en", "a"),
        (4, "", "en", "a"),
        (5, " \n\t ", "en", None),
        (6, "!!! ... ???", "en", "a"),
        (7, long, "en", "a"),
        (8, prose(2, 90), None, "a"),
        (9, prose(3, 90) + " " + " ".join(prose(1, 80).split()[5:70]), "de", "a"),
        (None, None, None, None),
        (10, "x" * 300_000, "en", "a"),
        (11, "naïve Ünïcode — 日本語テキスト 🎉 ▁ marker\u0000 end", "fr", "a"),
    ]
    full = [(i, t, lang, s, None if t is None else len(t), *("c" for _ in CLASHING)) for i, t, lang, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
