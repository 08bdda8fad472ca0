"""Random documents of few words."""

from __future__ import annotations

import random


def doc(rng: random.Random, n: int, words: int) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))
