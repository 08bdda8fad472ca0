"""The public suffix of a host, by the rules of publicsuffix.org.

A rule is a suffix; a leading ``*`` stands for any one label, a leading ``!`` makes
an exception, whose suffix lacks the first label. Exceptions go before all others,
then the longest rule; a host that no rule meets has its last label as suffix. Rules
with letters outside ASCII hold in both spellings (Unicode and ``xn--``). The list
that is shipped is used whole, its private part (``github.io``), too.
"""

from __future__ import annotations

import functools
import pkgutil
from collections.abc import Callable, Iterable

import pyarrow as pa


def shipped() -> tuple[str, ...]:
    """The rules of the list in this package."""
    lines = pkgutil.get_data(__package__, "public_suffix_list.dat").decode("utf-8").splitlines()
    return tuple(line.split()[0] for line in lines if line.strip() and not line.startswith("//"))


def _spellings(rule: str) -> Iterable[str]:
    yield rule
    if not rule.isascii():
        yield ".".join(label if label.isascii() else label.encode("idna").decode("ascii") for label in rule.split("."))


@functools.lru_cache(8)
def finder(rules: tuple[str, ...] | None = None) -> Callable[[str], str]:
    """A function from a lower-case host to its public suffix; None: the rules of the list."""
    exact, wild, exceptions = set(), set(), set()
    for rule in shipped() if rules is None else rules:
        for r in _spellings(rule.lower()):
            if r.startswith("!"):
                exceptions.add(r[1:])
            elif r.startswith("*."):
                wild.add(r[2:])
            else:
                exact.add(r)
    deepest = max((r.count(".") for r in exact | wild | exceptions), default=0) + 2

    def suffix(host: str) -> str:
        labels = host.split(".")
        tails = [".".join(labels[i:]) for i in range(max(0, len(labels) - deepest), len(labels))]
        for i, tail in enumerate(tails):
            if tail in exceptions:
                return tails[i + 1]
        for i, tail in enumerate(tails):
            if tail in exact or (i + 1 < len(tails) and tails[i + 1] in wild):
                return tail
        return labels[-1]

    return suffix


def suffixes(hosts: pa.Array, rules: tuple[str, ...] | None = None) -> pa.Array:
    """The public suffix of each host; each distinct host is looked up once."""
    coded = hosts.dictionary_encode()
    find = finder(rules)
    found = pa.array([None if h is None else find(h) for h in coded.dictionary.to_pylist()], pa.string())
    return found.take(coded.indices)
