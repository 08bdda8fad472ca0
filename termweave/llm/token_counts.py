"""Token counts of documents of any length, with overlap resynchronisation.

Texts up to CHUNK characters are encoded whole. A longer one is encoded in chunks
that overlap by OVERLAP characters, and the chunks are spliced where both have a
token boundary that is proven stable: between two characters of different classes
(letters, numbers, other marks, white space), but not before the letters or numbers
right of white space or, for letters, of an apostrophe. No alternative of PATTERN
matches across such a place and none before it looks beyond it, so a text's tokens are
those of what is left of it and of what is right of it, wherever encoding began or
ended. If the overlap has no such place, or the chunks don't agree there, the overlap
is doubled, up to the whole chunk on the left; if that has none either, both become one
chunk, of twice the length. So the characters encoded are a small multiple of the text's.

Defined cases: null and empty texts have 0 tokens and 0 chunks; a null id stays
null; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored. Strings of special tokens count as ordinary text. A text
of any length is counted whole; one without a stable place ends as one chunk.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import two

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 1 << 16, 1 << 10

_SPACE, _LETTER, _NUMBER, _MARK, _APOSTROPHE = 1, 2, 3, 4, 5


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point of the basic plane; 0 for those that Unicode 3.2 doesn't have or engines may see differently."""
    table = np.zeros((1 << 16) + 1, np.uint8)
    old = unicodedata.ucd_3_2_0
    for c in range(1 << 16):
        kind, now = old.category(chr(c)), unicodedata.category(chr(c))
        if kind[0] == now[0] and kind[0] in "LNPS":
            table[c] = {"L": _LETTER, "N": _NUMBER}.get(kind[0], _MARK)
    table[[ord(c) for c in " \t\n\r"]] = _SPACE
    table[ord("'")] = _APOSTROPHE
    return table


def stable(text: str) -> np.ndarray:
    """Places of text (characters before each) that are proven to be token boundaries whatever is around."""
    kind = _classes()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 1 << 16)]
    left, right = kind[:-1], kind[1:]
    same = np.where(left == _APOSTROPHE, _MARK, left) == np.where(right == _APOSTROPHE, _MARK, right)
    known = (left != 0) & (right != 0) & (left != _SPACE) & ~same
    return np.flatnonzero(known & ~((left == _APOSTROPHE) & (right == _LETTER))) + 1


@functools.lru_cache(2)
def encoding(vocabulary: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(2)
def _sizes(enc: tiktoken.Encoding) -> np.ndarray:
    """Bytes of each token."""
    sizes = np.zeros(enc.n_vocab, np.int64)
    for t in enc._mergeable_ranks.values():
        sizes[t] = len(enc.decode_single_token_bytes(t))
    return sizes


def _ends(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Where the tokens of text end, in bytes, after a 0."""
    return np.append(0, np.cumsum(_sizes(enc)[np.array(enc.encode_ordinary(text), np.int64)]))


def splice(left: np.ndarray, right: np.ndarray, shared: str, before: int) -> tuple[int, int] | None:
    """(tokens of the left chunk, tokens of the right chunk to skip) at a common stable boundary.

    left, right: token ends of both; shared: the overlap's text; before: bytes of the left chunk
    before the overlap. The boundary nearest the overlap's middle is taken.
    """
    places = stable(shared)
    for p in places[np.argsort(np.abs(places - len(shared) // 2), kind="stable")].tolist():
        at = len(shared[:p].encode())
        i, j = int(np.searchsorted(left, before + at)), int(np.searchsorted(right, at))
        if i < len(left) and j < len(right) and left[i] == before + at and right[j] == at:
            return i, j
    return None


def count(enc: tiktoken.Encoding, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks, times that an overlap was widened)."""
    if len(text) <= chunk:
        return len(enc.encode_ordinary(text)), int(bool(text)), 0
    total, chunks, widened = 0, 1, 0
    start, stop = 0, chunk
    left, skip = _ends(enc, text[:chunk]), 0  # skip: tokens of `left` that were counted before
    while stop < len(text):
        reach, found = overlap, None
        while True:
            begin = max(start, stop - reach)
            # Nothing is encoded for an overlap without a stable place.
            if len(stable(text[begin:stop])):
                end = min(len(text), stop + max(chunk, reach))
                right = _ends(enc, text[begin:end])
                found = splice(left, right, text[begin:stop], len(text[start:begin].encode()))
                if found and found[0] >= skip:
                    break
                found = None
            widened += 1
            if begin == start:  # the overlap is the whole left chunk
                break
            reach *= 2
        if found:
            total += found[0] - skip
            skip, chunks = found[1], chunks + 1
        else:  # one chunk of both
            begin, end = start, min(len(text), stop + max(chunk, stop - start))
            right = _ends(enc, text[begin:end])
            skip = int(np.searchsorted(right, left[skip]))
        start, stop, left = begin, end, right
    return total + len(left) - 1 - skip, chunks, widened


def _run(vocabulary: bytes, pattern: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        for batch in batches:
            found = [count(enc, t.as_py() or "", chunk, overlap) for t in batch.column(1)]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens", "n_chunks", "n_widened"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document. The driver reads the vocabulary file and sends it with the tasks."""
    ranks = Path(vocabulary).read_bytes()
    return two(docs, id_col, text_col).mapInArrow(_run(ranks, pattern, chunk, overlap), "doc_id long, n_tokens long, n_chunks long, n_widened long")


def tokens(text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """The number of tokens of a column of texts; 0 for a null one."""
    ranks = Path(vocabulary).read_bytes()

    def run(texts: pa.Array) -> pa.Array:
        enc = encoding(ranks, pattern)
        return pa.array([count(enc, t.as_py() or "", chunk, overlap)[0] for t in texts], pa.int64())

    return F.arrow_udf(run, "long")(text)
