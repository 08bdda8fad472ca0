"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here (pieces with scores and types, kind of model,
byte fallback, normaliser), and a tokenizers pipeline is rebuilt from it: the
precompiled normaliser, the white-space marker, unigram scores or the merges that
BPE scores imply, and byte fallback.

If no piece spans a marker or line end (checked), a text falls into segments that
are encoded each by itself: words with their marker, and line ends. Every distinct
segment is encoded once, in multithreaded batches, and ids are put together with
numpy. Texts with runs of spaces or literal markers are encoded whole. Decoding goes
the same way back: every piece, and every distinct run of byte pieces, is decoded once by
the library, and the texts are put together.

Defined cases: a null text has null ids; an empty one has no ids; a null id stays
null; repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored. A text of any length is encoded and decoded whole. Ids that
no piece has, and null ids, have no text.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from struct import unpack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, spread, two

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
MARK = "▁"
#: Distinct segments that a worker remembers; beyond, it starts anew.
REMEMBERED = 300_000

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    unigram: bool = True
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    strip_spaces: bool = True
    escape: bool = True
    suffix: bool = False


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[i : i + n]
            i += n


def parse(data: bytes) -> Model:
    """The parts of a SentencePiece model file that encoding needs."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            m.pieces.append((f.get(1, b"").decode(), unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            f = dict(_fields(value))
            m.unigram, m.byte_fallback, m.suffix = f.get(3, 1) == 1, bool(f.get(35, 0)), bool(f.get(24, 0))
            if f.get(3, 1) not in (1, 2):
                raise ValueError("only unigram and BPE models are supported")
        elif number == 3:
            f = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.strip_spaces, m.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    if m.suffix:
        raise ValueError("white space as a suffix isn't supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """The merges that the scores of a BPE model imply, best first."""
    rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for p, i in rank.items():
        splits = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
        found += [(-m.pieces[i][1], rank[a], rank[b], a, b) for a, b in splits]
    found.sort(key=lambda x: x[:3])
    return [(a, b) for *_, a, b in found]


class Codec:
    """Encodes and decodes like the SentencePiece model in data."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        m = self.model = parse(data)
        unknown = next(i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN)
        if m.unigram:
            core = lambda: models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=unknown, byte_fallback=m.byte_fallback)
        else:
            vocab, rules = {p: i for i, (p, _, _) in enumerate(m.pieces)}, merges(m)
            core = lambda: models.BPE(vocab=vocab, merges=rules, unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.strip_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if m.escape else " "))
        if m.escape:
            steps.append(normalizers.Replace(" ", MARK))
        self.whole, self.part = Tokenizer(core()), Tokenizer(core())
        self.whole.normalizer = normalizers.Sequence(steps)
        decode = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        self.whole.decoder = decoders.Sequence(decode + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []))
        self.runs = Tokenizer(core())
        self.runs.decoder = decoders.Sequence(decode)
        self.is_byte = np.array([kind == BYTE for _, _, kind in m.pieces], bool)
        self._pieces()
        own = [p for p, _, kind in m.pieces if kind in (NORMAL, USER)]
        self.splits = m.escape and m.byte_fallback and m.dummy_prefix and not m.strip_spaces and not m.charsmap and not any("\n" in p or (MARK in p[1:] and p.strip(MARK)) for p in own)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.at, self.size, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32), 0

    def _learn(self, segments: list[str]) -> None:
        for i in range(0, len(segments), 20_000):
            part = segments[i : i + 20_000]
            found = [e.ids for e in self.part.encode_batch_fast(part, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            total, n = int(sizes.sum()), len(self.known)
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while n + len(part) > len(self.at):
                self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
            self.pool[self.used : self.used + total] = np.fromiter((x for ids in found for x in ids), np.int32, total)
            self.at[n : n + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(part)] = sizes
            self.used += total
            self.known.update(zip(part, range(n, n + len(part))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        if not self.splits:
            return self._encode_whole(texts)
        odd = [i for i, t in enumerate(texts) if "  " in t or t[:1] == " " or MARK in t]
        plain = texts if not odd else [t if not ("  " in t or t[:1] == " " or MARK in t) else "" for t in texts]
        split = [(MARK + t.replace(" ", " " + MARK)).replace("\n", " \n ").split(" ") if t else [] for t in plain]
        if len(self.known) > REMEMBERED:
            self._forget()
        new = {s for one in split for s in one}.difference(self.known)
        if new:
            self._learn(sorted(new))
        number = np.fromiter((self.known[s] for one in split for s in one), np.int64, sum(map(len, split)))
        size = self.size[number].astype(np.int64)
        ids = self.pool[spread(self.at[number], size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        stops = np.cumsum([len(one) for one in split], dtype=np.int64)
        counts = np.diff(ends[np.concatenate([[0], stops])])
        if odd:
            more, sizes = self._encode_whole([texts[i] for i in odd])
            where = np.concatenate([[0], np.cumsum(counts)])[odd]
            ids = np.insert(ids, np.repeat(where, sizes), more)
            counts[odd] = sizes
        return ids, counts

    def _encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids if t else [] for t, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False))]
        return np.fromiter((x for ids in found for x in ids), np.int32, sum(map(len, found))), np.array([len(x) for x in found], np.int64)

    def decode_whole(self, ids: list[list[int]]) -> list[str]:
        """The texts of lists of ids by the library's decoder, each list at once."""
        return self.whole.decode_batch(ids, skip_special_tokens=True)

    def decode(self, lists: list[list[int]] | pa.ListArray) -> list[str]:
        """The same, but every distinct run of ids is decoded once; a null list has an empty text.

        A run is one piece, or as many byte pieces as there are in a row: the decoder's steps
        never look beyond that, so the runs' texts in a row are the whole's, but for the space
        that the dummy prefix leaves in front.
        """
        lists = pa.array(lists, pa.list_(pa.int32())) if isinstance(lists, list) else lists
        counts = np.asarray(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), np.int64)
        ids = np.asarray(pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False), np.int64)
        doc = np.repeat(np.arange(len(counts)), counts)
        real = (ids >= 0) & (ids < len(self.is_byte))
        if not real.all():  # no piece, no text
            ids, doc = ids[real], doc[real]
        many = np.append(False, self.is_byte[ids[1:]] & self.is_byte[ids[:-1]] & (doc[1:] == doc[:-1])) if len(ids) else real
        if many.any():
            ids, doc = self._fused(ids, doc, many)
        size = self.said_size[ids]
        text = self.said[spread(self.said_at[ids], size)].tobytes()
        ends = np.cumsum(np.bincount(doc, weights=size, minlength=len(counts)).astype(np.int64)).tolist()
        out = [text[a:b].decode() for a, b in zip([0, *ends], ends)]
        return [t[1:] if t[:1] == " " else t for t in out] if self.model.dummy_prefix else out

    def _fused(self, ids: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of byte pieces as one number each; many: which ids go on with the run before."""
        begin = np.flatnonzero(~many & np.append(many[1:], False))
        end = np.append(np.flatnonzero(many[:-1] & ~many[1:]) + 1, [len(ids)] if many[-1] else []).astype(np.int64)
        body = ids[spread(begin, end - begin)].astype(np.int32).tobytes()
        if len(self.fused) > REMEMBERED:
            self._pieces()
        stops = (4 * np.cumsum(end - begin)).tolist()
        runs = [body[a:b] for a, b in zip([0, *stops], stops)]
        new = list(dict.fromkeys(r for r in runs if r not in self.fused))
        if new:
            self.fused.update(zip(new, range(len(self.said_at), len(self.said_at) + len(new))))
            self._say(self.runs.decode_batch([np.frombuffer(r, np.int32).tolist() for r in new], skip_special_tokens=True))
        number = [self.fused[r] for r in runs]
        ids = ids.copy()
        ids[begin] = number
        return ids[~many], doc[~many]

    def _pieces(self) -> None:
        self.said, self.said_at, self.said_size, self.fused = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), {}
        self._say(self.runs.decode_batch([[i] for i in range(len(self.model.pieces))], skip_special_tokens=True))

    def _say(self, texts: list[str]) -> None:
        """Number these texts."""
        body = [t.encode() for t in texts]
        sizes = np.array(list(map(len, body)), np.int64)
        self.said_at = np.append(self.said_at, len(self.said) + np.cumsum(sizes) - sizes)
        self.said_size = np.append(self.said_size, sizes)
        self.said = np.append(self.said, np.frombuffer(b"".join(body), np.uint8))


@functools.lru_cache(2)
def codec(data: bytes, threads: int = THREADS) -> Codec:
    return Codec(data, threads)


def _encode(data: bytes, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data, threads)
        for rows, texts, null in pieces(batches):
            strings = texts.to_pylist()
            ids, counts = c.encode(strings)
            off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(ids))
            same = [a == b for a, b in zip(c.decode(lists), strings)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pc.if_else(null, pa.scalar(None, lists.type), lists), pc.if_else(null, pa.scalar(None, pa.int64()), pa.array(counts)), pc.if_else(null, pa.scalar(None, pa.bool_()), pa.array(same))],
                ["doc_id", "ids", "n_ids", "round_trip"],
            )

    return run


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip): round_trip says whether the decoder gives the text back from the ids."""
    return two(docs, id_col, text_col).mapInArrow(_encode(Path(model).read_bytes(), threads), "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def _decode(data: bytes, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data, threads)
        for batch in batches:
            lists = batch.column(1)
            texts = pa.array(c.decode(lists), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))], ["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """(doc_id, text) of lists of ids; a null list gives a null text."""
    own = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return own.mapInArrow(_decode(Path(model).read_bytes(), threads), "doc_id long, text string")
