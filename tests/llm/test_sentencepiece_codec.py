"""Parity with the SentencePiece library, and round trips."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import prose
from termweave.llm import queries, sentencepiece_codec as codec

DATA = Path(codec.MODEL).read_bytes()


@pytest.fixture(scope="module")
def peer():
    return sentencepiece.SentencePieceProcessor(model_proto=DATA)


@pytest.fixture(scope="module")
def ours():
    return codec.Codec(DATA)


def split(ours, texts):
    ids, counts = ours.encode(texts)
    ends = counts.cumsum()
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n▁ab.é日🎉\t0", max_size=40))
def test_parity_over_any_text(text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text) or "\x00" in text:
        return
    mine, other = codec.codec(DATA), sentencepiece.SentencePieceProcessor(model_proto=DATA)
    assert split(mine, [text]) == [other.encode(text)]
    assert mine.decode([other.encode(text)]) == [other.decode(other.encode(text))]


def test_query_against_library(spark, small, peer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in queries.op4_sentencepiece(spark, small).collect()}
    assert set(found) == set(texts)
    for i, t in texts.items():
        assert found[i]["ids"] == peer.encode(t) and found[i]["n_ids"] == len(found[i]["ids"]) and found[i]["round_trip"]


def test_decoding_gives_the_texts_back(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    back = codec.decode_pieces(codec.encode_pieces(docs))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))


def test_round_trip_is_what_the_decoder_gives(spark, monkeypatch):
    texts = ["a b", "", None, " two  spaces ", "line\nend", "naïve 日本 🎉 \t", "a literal ▁ marker"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = codec.encode_pieces(docs)
    back = {r["doc_id"]: r["text"] for r in codec.decode_pieces(encoded).collect()}
    found = {r["doc_id"]: r["round_trip"] for r in encoded.collect()}
    assert found == {i: None if t is None else back[i] == t for i, t in enumerate(texts)} and found[0] and not found[6]
    monkeypatch.setattr(codec.Codec, "decode", lambda self, ids: ["wrong"] * len(ids))
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 2], "text": pa.array(["a b", None])})
    assert [x for b in codec._encode(DATA, 2)(iter([batch])) for x in b.column(3).to_pylist()] == [False, None]


def test_memory_starts_anew(ours, peer, monkeypatch):
    monkeypatch.setattr(codec, "REMEMBERED", 50)
    for seed in range(3):
        t = prose(seed, 100)
        assert split(ours, [t, ""]) == [peer.encode(t), []]


# --- a unigram model written by hand ----------------------------------------------


def field(number: int, kind: int, body: bytes) -> bytes:
    return bytes([number << 3 | kind]) + body if number < 16 else varint(number << 3 | kind) + body


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(number: int, body: bytes) -> bytes:
    return field(number, 2, varint(len(body)) + body)


def unigram(byte_fallback: bool, strip: bool) -> bytes:
    words = {"▁": -2.0, "▁the": -1.5, "▁th": -3.0, "e": -2.5, "t": -3.5, "h": -3.6, "▁cat": -2.2, "c": -4.0, "a": -4.1, "s": -3.2, "▁sat": -2.9, "at": -2.7, "▁s": -3.1, ".": -2.4}
    pieces = [("<unk>", 0.0, codec.UNKNOWN), ("<s>", 0.0, codec.CONTROL), ("</s>", 0.0, codec.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0.0, codec.BYTE) for b in range(256)] if byte_fallback else []
    pieces += [(p, s, codec.NORMAL) for p, s in words.items()]
    body = b"".join(message(1, message(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, varint(k))) for p, s, k in pieces)
    trainer = field(3, 0, varint(1)) + field(4, 0, varint(len(pieces))) + field(35, 0, varint(int(byte_fallback)))
    normal = message(1, b"identity") + field(3, 0, varint(1)) + field(4, 0, varint(int(strip))) + field(5, 0, varint(1))
    return body + message(2, trainer) + message(3, normal)


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("strip", [True, False])
def test_unigram_scores_and_fallback(fallback, strip):
    data = unigram(fallback, strip)
    mine, other = codec.Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert mine.model.unigram and mine.model.byte_fallback is fallback
    texts = ["the cat sat.", "thecats", "the  cat ", " a", "zebra", "é sat", "ttttt", ""]
    assert split(mine, texts) == [other.encode(t) for t in texts]


def test_other_models_are_refused():
    word = message(1, message(1, b"<unk>") + field(3, 0, varint(2))) + message(2, field(3, 0, varint(3)))
    with pytest.raises(ValueError):
        codec.parse(word)


def test_decoder_of_runs_is_the_library_s(ours):
    """Ids in any order: bytes of broken characters, ids without a piece, controls, leading markers."""
    rng = np.random.default_rng(5)
    n = len(ours.model.pieces)
    lists = [rng.integers(0, 300, k).tolist() for k in range(40)] + [rng.integers(-3, n + 3, k).tolist() for k in (1, 7, 50, 3000)]
    byte = [i for i, p in enumerate(ours.model.pieces) if p[2] == codec.BYTE]
    lists += [[byte[0xE6], byte[0x97], n + 9, byte[0xA5]], [byte[0xFF]] * 5, [byte[10]], []]
    assert ours.decode(lists) == ours.decode_whole([[i for i in one if 0 <= i < n] for one in lists])
    assert ours.decode(pa.array([None, [], [byte[65]]], pa.list_(pa.int32()))) == ["", "", "A"]
