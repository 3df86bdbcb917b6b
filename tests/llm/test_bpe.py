"""Byte-level BPE against the library that defines it."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from proseforge.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        ranks = bpe.read_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Vocabulary(ranks, public_tokenizers.PATTERN), library


def ids_of(vocabulary, text):
    packed = vocabulary.encode(text)
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


def some_text(draw):
    kind = draw.random()
    if kind < 0.3:
        return "".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x3000)])) for _ in range(draw.randrange(60)))
    if kind < 0.6:
        return "".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(200)))
    if kind < 0.8:
        return "".join(draw.choice(" \n\t\x1c\x1f\x85　a1") for _ in range(draw.randrange(40)))
    return "".join(draw.choice("aAeE!!!??==-- 0") for _ in range(draw.randrange(300)))


def test_same_ids_as_the_library(both):
    ours, library = both
    draw = random.Random(7)
    for _ in range(1500):
        text = some_text(draw)
        assert ids_of(ours, text) == library.encode_ordinary(text)
        assert ours.decode(ours.encode(text)).decode() == text


def test_long_piece_without_spaces(both):
    ours, library = both
    for text in ("a" * 30_000, "ab" * 15_000, "".join(random.Random(1).choice("etaoin") for _ in range(20_000))):
        assert ids_of(ours, text) == library.encode_ordinary(text)


def test_caches_turn_over(both, monkeypatch):
    ours, library = both
    monkeypatch.setattr(bpe, "PIECES", 5)
    monkeypatch.setattr(bpe, "PAIRS", 7)
    text = "one two three four five six seven eight nine ten eleven twelve unhelpfulness one two zzyzx"
    for _ in range(3):
        assert ids_of(ours, text) == library.encode_ordinary(text)


def test_table_edges(spark, both):
    library = both[1]
    schema = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_tokens", T.StringType()), ("a.b", T.IntegerType()))])
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, "Où est-il ?\n\n  ok", None, 3), (3, "Où est-il ?\n\n  ok", None, 3), (None, "word " * 40_000, "y", None)]
    got = bpe.round_trip(spark.createDataFrame(rows, schema), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 5
    by = {(r["doc_id"], r["a.b"]): r for r in got}
    for doc, text, _, extra in rows:
        ids = library.encode_ordinary(text or "")
        r = by[(doc, extra)]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    empty = bpe.encode(spark.createDataFrame([], schema), PATH, public_tokenizers.PATTERN)
    assert empty.columns == ["doc_id", "text", "a.b", "ids", "n_tokens"] and empty.count() == 0


def test_query_covers_every_document(spark, sf, both):
    from proseforge.llm.queries import op8_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op8_byte_bpe(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        ids = both[1].encode_ordinary(text)
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
