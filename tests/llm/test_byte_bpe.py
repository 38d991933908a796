"""Byte-level BPE against the tokenizer libraries, on odd texts and on the whole table."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from incident_signals.llm import byte_bpe, hashing
from incident_signals.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
ODD = [
    "", None, " ", "  ", "\n", "a\n\n b", "don't we'll 'tis ''s it's's a  b   \n\n x 12ab ' s 're", "I'm'd'll  ", "'", "x'", "x'r",
    "x'l", "'ll", "<|endoftext|> x", "\x1c\x1d a\u0085b　c", "a" * 30_000, " " * 20_000, "ab" * 9_000 + "!?" * 2_000, "é\U0001f600ـ中文",
]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.from_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = dict(zip(vocabulary.tokens, vocabulary.ids))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(vocabulary, texts):
    data, offsets = hashing.column_bytes(pa.array(texts, pa.string()))
    ids, bounds, firsts = vocabulary.encode(data[: offsets[-1]], offsets)
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])], firsts


def random_texts(n, alphabet, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("block", [3, 512])
def test_like_the_library(vocabulary, library, monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK", block)
    anything = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ODD + random_texts(3_000, "aZé中 \n\t\r'' 's're1٣²Ⅷ.,!<|>_\u0085\xa0　 \x1c\U0001f600strevmld", 1)
    texts += random_texts(3_000, anything, 2)
    got, _ = encoded(vocabulary, texts)
    assert got == [library.encode_ordinary(t or "") for t in texts]


def test_classes_of_all_code_points():
    """A letter joins a letter, a number a number, other marks each other; the rest is white space."""
    split = pytest.importorskip("tokenizers").pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    classes = byte_bpe.codepoint_classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for mark, kind in (("a", byte_bpe.LETTER), ("1", byte_bpe.NUMBER), ("!", byte_bpe.OTHER)):
        # a line of white space before and after keeps each pair apart
        pieces = split("\n\n".join(mark + chr(c) for c in points if classes[c] != byte_bpe.SPACE))
        joined = {a for _, (a, b) in pieces if b - a == 2}
        listed = [c for c in points if classes[c] != byte_bpe.SPACE]
        assert {i * 4 for i, c in enumerate(listed) if classes[c] == kind} == {a for a in joined if a % 4 == 0}
    spaces = [c for c in points if classes[c] == byte_bpe.SPACE]
    assert all(len(split(mark + chr(c))) == 2 for c in spaces for mark in "a1!")


def test_long_pieces_merge_as_short_ones_do(vocabulary):
    pieces = [p.encode() for p in random_texts(400, "abcdefghijklmnopqrstuvwxyz", 3) if len(p) > 1]
    ranks, number = vocabulary.merged_together(pieces, 64)
    alone = byte_bpe.Vocabulary(vocabulary.tokens, vocabulary.ids, whole=False)
    assert [r[:n].tolist() for r, n in zip(ranks, number)] == [alone.merged(p) for p in pieces]


def test_vocabulary_file_of_merges():
    tokenizers = pytest.importorskip("tokenizers")
    own = byte_bpe.Vocabulary.from_tokenizer_json(P.path("byte_bpe_50k.json"))
    other = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = [t or "" for t in ODD] + random_texts(1_000, "aZé中 \n'str1²Ⅷ.,!<|>_\U0001f600", 4)
    got, _ = encoded(own, texts)
    assert got == [e.ids for e in other.encode_batch(texts, add_special_tokens=False)]
    assert np.array_equal(np.sort(own.id), np.arange(50_256))


def test_tables_round_trip(spark, vocabulary, library):
    rows = [(i, t, "mine") for i, t in enumerate(ODD * 2)] + [(None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "ids", "offsets", "decoded"]
    for r in out.collect():
        whole = (r.text or "").encode()
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == whole
        assert [whole[a:b] for a, b in zip(r.offsets, [*r.offsets[1:], len(whole)])] == [library.decode_single_token_bytes(i) for i in r.ids]
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), vocabulary), vocabulary).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(ids, vocabulary).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([50_300],)], "ids array<int>"), vocabulary).collect()


def test_query_like_the_library(spark, sf_dir, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_byte_bpe_round_trip"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    assert len(got) == len(rows)
    for key, text in rows:
        ids = library.encode_ordinary(text)
        want = len(ids), *(hashlib.sha256(b).hexdigest() for b in (",".join(map(str, ids)).encode(), text.encode()))
        assert got[key] == want
