"""Alignment of two tokenizers against the libraries and a plain merge."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import pytest

from incident_signals.llm import byte_bpe, token_alignment
from incident_signals.llm.queries import QUERIES

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

ODD = [
    None, "", "plain words here", "plain words here", "  two  blanks\n\n and\ttabs", "▁ stands for a blank", "é中文\U0001f600ſtrange ﬁ",
    "<s> and <|endoftext|>", "=" * 3_000, "-=" * 900 + " " * 700, "a" * 5_000, "x", " ", "1234567 " * 500,
]


@pytest.fixture(scope="module")
def pair():
    a = byte_bpe.Vocabulary.from_tokenizer_json(P.path("byte_bpe_50k.json"))
    return a, token_alignment.Pieces.from_file(P.path("piece_bpe_32k.model"))


def brute(texts):
    """(n_a, n_b, n_groups, n_links, groups, n_best, count_sum) of each text."""
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    out, linked = [], []
    for text in texts:
        tokens_a = a.encode(" " + text, add_special_tokens=False) if text else None
        ids = (tokens_a.ids, b.encode(text)) if text else ([], [])
        spelled = [
            [bytes(letter[c] for c in a.id_to_token(i)) for i in ids[0]],
            [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]],
        ]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            out.append([0, 0, 0, 0, ""])
            linked.append(Counter())
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
        both = sorted(set(ends[0]) & set(ends[1]))
        pairs = [([], []) for _ in both]
        for side in (0, 1):
            for i, end in zip(ids[side], ends[side]):
                pairs[bisect.bisect_left(both, end)][side].append(i)
        links = Counter((x, y) for g, h in pairs for x in g for y in h)
        text_of = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in pairs)
        out.append([len(ids[0]), len(ids[1]), len(pairs), sum(links.values()), text_of])
        linked.append(links)
    held = Counter(p for links in linked for p in links)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    for row, links in zip(out, linked):
        row.append(sum(n for p, n in links.items() if held[p] == best[p[0]]))
        row.append(sum(n * held[p] for p, n in links.items()))
    return [tuple(r) for r in out]


@pytest.mark.parametrize("work", [1, 2, 7, 512])
def test_merge_path_at_any_piece_size(work):
    rng = np.random.default_rng(work)
    for n in (1, 2, 5, 40, 700):
        last = 3 * n
        a, b = (np.append(np.sort(rng.choice(np.arange(1, last), min(n, last - 1), replace=False)), last) for _ in range(2))
        both = np.intersect1d(a, b)
        group_a, group_b, number = token_alignment.merge_path(a, b, work)
        assert number == len(both)
        assert group_a.tolist() == np.searchsorted(both, a).tolist() and group_b.tolist() == np.searchsorted(both, b).tolist()
    nothing = np.empty(0, np.int64)
    assert token_alignment.merge_path(nothing, nothing, work)[2] == 0


def test_pieces_of_equal_work():
    a = np.arange(1, 1_001) * 1_000
    b = np.append(np.arange(1, 5_000), 1_000_000)  # nearly all ends of B come before the second of A
    at = token_alignment.crossings(a, b, np.arange(0, 6_000, 512))
    merged = sorted([(e, 0) for e in a] + [(e, 1) for e in b])
    assert at.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in range(0, 6_000, 512)]


@pytest.mark.parametrize("block, group", [(1, 0), (1_000, 64), (8 << 20, 64)])
def test_like_the_libraries(spark, pair, monkeypatch, block, group):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_alignment, "SMALL_GROUP", group)
    monkeypatch.setattr(token_alignment.hashing, "CHUNK_BYTES", 500)
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(ODD)] + [(None, "plain x", "y"), (2, "again", "z")],
                                 "doc_id long, text string, n_a string")
    got = token_alignment.align(docs, *pair)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(k, *b) for k, b in zip([*range(len(ODD)), None, 2], brute(ODD + ["plain x", "again"]))]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_nothing_to_align(spark, pair):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(map(tuple, token_alignment.align(docs, *pair, digest=True).collect())) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]
    assert token_alignment.align(docs.limit(0), *pair).count() == 0


def test_query_like_the_libraries(spark, sf_dir):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_cross_tokenizer_alignment"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {
        row.doc_id: (*r[:4], *r[5:], hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "")
        for row, r in zip(rows, brute([row.text for row in rows]))
    }
    assert len(got) == len(rows) and got == want


def test_blocks_are_written_one_by_one(spark):
    """A row group holds a block or two, however many blocks a task writes; else its writer and its readers hold them all."""
    import pyarrow.parquet as pq

    from incident_signals.llm.components import LARGE_ROWS, settled

    large = spark.range(0, 12, 1, 1).selectExpr("id", "transform(sequence(1, 500000), x -> xxhash64(x, id)) AS v")
    (path,) = settled(large, "large-rows", LARGE_ROWS).inputFiles()
    file = pq.ParquetFile(path.removeprefix("file://"))
    assert file.metadata.num_rows == 12
    assert max(file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)) <= 6
