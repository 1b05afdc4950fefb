"""Encoding, counting and packing against the libraries and brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import bpe, packing

TEXTS = ["", None, "plain words", "  lead\n\n\ntrail  \t", "it's we'll 12345 ééé 日本語 🙂", "x" * 5000, " " * 3000 + "y", "a b c\x1cd", "Σίσυφος ΟΔΟΣ", "é café", "<|endoftext|> in text"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("r", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stitched_chunks_equal_the_whole(reference):
    import public_tokenizers as P
    import regex

    find, rng = regex.compile(P.PATTERN).findall, random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(["a", "bc", " ", "  ", "\n", "'s", "12", "é", "!!", "　", "longword" * 3], k=rng.randrange(80)))
        for chunk, overlap in ((16, 4), (7, 7), (40, 1)):
            assert bpe.stitched(text, find, chunk, overlap) == find(text)
    assert bpe.stitched("x" * 1000, find, 50, 5) == ["x" * 1000]


def test_encode_and_decode(spark, reference):
    path = bpe.vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, "", "again"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encode_documents(df, path, with_ids=True).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t, _ in rows:
        ids = reference.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        want.setdefault((i, len(ids)), (hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    for r in out:
        assert (r["ids_sha256"], r["decoded_sha256"], r["ids"]) == want[r["doc_id"], r["n_tokens"]]
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(df, path, with_ids=True), path).collect()}
    assert all(texts[i] == (t or "") for i, t, _ in rows[1:])
    assert bpe.encode_documents(df.limit(0), path).count() == 0


def test_word_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    whole, own, rng = Tokenizer.from_file(path), bpe.word_bpe(path), random.Random(2)
    made = ["".join(rng.choices("abcXYZ éÜñß'sΣ.,!1٣́ \n\t\x85日", k=rng.randrange(60))) for _ in range(500)]
    for text in [t for t in TEXTS if t] + made:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_histogram_against_brute_force(spark):
    rng = random.Random(3)
    values = [rng.randrange(0, 60) for _ in range(200)]
    h = bpe.length_histogram(spark.createDataFrame([(v,) for v in values] + [(None,)], "n_tokens long"), block=8)
    rows = h.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(values))
    for r in rows:
        n = r["n_tokens"]
        assert r["docs"] == values.count(n) and r["tokens"] == n * values.count(n)
        assert r["docs_at_least"] == sum(v >= n for v in values) and r["tokens_at_least"] == sum(v for v in values if v >= n)
        assert r["docs_up_to"] == sum(v <= n for v in values) and r["truncated_tokens"] == sum(min(v, n) for v in values)
    for r in bpe.at_limits(h, [0, 7, 30, 1000]).collect():
        assert r["docs_that_fit"] == sum(v <= r["context"] for v in values) and r["truncated_tokens"] == sum(min(v, r["context"]) for v in values)
    assert bpe.length_histogram(spark.createDataFrame([], "n_tokens long")).count() == 0


def test_plan_uses_every_piece_once():
    rng = random.Random(4)
    for size in (16, 64, 257):
        for n in (0, 1, 5, 400):
            lengths = [rng.randrange(1, size + 1) for _ in range(n)]
            counts = {v: lengths.count(v) for v in set(lengths)}
            used: dict = {}
            sequences = 0
            for pattern, times in packing.plan(counts, size):
                assert sum(pattern) <= size and times > 0
                sequences += times
                for v in pattern:
                    used[v] = used.get(v, 0) + times
            assert used == counts
            if n == 400:
                assert sequences <= max(-(-sum(lengths) // size), sum(v > size / 2 for v in lengths)) * 1.03 + 1
    assert packing.plan({5: 2, 3: 2, 2: 2, 4: 1}, 8)[0] in [((5, 3), 2)]


def test_exact_complements_of_three():
    assert packing.plan({10: 1, 3: 1, 2: 1, 1: 1}, 16) == [((10, 3, 2, 1), 1)]
    assert packing.plan({10: 2, 3: 4}, 16) == [((10, 3, 3), 2)]


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "word " * 5000), (101, "same"), (102, "same"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(packing.pieces(df, path)).collect()
    tok = Tokenizer.from_file(path)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by) == len(rows)
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        got = sorted(by[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for n, a in enumerate(range(0, len(ids), 2048))]
    places = {}
    for r in out:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(df.limit(0), path)).count() == 0


def test_pack_of_equal_rows(spark):
    df = spark.createDataFrame([(1, 0, 7)] * 50 + [(2, 0, 9)] * 30, "doc_id long, piece int, length long").withColumn("x", F.lit(1))
    out = packing.pack(df, 16).collect()
    assert len(out) == 80 and len({(r["sequence_id"], r["offset"]) for r in out}) == 80
    assert len({r["sequence_id"] for r in out}) == 40
