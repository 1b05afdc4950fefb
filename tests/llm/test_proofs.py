"""Operators that SQL cannot express, held against brute force; long texts, repeated rows and clashing names."""

import hashlib
import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import bpe, ngram_join, packing, quality, substring_dedup


def clashing(df):
    return df.withColumn("n_tokens", F.lit("x")).withColumn("docs", F.lit(1)).withColumn("block", F.lit(2)).withColumn("sequence_id", F.lit(9)).withColumn("offset", F.lit(8)).withColumn("spans", F.lit(7)).withColumn("score", F.lit(6))


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "Привет", "naïve", "x1", "don't", "  ", "\n", "1234567", "🙂", "ſ", "end."]
    return [None, "", " "] + [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(n)] + ["word " * 40_000 + "🙂" * 3_000 + " tail" * 9]


def test_token_lengths_and_histogram(spark):
    import tiktoken
    from public_tokenizers import PATTERN

    path = bpe.vocabulary("byte_bpe_50k.tiktoken")
    ranks = bpe.byte_bpe(path)
    import base64

    with open(path, "rb") as f:
        core = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rows = list(enumerate(texts(1))) + [(3, texts(1)[3]), (None, "one two")]
    want = [(i, len(core.encode_ordinary(t or ""))) for i, t in rows]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r["doc_id"], r["n_tokens"]) for r in bpe.token_lengths(df, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and ranks.encode("") == b""
    n = np.array([k for _, k in want])
    for block in (3, 256):
        for r in bpe.length_histogram(bpe.token_lengths(df, path), block).collect():
            k = r["n_tokens"]
            assert (r["docs"], r["tokens"], r["docs_at_least"], r["tokens_at_least"]) == ((n == k).sum(), n[n == k].sum(), (n >= k).sum(), n[n >= k].sum())
            assert (r["docs_up_to"], r["tokens_up_to"], r["truncated_tokens"]) == ((n <= k).sum(), n[n <= k].sum(), np.minimum(n, k).sum())
    limits = {r["context"]: (r["docs_that_fit"], r["truncated_tokens"]) for r in bpe.at_limits(bpe.length_histogram(bpe.token_lengths(df, path)), [0, 7, 40, 10**6]).collect()}
    assert limits == {c: ((n <= c).sum(), np.minimum(n, c).sum()) for c in (0, 7, 40, 10**6)}


def test_byte_bpe_of_texts_over_a_chunk(spark):
    path = bpe.vocabulary("byte_bpe_multi_50k.tiktoken")
    from public_tokenizers import PATTERN
    import base64
    import tiktoken

    with open(path, "rb") as f:
        core = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    rng = random.Random(2)
    long = "".join(rng.choices(["a", " ", "é", "\n", "  ", "12", "слово", "🙂", "!?"], k=64_500)) + "z" * 3_000 + "".join(rng.choices(["ab", " "], k=40_000)) + " " * 3_000 + "x"
    rows = list(enumerate([*texts(3, 10), long]))
    got = {r["doc_id"]: r for r in bpe.encode_documents(clashing(spark.createDataFrame(rows, "doc_id long, text string")), path, with_ids=True).collect()}
    for i, t in rows:
        ids = core.encode_ordinary(t or "")
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def spans_by_brute_force(rows, shortest):
    """Every chunk but the first of its bytes, in the order of doc_id (null last), text hash and place; neighbours join."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    first, out = {}, {}
    for i, h, raw in sorted(rows, key=key):
        ends = substring_dedup.boundaries(raw).tolist()
        found = []
        for a, b in zip([0, *ends], ends):
            seen = first.setdefault(raw[a:b], (i, h, a))
            if seen != (i, h, a):
                found.append((a, b, seen[0]))
        runs = []
        for a, b, source in found:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b, source])
        runs = [(a, b - a, s) for a, b, s in runs if b - a >= shortest]
        if runs:
            out[i, h] = runs
    return out


@pytest.mark.parametrize("hot, batch", [(64, 50_000), (3, 200)])
def test_substring_spans_against_brute_force(spark, monkeypatch, hot, batch):
    rng = random.Random(hot)
    passages = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=70)) for _ in range(6)]
    given = []
    for i in range(120):
        parts = [" ".join(rng.choices([f"v{i}" for i in range(3000)], k=rng.randrange(60))) for _ in range(3)] + rng.sample(passages, rng.randrange(3))
        rng.shuffle(parts)
        given.append((i, "\n".join(parts)))
    given += [(None, passages[0] + " é"), (None, given[5][1]), (7, given[7][1]), (7, "other " + passages[1]), (200, None), (201, ""), (202, "lorem " * 30_000 + passages[2])]
    df = clashing(spark.createDataFrame(given, "doc_id long, text string"))
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    hashes = {r["t"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("t"), substring_dedup._hash("text").alias("h")).collect()}
    rows = list({(i, hashes[t or ""], (t or "").encode()) for i, t in given})
    want = spans_by_brute_force(rows, substring_dedup.SHORTEST)
    got = {(r["doc_id"], r["_h"]): [tuple(s) for s in r["spans"]] for r in substring_dedup.repeated_spans(df).collect()}
    assert {k: [(a, n) for a, n, _ in v] for k, v in got.items()} == {k: [(a, n) for a, n, _ in v] for k, v in want.items()}
    order = lambda i: (i is None, i or 0)
    assert all(order(s) <= order(k[0]) for k, v in got.items() for _, _, s in v)
    if hot == 64:
        assert got == want
    cut = substring_dedup.dedup_substrings(df).collect()
    assert len(cut) == len(given) and {r["score"] for r in cut} == {6}
    for r in cut:
        raw = next(t for i, t in given if i == r["doc_id"] and (r["spans"] is None and t == r["text"] or r["spans"] is not None and len((t or "").encode()) - sum(s["length"] for s in r["spans"]) <= len((r["text"] or "").encode()) + 8))
        assert r["text"] == substring_dedup._without(raw, r["spans"])


def test_ranking_fits_the_loss():
    rng = np.random.default_rng(4)
    values = np.c_[np.ones(300), rng.normal(size=(300, 4))]
    good = (values @ np.array([0, 2.0, -1.0, 0.0, 0.5]) + rng.logistic(size=300) > 0).astype(int)
    model = quality.fit(values, good, pairs=5_000)
    x = (values - np.array(model.centre)) / np.array(model.spread)
    draw = np.random.default_rng(7)
    gap = x[draw.choice(np.flatnonzero(good == 1), 5_000)] - x[draw.choice(np.flatnonzero(good == 0), 5_000)]
    loss = lambda w: np.mean(np.log1p(np.exp(-gap @ w))) + 5e-4 * w @ w
    w = np.zeros(5)
    for _ in range(4_000):  # plain descent on the same loss
        w += 0.5 * ((gap / (1 + np.exp(gap @ w))[:, None]).mean(0) - 1e-3 * w)
    assert abs(loss(np.array(model.weights)) - loss(w)) < 1e-6 and np.abs(np.array(model.weights) - w).max() < 1e-2
    raw = x @ np.array(model.weights)
    assert (raw < model.threshold).sum() == (good == 0).sum()
    assert all(model.score(v) >= 0.5 for v in values[raw > model.threshold])


def test_places_are_kept_with_clashing_names(spark):
    parts = clashing(spark.createDataFrame([(i, 0, 0, 1 + i * 37 % 2048, 0) for i in range(3_000)], "doc_id long, piece int, start long, length long, ids_crc32 long"))
    out = packing.pack(parts).collect()
    assert len(out) == 3_000
    held: dict = {}
    for r in out:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = max(-(-sum(r["length"] for r in out) // 2048), sum(r["length"] > 1024 for r in out))  # no two of more than half a sequence share one
    assert least <= len(held) <= 1.02 * least


def linked(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b)


@pytest.mark.parametrize("percent, edits", [(80, 9), (80, 3)])
def test_a_large_group_about_the_threshold(spark, percent, edits):
    """Several hundred texts that differ a little more or less than the threshold: no link is missed, and pairs stay few."""
    rng = random.Random(edits)
    base = [f"b{i}" for i in range(170)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(len(w)), edits // 2 + rng.randrange(edits)):
            w[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((400, " ".join([*(f"long{i}" for i in range(30_000)), *base])))
    rows.append((401, " ".join([*(f"long{i}" for i in range(30_000)), *base[:100]])))
    words = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            if linked(sets[i], sets[j], percent):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df, 5, percent).collect()}
    assert got == {i: find(i) for i in sets}


def test_forest_spans_what_is_linked():
    rng = np.random.default_rng(5)
    for trial in range(30):
        base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = []
        for _ in range(rng.integers(2, 40)):
            s = base[rng.random(60) < 0.95]
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 62, rng.integers(0, 8)).astype(np.uint64)])))
        want = {(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 100 >= 80 * len(np.union1d(sets[i], sets[j]))}
        edges = list(ngram_join.forest(list(range(len(sets))), sets, 80))
        assert all((b, a) in want for a, b in edges) and len(edges) < len(sets)
        label = lambda pairs: dict(zip(*map(lambda x: x.tolist(), _labels(pairs, len(sets)))))
        assert label(edges) == label(want)
        near = ngram_join.near(np.array([len(s) for s in sets]), [ngram_join.bitmap(s, 80) for s in sets], 80)
        assert all(near[i] and near[j] for i, j in want)


def _labels(pairs, n):
    from trajecta.llm.graph import least_labels

    loops = [(i, i) for i in range(n)]
    a, b = (np.array(x) for x in zip(*[*pairs, *loops]))
    return least_labels(a, b)


def test_components_over_several_tasks(spark):
    from trajecta.llm import graph

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(150)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(150)]
    got = {r["v"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), local=40).collect()}
    one = {r["v"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == one and all(got[i] == 0 for i in range(151))


def test_tables_go_when_they_are_done_with(spark):
    import os

    from trajecta.llm import common

    out, path = common.settled(spark, lambda: common.saved(common.saved(spark.range(3)).withColumn("x", F.lit(1))))
    folder = os.path.dirname(path.removeprefix("file:"))
    assert out.count() == 3 and path in common._written
    before = set(os.listdir(folder))
    again, other = common.settled(spark, lambda: common.saved(out), path)
    assert again.count() == 3 and set(os.listdir(folder)) - before == {os.path.basename(other)} and os.path.basename(path) not in os.listdir(folder)
