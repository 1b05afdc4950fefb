"""Exact, line, substring and near-duplicate operators against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.llm import exact_dedup, graph, line_dedup, ngram_join, substring_dedup

WORDS = [f"w{i}" for i in range(40)]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("name", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("_h", F.lit(2)).withColumn("spans", F.lit(3)).withColumn("n_lines_removed", F.lit(4)).withColumn("_gone", F.lit(5)) if extra else df


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("bits, block", [(55, 512), (55, 4), (2, 8), (4, 3)])
def test_exact_groups(spark, bits, block):
    rng = random.Random(bits + block)
    texts = [None, "", " ", "\t\n", "a  b", "a b", "a\nb ", "é" * 9, "x" * 40, "x" * 41] + ["".join(rng.choices("ab \n", k=rng.randrange(30))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "\t\n"), (None, "a b"), (None, "only")]
    out = exact_dedup.exact_groups(documents(spark, rows), block=block, bits=bits).collect()
    assert len(out) == len(rows)
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        ids = by_hash[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["keep_id"] == (min(known) if known else None) and r["group_size"] == len(ids)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


def test_buckets_hold_any_number_of_values(spark):
    rows = [(i, f"{i:04d}") for i in range(1500)] + [(2000 + i, f"{i:04d}") for i in range(700)]  # two bits: hundreds of blocks in a bucket
    out = exact_dedup.exact_groups(documents(spark, rows, False), block=4, bits=2).collect()
    assert {r["doc_id"]: r["keep_id"] for r in out} == {i: i % 2000 for i, _ in rows}
    texts = [(i, f"{i % 40:02d}{i // 40:02d}") for i in range(1600)]  # two blocks each: crowded at the next level too
    out = exact_dedup.exact_groups(documents(spark, texts, False), block=2, bits=1).collect()
    assert all(r["keep_id"] == r["doc_id"] and r["group_size"] == 1 for r in out)


def test_exact_groups_of_texts_over_a_slab(spark):
    long = "word " * 30_000
    rows = [(1, long), (2, long.replace(" ", "\n\t")), (3, long + "x"), (4, "y" + long)]
    out = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(documents(spark, rows, False)).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4}


def test_exact_dedup_keeps_columns(spark):
    out = exact_dedup.dedup(documents(spark, [(2, "a"), (1, "a"), (3, "b")]))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3] and out.columns == documents(spark, []).columns


def lines_left(rows, window=3, chars=200):
    """Windows of lines (so many, or fewer with so many characters) that occur before, in the order of doc_id, are deleted."""
    seen, gone = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        out = set()
        for s in range(len(lines)):
            k = next((k for k in range(1, window + 1) if s + k <= len(lines) and (k == window or sum(map(len, lines[s : s + k])) >= chars)), 0)
            key = tuple(lines[s : s + k])
            if not "".join(key).strip():
                continue
            if key in seen:
                out |= set(range(s, s + k))
            seen.add(key)
        gone[i, t] = out
    return {k: ("\n".join(x for n, x in enumerate((k[1] or "").split("\n")) if n not in g), len(g)) for k, g in gone.items()}


def test_line_dedup(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choices(["a", "b", "c", "", "long line"], k=rng.randrange(12))) for _ in range(60)]
    block = "\n".join(["one", "two", "three", "four"])
    texts += [f"x\n{block}\ny", f"{block}\n{block}", block, "p\n" + block, "\n\n\n\n", "", None, block]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "q\n" + block)]
    want = lines_left(rows)
    out = line_dedup.dedup_lines(documents(spark, rows)).collect()
    assert {(r["_h"], r["_gone"], r["name"]) for r in out} == {(2, 5, "clash")}
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["text"] or "", r["n_lines_removed"]) for r in out) == Counter((i, *want[i, t]) for i, t in rows)
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


@pytest.mark.parametrize("window, chars", [(3, 6), (3, 9), (2, 4), (4, 12), (1, 100)])
def test_line_dedup_of_short_runs(spark, window, chars):
    rng = random.Random(window * chars)
    texts = ["\n".join(rng.choices(["a", "bb", "", "long line", "five5", "\u00e9\u00e9\u00e9\u00e9"], k=rng.randrange(9))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(80, None), (81, "long line"), (82, "x" * 300), (None, "x" * 300), (3, texts[3])]
    want = lines_left(rows, window, chars)
    out = line_dedup.dedup_lines(documents(spark, rows), window=window, chars=chars).collect()
    assert Counter((r["doc_id"], r["text"] or "", r["n_lines_removed"]) for r in out) == Counter((i, *want[i, t]) for i, t in rows)


def test_line_dedup_of_a_very_long_text(spark):
    lines = [f"line {i} of many" for i in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["head", *lines[5_000:15_000], "tail"]))]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows, False)).collect()}
    assert out == {1: rows[0][1], 2: "head\ntail"}


def test_gear_boundaries_resist_insertions():
    rng = random.Random(5)
    raw = bytes(rng.choices(b"abcdefgh ", k=20_000))
    cut = lambda r: {r[a:b] for a, b in zip([0, *substring_dedup.boundaries(r).tolist()], substring_dedup.boundaries(r).tolist())}
    shifted = raw[:7000] + b"INSERTED" + raw[7000:]
    assert len(cut(raw) - cut(shifted)) <= 4
    same = substring_dedup.boundaries(b"x" * 5000)
    assert same[-1] == 5000 and np.diff(same, prepend=0).max() <= substring_dedup.LONGEST
    assert substring_dedup.boundaries(b"").tolist() == []


def test_substring_dedup_cuts_later_passages(spark):
    rng = random.Random(6)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage, inside = sentence(60), sentence(70)
    rows = [(1, sentence(100)), (2, f"{sentence(20)} {passage} {sentence(20)}"), (3, f"{sentence(31)} {passage} {sentence(9)}"), (4, f"é {passage}"), (5, f"{inside} {sentence(10)} {inside}"), (6, None), (7, ""), (8, "short"), (None, passage)]
    df = documents(spark, rows)
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(df).collect()}
    assert {i for i, r in out.items() if r["spans"]} == {3, 4, 5, None}
    for i, t in rows:
        if not out[i]["spans"]:
            assert out[i]["text"] == t
    middle = passage[len(passage) // 3 : len(passage) // 2]
    assert middle in out[2]["text"] and all(middle not in out[i]["text"] for i in (3, 4, None))
    assert out[5]["text"].count(inside[200:260]) == 1
    assert out[3]["spans"][0]["source"] == 2
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


def test_substring_dedup_without_ids(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    twice, shared, passage = sentence(60), sentence(60), sentence(60)
    # what is cut from one text stands at a place where other texts of the same (or no) doc_id hold what is theirs alone
    rows = [(None, f"{twice} {sentence(9)} {twice}"), (None, sentence(150)), (None, f"{shared} {sentence(30)}"), (None, f"{sentence(40)} {shared}"), (None, f"{sentence(50)} {passage}")]
    rows += [(7, f"{sentence(12)} {passage}"), (7, sentence(150)), (8, f"{passage} {sentence(80)}"), (8, sentence(160)), (8, "")]
    out = substring_dedup.dedup_substrings(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    left = [r["text"] for r in out]
    assert rows[1][1] in left and rows[6][1] in left and rows[8][1] in left  # unique texts stay whole
    for p in (twice, shared, passage):
        middle = p[len(p) // 3 : len(p) // 2]
        assert sum(x.count(middle) for x in left) == 1
    cut = [r for r in out if r["spans"]]
    assert sorted((r["doc_id"], r["spans"][0]["source"]) for r in cut if r["doc_id"] is not None) == [(8, 7)]
    assert Counter(r["spans"][0]["source"] for r in cut if r["doc_id"] is None) == Counter([None, None, 7])


def jaccard(rows, size, percent):
    sets: dict = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[i] for y in sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: sorted(map(len, s)) for i, s in sets.items()}


@pytest.mark.parametrize("size, percent, cell", [(3, 90, 4096), (3, 60, 4), (2, 80, 3)])
def test_jaccard_components(spark, size, percent, cell):
    rng = random.Random(size * percent)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(40)))) for i in range(40)]
    base = rng.choices(WORDS, k=60)
    for i in range(40, 90):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, " \n"), (93, "One"), (94, "one"), (95, "two words"), (96, "TWO\twords"), (97, rows[0][1]), (98, "É x y"), (99, "é x y")]
    components, sizes = jaccard(rows, size, percent)
    out = ngram_join.jaccard_components(documents(spark, rows), size, percent, cell=cell).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == components
    assert all(r["n_shingles"] in sizes[r["doc_id"]] for r in out)


def test_jaccard_odd_rows(spark):
    out = ngram_join.jaccard_components(documents(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (None, "alone x y z"), (7, "q r s t u v"), (7, "q r s t u v")]), 2, 80).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in out), key=str) == sorted([(None, 5), (5, 5), (None, None), (7, 7), (7, 7)], key=str)
    assert ngram_join.jaccard_components(documents(spark, []), 2, 80).count() == 0
    kept = ngram_join.keep_one(documents(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_jaccard_texts_without_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (None, a + " more"), (None, b + " more"), (None, c), (None, c + " more"), (None, c), (None, "alone x y z"), (None, None), (None, " "), (3, None)]
    df = documents(spark, rows)
    out = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(df).collect())
    assert out == Counter([(1, 1), (2, 2), (None, 1), (None, 2), (3, 3)] + [(None, None)] * 6)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(left) == 7 and {(1, a), (2, b), (3, None), (None, "alone x y z"), (None, None), (None, " ")} < set(left)
    assert [t for i, t in left if i is None and (t or "").startswith("c0")][0] in (c, c + " more")
    for low in (-(1 << 63), (1 << 63) - 1):  # whatever the text's hash, a doc_id goes before it
        out = ngram_join.keep_one(documents(spark, [(None, a), (low, a + " more"), (None, a + " yet more")])).collect()
        assert [r["doc_id"] for r in out] == [low]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(1, 40)).astype(np.uint64)]))
        for percent in (0, 80, 90):
            x, y = ngram_join.bitmap(a, percent), ngram_join.bitmap(b, percent)
            low = ngram_join.apart(int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little"), 8 * len(y))
            assert low <= len(np.setxor1d(a, b))


def test_components_of_a_long_chain(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)]
    out = {r["v"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(n)) and out[1001] == 1000
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
