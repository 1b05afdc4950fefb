"""Operators on small literals, with brute-force versions where the rule is a loop."""

import random

from pyspark.sql import functions as F

from trajecta.operators import joins, selection, sequences


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_runs_repeats_and_retries(spark):
    data = [("a", i, n, n == "e") for i, n in enumerate("xxyeezzz")] + [("b", 0, "x", False)]
    df = spark.createDataFrame(data, "k string, s int, n string, err boolean")
    assert rows(sequences.longest_run(df, ["k"], ["s"], "n"), "k", "longest_run") == [("a", 3), ("b", 1)]
    assert rows(sequences.most_repeated(df, ["k"], "n"), "k", "most_repeated") == [("a", 3), ("b", 1)]
    assert rows(sequences.failed_retries(df, ["k"], ["s"], "err", "n"), "k", "failed_retries") == [("a", 1), ("b", 0)]


def test_redundant_against_a_loop(spark):
    rng = random.Random(3)
    data = [(t, i, rng.choice("eabc")) for t in range(6) for i in range(30)]
    expected = []
    for t in range(6):
        seen, n = set(), 0
        for _, _, c in (x for x in data if x[0] == t):
            if c == "e":
                seen = set()
            else:
                n += c in seen
                seen.add(c)
        expected.append((t, n))
    df = spark.createDataFrame(data, "t int, s int, c string").withColumn("edit", F.col("c") == "e")
    assert rows(sequences.redundant(df, ["t"], ["s"], "edit", "c"), "t", "redundant") == expected


def test_keep_first_and_caps(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "a", True), (4, "a", True), (5, "b", False)], "o int, k string, ok boolean").withColumn("reason", F.when(~F.col("ok"), "bad"))
    assert rows(sequences.keep_first(df.select("o", "k"), ["k"], ["o"]), "o") == [(1,), (5,)]
    assert rows(sequences.capped(df, "k", ["o"], "ok", 2).fillna("", ["reason"]), "o", "reason") == [(1, ""), (2, "bad"), (3, ""), (4, "per_instance"), (5, "bad")]


def test_collapse_keeps_the_last_kept_turn(spark):
    turns = [(0, "ls", "a"), (1, "ls", "a\nb"), (2, "ls", "a\nb"), (3, "cat", "x"), (4, "submit_patch", "x"), (5, "submit_patch", "x")]
    df = spark.createDataFrame([("t", s, n, "{}", r) for s, n, r in turns], "k string, s int, n string, a string, r string")
    out = sequences.collapse_adjacent(df, ["k"], ["s"], "n", "a", "r").first()
    assert (out["n_kept"], out["n_dropped"]) == (4, 2)
    assert [x["at"]["s"] for x in out["kept"]] == [1, 3, 4, 5]


def test_bucket_plan_pads_the_last_step(spark):
    df = spark.range(7).select("id", F.when(F.col("id") < 5, 10).otherwise(100).alias("n"), F.shiftleft("id", 34).alias("h"))
    out = sequences.bucket_plan(df, "n", "h", ["id"], [16, 128], 2)
    assert rows(out, "id", "bucket", "step_in_bucket", "full") == [(0, 16, 0, True), (1, 16, 0, True), (2, 16, 1, True), (3, 16, 1, True), (4, 16, 2, False), (5, 128, 0, True), (6, 128, 0, True)]


def test_range_join_against_all_pairs(spark):
    rng = random.Random(5)
    windows = [(i, lo := rng.uniform(0, 500), lo + rng.uniform(0, 90)) for i in range(40)]
    points = [(i, rng.uniform(0, 600)) for i in range(150)]
    w, p = spark.createDataFrame(windows, "w int, lo double, hi double"), spark.createDataFrame(points, "p int, at double")
    inner = sorted((i, j) for i, lo, hi in windows for j, at in points if lo <= at <= hi)
    assert rows(joins.range_join(w, p, "lo", "hi", "at", 30.0, "inner"), "w", "p") == inner
    left = joins.range_join(w, p, "lo", "hi", "at", 30.0)
    assert left.count() == len(inner) + len({i for i, *_ in windows} - {i for i, _ in inner})


def test_sequenced_match(spark):
    left = spark.createDataFrame([("i", 0, 5), ("i", 1, 9), ("i", 2, 7), ("i", 3, 7)], "k string, o int, n int")
    right = spark.createDataFrame([("i", 0, 5, "a"), ("i", 1, 6, "b"), ("i", 2, 7, "c")], "k string, r int, n int, v string")
    assert rows(joins.sequenced_match(left, right, "k", "o", "r", ["n"], "v").fillna("-", ["v"]), "o", "v") == [(0, "a"), (1, "-"), (2, "c"), (3, "-")]


def test_map_delta(spark):
    base = {"a": -0.1, "b": -2.0, "c": -3.0}
    cases = [(base, base, 0.0), (base, {**base, "b": -2.2}, 0.2), ({"a": -1.0}, {"b": -1.0}, 0.0), ({"a": -0.2, "b": -1.0}, {"a": -0.2, "c": -1.0}, 0.0)]
    for a, b, want in cases:
        df = spark.createDataFrame([(a, b)], "a map<string,double>, b map<string,double>")
        assert abs(df.select(joins.map_delta(F.col("a"), F.col("b"))).first()[0] - want) < 1e-9
    assert spark.createDataFrame([({"x": 1.0, "y": 1.0},)], "m map<string,double>").select(joins.top_key(F.col("m"))).first()[0] == "x"


def greedy(items, target, cap, repo_pen, inst_pen):
    repos, insts, out, left = {}, {}, [], list(items)
    while left and len(out) < target:
        left = [x for x in left if repos.get(x[2], 0) < cap and insts.get(x[1], 0) < 2]
        if not left:
            break
        eff = lambda x: x[3] - repo_pen * repos.get(x[2], 0) - (inst_pen if insts.get(x[1]) else 0)
        top = max(map(eff, left))
        pick = min((x for x in left if eff(x) >= top - 1e-12), key=lambda x: (x[1], x[0]))
        left.remove(pick)
        repos[pick[2]] = repos.get(pick[2], 0) + 1
        insts[pick[1]] = insts.get(pick[1], 0) + 1
        out.append(pick[0])
    return out


def test_diverse_top_k_against_the_greedy_loop(spark):
    rng = random.Random(11)
    for trial in range(4):
        items = [(i, f"i{i // 2}", f"r{(i // 2) % 4}" if trial < 3 else f"r{i % 3}", round(rng.random(), 2)) for i in range(40)]
        df = spark.createDataFrame(items, "idx int, instance_id string, repo string, score double")
        out = selection.diverse_top_k(df, 15, 5, 0.07, 0.11)
        assert [r["idx"] for r in out.orderBy("pick").collect()] == greedy(items, 15, 5, 0.07, 0.11)


def test_nearest_rank(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 100):
        values = sorted(round(rng.gauss(0, 3), 1) for _ in range(n))
        want = [(p, values[min(n - 1, round((n - 1) * p / 100))]) for p in (0, 10, 25, 50, 75, 90, 100)]
        assert rows(selection.nearest_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v", blocks=8), "p", "value") == want
    assert selection.nearest_rank(spark.createDataFrame([], "v double"), "v").count() == 0


def test_hash_split_and_sign_test(spark):
    import hashlib
    from math import comb

    ids = [f"x{i}" for i in range(50)]
    got = dict(rows(spark.createDataFrame([(i,) for i in ids], "i string").select("i", selection.hash_mod("i").alias("m")), "i", "m"))
    assert got == {i: int(hashlib.md5(i.encode()).hexdigest(), 16) % 1000 for i in ids}
    pairs = [(a, b) for a in range(0, 12, 3) for b in range(0, 30, 7)] + [(2000, 2100)]
    out = spark.createDataFrame(pairs, "lower long, higher long").select("lower", "higher", selection.sign_test("lower", "higher").alias("p")).collect()
    for r in out:
        n, k = r[0] + r[1], min(r[0], r[1])
        want = 1.0 if not n else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)
        assert abs(r["p"] - want) < 1e-9


def test_compare_keys_and_resume(spark):
    want = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "n string, s int")
    have = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "n string, s int")
    assert rows(joins.compare_keys(want, have, "n", "s"), "n", "state") == [("a", "missing"), ("b", "same"), ("c", "shape_bad"), ("d", "extra")]
    assert rows(joins.not_done(want, have, "n"), "n") == [("a",)]
