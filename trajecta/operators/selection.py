"""Selection and order statistics: diverse top-k without a loop, nearest-rank quantiles, hash splits, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diverse_top_k(items: DataFrame, target: int | Column, max_per_repo: int, repo_penalty: float, instance_penalty: float, idx: str = "idx", instance: str = "instance_id", repo: str = "repo", score: str = "score") -> DataFrame:
    """The greedy choice by score - repo_penalty * (kept of the repository) - instance_penalty (if the instance is kept).

    At most ``max_per_repo`` of a repository and two of an instance; ties go to the lesser instance, then idx.
    Set-wise: penalties are common within a repository, so the greedy order inside one is fixed, effective
    scores fall along it, and the whole choice is a merge of falling sequences. Where an instance stands in
    several repositories this does not hold, and greedy_top_k() runs instead. Adds effective and pick (from 1).
    """
    wide = not items.groupBy(instance).agg(F.min(repo).alias("a"), F.max(repo).alias("b")).where("a <> b").isEmpty()
    if wide:
        return greedy_top_k(items, target, max_per_repo, repo_penalty, instance_penalty, idx, instance, repo, score)
    within = Window.partitionBy(instance).orderBy(F.desc(score), idx)
    two = items.withColumn("_r", F.row_number().over(within)).where("_r <= 2").withColumn("_p", F.when(F.col("_r") == 2, F.lit(float(instance_penalty))).otherwise(F.lit(0.0)))
    in_repo = Window.partitionBy(repo).orderBy(F.desc(F.col(score) - F.col("_p")), instance, idx)
    ranked = two.withColumn("_k", F.row_number().over(in_repo) - 1).where(F.col("_k") < max_per_repo)
    scored = ranked.withColumn("effective", F.col(score) - F.lit(float(repo_penalty)) * F.col("_k") - F.col("_p"))
    return numbered(scored.drop("_r", "_p", "_k"), "effective", [instance, idx], "pick").where(F.col("pick") <= int(target))


def cuts(df: DataFrame, value: str, blocks: int = 256) -> list[float]:
    """Values that part the rows into about equal blocks, whatever their distribution: one aggregation, ``blocks`` numbers."""
    found = df.agg(F.percentile_approx(F.col(value).cast("double"), [n / blocks for n in range(1, blocks)], 10_000).alias("c")).first()["c"]
    return sorted(set(found or []))


def numbered(df: DataFrame, value: str, ties: Sequence[str], into: str) -> DataFrame:
    """Numbers all rows from 1 by falling ``value``, then ``ties``, without a task that sees all of them.

    Rows are ranked within blocks of values, whose counts give each block its start; equal values are in one block.
    """
    bounds = cuts(df, value)
    # the number of bounds above the value: the block of the greatest values is 0
    block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > F.col(value).cast("double"))) if bounds else F.lit(0)
    dealt = df.withColumn("_b", block)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    starts = dealt.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    w = Window.partitionBy("_b").orderBy(F.desc(value), *ties)
    return dealt.join(F.broadcast(starts), "_b").withColumn(into, F.row_number().over(w) + F.col("_s")).drop("_b", "_s")


def greedy_top_k(items: DataFrame, target: int, max_per_repo: int, repo_penalty: float, instance_penalty: float, idx: str = "idx", instance: str = "instance_id", repo: str = "repo", score: str = "score") -> DataFrame:
    """The same choice one by one, for instances that stand in several repositories.

    Only the best candidates of each repository can be chosen, so at most two of an instance and
    ``max_per_repo`` + the instances' doubles of a repository meet in the one task that walks them.
    """
    schema = items.withColumn("effective", F.lit(0.0)).withColumn("pick", F.lit(0)).schema

    def walk(given: pd.DataFrame) -> pd.DataFrame:
        rows = given.sort_values([score, instance, idx], ascending=[False, True, True]).to_dict("records")
        repos: dict = {}
        instances: dict = {}
        out: list[dict] = []
        while rows and len(out) < int(target):
            rows = [r for r in rows if repos.get(r[repo], 0) < max_per_repo and instances.get(r[instance], 0) < 2]
            if not rows:
                break
            effective = [r[score] - repo_penalty * repos.get(r[repo], 0) - (instance_penalty if instances.get(r[instance]) else 0) for r in rows]
            top = max(effective)
            at = min((i for i, e in enumerate(effective) if e >= top - 1e-12), key=lambda i: (rows[i][instance], rows[i][idx]))
            row = rows.pop(at)
            repos[row[repo]] = repos.get(row[repo], 0) + 1
            instances[row[instance]] = instances.get(row[instance], 0) + 1
            out.append({**row, "effective": effective[at], "pick": len(out) + 1})
        return pd.DataFrame(out, columns=[f.name for f in schema])

    two = items.withColumn("_r", F.row_number().over(Window.partitionBy(instance).orderBy(F.desc(score), idx))).where("_r <= 2").drop("_r")
    return two.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(walk, schema)


def target_size(keep: float, n: int) -> int:
    """keep * n rounded to the nearest, halves to even."""
    return round(keep * n)


def nearest_rank(df: DataFrame, value: str, percents: Sequence[int] = (0, 10, 25, 50, 75, 90, 100), blocks: int = 256) -> DataFrame:
    """p and value: the value at index round_half_even((n - 1) * p / 100) of the sorted values (nulls left out).

    Exact without a global sort: distinct values are counted, blocks of about equal numbers of rows are cut at approximate
    quantiles (an outlier changes nothing), and only the blocks that hold an asked index are ranked. No values give no rows.
    """
    given = df.where(F.col(value).isNotNull())
    bounds = cuts(given, value, blocks)
    counted = given.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("v"))) if bounds else F.lit(0)
    tagged = counted.withColumn("b", block.cast("long"))
    upto, all_ = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per block
    starts = tagged.groupBy("b").agg(F.sum("c").alias("bc")).select("b", "bc", F.coalesce(F.sum("bc").over(upto), F.lit(0)).alias("before"), F.sum("bc").over(all_).alias("n"))
    # (n - 1) * p / 100 in whole hundredths, so halves are exact
    at = F.expr("(n - 1) * p div 100 + case when (n - 1) * p % 100 > 50 then 1 when (n - 1) * p % 100 = 50 then ((n - 1) * p div 100) % 2 else 0 end")
    asked = starts.withColumn("p", F.explode(F.array(*(F.lit(int(p)).cast("long") for p in percents)))).withColumn("at", at).where("at >= before and at < before + bc").select("b", "p", "at", "before")
    inside = Window.partitionBy("b", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = tagged.join(F.broadcast(asked), "b").withColumn("upto", F.col("before") + F.sum("c").over(inside))
    return found.where("at < upto and at >= upto - c").select(F.col("p").cast("int").alias("p"), F.col("v").alias("value"))


def hash_mod(column: str, modulus: int = 1000) -> Column:
    """The MD5 of a text as a 128-bit number, modulo ``modulus``: a fold over its hexadecimal digits."""
    return F.expr(f"aggregate(split(md5({column}), ''), 0, (_a, _h) -> cast((_a * 16 + instr('0123456789abcdef', _h) - 1) % {modulus} as int))")


def hash_split(df: DataFrame, column: str, fraction: float, into: str = "split") -> DataFrame:
    """valid for the ids whose hash falls under ``fraction``, else train; the same id always goes the same way."""
    return df.withColumn(into, F.when(hash_mod(column) < F.lit(fraction * 1000), "valid").otherwise("train"))


def top_frequent(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The ``n`` most frequent keys, ties to the one met first in ``order``."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_at")).orderBy(F.desc("n"), "first_at").limit(n)


def count_histogram(df: DataFrame, key: str) -> DataFrame:
    """How many keys have how many rows."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("keys"))


def sign_test(lower: str, higher: str) -> Column:
    """The two-sided exact sign test: 1 without differences. In logarithms, so any count is finite."""
    n, k = f"({lower} + {higher})", f"least({lower}, {higher})"
    # the binomial terms by their ratios, from the term at i = 0 on: log C(n, 0) = 0
    fold = f"aggregate(sequence(0L, {k}), named_struct('t', 0.0D, 's', 0.0D), (a, i) -> named_struct('t', if(i = 0, 0.0D, a.t + ln(cast({n} - i + 1 as double)) - ln(cast(i as double))), 's', a.s + exp(if(i = 0, 0.0D, a.t + ln(cast({n} - i + 1 as double)) - ln(cast(i as double))) - {n} * ln(2.0D))), a -> a.s)"
    return F.expr(f"if({n} = 0, 1.0D, least(1.0D, 2.0D * {fold}))")


def seeded_order(column: str, seed: int) -> Column:
    """A deterministic shuffle: the hash of the column and the seed, to order by."""
    return F.xxhash64(F.lit(seed), F.col(column))
