"""Operators over ordered events: runs, repeats, retries, carry-forward, collapse, caps and bucket plans.

Each takes the columns that part (``keys``) and order (``order``) the rows. An order must be total within
its keys; then every result is deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str = "island") -> DataFrame:
    """Numbers maximal runs of equal consecutive values (nulls are equal)."""
    w = _ordered(keys, order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("long")
    return df.withColumn(into, F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def longest_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str = "longest_run") -> DataFrame:
    """The length of the longest run of equal consecutive values of each key."""
    runs = islands(df, keys, order, value).groupBy(*keys, "island").agg(F.count("*").alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias(into))


def most_repeated(df: DataFrame, keys: Sequence[str], value: str, into: str = "most_repeated") -> DataFrame:
    """The greatest multiplicity of a value of each key: two partial aggregations, so a common value is no hot spot."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max("_n").alias(into))


def failed_retries(df: DataFrame, keys: Sequence[str], order: Sequence[str], error: str, name: str, into: str = "failed_retries") -> DataFrame:
    """How often an error directly follows another error of the same name."""
    w = _ordered(keys, order)
    hit = F.col(error) & F.lag(error).over(w) & F.col(name).eqNullSafe(F.lag(name).over(w))
    return df.withColumn("_hit", hit).groupBy(*keys).agg(F.count_if("_hit").alias(into))


def redundant(df: DataFrame, keys: Sequence[str], order: Sequence[str], resets: str, key: str, into: str = "redundant") -> DataFrame:
    """How many rows repeat an earlier ``key`` since the last row where ``resets`` is true; such rows never count themselves."""
    epoch = df.withColumn("_epoch", F.sum(F.col(resets).cast("long")).over(_ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)))
    again = epoch.where(~F.col(resets)).groupBy(*keys, "_epoch", key).agg((F.count("*") - 1).alias("_again")).groupBy(*keys).agg(F.sum("_again").alias("_again"))
    return df.select(*keys).distinct().join(again, list(keys), "left").select(*keys, F.coalesce("_again", F.lit(0)).alias(into))


def edit_order(df: DataFrame, keys: Sequence[str], seq: str, kind: str) -> DataFrame:
    """verify_after_edit (a run between the last edit and the first submit) and run_before_edit, false without edits."""
    marks = df.groupBy(*keys).agg(
        F.min(F.when(F.col(kind) == "edit", F.col(seq))).alias("_first"),
        F.max(F.when(F.col(kind) == "edit", F.col(seq))).alias("_last"),
        F.min(F.when(F.col(kind) == "submit", F.col(seq))).alias("_submit"),
        F.min(F.when(F.col(kind) == "run", F.col(seq))).alias("_first_run"),
    )
    # the first run behind the last edit needs a second look, at the keys' marks only
    after = df.where(F.col(kind) == "run").select(*keys, F.col(seq).alias("_at")).join(marks, list(keys))
    after = after.groupBy(*keys).agg(F.bool_or((F.col("_at") > F.col("_last")) & (F.col("_submit").isNull() | (F.col("_at") < F.col("_submit")))).alias("_after"))
    return marks.join(after, list(keys), "left").select(*keys, F.coalesce("_after", F.lit(False)).alias("verify_after_edit"), F.coalesce(F.col("_first_run") < F.col("_first"), F.lit(False)).alias("run_before_edit"))


def signals(df: DataFrame, keys: Sequence[str], seq: str, name: str, error: str, kind: str, key: str) -> DataFrame:
    """df with what redundant(), failed_retries() and edit_order() ask of a row, after one exchange by ``keys``.

    Adds _again, _retry (flags), _verifies (a run between the last edit and the first submit) and _early (a run before the
    first edit); count_if and bool_or of them by ``keys`` need no exchange any more.
    """
    w, whole = _ordered(keys, [seq]), Window.partitionBy(*keys)
    at = lambda k, pick: pick(F.when(F.col(kind) == k, F.col(seq))).over(whole)
    edit, run = F.col(kind) == "edit", F.col(kind) == "run"
    marked = df.select(
        "*", F.sum(F.coalesce(edit, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_epoch"),
        (F.col(error) & F.lag(error).over(w) & F.col(name).eqNullSafe(F.lag(name).over(w))).alias("_retry"),
        at("edit", F.min).alias("_first"), at("edit", F.max).alias("_last"), at("submit", F.min).alias("_submit"),
    )
    again = F.row_number().over(Window.partitionBy(*keys, "_epoch", key, F.coalesce(edit, F.lit(False))).orderBy(seq)) > 1
    verifies = run & (F.col(seq) > F.col("_last")) & (F.col("_submit").isNull() | (F.col(seq) < F.col("_submit")))
    out = marked.select("*", (again & ~F.coalesce(edit, F.lit(False))).alias("_again"), F.coalesce(verifies, F.lit(False)).alias("_verifies"), F.coalesce(run & (F.col(seq) < F.col("_first")), F.lit(False)).alias("_early"))
    return out.drop("_epoch", "_first", "_last", "_submit")


def signal_sums() -> list[Column]:
    """The aggregates of signals()."""
    return [F.count_if("_again").alias("redundant"), F.count_if("_retry").alias("failed_retries"), F.bool_or("_verifies").alias("verify_after_edit"), F.bool_or("_early").alias("run_before_edit")]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: a keyed least row by partial aggregation, so a common key is no hot spot."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def arg_max_first(value: str | Column, by: str | Column, order: str | Column) -> Column:
    """The value at the greatest ``by``; of ties the one that comes first in ``order`` (a number)."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return F.max_by(as_column(value), F.struct(as_column(by), -as_column(order)))


def capped(df: DataFrame, key: str, order: Sequence[str], ok: str, cap: int, reason: str = "reason", over: str = "per_instance") -> DataFrame:
    """``reason`` becomes ``over`` for rows that come when ``cap`` earlier rows of the key were ok."""
    before = F.coalesce(F.sum(F.col(ok).cast("long")).over(_ordered([key], order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(reason, F.when(before >= cap, F.lit(over)).otherwise(F.col(reason)))


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """As-of: the last value that is not null before each row."""
    return df.withColumn(into, F.last(value, ignorenulls=True).over(_ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)))


def carry_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], emits: str, text: str, into: str = "carried", sep: str = "\n\n") -> DataFrame:
    """One row per emitting row: its own and the preceding silent rows' non-empty texts, joined."""
    w = _ordered(keys, order)
    group = F.coalesce(F.sum(F.col(emits).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return (
        df.withColumn("_group", group).groupBy(*keys, "_group").agg(F.max(F.when(F.col(emits), F.struct(*order))).alias("_at"), parts.alias("_parts"))
        .where("_at is not null").select(*keys, "_at.*", F.array_join(F.expr("filter(transform(_parts, p -> p._text), t -> t <> '')"), sep).alias(into))
    )


def collapse_adjacent(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, args: str, result: str, keep_apart: str = "submit_patch") -> DataFrame:
    """Folds turns into the last kept one: equal calls with an equal result lose the later turn, and with a result
    whose non-blank lines include all of the earlier one's lose the earlier turn.

    Returns keys, n_kept, n_dropped and kept (an array of the order's, name's, args' and result's structs). The
    fold runs over one key's array, so a key's turns must fit a row; ``keep_apart`` is never folded.
    """
    turn = F.struct(F.struct(*order).alias("at"), F.col(name).alias("name"), F.col(args).alias("args"), F.col(result).alias("result"), F.expr(f"filter(split({result}, '\n', -1), l -> trim(l) <> '')").alias("lines"))
    gathered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))

    def step(kept: Column, t: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        same = (F.size(kept) > 0) & last["name"].eqNullSafe(t["name"]) & last["args"].eqNullSafe(t["args"]) & (t["name"] != keep_apart)
        repeat = same & last["result"].eqNullSafe(t["result"])
        within = same & (F.size(last["lines"]) > 0) & (F.size(F.array_except(last["lines"], t["lines"])) == 0)
        return F.when(repeat, kept).when(within, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(t))).otherwise(F.concat(kept, F.array(t)))

    folded = gathered.withColumn("_kept", F.aggregate("_turns", F.expr("filter(_turns, t -> false)"), step))
    return folded.select(*keys, F.size("_kept").cast("long").alias("n_kept"), (F.size("_turns") - F.size("_kept")).cast("long").alias("n_dropped"), F.expr("transform(_kept, t -> named_struct('at', t.at, 'name', t.name, 'args', t.args, 'result', t.result))").alias("kept"))


def dense_rows(df: DataFrame, key: str, spread: str, order: Sequence[str], into: str) -> DataFrame:
    """Numbers the rows of each key from 0 in the order of ``spread`` (an evenly spread long, such as a hash), then ``order``.

    Rows are ranked in 1,024 ranges of ``spread``, whose counts give each range its start, so a key that
    holds most rows is dealt over all of them.
    """
    blocks = df.withColumn("_block", F.shiftright(F.col(spread), 54))
    starts = blocks.groupBy(key, "_block").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy(key, "_block").orderBy(spread, *order)
    return blocks.join(starts, [key, "_block"]).withColumn(into, F.row_number().over(w) - 1 + F.col("_start")).drop("_block", "_start")


def bucket_plan(df: DataFrame, length: str, spread: str, order: Sequence[str], buckets: Sequence[int], batch: int) -> DataFrame:
    """Steps of ``batch`` rows of one length bucket (the smallest that holds the row, else the largest).

    Rows go in the order of ``spread`` (a seeded hash), then ``order``. Adds bucket, step_in_bucket (from 0)
    and full: the last step of a bucket may not be.
    """
    sizes = sorted(buckets)
    bucket = F.coalesce(*(F.when(F.col(length) <= b, F.lit(b)) for b in sizes), F.lit(sizes[-1]))
    out = dense_rows(df.withColumn("bucket", bucket), "bucket", spread, order, "_n")
    totals = out.groupBy("bucket").agg(F.count("*").alias("_total"))
    return out.join(F.broadcast(totals), "bucket").withColumn("step_in_bucket", F.expr(f"cast(_n div {batch} as bigint)")).withColumn("full", (F.col("step_in_bucket") + 1) * batch <= F.col("_total")).drop("_n", "_total")
