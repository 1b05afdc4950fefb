"""Joins beyond plain equality: time ranges by slots, order-consuming matches, map deltas and key comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(windows: DataFrame, points: DataFrame, lo: str, hi: str, at: str, slot: float, how: str = "left") -> DataFrame:
    """Joins every window to the points with lo <= at <= hi (seconds), by time slots.

    A window is dealt to the slots it touches and a point to its one slot, so the join is an equality with
    the range as a residue, needs no duplicate removal, and a busy time only fills its slot. Windows without
    a point stay once, with nulls, where ``how`` is "left". ``slot`` should be near the usual window length.
    """
    where = lambda c: F.floor(F.col(c) / F.lit(float(slot))).cast("long")
    tagged = windows.withColumn("_w", F.monotonically_increasing_id()) if how == "left" else windows
    dealt = tagged.withColumn("_slot", F.explode(F.sequence(where(lo), where(hi))))
    slotted = points.withColumn("_slot", where(at))
    hits = dealt.join(slotted, "_slot").where(F.col(at).between(F.col(lo), F.col(hi))).drop("_slot")
    if how != "left":
        return hits
    alone = dealt.join(slotted.select("_slot", F.col(at).alias("_at")), "_slot", "left").groupBy(*windows.columns, "_w").agg(F.bool_or(F.col("_at").between(F.col(lo), F.col(hi))).alias("_hit")).where("not coalesce(_hit, false)")
    return hits.drop("_w").unionByName(alone.select(*windows.columns), allowMissingColumns=True)


def range_aggregate(windows: DataFrame, points: DataFrame, key: Sequence[str], lo: str, hi: str, at: str, slot: float, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates the points of each window; windows without points stay, with nulls. ``key`` names a window."""
    hits = range_join(windows, points, lo, hi, at, slot, "inner").groupBy(*key).agg(*(c.alias(n) for n, c in aggregates.items()))
    return windows.join(hits, list(key), "left")


def sequenced_match(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str, match: Sequence[str], carry: str) -> DataFrame:
    """Per key, each left row in order takes the next unused right row whose ``match`` columns are equal.

    A left row without a match takes none and uses none. Adds ``carry`` of the matched right row and matched.
    A fold over the key's sorted left rows with, for each compared value, the places of its right rows: a step looks at the
    rows of its own value alone. A key's compared values and places must fit a row.
    """
    value = F.to_json(F.struct(*match))
    wants = left.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(left_order).alias("o"), value.alias("m")))).alias("_l"))
    offers = right.groupBy(key, value.alias("_m")).agg(F.array_sort(F.collect_list(right_order)).alias("_at")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_m", "_at"))).alias("_r"))
    both = wants.join(offers, key, "left")

    def step(state: Column, wanted: Column) -> Column:
        ahead = F.filter(F.try_element_at("_r", wanted["m"]), lambda at: state["used"].isNull() | (at > state["used"]))
        took = F.get(ahead, F.lit(0))
        return F.struct(F.coalesce(took, state["used"]).alias("used"), F.concat(state["took"], F.array(took)).alias("took"))

    kinds = dict(right.dtypes)
    start = F.struct(F.lit(None).cast(kinds[right_order]).alias("used"), F.array().cast(f"array<{kinds[right_order]}>").alias("took"))
    pairs = both.select(key, F.explode(F.arrays_zip(F.transform("_l", lambda x: x["o"]).alias("o"), F.aggregate("_l", start, step, lambda s: s["took"]).alias("took"))).alias("p"))
    pairs = pairs.select(key, F.col("p.o").alias(left_order), F.col("p.took").alias("_took"))
    found = pairs.join(right.select(F.col(key).alias("_key"), F.col(right_order).alias("_order"), carry), (F.col(key) == F.col("_key")) & (F.col("_took") == F.col("_order")), "left")
    return left.join(found.select(key, left_order, carry, F.col("_took").isNotNull().alias("matched")), [key, left_order], "left")


def map_delta(a: Column, b: Column) -> Column:
    """The largest change between two maps of token to log-probability.

    A token in both counts with its absolute difference; one in a single map counts with its value less the
    other map's least, which may be negative; the result is 0 at least, and null if a map is null or empty.
    """

    def one_way(x: Column, y: Column) -> Column:
        least = F.array_min(F.map_values(y))
        each = F.transform(F.map_entries(x), lambda e: F.coalesce(F.abs(e["value"] - F.try_element_at(y, e["key"])), e["value"] - least))
        return F.array_max(each)

    return F.when(F.size(a) * F.size(b) > 0, F.greatest(F.lit(0.0), one_way(a, b), one_way(b, a)))


def top_key(m: Column) -> Column:
    """The key of a map's greatest value, the first of ties."""
    entries = F.map_entries(m)
    best = F.array_max(F.map_values(m))
    return F.filter(entries, lambda e: e["value"] == best)[0]["key"]


def delta_verdict(base: Column, repeat: Column, other: Column, least: float = 0.05, times: float = 5.0) -> Column:
    """struct differs, max_dlogprob, noise, threshold: different top keys, or a change over the noise of two base runs."""
    noise, change = map_delta(base, repeat), map_delta(base, other)
    threshold = F.greatest(F.lit(least), F.lit(times) * noise)
    return F.struct(((top_key(other) != top_key(base)) | (change > threshold)).alias("differs"), change.alias("max_dlogprob"), noise.alias("noise"), threshold.alias("threshold"))


def compare_keys(expected: DataFrame, found: DataFrame, key: str, shape: str) -> DataFrame:
    """key and state of all keys: missing, extra, shape_bad or same; a full outer join on the key."""
    a = expected.select(F.col(key), F.col(shape).alias("_want"), F.lit(True).alias("_a"))
    b = found.select(F.col(key), F.col(shape).alias("_have"), F.lit(True).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(~F.col("_want").eqNullSafe(F.col("_have")), "shape_bad").otherwise("same")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def inspected_first(df: DataFrame, keys: Sequence[str], seq: str, edits: str, reads: str) -> DataFrame:
    """Per key, the share of edited targets with an earlier read of the same target; 1 without edits.

    ``edits`` and ``reads`` hold the target of a row that edits or reads, else null. Only the first edit and
    the first read of a target matter, so the theta join is two partial aggregations and an equality.
    """
    first = df.where(F.col(edits).isNotNull()).groupBy(*keys, F.col(edits).alias("_t")).agg(F.min(seq).alias("_edit"))
    read = df.where(F.col(reads).isNotNull()).groupBy(*keys, F.col(reads).alias("_t")).agg(F.min(seq).alias("_read"))
    share = first.join(read, [*keys, "_t"], "left").groupBy(*keys).agg(F.avg(F.coalesce((F.col("_read") < F.col("_edit")).cast("double"), F.lit(0.0))).alias("_share"))
    return df.select(*keys).distinct().join(share, list(keys), "left").select(*keys, F.coalesce("_share", F.lit(1.0)).alias("read_before_edit"))


def not_done(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks whose key has no result yet: what a resumed run has left."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def unknown_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return asked.select(key).distinct().join(known.select(key), key, "left_anti")


def condition_grid(contexts: DataFrame, conditions: DataFrame, samples: int) -> DataFrame:
    """Every context under every condition, ``samples`` times. Conditions come from a command line and are broadcast."""
    return contexts.join(F.broadcast(conditions)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def sampled(requests: DataFrame, sampler, schema: str) -> DataFrame:
    """Answers of an external sampler: ``sampler`` maps a request's dict to a dict of ``schema``'s fields.

    Rows are sent one by one within a partition; the result should be written before it is used twice,
    because sampling is not deterministic.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([sampler(row) for row in batch.to_dict("records")])

    return requests.mapInPandas(run, schema)
