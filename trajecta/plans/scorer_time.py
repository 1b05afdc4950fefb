"""How long logged runs would take on a reference machine: calls joined to tasks by time, then a cost model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import range_aggregate

#: Seconds of a call, tokens a second, seconds of slack around a task, hours of the limit.
PER_CALL, TOKENS_A_SECOND, SLACK, LIMIT_HOURS = 0.6, 25.5, 2.0, 12.0


def task_windows(results: DataFrame) -> DataFrame:
    """Adds lo and hi: a task's start (else its end less its wall time) and end, with slack."""
    start = F.coalesce("started_at", F.col("ended_at") - F.col("wall_s"))
    return results.withColumn("lo", start - F.lit(SLACK)).withColumn("hi", F.col("ended_at") + F.lit(SLACK))


def estimates(results: DataFrame, calls: DataFrame, key: list[str], per_call: float = PER_CALL, tokens_a_second: float = TOKENS_A_SECOND, cap_s: float | None = None, slot: float = 3600.0) -> DataFrame:
    """Per task: n_calls, n_thinking, completion_tokens, llm_local_s, llm_est_s, tool_s, est_s.

    Only calls with status 200 (or none) count; a call in two tasks' windows counts for both; a task
    without calls stays.
    """
    answered = calls.where(F.coalesce("status", F.lit(200)) == 200).select(F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("dt", F.lit(0.0)).alias("dt"), F.coalesce("completion_tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("enable_thinking", F.lit(False)).alias("thinking"))
    sums = {
        "n_calls": F.count("*"), "n_thinking": F.count_if("thinking"), "completion_tokens": F.sum("tokens"), "llm_local_s": F.sum("dt"),
        "llm_est_s": F.sum(F.lit(per_call) + F.col("tokens") / F.lit(tokens_a_second)),
    }
    out = range_aggregate(task_windows(results), answered, key, "lo", "hi", "t", slot, sums)
    out = out.fillna({"n_calls": 0, "n_thinking": 0, "completion_tokens": 0, "llm_local_s": 0.0, "llm_est_s": 0.0})
    out = out.withColumn("tool_s", F.greatest(F.lit(0.0), F.coalesce("wall_s", F.lit(0.0)) - F.col("llm_local_s"))).withColumn("est_s", F.col("llm_est_s") + F.col("tool_s"))
    return out.withColumn("est_s", F.least("est_s", F.lit(float(cap_s)))) if cap_s else out


def projection(found: DataFrame, by: list[str] = [], n_tasks: int = 120, setup_min: float = 1.0, order: str | None = None) -> DataFrame:
    """Per group: tasks, mean_min, median_min, solved, hours for ``n_tasks`` tasks, and whether that fits the limit.

    With ``order`` the groups come in the order in which they are first seen.
    """
    hours = (F.avg("est_s") + setup_min * 60) * n_tasks / 3600
    out = found.groupBy(*by).agg(F.count("*").alias("tasks"), (F.avg("est_s") / 60).alias("mean_min"), (F.median("est_s") / 60).alias("median_min"), F.count_if("resolved").alias("solved"), F.coalesce(hours, F.lit(0.0)).alias("hours"), *([F.min(order).alias("_first")] if order else []))
    out = out.orderBy("_first").drop("_first") if order else out
    return out.withColumn("verdict", F.when(F.col("hours") > LIMIT_HOURS, "over").when(F.col("hours") > LIMIT_HOURS - 1.5, "near").otherwise("fits"))
