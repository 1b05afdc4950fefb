"""Replay: logged contexts chosen, crossed with conditions, sampled by a plugged-in sampler, and compared in pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calls, text
from ..functions.requests import Condition, declared_names
from ..operators import joins, selection, sequences


def selector(how: str, onset: bool = True) -> Column:
    """The condition of a selector over columns body and raw: all, malformed, after-error, repeat or repeat-onset."""
    messages = F.col("body.messages")
    history = F.transform(calls.history_calls(messages), lambda c: F.struct(c["function"]["name"].alias("name"), F.to_json(F.try_parse_json(c["function"]["arguments"])).alias("arguments")))
    if how == "all":
        return F.lit(True)
    if how == "malformed":
        bad = F.size(calls.classify(F.col("raw"), declared_names(F.col("body.tools")))["malformed_names"]) > 0
        return F.col("raw").isNotNull() & bad & (~calls.malformed_before(messages) if onset else F.lit(True))
    if how == "after-error":
        return calls.after_error(messages)
    if how == "repeat":
        return calls.repeats_itself(history)
    if how == "repeat-onset":
        last = F.try_element_at(history, F.lit(-1))
        return (F.size(history) > 0) & (F.col("next_name") == last["name"]) & F.col("next_args").eqNullSafe(last["arguments"]) & ~calls.repeats_itself(history)
    raise ValueError(f"unknown selector {how!r}")


def select(contexts: DataFrame, how: str, onset: bool = True, role: str | None = None) -> DataFrame:
    """Contexts (ordinal, body, raw) that a selector keeps; ``role`` is looked for in the system text."""
    out = contexts.where(text.matches(text.system_text(F.col("body.messages")), role)) if role else contexts
    if how != "repeat-onset":
        return out.where(F.coalesce(selector(how, onset), F.lit(False)))
    first = F.try_element_at(calls.call_texts(calls.reasoning_split(calls.strip_stop(F.coalesce("raw", F.lit(""))))["content"]), F.lit(1))
    parsed = out.withColumn("next_name", first["name"]).withColumn("_parsed", calls.parsed_arguments(first["args"])).withColumn("next_args", F.to_json(F.try_parse_json("_parsed.args")))
    return parsed.where(F.coalesce(selector(how), F.lit(False))).drop("next_name", "next_args", "_parsed")


def dedupe(contexts: DataFrame) -> DataFrame:
    """The first context of each session: 200 characters of the system text and 300 of the first user message."""
    keyed = contexts.withColumn("_s", F.left(text.system_text(F.col("body.messages")), F.lit(200))).withColumn("_u", text.first_user(F.col("body.messages"), 300))
    return sequences.keep_first(keyed, ["_s", "_u"], ["ordinal"]).drop("_s", "_u")


def limited(contexts: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """A seeded sample of ``limit`` contexts (all, if there are no more)."""
    return contexts.orderBy(selection.seeded_order("ordinal", seed), "ordinal").limit(limit) if limit else contexts


def grid(contexts: DataFrame, conditions: Sequence[Condition], samples: int, require_subs: bool = False) -> DataFrame:
    """ctx, cond, k, subs, system, overrides: every context under every condition ``samples`` times.

    With ``require_subs`` a context goes as a whole if a condition that edits the system text substitutes nothing in it.
    """
    first = F.element_at("body.messages", 1)
    out = None
    for n, condition in enumerate(conditions):
        edited, made = condition.system(text.system_text(F.col("body.messages"), ""))
        own = contexts.select(
            F.col("ordinal").alias("ctx"), F.lit(condition.name).alias("cond"), F.lit(n).alias("cond_at"), F.when(first["role"].isin("system", "developer"), made).otherwise(F.lit(0)).cast("long").alias("subs"),
            edited.alias("system"), F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in condition.overrides().items())), {"ignoreNullFields": "false"}).alias("overrides") if condition.overrides() else F.lit("{}").alias("overrides"),
            F.lit(condition.edits_system).alias("edits"), "body", F.try_element_at(calls.history_calls(F.col("body.messages")), F.lit(-1))["function"].alias("prev_call"),
        )
        out = own if out is None else out.union(own)
    if require_subs:
        fruitless = out.where("edits and subs = 0").select("ctx").distinct()
        out = out.join(fruitless, "ctx", "left_anti")
    return out.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).drop("edits")


def records(samples: DataFrame, names: Sequence[str] | None = None, own: dict | None = None) -> DataFrame:
    """ctx, cond, k and a column for every metric of samples with the columns that functions.calls.SAMPLE names."""
    return samples.select("ctx", "cond", "k", *(c.alias(n) for n, c in calls.metrics(names, own).items()))


def long_form(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """ctx, cond, metric, value, flag (whether the metric is a boolean); null values are left out."""
    kinds = dict(rows.dtypes)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(kinds[n] == "boolean").alias("flag")) for n in names)))
    return rows.select("ctx", "cond", each.alias("m")).select("ctx", "cond", "m.*").where("value is not null")


def rates(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """cond, metric, n, hits (of booleans, else null) and mean."""
    return long_form(rows, names).groupBy("cond", "metric").agg(F.count("*").alias("n"), F.sum(F.when(F.col("flag"), F.col("value"))).cast("long").alias("hits"), F.avg("value").alias("mean"))


def paired(rows: DataFrame, names: Sequence[str], base: str) -> DataFrame:
    """cond, metric, lower, higher, tied and p: contexts' means against the base condition's, with the exact sign test."""
    means = long_form(rows, names).groupBy("ctx", "cond", "metric").agg(F.avg("value").alias("mean"))
    left = means.where(F.col("cond") == base).select("ctx", "metric", F.col("mean").alias("base_mean"))
    gap = means.where(F.col("cond") != base).join(left, ["ctx", "metric"]).withColumn("d", F.col("mean") - F.col("base_mean"))
    out = gap.groupBy("cond", "metric").agg(F.count_if(F.col("d") < 0).alias("lower"), F.count_if(F.col("d") > 0).alias("higher"), F.count_if(F.col("d") == 0).alias("tied"))
    return out.withColumn("p", selection.sign_test("lower", "higher"))


#: What a sampler answers for a row of the grid.
ANSWER = "ctx long, cond string, k int, raw string, content string, calls array<struct<name:string,arguments:string>>, finish string, completion_tokens int"


def sampled_records(contexts: DataFrame, conditions: Sequence[Condition], samples: int, sampler, names: Sequence[str] | None = None, require_subs: bool = False) -> DataFrame:
    """records() of the grid's rows as a sampler answers them (a dict of ANSWER's fields); write the result before comparing it."""
    answers = joins.sampled(grid(contexts, conditions, samples, require_subs), sampler, ANSWER)
    last = F.try_element_at(calls.history_calls(F.col("body.messages")), F.lit(-1))["function"]
    about = contexts.select(F.col("ordinal").alias("ctx"), declared_names(F.col("body.tools")).alias("declared"), F.struct(last["name"].alias("name"), last["arguments"].alias("arguments")).alias("prev_call"))
    return records(answers.join(about, "ctx"), names)
