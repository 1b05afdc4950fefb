"""Session and role statistics of a request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.calls import canonical, classify
from ..functions.requests import declared_names, is_overflow
from ..operators import sequences


def sessions(log: DataFrame, roles: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """A row per role and first user message: requests, malformed, unparsed, overflow, and the longest request's messages.

    ``log`` has ordinal, status, body, raw and error. Of equally long requests the first counts.
    """
    said = log.where(F.coalesce(F.size("body.messages"), F.lit(0)) > 0)
    info = classify(F.col("raw"), declared_names(F.col("body.tools")))
    keyed = said.select(
        "ordinal", text.role_label(text.system_text(F.col("body.messages")), roles).alias("role"), text.first_user(F.col("body.messages")).alias("key"),
        F.col("body.messages").alias("messages"), info.alias("info"), is_overflow(F.col("status"), F.col("error")).alias("over"), (F.coalesce("raw", F.lit("")) != "").alias("answered"),
    )
    return keyed.groupBy("role", "key").agg(
        F.count("*").alias("requests"), F.count_if(F.col("answered") & (F.size("info.malformed_names") > 0)).alias("malformed"), F.count_if(F.col("answered") & F.col("info.unparsed")).alias("unparsed"),
        F.count_if("over").alias("overflow"), F.min("ordinal").alias("first_at"), sequences.arg_max_first(F.col("messages"), F.size("messages"), F.col("ordinal")).alias("longest"),
    )


def session_calls(found: DataFrame) -> DataFrame:
    """role, key, seq, name and call (name and canonical arguments) of every call in the sessions' longest requests."""
    turns = found.select("role", "key", F.posexplode("longest").alias("turn", "m")).where("m.role = 'assistant'")
    calls = turns.select("role", "key", "turn", F.posexplode("m.tool_calls").alias("at", "c")).withColumn("seq", F.col("turn").cast("long") * (1 << 20) + F.col("at"))
    return calls.select("role", "key", "seq", F.col("c.id").alias("id"), F.col("c.function.name").alias("name"), F.concat_ws("\u0000", "c.function.name", canonical(F.col("c.function.arguments"))).alias("call"))


def edit_outcomes(found: DataFrame, calls: DataFrame) -> DataFrame:
    """edit_ok, edit_not_found and edit_error of every session: results behind the edit call with their id."""
    results = found.select("role", "key", F.posexplode("longest").alias("turn", "m")).where("m.role = 'tool'").select("role", "key", (F.col("turn").cast("long") * (1 << 20)).alias("at"), F.col("m.tool_call_id").alias("id"), text.edit_outcome(F.coalesce("m.content", F.lit(""))).alias("outcome"))
    edits = calls.where("name = 'edit_file'").groupBy("role", "key", "id").agg(F.min("seq").alias("seq"))
    hits = results.join(edits, ["role", "key", "id"]).where("at > seq")
    return hits.groupBy("role", "key").agg(*(F.count_if(F.col("outcome") == o).alias(f"edit_{o}") for o in ("ok", "not_found", "error")))


def session_report(log: DataFrame, roles: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """sessions() with longest_run, most_repeated and edit outcomes, 0 where a session has no calls."""
    found = sessions(log, roles)
    calls = session_calls(found)
    out = found.drop("longest")
    for part in (sequences.longest_run(calls, ["role", "key"], ["seq"], "call"), sequences.most_repeated(calls, ["role", "key"], "call"), edit_outcomes(found, calls)):
        out = out.join(part, ["role", "key"], "left")
    return out.fillna(0)


def role_report(report: DataFrame, loop: int = 10) -> DataFrame:
    """A row per role: totals, and sessions with a run of ``loop`` equal calls or more."""
    sums = ["requests", "edit_ok", "edit_not_found", "edit_error", "malformed", "unparsed", "overflow"]
    return report.groupBy("role").agg(F.count("*").alias("sessions"), *(F.sum(c).alias(c) for c in sums), F.count_if(F.col("longest_run") >= loop).alias("loops"))


def most_repetitive(report: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` sessions by their most repeated call, of which those with two repeats or more stay."""
    return report.orderBy(F.desc("most_repeated"), "first_at").limit(top).where("most_repeated >= 2")
