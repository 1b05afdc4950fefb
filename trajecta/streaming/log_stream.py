"""The request log as a stream: classification and routing, running sessions, attribution to tasks, idle gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schema
from ..functions import text
from ..functions.calls import classify, completion
from ..functions.requests import Budget, declared_names, is_overflow
from ..sources import sinks


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a growing log folder, as rows of the full request log."""
    return spark.readStream.schema(schema.REQUEST_LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def classified(log: DataFrame) -> DataFrame:
    """Adds n_messages, malformed_names, unparsed and suspicious to a request log, batch or stream."""
    info = classify(F.col("raw"), declared_names(F.col("body.tools")))
    made = completion(F.coalesce("raw", F.lit("")), F.coalesce(F.size("body.tools"), F.lit(0)) > 0, F.lit("stop"))
    out = log.withColumn("_i", info).withColumn("_m", made)
    empty = (F.size("_m.calls") == 0) & (F.coalesce("_m.content", F.lit("")) == "")
    odd = (F.size("_i.malformed_names") > 0) | F.col("_i.unparsed") | (F.size("_i.unknown_tools") > 0) | F.col("_i.damaged_args") | empty
    return out.select(*log.columns, F.coalesce(F.size("body.messages"), F.lit(0)).alias("n_messages"), F.col("_i.malformed_names").alias("malformed_names"), F.col("_i.unparsed").alias("unparsed"), ((F.coalesce("status", F.lit(200)) == 200) & odd).alias("suspicious"))


def route(log: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes summary, full and suspect rows of a log stream; each batch is computed once for the three."""

    def write(batch: DataFrame, _: int) -> None:
        rows = classified(batch).persist()
        try:
            sinks.routed_log(rows, path)
        finally:
            rows.unpersist()

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def running_sessions(log: DataFrame) -> DataFrame:
    """Per role and first user message: requests, overflow and the longest history so far (update or complete mode)."""
    return log.where(F.size("body.messages") > 0).groupBy(text.role_label(text.system_text(F.col("body.messages"))).alias("role"), text.first_user(F.col("body.messages")).alias("key")).agg(F.count("*").alias("requests"), F.count_if(is_overflow(F.col("status"), F.col("error"))).alias("overflow"), F.max(F.size("body.messages")).alias("longest"))


def running_roles(log: DataFrame) -> DataFrame:
    return log.groupBy(text.role_label(text.system_text(F.col("body.messages"))).alias("role")).agg(F.count("*").alias("requests"))


def attributed(calls: DataFrame, tasks: DataFrame, slack_s: int = 2, late: str = "10 minutes", longest: str = "12 hours") -> DataFrame:
    """Stream-stream join of calls (at) to tasks (started, ended: timestamps) with slack; watermarks bound the state.

    Like the batch range join it is an equality on time slots (of an hour) with the range as a residue, as
    such joins need one. A call waits for its task's end for as long as a task may last, ``longest``: the length of a
    whole run unless given. Calls made longer before their task's end are not attributed; the batch join has no such bound.
    """
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    slack = F.expr(f"interval {slack_s} seconds")
    c = calls.withWatermark("at", late).withColumn("_slot", hour(F.col("at")))
    t = tasks.withWatermark("ended", late).withColumn("_of", F.explode(F.sequence(hour(F.col("started") - slack), hour(F.col("ended") + slack))))
    near = f"_slot = _of and at >= started - interval {slack_s} seconds and at <= ended + interval {slack_s} seconds and ended <= at + interval {longest}"
    return c.join(t, F.expr(near)).drop("_slot", "_of")


def budgeted(tokens: DataFrame, budget: int, start: tuple[int, ...] = (100,), end: tuple[int, ...] = (101,)) -> DataFrame:
    """The tokens that requests emit under a thinking budget, from a stream of their proposals: request, seq, token.

    The state of a request is its open thought; it is keyed by request, and a request's proposals come in the order of seq
    across batches (within one they are sorted). ``requests.Budget`` holds the rule.
    """

    def emit(key, batches, state):
        machine = Budget(budget, start, end, *state.get) if state.exists else Budget(budget, start, end)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = pd.DataFrame({"request": rows["request"], "seq": rows["seq"], "token": [machine.step(int(t)) for t in rows["token"]]})
        state.update(machine.state)
        yield out

    return tokens.select("request", "seq", "token").groupBy("request").applyInPandasWithState(emit, "request string, seq long, token int", "inside boolean, count int, forced int, tail array<int>", "append", "NoTimeout")


def idle_sessions(calls: DataFrame, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of calls (at: timestamp) of each key that end after an idle ``gap``: start, end and calls."""
    return calls.withWatermark("at", late).groupBy(F.session_window("at", gap), key).agg(F.count("*").alias("calls")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "calls")
