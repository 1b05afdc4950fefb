"""Rendering: conversations as training windows in the turn format, split by the hash of their instance."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.requests import user_message
from ..operators.selection import hash_split
from ..operators.windows import assembled, windows, word_count

PLACEHOLDERS = {"repo": "<<REPO>>", "problem_statement": "<<PROBLEM_STATEMENT>>", "workspace_tree": "<<WORKSPACE_TREE>>"}


def user_template(content: str) -> dict:
    """A user template from JSON, with default placeholders; raises ValueError for a missing part."""
    template = json.loads(content)
    if missing := [k for k in ("user_message", "tree_section") if k not in template]:
        raise ValueError(f"the user template lacks {missing}")
    return {"placeholders": PLACEHOLDERS} | template


def error_turns(conversations: DataFrame, how: str) -> DataFrame:
    """ordinal and untrained: the numbers of assistant messages whose call returned an error.

    off: none; tool: errors that a wrong call caused; all: any error. A message's results are the tool
    messages that follow it directly.
    """
    if how == "off":
        return conversations.select("ordinal", F.array().cast("array<int>").alias("untrained"))
    w = Window.partitionBy("ordinal").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = conversations.select("ordinal", F.posexplode("messages").alias("pos", "m")).withColumn("turn", F.last(F.when(F.col("m.role") != "tool", F.col("pos")), ignorenulls=True).over(w))
    made = rows.where("m.role = 'assistant'").select("ordinal", F.col("pos").alias("turn"), F.explode("m.tool_calls").alias("c")).select("ordinal", "turn", F.col("c.id").alias("id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("args"))
    got = rows.where("m.role = 'tool'").select("ordinal", "turn", F.col("m.tool_call_id").alias("id"), F.col("m.content").alias("result"))
    at = lambda p: F.get_json_object("result", f"$.{p}")
    error = at("status") == "error" if how == "all" else text.tool_error(F.col("name"), F.get_json_object("args", "$.command"), at("status"), at("details.exit_code"), at("error_message"), at("details.stderr"))
    bad = made.join(got, ["ordinal", "turn", "id"]).where(F.coalesce(error, F.lit(False))).groupBy("ordinal").agg(F.sort_array(F.collect_set("turn")).alias("untrained"))
    return conversations.select("ordinal").join(bad, "ordinal", "left").select("ordinal", F.coalesce("untrained", F.array().cast("array<int>")).alias("untrained"))


def render(conversations: DataFrame, system: str, template: dict, tools: Sequence[dict] = (), thinking: bool = False, encoding: str = "single", most: int = 12_288, valid: float = 0.02, mask_errors: str = "off", count=word_count) -> DataFrame:
    """segments, instance_id, turns and split (train or valid) of conversations (with ordinal).

    ``count`` is the number of tokens of a text, by words unless a tokenizer is given.
    """
    listing = F.try_element_at(F.filter("messages", lambda m: (m["role"] == "tool") & (m["name"] == "run_command")), F.lit(1))["content"]
    tree = text.tree_listing(F.coalesce(F.get_json_object(listing, "$.stdout"), F.lit("")))
    given = conversations.withColumn("_user", user_message(template, tree, F.col("repo"), F.col("issue"))).join(error_turns(conversations, mask_errors), "ordinal")

    def build(row: dict) -> tuple[list[dict], list[int]]:
        return assembled(row, system, row["_user"], thinking, encoding), [k + 2 for k in row["untrained"]]  # behind the system and user messages

    return hash_split(windows(given, build, tools, thinking, most, count), "instance_id", valid)
