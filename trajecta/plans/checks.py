"""Small checks around a run: adapter canaries, smoke summaries, adapter keys, data preparation and training plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, selection, sequences


def canary_rows(samples: DataFrame, adapters: Sequence[str]) -> DataFrame:
    """label, adapter, error, differs, max_dlogprob, noise, threshold from samples (label, role, top map, error).

    Roles are base, base_repeat and the adapters' names. A failed base makes an error of every adapter's row.
    """
    by = samples.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("role", F.struct("top", "error")))).alias("m"))
    base, again = F.try_element_at("m", F.lit("base")), F.try_element_at("m", F.lit("base_repeat"))
    each = by.withColumn("adapter", F.explode(F.array(*map(F.lit, adapters)))).withColumn("a", F.expr("try_element_at(m, adapter)"))
    base_error = F.coalesce(base["error"], again["error"], F.when(base["top"].isNull() | again["top"].isNull(), F.lit("no answer")))
    error = F.when(base_error.isNotNull(), F.concat(F.lit("base: "), base_error)).otherwise(F.coalesce(F.col("a.error"), F.when(F.col("a.top").isNull(), F.lit("no answer"))))
    verdict = joins.delta_verdict(base["top"], again["top"], F.col("a.top"))
    out = each.select("label", "adapter", F.left(error, F.lit(300)).alias("error"), verdict.alias("v"))
    return out.select("label", "adapter", "error", *(F.when(F.col("error").isNull(), F.col(f"v.{c}")).alias(c) for c in ("differs", "max_dlogprob", "noise", "threshold")))


def adapter_verdicts(rows: DataFrame) -> DataFrame:
    """adapter, differs and why not: requests failed (all of them), or logits unchanged."""
    any_ = F.coalesce(F.bool_or("differs"), F.lit(False))
    why = F.when(any_, "").when(F.bool_and(F.col("differs").isNull()), "requests failed").otherwise("logits unchanged")
    return rows.groupBy("adapter").agg(any_.alias("differs"), why.alias("why"))


def discovered(models: DataFrame) -> DataFrame:
    """id and is_base of a model list: what has no parent is a base."""
    return models.select("id", (F.coalesce("parent", F.lit("")) == "").alias("is_base"))


def smoke_agents(log: DataFrame) -> DataFrame:
    """role, head and requests, with the tools of the first request."""
    return log.groupBy("role", F.left("system_head", F.lit(40)).alias("head")).agg(F.count("*").alias("requests"), F.min_by("tools", "ordinal").alias("tools"))


def smoke_settings(log: DataFrame) -> DataFrame:
    """How often an agent used each set of sampling settings."""
    return log.groupBy("role", F.left("system_head", F.lit(40)).alias("head"), "enable_thinking", "thinking_token_budget", "max_tokens", "temperature", "top_k").agg(F.count("*").alias("requests"))


def smoke_counts(log: DataFrame) -> DataFrame:
    """what, value, n: counts of result encodings, of message roles of results, and of results with an error."""
    encoding = log.where("last_tool_encoding is not null").groupBy(F.col("last_tool_encoding").alias("value")).agg(F.count("*").alias("n")).select(F.lit("encoding").alias("what"), "value", "n")
    roles = log.select(F.explode("tool_result_roles").alias("value")).groupBy("value").agg(F.count("*").alias("n")).select(F.lit("role").alias("what"), "value", "n")
    errors = log.agg(F.count_if(F.col("last_tool_result").contains('"status": "error"')).alias("n")).select(F.lit("error").alias("what"), F.lit("error").alias("value"), "n")
    return encoding.union(roles).union(errors)


def scripted_answer(messages: Column, tools: Column, steps: Sequence[dict]) -> Column:
    """A scripted model's next step: struct tool, args, text, by the number of assistant messages with calls so far.

    Steps of undeclared tools are left out; behind the last step the answer is OK.
    """
    each = [F.struct(F.lit(s.get("tool")).cast("string").alias("tool"), F.lit(s.get("args", "{}") if "tool" in s else None).cast("string").alias("args"), F.lit(s.get("text")).cast("string").alias("text")) for s in steps]
    open_ = F.filter(F.array(*each), lambda s: s["tool"].isNull() | F.array_contains(tools, s["tool"]))
    done = F.size(F.filter(messages, lambda m: (m["role"] == "assistant") & (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0)))
    last = F.struct(F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("args"), F.lit("OK").alias("text"))
    return F.coalesce(F.get(open_, done), last)


def adapter_check(expected: DataFrame, header: DataFrame) -> DataFrame:
    """state and n of an adapter's tensors against the expected ones (name, shape)."""
    return joins.compare_keys(expected, header, "name", "shape").groupBy("state").agg(F.count("*").alias("n"))


def per_module(header: DataFrame) -> DataFrame:
    """How many adapter tensors each module has."""
    module = F.regexp_extract("name", r"\.(self_attn|mlp)\.(\w+)\.lora_", 2)
    return header.select(module.alias("module")).where("module <> ''").groupBy("module").agg(F.count("*").alias("n"))


def tensor_names(layers: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Names of the adapter tensors of layers (layer) and modules (name -> parent): two for each."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("parent"), F.lit(m).alias("module")) for m, p in targets.items())))
    ab = F.explode(F.array(F.lit("A"), F.lit("B")))
    return layers.select("layer", each.alias("t")).select("layer", "t.*", ab.alias("ab")).select(F.format_string("base_model.model.model.language_model.layers.%d.%s.%s.lora_%s.weight", "layer", "parent", "module", "ab").alias("name"))


def length_stats(rows: DataFrame, length: str) -> DataFrame:
    """tokens, max_len, median (cut to a whole number), and the shares up to 4,096 and 8,192, in one row."""
    n = F.col(length)
    return rows.agg(F.sum(n).alias("tokens"), F.max(n).alias("max_len"), F.floor(F.median(n)).cast("long").alias("p50_len"), F.round(F.avg((n <= 4096).cast("double")), 4).alias("share_le_4096"), F.round(F.avg((n <= 8192).cast("double")), 4).alias("share_le_8192"))


def trainable(windows: DataFrame, tokens: str, mask: str, most: int) -> DataFrame:
    """Windows of at most ``most`` tokens with a target among them."""
    return windows.where((F.size(tokens) <= most) & F.exists(mask, lambda x: x == 1))


def with_targets(windows: DataFrame, mask: str, largest: int) -> DataFrame:
    """Windows with a target behind the first of the ``largest`` tokens that a step holds."""
    return windows.where(F.exists(F.slice(mask, 2, largest - 1), lambda x: x == 1))


def target_counts(windows: DataFrame, tokens: str, mask: str) -> DataFrame:
    return windows.agg(F.sum(F.size(tokens)).cast("long").alias("tokens"), F.sum(F.aggregate(F.slice(mask, 2, 1 << 30), F.lit(0).cast("long"), lambda a, x: a + x)).alias("targets"), F.max(F.size(tokens)).alias("max_len"))


def shifted(tokens: str, mask: str, length: int) -> tuple[Column, Column, Column]:
    """inputs, targets and target mask of a step: cut or padded with 0 to ``length``, targets one ahead."""
    pad = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(0), length)), 1, length)
    ahead = lambda c: pad(F.slice(F.slice(F.col(c), 1, length), 2, length))
    return pad(F.col(tokens)), ahead(tokens), ahead(mask)


def tokenized(windows: DataFrame) -> DataFrame:
    """words and mask of windows' segments, by white space: every segment on its own, its flag for each of its words."""
    words = lambda s: F.filter(F.split(s["text"], r"(?U)\s+"), lambda w: w != "")
    return windows.select("*", F.flatten(F.transform("segments", words)).alias("words"), F.flatten(F.transform("segments", lambda s: F.array_repeat(s["train"], F.size(words(s))))).alias("mask"))


def epoch_plan(windows: DataFrame, key: str, length: str, buckets: Sequence[int], batch: int, epochs: int, seed: int) -> DataFrame:
    """epoch, bucket, step_in_bucket and full of every window, shuffled anew for each epoch: by 60 bits of a seeded MD5."""
    digest = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("epoch")).cast("string"), F.col(key).cast("string")))
    spread = F.shiftleft(F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long"), 3)  # an evenly spread long
    each = windows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("_s", spread)
    out = None
    for e in range(epochs):
        one = sequences.bucket_plan(each.where(F.col("epoch") == e), length, "_s", [key], buckets, batch)
        out = one if out is None else out.unionByName(one)
    return out.drop("_s")


def plan_stats(plan: DataFrame) -> DataFrame:
    """Steps of every epoch and bucket."""
    return plan.groupBy("epoch", "bucket").agg((F.max("step_in_bucket") + 1).alias("steps"))


def learning_rates(steps: DataFrame, step: str, peak: float, warmup: int, hold: int, horizon: int, floor: float) -> DataFrame:
    """Adds rate: linear warm-up, hold, then a cosine to floor * peak at ``horizon``."""
    s = F.col(step).cast("double")
    part = F.least(F.lit(1.0), (s - hold) / float(max(horizon - hold, 1)))
    return steps.withColumn("rate", F.when(s <= warmup, s * peak / float(max(warmup, 1))).when(s <= hold, F.lit(peak)).otherwise(F.lit(peak) * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * part)))))


def step_medians(steps: DataFrame, bucket: str, order: str, seconds: str) -> DataFrame:
    """The median step time of each bucket without its first step."""
    first = steps.groupBy(bucket).agg(F.min(order).alias("_first"))
    return steps.join(F.broadcast(first), bucket).where(F.col(order) > F.col("_first")).groupBy(bucket).agg(F.median(seconds).alias("median_s"))


def masked_mean(value: str, weight: str) -> Column:
    """The weighted mean with a weight of 1 at least: an aggregate."""
    return F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1.0))


def trailing_mean(df: DataFrame, order: str, value: str, rows: int, into: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.withColumn(into, F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)))


def horizon(step: Column, step_s: Column, ckpt_s: Column, left_s: Column, planned: int, every: int, batch: int) -> Column:
    """Where a schedule is to end: the steps that still fit in 97 % of the time left at the measured costs, never past the plan nor before now.

    ``step_s`` is the mean of the last steps (trailing_mean over 300), ``ckpt_s`` that of a checkpoint every ``every`` windows.
    """
    fit = F.floor(F.lit(0.97) * left_s / (step_s + F.lit(float(batch)) * ckpt_s / F.lit(float(every)))).cast("long")
    return F.greatest(F.least(F.lit(planned).cast("long"), step + F.greatest(fit, F.lit(0).cast("long"))), step)


def fitting_pairs(rows: DataFrame, prompt: str, completion: str, most: int, stops: int = 1) -> DataFrame:
    """Prompt and completion pairs of at most ``most`` tokens with the stop tokens behind, by words."""
    return rows.where(text.whitespace_tokens(F.col(prompt)) + text.whitespace_tokens(F.col(completion)) + stops <= most)


def numbers_digest(numbers: str, width: int = 4) -> Column:
    """The SHA-256 of an array of integers, each in ``width`` little-endian bytes."""
    byte = lambda x, i: F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0")
    return F.sha2(F.unhex(F.array_join(F.transform(numbers, lambda x: F.concat(*(byte(x.cast("int"), i) for i in range(width)))), "")), 256)


def manifest_mismatches(windows: DataFrame, manifest: DataFrame, tokens: str = "words", mask: str = "mask", first: int = 64) -> DataFrame:
    """row of the first windows whose digests of tokens (4 bytes each) or mask (1 byte) are not the manifest's (row, tokens_sha256, mask_sha256)."""
    own = windows.where(F.col("row") < first).select("row", numbers_digest(tokens).alias("_t"), numbers_digest(mask, 1).alias("_m"))
    return own.join(manifest, "row").where((F.col("_t") != F.col("tokens_sha256")) | (F.col("_m") != F.col("mask_sha256"))).select("row")


def first_that_fits(probes: DataFrame, order: str, fits: str) -> DataFrame:
    """The first configuration in order that fits."""
    return probes.where(F.col(fits)).orderBy(order).limit(1)


def best_candidate(candidates: DataFrame, loss: str, off: str) -> DataFrame:
    """The candidate of least loss, ties to the least distance."""
    return candidates.orderBy(loss, F.abs(off)).limit(1)


def validation_rows(rows: DataFrame, key: str, n: int = 64, seed: int = 0) -> DataFrame:
    """A seeded choice of ``n`` rows."""
    return rows.orderBy(selection.seeded_order(key, seed), key).limit(n)


def outcome_counts(rows: DataFrame, outcome: str) -> DataFrame:
    return rows.groupBy(outcome).agg(F.count("*").alias("n"))


def positional_mismatches(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Rows whose value differs from the other side's row of the same number."""
    return left.join(right.withColumnRenamed(value, "_other"), "row").where(~F.col(value).eqNullSafe(F.col("_other"))).select("row")


def fingerprints(files: DataFrame, known: dict[str, str]) -> DataFrame:
    """Adds label: the name of a file's known digest, else null. ``known`` is a short table of constants."""
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return files.withColumn("label", F.try_element_at(F.create_map(*pairs), F.col("sha256")) if pairs else F.lit(None).cast("string"))
