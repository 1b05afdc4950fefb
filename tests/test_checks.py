"""The small plans and functions around a run, each on a table of a few rows."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from trajecta.functions import requests, text
from trajecta.operators import joins, selection
from trajecta.plans import checks, scorer_time
from trajecta.sources import scans, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def value(spark, column, **fields):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in fields.items()), column.alias("_out")).first()["_out"]


def test_models_and_layers(spark):
    models = spark.createDataFrame([("base", None), ("lora", "base"), ("odd", "")], "id string, parent string")
    assert rows(checks.discovered(models)) == [("base", True), ("lora", False), ("odd", True)]
    names = [r[0] for r in checks.tensor_names(spark.createDataFrame([(3,)], "layer int"), {"q_proj": "self_attn"}).collect()]
    assert names == [f"base_model.model.model.language_model.layers.3.self_attn.q_proj.lora_{x}.weight" for x in "AB"]
    assert requests.module_pattern([1, 2], {"q_proj": "self_attn", "up_proj": "mlp"}) == r"model\.language_model\.layers\.(1|2)\.(self_attn\.(q_proj)|mlp\.(up_proj))"


def test_scripted_answers(spark):
    steps = [{"tool": "a", "args": '{"x": 1}'}, {"tool": "undeclared"}, {"text": "half"}]
    calls = "array<struct<role:string,tool_calls:array<string>>>"
    out = []
    for done in range(4):
        df = spark.createDataFrame([([("assistant", ["c"])] * done + [("assistant", None), ("tool", None)], ["a"])], f"messages {calls}, tools array<string>")
        out.append(tuple(df.select(checks.scripted_answer(F.col("messages"), F.col("tools"), steps).alias("s")).select("s.*").first()))
    assert out == [("a", '{"x": 1}', None), (None, None, "half"), (None, None, "OK"), (None, None, "OK")]


def test_training_rows(spark):
    w = spark.createDataFrame([(0, [5, 6, 7], [0, 1, 1]), (1, [5, 6], [0, 0]), (2, [1, 2, 3, 4, 5], [1, 0, 0, 0, 0]), (3, [9], [1])], "row long, words array<int>, mask array<int>")
    assert [r["row"] for r in checks.trainable(w, "words", "mask", 4).collect()] == [0, 3]
    assert [r["row"] for r in checks.with_targets(w, "mask", 5).collect()] == [0]
    assert tuple(checks.target_counts(w, "words", "mask").first()) == (11, 2, 5)
    x, y, m = checks.shifted("words", "mask", 4)
    assert tuple(w.where("row = 0").select(x, y, m).first()) == ([5, 6, 7, 0], [6, 7, 0, 0], [1, 1, 0, 0])
    assert tuple(w.where("row = 2").select(x, y, m).first()) == ([1, 2, 3, 4], [2, 3, 4, 0], [0, 0, 0, 0])
    seg = spark.createDataFrame([([("a b", 0), ("", 1), ("c", 1)],)], "segments array<struct<text:string,train:int>>")
    assert tuple(checks.tokenized(seg).select("words", "mask").first()) == (["a", "b", "c"], [0, 0, 1])
    digest = lambda xs, f: hashlib.sha256(b"".join(struct.pack(f, x) for x in xs)).hexdigest()
    manifest = spark.createDataFrame([(0, digest([5, 6, 7], "<i"), digest([0, 1, 1], "<b")), (1, digest([5, 6], "<i"), "other"), (2, "other", ""), (70, "", "")], "row long, tokens_sha256 string, mask_sha256 string")
    assert rows(checks.manifest_mismatches(w, manifest)) == [(1,), (2,)]
    assert rows(checks.manifest_mismatches(w, manifest, first=2)) == [(1,)]
    pairs = spark.createDataFrame([("a b", "c"), ("a b c", "d"), ("", "")], "prompt string, completion string")
    assert rows(checks.fitting_pairs(pairs, "prompt", "completion", 4)) == [("", ""), ("a b", "c")]


def test_choices(spark):
    probes = spark.createDataFrame([(1, False), (2, True), (3, True)], "n int, fits boolean")
    assert checks.first_that_fits(probes, "n", "fits").first()["n"] == 2
    found = spark.createDataFrame([("a", 0.5, -3.0), ("b", 0.5, 1.0), ("c", 0.9, 0.0)], "name string, loss double, off double")
    assert checks.best_candidate(found, "loss", "off").first()["name"] == "b"
    some = checks.validation_rows(spark.range(500), "id", 10, 1)
    assert rows(some) == rows(checks.validation_rows(spark.range(500).repartition(7), "id", 10, 1)) and rows(some) != rows(checks.validation_rows(spark.range(500), "id", 10, 2))
    left, right = (spark.createDataFrame(list(enumerate(x)), "row int, value string") for x in (["a", "b", None, "d"], ["a", "x", None, None]))
    assert rows(checks.positional_mismatches(left, right, "value")) == [(1,), (3,)]
    assert rows(joins.unknown_ids(spark.createDataFrame([(1,), (2,), (2,)], "id int"), spark.createDataFrame([(1,)], "id int"), "id")) == [(2,)]


@pytest.mark.parametrize("step, t, ckpt, left, want", [(10, 2.0, 50.0, 1000.0, 200), (10, 2.0, 50.0, 100.0, 34), (10, 2.0, 50.0, -5.0, 10), (250, 2.0, 50.0, 1000.0, 250)])
def test_horizon(spark, step, t, ckpt, left, want):
    assert value(spark, checks.horizon(F.lit(step).cast("long"), F.lit(t), F.lit(ckpt), F.lit(left), 200, 50, 2)) == (want if want != 34 else 10 + int(0.97 * 100 / 4))


def test_arms_come_as_first_seen(spark):
    found = spark.createDataFrame([(3, "b", 60.0, True), (1, "z", 120.0, False), (5, "b", 60.0, False)], "ordinal long, arm string, est_s double, resolved boolean")
    assert [(r["arm"], r["tasks"]) for r in scorer_time.projection(found, ["arm"], order="ordinal").collect()] == [("z", 1), ("b", 2)]


def test_request_bodies(spark):
    assert value(spark, requests.requested_output(F.lit(None).cast("int"), F.lit(7))) == 7 and value(spark, requests.requested_output(F.lit(3), F.lit(7))) == 3
    body = F.create_map(*map(F.lit, ["n", "4", "stream", "true", "messages", "[]", "temperature", "1.0"]))
    assert value(spark, requests.control_body(body, "m", 16, False)) == {"messages": "[]", "model": '"m"', "temperature": "0.0", "max_tokens": "16"}
    assert value(spark, requests.control_body(body, "m", 16, True))["top_logprobs"] == "5"
    assert value(spark, requests.is_agent_tool(F.array(F.lit("request")))) and not value(spark, requests.is_agent_tool(F.array(F.lit("a"), F.lit("request"))))
    assert json.loads(value(spark, requests.wrapped_result(F.lit('{"a": 1}'), "double"))) == {"result": '{"a": 1}'} and value(spark, requests.wrapped_result(F.lit("x"), "single")) == "x"
    assert json.loads(value(spark, requests.error_body(F.lit("no"), F.lit(400), F.lit("max_tokens"))))["error"] == {"message": "no", "type": "BadRequestError", "param": "max_tokens", "code": 400}
    assert json.loads(value(spark, requests.error_body(F.lit("no"), F.lit(500), F.lit("max_tokens"))))["error"]["param"] is None


def test_normalized_tools_and_messages(spark):
    from trajecta import schema

    df = spark.createDataFrame([([(None, ("f", None, '{"type": "object"}')), ("function", ("g", "d", None))],), (None,)], f"tools {schema.TOOLS}").select(requests.normalized_tools(F.col("tools")).alias("t"))
    told, none = [r["t"] for r in df.collect()]
    assert none is None and json.loads(told) == [{"type": "function", "function": {"name": "f", "description": None, "parameters": {"type": "object"}}}, {"type": "function", "function": {"name": "g", "description": "d", "parameters": None}}]
    message = lambda role, calls=None, reasoning="r": (role, "c", reasoning, "id", None, calls)
    call = lambda args: [("1", "function", ("f", args))]
    given = [[message("user"), message("assistant", call("")), message("tool"), message("assistant", [])], [message("assistant", call("{bad"))], []]
    out = spark.createDataFrame([(m,) for m in given], f"m array<{schema.MESSAGE}>").select(requests.rebuilt(F.col("m")).alias("x")).select("x.*").collect()
    assert [r["error"] for r in out] == [None, "arguments are no JSON: {bad", None]
    kept = out[0]["messages"]
    assert [m["tool_call_id"] for m in kept] == [None, None, "id", None] and [m["reasoning"] for m in kept] == [None, "r", None, "r"]
    assert kept[1]["tool_calls"][0]["function"]["arguments"] == "{}" and kept[3]["tool_calls"] is None and out[1]["messages"] is None


def test_content_parts(spark):
    parts = '[{"type": "text", "text": "a"}, {"type": "image"}, {"text": "b"}]'
    system = lambda c: F.array(F.struct(F.lit("system").alias("role"), F.lit(c).alias("content")))
    assert value(spark, text.system_text(system(parts))) == "a  b" and value(spark, text.system_text(system(parts), "")) == "ab"
    assert value(spark, text.system_text(system("[plain] text"))) == "[plain] text" and value(spark, text.system_text(system("[1, 2]"))) == "[1, 2]"
    kinds = [('"not json"', "raw"), ('"{\\"result\\": \\"{}\\"}"', "double"), ('"{\\"a\\": 1}"', "single"), ("[1]", "parts"), ('{"a": 1}', "other"), ("null", "other")]
    assert [value(spark, text.variant_encoding(F.parse_json(F.lit(v)))) for v, _ in kinds] == [k for _, k in kinds]


def test_budget_fold_agrees_with_the_machine(spark):
    for start, end in ((100, 101), ((100, 7), (101, 8, 9))):
        for proposals in ([100, 7, 1, 2, 3, 4], [1, 100, 7, 5, 101, 8, 9, 6, 100, 7, 1, 1, 1, 1]):
            s, e = ((start,), (end,)) if isinstance(start, int) else (start, end)
            machine = requests.Budget(2, s, e)
            assert value(spark, requests.budgeted(F.array(*map(F.lit, proposals)), 2, start, end)) == [machine.step(t) for t in proposals]
    inside = requests.Budget.after([100, 1], 2)
    assert value(spark, requests.budgeted(F.array(*map(F.lit, [5, 6, 7])), 2, inside=F.lit(True), spent=F.lit(1))) == [inside.step(t) for t in (5, 6, 7)] == [5, 101, 7]


def test_sampling(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "ctx long, prompt string")
    out = joins.sampled(asked, lambda row: {"ctx": row["ctx"], "text": row["prompt"].upper()}, "ctx long, text string")
    assert rows(out) == [(1, "A"), (2, "B")]


def test_replay_from_contexts_to_rates(spark, tmp_path):
    from trajecta.plans import replay

    call = lambda args: {"id": "1", "type": "function", "function": {"name": "f", "arguments": args}}
    body = lambda i: {"messages": [{"role": "system", "content": "Be brief."}, {"role": "user", "content": f"q{i}"}, {"role": "assistant", "tool_calls": [call('{"i": %d}' % i)]}], "tools": [{"type": "function", "function": {"name": "f"}}]}
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"status": 200, "body": body(i)}) for i in range(4)))
    contexts = scans.contexts(spark, str(tmp_path / "log.jsonl"))

    def sampler(row):
        hot = json.loads(row["overrides"]).get("temperature", 0) > 0
        named = "g" if hot and row["k"] else "f"
        return {"ctx": row["ctx"], "cond": row["cond"], "k": row["k"], "raw": None, "content": row["system"], "calls": [{"name": named, "arguments": row["prev_call"]["arguments"]}], "finish": "stop", "completion_tokens": 10 + 5 * hot}

    conditions = [requests.parse_condition("orig="), requests.parse_condition("hot=temp:0.6")]
    found = replay.sampled_records(contexts, conditions, 2, sampler, ["unknown_tool", "exact_repeat", "completion_tokens"]).cache()
    assert found.count() == 16
    rates = {(r["cond"], r["metric"]): (r["n"], r["hits"], r["mean"]) for r in replay.rates(found, ["unknown_tool", "exact_repeat", "completion_tokens"]).collect()}
    assert rates["orig", "unknown_tool"] == (8, 0, 0.0) and rates["hot", "unknown_tool"] == (8, 4, 0.5) and rates["orig", "exact_repeat"] == (8, 8, 1.0) and rates["hot", "completion_tokens"] == (8, None, 15.0)
    pairs = {r["metric"]: (r["lower"], r["higher"], r["tied"]) for r in replay.paired(found, ["unknown_tool", "completion_tokens"], "orig").collect()}
    assert pairs == {"unknown_tool": (0, 4, 0), "completion_tokens": (0, 4, 0)}


def test_numbering_has_no_favourites(spark):
    values = [(i, float(i % 7)) for i in range(300)] + [(300, 1e300), (301, -1e300), (302, float("inf"))]
    df = spark.createDataFrame(values, "i long, v double")
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(values, key=lambda x: (-x[1], x[0])))}
    assert {r["i"]: r["pick"] for r in selection.numbered(df, "v", ["i"], "pick").collect()} == want
    assert selection.numbered(df.limit(0), "v", ["i"], "pick").count() == 0
    import statistics

    finite = df.where("i < 302")
    got = {r["p"]: r["value"] for r in selection.nearest_rank(finite, "v").collect()}
    ordered = sorted(v for i, v in values if i < 302)
    assert got == {p: ordered[round((len(ordered) - 1) * p / 100)] for p in (0, 10, 25, 50, 75, 90, 100)} and statistics.median(ordered) == got[50]
    assert selection.nearest_rank(df.limit(0), "v").count() == 0


def test_sinks_part_their_rows(spark, tmp_path):
    sinks.by_adapter(spark.createDataFrame([("a", 1), ("b", 2)], "adapter string, n int"), str(tmp_path / "x"))
    assert rows(spark.read.json(str(tmp_path / "x")).select("adapter", "n")) == [("a", 1), ("b", 2)]
    sinks.windows(spark.createDataFrame([(f"i{n}",) for n in range(200)], "instance_id string"), str(tmp_path / "w"), 0.2)
    split = {r["split"]: r["n"] for r in spark.read.json(str(tmp_path / "w")).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert split["train"] + split["valid"] == 200 and 10 < split["valid"] < 80


def test_lines_and_requests_in_the_jvm(spark, tmp_path):
    lines = [json.dumps({"t": 1.0, "status": 200, "body": {"messages": [{"role": "user", "content": f"q{i}"}]}, "raw": "r"}) for i in range(300)]
    (tmp_path / "b.jsonl").write_text("\n".join(lines[:200]) + "\n\n")
    (tmp_path / "a.jsonl").write_text("\n".join([*lines[200:], json.dumps({"model": "m", "messages": [{"role": "user", "content": "bare"}]}), json.dumps({"status": 500, "body": {"messages": [{"role": "user"}]}}), json.dumps({"body": {"messages": []}})]))
    paths = [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")]
    found = scans.contexts(spark, paths).orderBy("ordinal").collect()
    assert [r["body"]["messages"][0]["content"] for r in found] == [f"q{i}" for i in range(300)] + ["bare"] and found[-1]["raw"] is None and found[0]["raw"] == "r"
    plan = scans.contexts(spark, paths)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan.replace("Scan ExistingRDD[_path", "")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1048576")
    try:
        (tmp_path / "long.txt").write_text("".join(f"{i:06d} {'x' * 90}\n" for i in range(50_000)))  # five splits
        got = scans.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert got.rdd.getNumPartitions() > 2 and got.where(F.col("row") != F.left("value", F.lit(6)).cast("long")).count() == 0 and got.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, n in (("b", 25), ("a", 10), ("c", 3)):
        pq.write_table(pa.table({"x": [f"{name}{i}" for i in range(n)]}), tmp_path / f"{name}.parquet", row_group_size=10)
    every = scans.parquet_ordered(spark, str(tmp_path))
    take = lambda lo, hi: [r["x"] for r in scans.row_groups(every, scans.group_ranges(spark, str(tmp_path), lo, hi)).orderBy("ordinal").collect()]
    assert take(1, 1) == [f"b{i}" for i in range(10, 20)] and take(0, 0) == [f"a{i}" for i in range(10)] + [f"b{i}" for i in range(10)] + [f"c{i}" for i in range(3)] and take(2, 9) == [f"b{i}" for i in range(20, 25)]


def test_a_header_is_read_without_its_tensors(spark, tmp_path):
    head = json.dumps({"__metadata__": {}, "w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 24)
    assert [tuple(r) for r in scans.safetensors_header(spark, str(tmp_path / "m.safetensors")).collect()] == [("w", "F32", [2, 3])]
    (tmp_path / "lines.txt").write_bytes(b"a\nb\n\xff\nlast")
    found = {r["name"]: (r["bytes"], r["lines"]) for r in scans.file_manifest(spark, str(tmp_path)).collect()}
    assert found["lines.txt"] == (10, 3)
