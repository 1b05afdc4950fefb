"""Whole plans on small trajectories and logs."""

import json

from pyspark.sql import functions as F

from trajecta import schema
from trajecta.operators.convert import Limits, convert, convert_row, reasons
from trajecta.operators.windows import pack, spans
from trajecta.plans import checks, curate, logstats, scorer_time
from trajecta.sources import scans, sinks
from trajecta.streaming import log_stream


def call(i, name, **args):
    return {"id": i, "type": "function", "function": {"name": name, "arguments": json.dumps(args)}}


def raw(instance="a", resolved=1, steps=(), finish=True):
    messages = [{"role": "user", "content": "<uploaded_files>\n/workspace/r__1\n</uploaded_files>\n<issue_description>\nfix it\n</issue_description>"}]
    for n, (name, args, seen, said) in enumerate(steps):
        messages.append({"role": "assistant", "content": said, "tool_calls": [call(f"c{n}", name, **args)]})
        if seen is not None:
            messages.append({"role": "tool", "tool_call_id": f"c{n}", "content": seen})
    if finish:
        messages.append({"role": "assistant", "content": "", "tool_calls": [call("end", "finish")]})
    return {"instance_id": instance, "repo": "r", "resolved": resolved, "trajectory": messages, "model_patch": "diff --git a/x.py b/x.py\n+1\n"}


VIEW = "Here's the result of running `cat -n` on /workspace/r__1/x.py:\n     1\ta\n     2\tb\n     3\tc\n"
EDIT = "The file /workspace/r__1/x.py has been edited. Here's the result of running `cat -n` on a snippet of /workspace/r__1/x.py:\n     4\tp\n     5\tq\n     6\tnew\n     7\tr\nReview the changes"


def test_converter_steps():
    steps = [
        ("think", {"thought": "hmm"}, None, "First."),
        ("str_replace_editor", {"command": "view", "path": "/workspace/r__1/x.py"}, VIEW, ""),
        ("str_replace_editor", {"command": "create", "path": "/workspace/r__1/t.py", "file_text": "print(1)"}, "File created successfully at: /workspace/r__1/t.py", ""),
        ("execute_bash", {"command": "cd /workspace/r__1 && python t.py"}, "boom\n[The command completed with exit code 1.]", ""),
        ("str_replace_editor", {"command": "str_replace", "path": "/workspace/r__1/x.py", "old_str": "old", "new_str": "new"}, EDIT, "Now edit."),
    ]
    out, why = convert_row(raw(steps=steps))
    assert why is None and out["n_turns"] == 5 and out["issue"] == "fix it"
    names = [c["function"]["name"] for m in out["messages"] for c in m.get("tool_calls") or []]
    assert names == ["read_file", "run_command", "run_command", "edit_file", "submit_patch"]
    assert out["messages"][0]["reasoning"] == "First.\n\nhmm"
    results = [json.loads(m["content"]) for m in out["messages"] if m["role"] == "tool"]
    assert results[0]["content"] == "a\nb\nc" and results[0]["end_line"] == 3
    args = [json.loads(c["function"]["arguments"]) for m in out["messages"] for c in m.get("tool_calls") or []]
    assert args[1]["command"] == "cat > /tmp/t.py <<'EOF'\nprint(1)\nEOF" and args[2]["command"] == "cd /workspace && python /tmp/t.py"
    assert results[2]["details"]["exit_code"] == 1
    assert "@@ -4,4 +4,4 @@" in results[3]["diff"] and "-old\n+new\n" in results[3]["diff"]
    assert results[4] == {"status": "ok", "patch_size": 28, "files_changed": 1}
    assert [m.get("tool_call_id") for m in out["messages"] if m["role"] == "tool"][:2] == ["call_0_0", "call_2_0"]


def test_converter_reasons():
    step = lambda name, args, seen="x": [(name, args, seen, "")]
    cases = [
        (raw(steps=step("str_replace_editor", {"command": "undo_edit", "path": "p"})), "undo_edit"), (raw(steps=step("browse", {})), "tool_browse"), (raw(steps=step("execute_bash", {"command": "x"}, None)), "missing_obs"),
        (raw(finish=False), "no_finish"), (raw(steps=step("execute_bash", {"command": "x", "is_input": "true"})), "is_input"), (raw(steps=step("execute_bash", {"command": "x"}, "it timed out")), "bash_timeout"),
        (raw(steps=step("str_replace_editor", {"command": "view", "path": "/etc/x"}, VIEW)), "path_outside_repo"), ({**raw(), "trajectory": [{"role": "user", "content": "hi"}]}, "no_workspace"),
    ]
    assert [convert_row(r)[1] for r, _ in cases] == [w for _, w in cases]
    view = raw(steps=step("str_replace_editor", {"command": "view", "path": "/workspace/r__1/x.py"}, VIEW))
    out, _ = convert_row(view, Limits(lines=1))
    assert sum(m["role"] == "tool" for m in out["messages"]) == 4
    longer = raw(steps=step("str_replace_editor", {"command": "view", "path": "/workspace/r__1/x.py"}, VIEW + "     4\td\n"))
    assert convert_row(longer, Limits(lines=1))[1] == "view_cap"
    big = raw(steps=step("execute_bash", {"command": "ls"}, "\n".join(f"line {i}" for i in range(2000))))
    out, _ = convert_row(big)
    assert json.loads(out["messages"][0]["tool_calls"][0]["function"]["arguments"])["command"].startswith("ls 2>&1 | tail -n ")


def test_malformed_rows_have_a_reason():
    view = lambda span: raw(steps=[("str_replace_editor", {"command": "view", "path": "/workspace/r__1/x.py", "view_range": span}, VIEW, "")])
    for row in (view(["a", "b"]), view([1]), view(7), raw(steps=[("execute_bash", {}, "x", "")]), raw(steps=[("think", {"thought": 5}, None, "")]), {"trajectory": None}, {"instance_id": "i"}, {**raw(), "trajectory": [{"content": "no role"}]}):
        assert convert_row(row) == (None, "malformed_row")
    bad = raw(steps=[("execute_bash", {"command": "x"}, "x", "")])
    bad["trajectory"][1]["tool_calls"][0]["function"]["arguments"] = "{no"
    assert convert_row(bad) == (None, "badjson")


def test_scratch_files_move_from_where_they_are_made():
    made = "File created successfully at: /workspace/r__1/t.py"
    steps = [
        ("execute_bash", {"command": "python t.py"}, "t.py", ""), ("str_replace_editor", {"command": "create", "path": "/workspace/r__1/t.py", "file_text": "EOF\n\nEOF\n"}, made, "make t.py"),
        ("execute_bash", {"command": "python /workspace/r__1/t.py at.py t.pyc"}, "ran t.py", ""), ("str_replace_editor", {"command": "create", "path": "/workspace/r__1/x.py", "file_text": "import t.py"}, made, ""),
    ]
    out, why = convert_row(raw(steps=steps))
    assert why is None
    said = [json.loads(c["function"]["arguments"]) for m in out["messages"] for c in m.get("tool_calls") or []]
    assert [a.get("command") for a in said[:3]] == ["python t.py", "cat > /tmp/t.py <<'PYEOF'\nEOF\n\nEOF\n\nPYEOF", "python /tmp/t.py at.py t.pyc"]
    assert said[3] == {"filepath": "x.py", "content": "import /tmp/t.py"} and out["messages"][2]["reasoning"] == "make /tmp/t.py"


def test_convert_table_and_cap(spark):
    given = [raw("a"), raw("a", 0), raw("a"), raw("a"), raw("b", finish=False)]
    df = spark.createDataFrame([json.dumps({"ordinal": i, **r}) for i, r in enumerate(given)], "string").select(F.from_json("value", f"ordinal long, {schema.RAW_TRAJECTORY}").alias("v")).select("v.*")
    out = convert(df)
    assert [r["reason"] for r in out.orderBy("ordinal").collect()] == [None, "unresolved", None, "per_instance", "no_finish"]
    assert reasons(out).count() == 3


def test_pack_cases():
    seg = lambda flags: [("h " * 10, 0), ("t " * 6, flags[0]), ("c " * 4, 0), ("t " * 6, flags[1]), ("c " * 4, 0), ("t " * 5, flags[2])]
    out = pack(seg((1, 1, 1)), most=30)
    assert ([[f for _, f in w] for w, _ in out], [n for _, n in out]) == ([[0, 1, 0, 1], [0, 0, 0, 1]], [2, 1])
    assert pack(seg((1, 1, 1)), most=12) == []
    assert [[f for _, f in w] for w, _ in pack(seg((0, 0, 1)), most=30)] == [[0, 0, 0, 1]]


def test_spans_tile_the_conversation():
    from trajecta.functions.requests import render

    out, _ = convert_row(raw(steps=[("execute_bash", {"command": "ls"}, "x\n[The command completed with exit code 0.]", "go")]))
    messages = [{"role": "system", "content": "S"}, {"role": "user", "content": "U"}, *out["messages"]]
    for thinking in (True, False):
        parts = spans(messages, thinking=thinking)
        whole = render(messages, thinking=thinking, prompt=False)
        joined = "".join(t for t, _ in parts)
        assert joined == (whole if thinking else whole.replace("<|turn>model\n", "<|turn>model\n<|channel>thought\n<channel|>", 1))
        assert [f for _, f in parts][:4] == [0, 1, 0, 1]


def conversation(ordinal, steps, repo="r"):
    messages = []
    for n, (name, args, result, reason) in enumerate(steps):
        messages += [{"role": "assistant", "reasoning": reason, "tool_calls": [call(f"k{n}", name, **args)]}, {"role": "tool", "tool_call_id": f"k{n}", "name": name, "content": json.dumps(result)}]
    return {"ordinal": ordinal, "instance_id": f"i{ordinal}", "repo": repo, "issue": "x", "n_turns": len(steps), "messages": messages}


def table(spark, conversations):
    return spark.createDataFrame([json.dumps(c) for c in conversations], "string").select(F.from_json("value", f"ordinal long, {schema.CONVERSATION}").alias("v")).select("v.*")


OK = {"status": "ok", "stdout": "x"}
BAD = {"status": "error", "error_message": "no"}
#: Looks at the bug, reads what it edits, runs the tests, and submits.
CLEAN = [
    ("run_command", {"command": "python tools/show_bug.py"}, OK, None), ("read_file", {"filepath": "lib/m.py"}, OK, None), ("edit_file", {"filepath": "lib/m.py"}, OK, None),
    ("run_command", {"command": "tox -e unit"}, OK, None), ("submit_patch", {}, {"status": "ok", "patch_size": 29, "files_changed": 1}, None),
]
#: Edits unread and in vain, twice; fetches what it must not, thinks long, looks twice at one thing.
SLOPPY = [
    ("edit_file", {"filepath": "notes.py"}, BAD, None), ("edit_file", {"filepath": "notes.py"}, BAD, None), ("run_command", {"command": "wget http://example.org/x"}, OK, "z" * 2001),
    ("run_command", {"command": "git status"}, OK, None), ("run_command", {"command": "git status"}, OK, None), ("submit_patch", {}, {"status": "ok", "patch_size": 1, "files_changed": 0}, None),
]
PATCH = "diff --git a/lib/m.py b/lib/m.py"


def test_curation(spark):
    convs = table(spark, [conversation(0, CLEAN), conversation(1, SLOPPY)])
    patches = spark.createDataFrame([(0, PATCH + "\n+1\n-2\n"), (1, None)], "ordinal long, patch string")
    a, b = curate.features(convs, patches).orderBy("ordinal").collect()
    assert abs(a["score"] - 1.0) < 1e-9 and a["patch_stats"]["src_changed"] == 2
    assert (b["tool_errors"], b["forbidden"], b["failed_retries"], b["redundant"], b["long_thoughts"], b["f_patch"]) == (2, 1, 1, 1, 1, 0.0)
    assert b["score"] < 0.5 and b["f_errors"] == 0.0


def test_normalize(spark):
    ls = {"command": "find ."}
    steps = [("run_command", ls, {"status": "ok", "stdout": "a"}, "Look."), ("run_command", ls, {"status": "ok", "stdout": "a\nb"}, "Deeper."), ("run_command", ls, {"status": "ok", "stdout": "a\nb"}, None), ("submit_patch", {}, OK, None)]
    row = curate.normalize(table(spark, [conversation(0, steps)])).first()
    assert (row["dropped"], row["n_turns"]) == (2, 2)
    assert row["messages"][0]["reasoning"] == "Look.\n\nDeeper." and json.loads(row["messages"][1]["content"])["stdout"] == "a\nb"


def test_matched_patches_and_choice(spark):
    convs = table(spark, [conversation(0, CLEAN)])
    source = spark.createDataFrame([(0, "i0", 1, "x"), (1, "i0", 1, PATCH[:29]), (2, "i0", 0, PATCH)], "ordinal long, instance_id string, resolved int, model_patch string")
    assert curate.matched_patches(convs, source).first()["patch"] == PATCH[:29]
    scores = spark.createDataFrame([(i, f"i{i}", "r", True, 1.0 - i / 10) for i in range(4)], "ordinal long, instance_id string, repo string, patch_matched boolean, score double")
    out = curate.choose(scores, 0.5).orderBy("ordinal").collect()
    assert [r["kept"] for r in out] == [True, True, False, False]
    assert curate.summary(curate.choose(scores, 0.5)).first()["kept"] == 2


def test_the_report_of_a_choice(spark):
    convs = table(spark, [conversation(i, CLEAN if i % 2 else SLOPPY, f"r{i // 4}") for i in range(8)])
    patches = spark.createDataFrame([(i, PATCH) for i in range(7)], "ordinal long, patch string")
    chosen = curate.choose(curate.features(curate.normalize(convs), patches), 0.5, 2, exclude=["r9"]).cache()
    told = curate.report(chosen, {"keep": 0.5}, 2)
    json.dumps(told)
    counts = told["counts"]
    kept = [r["repo"] for r in chosen.where("kept").collect()]
    assert told["params"] == {"keep": 0.5} and (counts["input"], counts["eligible"], counts["unmatched"], counts["excluded"], counts["target"]) == (8, 7, 1, 0, 4)
    assert counts["kept"] == len(kept) == 4 and counts["repos_at_cap"] == 2 and told["repos_kept_histogram"] == {2: 2} and counts["repos_eligible"] == 2
    assert set(told["score"]) == {"eligible", "kept", "rejected", "kept_min"} and told["score"]["kept_min"] == told["score"]["kept"]["0"] and set(told["raw_means"]) == set(curate.RAW)
    assert told["feature_means"]["order"]["kept"] >= told["feature_means"]["order"]["rejected"] and told["patch"]["kept_edits_existing_test"] + 0 <= 4


def entry(key, n_calls, name="run_command", raw_="", status=200, error=None, result="fine"):
    messages = [{"role": "system", "content": "You are a coder.\nMore"}, {"role": "user", "content": key}]
    for i in range(n_calls):
        messages += [{"role": "assistant", "tool_calls": [call(f"c{i}", name, command="ls")]}, {"role": "tool", "tool_call_id": f"c{i}", "content": result}]
    tools = [{"type": "function", "function": {"name": "run_command"}}]
    return {"t": 1.0, "status": status, "body": {"model": "m", "messages": messages, "tools": tools}, "raw": raw_, "error": error}


def test_log_statistics(spark, tmp_path):
    log = [entry("one", n) for n in range(1, 13)] + [entry("two", 1, "edit_file", result='{"status": "error", "m": "Not found"}'), entry("two", 0, raw_="<|tool_call>call:grep x{}<tool_call|>"), entry("two", 0, status=400, error="Context too long")]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in log) + "\n\n")
    scan = scans.request_log(spark, str(path))
    report = logstats.session_report(scan, [("coder", "coder")]).orderBy("first_at").collect()
    assert [(r["role"], r["key"], r["requests"], r["longest_run"], r["most_repeated"]) for r in report] == [("coder", "one", 12, 12, 12), ("coder", "two", 3, 1, 1)]
    assert (report[1]["edit_not_found"], report[1]["malformed"], report[1]["unparsed"], report[1]["overflow"]) == (1, 1, 1, 1)
    roles = logstats.role_report(logstats.session_report(scan)).first()
    assert (roles["role"], roles["sessions"], roles["loops"]) == ("You are a coder.", 2, 1)
    assert scans.contexts(spark, str(path)).count() == 14
    assert scans.tools_from_log(scan, ["run_command"]).count() == 1


def test_scorer_time(spark):
    tasks = spark.createDataFrame([("t1", 100.0, 200.0, 100.0, True), ("t2", None, 502.0, 102.0, False)], "id string, started_at double, ended_at double, wall_s double, resolved boolean")
    calls = spark.createDataFrame([(99.0, 20.0, None, 102, True), (150.0, 30.0, 200, 51, False), (160.0, 9.0, 400, 999, False), (300.0, 1.0, 200, 10, False), (499.0, 10.0, 200, 0, False)], "t double, dt double, status int, completion_tokens int, enable_thinking boolean")
    a, b = scorer_time.estimates(tasks, calls, ["id"], slot=60.0).orderBy("id").collect()
    assert (a["n_calls"], a["n_thinking"], a["completion_tokens"]) == (2, 1, 153)
    assert abs(a["llm_est_s"] - 7.2) < 1e-9 and abs(a["tool_s"] - 50) < 1e-9 and abs(a["est_s"] - 57.2) < 1e-9
    assert (b["lo"], b["hi"]) == (398.0, 504.0) and b["n_calls"] == 1
    capped = scorer_time.estimates(tasks, calls, ["id"], cap_s=60.0)
    assert sorted(round(r["est_s"], 1) for r in capped.collect()) == [57.2, 60.0]
    assert abs(scorer_time.projection(capped).first()["hours"] - ((57.2 + 60.0) / 2 + 60) * 120 / 3600) < 1e-9


def test_adapter_verdicts(spark):
    rows = spark.createDataFrame([("a", True), ("a", None), ("b", None), ("c", False), ("c", None)], "adapter string, differs boolean")
    assert sorted(tuple(r) for r in checks.adapter_verdicts(rows).collect()) == [("a", True, ""), ("b", False, "requests failed"), ("c", False, "logits unchanged")]


def test_resumable_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert sinks.append_new(rows, str(tmp_path / "r"), "id") == 2
    assert sinks.append_new(rows.union(spark.createDataFrame([("c", 3)], "id string, v int")), str(tmp_path / "r"), "id") == 1


def test_log_stream_routes_and_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(x) for x in [entry("one", 1, raw_="fine"), entry("one", 2, raw_="<|tool_call>call:grep x{}<tool_call|>")]))
    log_stream.route(log_stream.log_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out/summary")).count() == 2
    assert spark.read.json(str(tmp_path / "out/suspect")).count() == 1
    q = log_stream.running_sessions(log_stream.log_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    row = spark.table("running").first()
    assert (row["requests"], row["longest"]) == (2, 6)


def test_parquet_order_and_headers(spark, tmp_path):
    import struct

    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p/a"))
    spark.range(5, 8).coalesce(1).write.parquet(str(tmp_path / "p/b"))
    out = scans.parquet_ordered(spark, str(tmp_path / "p"), ["id"]).orderBy("ordinal").collect()
    assert [r["id"] for r in out] == list(range(8))
    header = json.dumps({"__metadata__": {}, "x": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "a.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + bytes(24))
    t = scans.safetensors_header(spark, str(tmp_path / "a.safetensors")).first()
    assert (t["name"], t["dtype"], t["shape"]) == ("x", "F32", [2, 3])
    m = scans.file_manifest(spark, str(tmp_path / "a.safetensors")).first()
    assert m["bytes"] == 8 + len(header) + 24
