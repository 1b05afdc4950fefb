"""Event-time parts of the stream: idle sessions and attribution of calls to tasks."""

import json

from trajecta.streaming import log_stream


def write(path, rows):
    path.mkdir(parents=True)
    (path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def run(df, name, mode="append"):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(180)
    return df.sparkSession.table(name)


def test_idle_sessions(spark, tmp_path):
    at = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00"
    path = write(tmp_path / "c", [{"user": "u", "at": at(m)} for m in (0, 10, 35, 90, 95)] + [{"user": "v", "at": at(600)}])
    calls = spark.readStream.schema("user string, at timestamp").json(path)
    out = run(log_stream.idle_sessions(calls, "user"), "idle", "complete")
    assert sorted((r["user"], r["calls"]) for r in out.collect()) == [("u", 2), ("u", 3), ("v", 1)]


def test_calls_are_attributed_with_slack(spark, tmp_path):
    calls = spark.readStream.schema("id string, at timestamp").json(write(tmp_path / "c", [{"id": x, "at": f"2024-01-01T00:00:{s:02d}"} for x, s in (("early", 7), ("in", 20), ("edge", 32), ("late", 33))]))
    tasks = spark.readStream.schema("task string, started timestamp, ended timestamp").json(write(tmp_path / "t", [{"task": "t", "started": "2024-01-01T00:00:10", "ended": "2024-01-01T00:00:30"}]))
    out = run(log_stream.attributed(calls, tasks), "attributed")
    assert sorted(r["id"] for r in out.collect()) == ["edge", "in"]


def test_roles_are_counted(spark, tmp_path):
    body = {"messages": [{"role": "system", "content": "Coder"}, {"role": "user", "content": "x"}]}
    log = log_stream.log_stream(spark, write(tmp_path / "l", [{"t": 1.0, "status": 200, "body": body}] * 3))
    assert [(r["role"], r["requests"]) for r in run(log_stream.running_roles(log), "roles", "complete").collect()] == [("Coder", 3)]


def test_calls_of_long_tasks_are_attributed(spark, tmp_path):
    calls = spark.readStream.schema("id string, at timestamp").json(write(tmp_path / "c", [{"id": x, "at": f"2024-01-01T{h:02d}:30:00"} for x, h in (("first", 0), ("third", 3), ("behind", 6))]))
    tasks = spark.readStream.schema("task string, started timestamp, ended timestamp").json(write(tmp_path / "t", [{"task": "t", "started": "2024-01-01T00:00:10", "ended": "2024-01-01T05:00:00"}]))
    out = run(log_stream.attributed(calls, tasks), "attributed_long")
    assert sorted(r["id"] for r in out.collect()) == ["first", "third"]


def test_budgets_are_kept_between_batches(spark, tmp_path):
    from trajecta.functions.requests import Budget

    proposals = {"a": [100, 1, 2, 3, 4, 100, 5], "b": [1, 100, 2, 101, 3]}
    path = write(tmp_path / "p", [{"request": r, "seq": i, "token": t} for r, ts in proposals.items() for i, t in enumerate(ts) if i < 3])
    (tmp_path / "p" / "b.json").write_text("\n".join(json.dumps({"request": r, "seq": i, "token": t}) for r, ts in proposals.items() for i, t in enumerate(ts) if i >= 3))
    tokens = spark.readStream.schema("request string, seq long, token int").option("maxFilesPerTrigger", 1).json(path)
    out: dict = {}
    for r in run(log_stream.budgeted(tokens, 2), "budgets").orderBy("request", "seq").collect():
        out.setdefault(r["request"], []).append(r["token"])
    for name, given in proposals.items():
        machine = Budget(2)
        assert out[name] == [machine.step(t) for t in given]
