"""Rendering with masks, request files of any shape, and the command line."""

import json

import pytest

from test_plans import BAD, CLEAN, OK, conversation, entry, raw, table
from trajecta import __main__ as cli
from trajecta.functions import requests
from trajecta.plans import render
from trajecta.sources import scans

TEMPLATE = {"user_message": "Repo <<REPO>>: <<PROBLEM_STATEMENT>>", "tree_section": "\n<<WORKSPACE_TREE>>"}


def test_error_turns_and_masks(spark):
    steps = [("edit_file", {"filepath": "a"}, BAD, None), ("run_command", {"command": "pytest"}, {"status": "error", "details": {"exit_code": 1}}, None), ("read_file", {"filepath": "a"}, OK, None), ("run_command", {"command": "ls x"}, {"status": "error", "error_message": "ls: cannot access", "details": {"exit_code": 2}}, None)]
    convs = table(spark, [conversation(0, steps)])
    found = {how: render.error_turns(convs, how).first()["untrained"] for how in ("off", "tool", "all")}
    assert found == {"off": [], "tool": [0, 6], "all": [0, 2, 6]}
    for how, trained in (("off", 4), ("tool", 2), ("all", 1)):
        rows = render.render(convs, "S {problem_description}", render.user_template(json.dumps(TEMPLATE)), mask_errors=how).collect()
        assert sum(r["turns"] for r in rows) == trained
        assert rows[0]["segments"][0]["text"].startswith("<bos><|turn>system\nS x<turn|>\n<|turn>user\nRepo r: x<turn|>\n") and rows[0]["split"] in ("train", "valid")
    with pytest.raises(ValueError):
        render.user_template("{}")


def test_request_files(spark, tmp_path):
    body = {"messages": [{"role": "user", "content": "x"}]}
    shapes = {"list.json": [body, {"body": body}, {"messages": []}], "one.json": body, "map.json": {"a": body, "b": {"body": body}, "c": 1}}
    for name, value in shapes.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "lines.jsonl").write_text(json.dumps(body) + "\n\n" + json.dumps({"body": body}) + "\n")
    labels = {name: sorted(r["label"] for r in scans.any_requests(spark, str(tmp_path / name)).collect()) for name in [*shapes, "lines.jsonl"]}
    assert labels == {"list.json": ["list:1", "list:2"], "one.json": ["one"], "map.json": ["a", "b"], "lines.jsonl": ["lines:1", "lines:3"]}
    doubled = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "ordinal long, label string")
    assert sorted(r["label"] for r in scans.labelled(doubled).collect()) == ["x", "x#2", "y"]


def test_budget_by_continuation():
    def complete(prompt, most):
        words = "<|channel> a b c".split()[:most] if "<|channel>" not in prompt else ["done"]
        return " ".join(words), len(words), "length" if len(words) == most and "done" not in words else "stop"

    assert requests.continued(complete, "p", 20, 2) == ("<|channel> a b<channel|>done", 5, "stop", True)
    assert requests.continued(complete, "p", 20, None)[3] is False


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "raw.jsonl").write_text("\n".join(json.dumps(raw(f"i{n}", steps=[("execute_bash", {"command": "ls"}, "x\n[The command completed with exit code 0.]", "go")])) for n in range(3)))
    cli.main(["convert", str(tmp_path / "raw.jsonl"), str(tmp_path / "conv")])
    lines = [x for p in sorted((tmp_path / "conv").glob("part*")) for x in p.read_text().splitlines()]
    assert len(lines) == 3
    (tmp_path / "conv.jsonl").write_text("\n".join(lines))
    cli.main(["curate", str(tmp_path / "conv.jsonl"), str(tmp_path / "cur"), "--source", str(tmp_path / "raw.jsonl"), "--keep", "0.5"])
    scores = spark.read.json(str(tmp_path / "cur/scores"))
    assert scores.where("eligible").count() == 3 and scores.where("kept").count() == 2
    (tmp_path / "s.md").write_text("Fix {problem_description}")
    (tmp_path / "u.json").write_text(json.dumps(TEMPLATE))
    (tmp_path / "t.json").write_text("[]")
    cli.main(["render", str(tmp_path / "conv.jsonl"), str(tmp_path / "win"), "--system-prompt", str(tmp_path / "s.md"), "--user-template", str(tmp_path / "u.json"), "--tools", str(tmp_path / "t.json")])
    assert spark.read.json(str(tmp_path / "win")).count() == 3
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(entry("one", n)) for n in range(1, 4)))
    cli.main(["log-stats", str(tmp_path / "log.jsonl")])
    cli.main(["replay", str(tmp_path / "log.jsonl"), "--select", "repeat", "--cond", "orig=", "--cond", "hot=temp:0.6", "--n", "2", "--out", str(tmp_path / "grid")])
    assert spark.read.json(str(tmp_path / "grid")).count() == 8
    (tmp_path / "res.jsonl").write_text(json.dumps({"id": "t", "resolved": True, "ended_at": 100.0, "wall_s": 50.0}))
    (tmp_path / "sum.jsonl").write_text(json.dumps({"t": 70.0, "dt": 5.0, "usage": {"completion_tokens": 51}}))
    cli.main(["scorer-time", "--results", str(tmp_path / "res.jsonl"), "--proxy-log", str(tmp_path / "sum.jsonl")])
    assert "47.6" in capsys.readouterr().out


def test_clean_conversation_is_all_trained(spark):
    rows = render.render(table(spark, [conversation(0, CLEAN)]), "S", render.user_template(json.dumps(TEMPLATE)), thinking=True, encoding="double").collect()
    assert rows[0]["turns"] == 5
