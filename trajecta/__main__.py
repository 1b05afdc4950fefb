"""python -m trajecta COMMAND: the engine's plans over files, with results as JSON lines or printed tables."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.requests import named_pairs, parse_condition
from .operators import convert as conversion
from .plans import checks, curate, logstats, render, replay, scorer_time
from .sources import scans, sinks
from . import schema


def _convert(spark: SparkSession, a: argparse.Namespace) -> None:
    limits = conversion.Limits(a.max_lines, a.max_file_chars, a.max_stdout)
    out = conversion.convert(scans.trajectories(spark, a.src, a.row_groups), max_turns=a.max_turns, per_instance=a.per_instance, resolved_only=not a.include_unresolved, limits=limits).persist()
    sinks.conversations(out, a.out)
    conversion.reasons(out).show(100, False)


def _curate(spark: SparkSession, a: argparse.Namespace) -> None:
    given = scans.conversations(spark, a.conv)
    given = given if a.no_normalize else curate.normalize(given)
    scores = curate.features(given, curate.matched_patches(given, scans.patches(spark, a.source))).persist()
    chosen = curate.choose(scores, a.keep, a.max_per_repo, a.repo_penalty, a.instance_penalty, [r for r in a.exclude_repos.split(",") if r]).persist()
    kept = given.join(chosen.where("kept").select("ordinal"), "ordinal", "left_semi")
    params = {"keep": a.keep, "max_per_repo": a.max_per_repo, "repo_penalty": a.repo_penalty, "instance_penalty": a.instance_penalty, "exclude_repos": sorted(filter(None, a.exclude_repos.split(","))), "weights": curate.WEIGHTS, "normalize": not a.no_normalize, "long_thought_chars": curate.LONG_THOUGHT}
    sinks.curation(chosen, kept, curate.report(chosen, params, a.max_per_repo), a.out)
    curate.feature_means(chosen, [c for c in chosen.columns if c.startswith("f_")]).show(20, False)


def _render(spark: SparkSession, a: argparse.Namespace) -> None:
    given = scans.excluded(scans.conversations(spark, a.conv), a.exclude_repos)
    given = scans.first_rows(given, a.limit) if a.limit else given
    if bool(a.tools) == bool(a.tools_from_log):
        raise SystemExit("give exactly one of --tools and --tools-from-log")
    if a.tools:
        tools = json.loads(Path(a.tools).read_text())
    else:
        found = scans.tools_from_log(scans.request_log(spark, a.tools_from_log), a.tool_names.split(",")).first()
        if not found:
            raise SystemExit(f"no request declares all of {a.tool_names}")
        tools = [t.asDict(True) for t in found["tools"]]
    rows = render.render(given, Path(a.system_prompt).read_text(), render.user_template(Path(a.user_template).read_text()), tools, a.mode == "think", a.encoding, a.max_len, a.valid_frac, a.mask_error_turns)
    rows.write.mode("overwrite").partitionBy("split").json(a.out)


def _log_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    report = logstats.session_report(scans.request_log(spark, a.logs), named_pairs(a.role)).persist()
    logstats.role_report(report, a.loop_threshold).orderBy("role").show(1000, False)
    logstats.most_repetitive(report, a.top).select("role", "longest_run", "most_repeated", "requests", F.left("key", F.lit(70)).alias("key")).show(a.top, False)


def _scorer_time(spark: SparkSession, a: argparse.Namespace) -> None:
    tasks = scans.jsonl_ordered(spark, a.results, schema.RESULT).withColumn("arm", F.coalesce("arm", F.lit("")) if a.by_arm else F.lit(""))
    log = scans.jsonl_ordered(spark, a.proxy_log, schema.SUMMARY_LOG).select("t", "dt", "status", "enable_thinking", "usage.completion_tokens")
    out = scorer_time.estimates(tasks, log, ["ordinal"], a.per_call, a.tok_s, a.cap_minutes * 60 if a.cap_minutes else None).persist()
    out.select("arm", "id", "resolved", "wall_s", "n_calls", "n_thinking", "completion_tokens", "llm_local_s", "llm_est_s", "tool_s", "est_s").orderBy("ordinal").show(10_000, False)
    scorer_time.projection(out, ["arm"], a.tasks, a.setup_minutes, "ordinal").show(100, False)


def _replay(spark: SparkSession, a: argparse.Namespace) -> None:
    """Selects contexts and writes the grid of requests, or with --sampler module:function the records of their samples; --records compares such records."""
    if a.records:
        rows = spark.read.json(a.records)
        names = a.metric or [c for c in rows.columns if c not in ("ctx", "cond", "k")]
        replay.rates(rows, names).orderBy("cond", "metric").show(1000, False)
        replay.paired(rows, names, a.base or rows.first()["cond"]).orderBy("cond", "metric").show(1000, False)
        return
    found = replay.select(scans.contexts(spark, a.logs), a.select, not a.no_onset, a.role)
    found = replay.limited(replay.dedupe(found) if a.dedupe else found, a.limit, a.seed)
    texts = {arg: Path(arg).read_text() for c in a.cond for op, arg in parse_condition(c).ops if op in ("subs", "append", "prepend")}
    conditions = [parse_condition(c, texts) for c in a.cond or ["orig="]]
    if a.dry:
        print(f"{found.count()} contexts selected ({a.select})")
    elif a.sampler:
        module, _, name = a.sampler.partition(":")
        replay.sampled_records(found, conditions, a.n, getattr(importlib.import_module(module), name), a.metric, a.require_subs).write.mode("overwrite").json(a.out)
    else:
        replay.grid(found, conditions, a.n, a.require_subs).write.mode("overwrite").json(a.out)


def _smoke(spark: SparkSession, a: argparse.Namespace) -> None:
    log = scans.jsonl_ordered(spark, a.logs, schema.SMOKE).persist()
    for table in (checks.smoke_agents(log), checks.smoke_settings(log).orderBy("role", F.desc("requests")), checks.smoke_counts(log)):
        table.show(1000, False)


def _check_adapter(spark: SparkSession, a: argparse.Namespace) -> None:
    header = scans.safetensors_header(spark, a.adapter).persist()
    checks.per_module(header).orderBy("module").show(100, False)
    if a.expected:
        checks.adapter_check(spark.read.schema("name string, shape array<long>").json(a.expected), header).show(10, False)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="trajecta", description=__doc__, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        p = commands.add_parser(name, formatter_class=argparse.ArgumentDefaultsHelpFormatter)
        p.set_defaults(run=run)
        for flags, options in arguments:
            p.add_argument(*flags.split(), **options)

    flag, many = {"action": "store_true"}, {"nargs": "+"}
    command("convert", _convert, ("src", {}), ("out", {}), ("--max-turns", {"type": int, "default": 40}), ("--per-instance", {"type": int, "default": 2}), ("--include-unresolved", flag), ("--row-groups", {}), ("--max-lines", {"type": int, "default": 150}), ("--max-file-chars", {"type": int, "default": 10_000}), ("--max-stdout", {"type": int, "default": 5_000}))
    command("curate", _curate, ("conv", {}), ("out", {}), ("--source", {"required": True}), ("--keep", {"type": float, "default": 0.4}), ("--max-per-repo", {"type": int, "default": 8}), ("--repo-penalty", {"type": float, "default": 0.02}), ("--instance-penalty", {"type": float, "default": 0.03}), ("--exclude-repos", {"default": ""}), ("--no-normalize", flag))
    command("render", _render, ("conv", {}), ("out", {}), ("--system-prompt", {"required": True}), ("--user-template", {"required": True}), ("--tools", {}), ("--tools-from-log", {}), ("--tool-names", {"default": "run_command,read_file,edit_file,write_file,get_status,submit_patch"}), ("--mode", {"choices": ["think", "nothink"], "default": "nothink"}), ("--encoding", {"choices": ["single", "double"], "default": "single"}), ("--max-len", {"type": int, "default": 12_288}), ("--valid-frac", {"type": float, "default": 0.02}), ("--limit", {"type": int, "default": 0}), ("--exclude-repos", {"default": ""}), ("--mask-error-turns", {"choices": ["off", "tool", "all"], "default": "off"}))
    command("log-stats", _log_stats, ("logs", many), ("--role", {"action": "append", "default": []}), ("--loop-threshold", {"type": int, "default": 10}), ("--top", {"type": int, "default": 10}))
    command("scorer-time", _scorer_time, ("--results", many | {"required": True}), ("--proxy-log", many | {"required": True}), ("--per-call", {"type": float, "default": 0.6}), ("--tok-s", {"type": float, "default": 25.5}), ("--cap-minutes", {"type": float}), ("--tasks", {"type": int, "default": 120}), ("--setup-minutes", {"type": float, "default": 1.0}), ("--by-arm", flag))
    command("replay", _replay, ("logs", {"nargs": "*"}), ("--select", {"default": "all", "choices": ["all", "malformed", "after-error", "repeat", "repeat-onset"]}), ("--no-onset", flag), ("--role", {}), ("--dedupe", flag), ("--limit", {"type": int, "default": 0}), ("--seed", {"type": int, "default": 0}), ("--cond", {"action": "append", "default": []}), ("--require-subs", flag), ("--n", {"type": int, "default": 4}), ("--out", {"default": "replay"}), ("--dry", flag), ("--sampler", {}), ("--records", {}), ("--base", {}), ("--metric", {"action": "append"}))
    command("smoke", _smoke, ("logs", many))
    command("check-adapter", _check_adapter, ("adapter", {}), ("--expected", {}))
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("trajecta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
