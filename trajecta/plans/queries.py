"""The query catalogue: every operator over the driver's tables, with the SQL that says the same.

Trajectories are users' events in order of time: views run, clicks inspect, purchases edit, signups submit
and errors fail. Logs, tasks and items are views over the same tables; each stands in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calls as fc
from ..functions import requests as fr
from ..functions import text as ft
from ..operators import joins, selection, sequences
from . import checks, curate, logstats, replay, scorer_time

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- views ------------------------------------------------------------------------------------------

CALLS = """c AS (SELECT user_id, event_id, event_type AS name, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type = 'error' AS err,
 CASE event_type WHEN 'purchase' THEN 'edit' WHEN 'view' THEN 'run' WHEN 'signup' THEN 'submit' WHEN 'click' THEN 'inspect' ELSE 'other' END AS kind,
 event_type || ':' || CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) AS key FROM events)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a call of its user's trajectory. The order (ts, event_id) becomes a number that only has to grow."""
    e = _table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "view", "run").when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "click", "inspect").otherwise("other")
    key = F.concat(F.col("event_type"), F.lit(":"), (F.floor("value") % 5).cast("string"))
    seq = F.row_number().over(sequences._ordered(["user_id"], ["ts", "event_id"]))
    return e.select("user_id", "event_id", F.col("event_type").alias("name"), "value", seq.cast("long").alias("seq"), (F.col("event_type") == "error").alias("err"), kind.alias("kind"), key.alias("key"))


RUNS = f"""WITH {CALLS}, f AS (SELECT *, CASE WHEN lag(name) OVER (PARTITION BY user_id ORDER BY seq) = name THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM f),
r AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY user_id, island)"""


@query(f"{RUNS} SELECT user_id, max(n) AS longest_run FROM r GROUP BY user_id")
def session_longest_run(spark, d):
    return sequences.longest_run(calls(spark, d), ["user_id"], ["seq"], "name")


@query(f"WITH {CALLS}, n AS (SELECT user_id, key, count(*) AS n FROM c GROUP BY user_id, key) SELECT user_id, max(n) AS most_repeated FROM n GROUP BY user_id")
def session_most_repeated(spark, d):
    return sequences.most_repeated(calls(spark, d), ["user_id"], "key")


@query(f"WITH {CALLS}, n AS (SELECT user_id, key, count(*) AS n FROM c GROUP BY user_id, key), m AS (SELECT user_id, max(n) AS most_repeated FROM n GROUP BY user_id ORDER BY most_repeated DESC, user_id LIMIT 10) SELECT * FROM m WHERE most_repeated >= 2")
def session_top_repetitive(spark, d):
    report = sequences.most_repeated(calls(spark, d), ["user_id"], "key").withColumn("first_at", F.col("user_id"))
    return logstats.most_repetitive(report, 10).drop("first_at")


@query("SELECT conv_id, turn, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) WHERE r = 1")
def session_argmax_first(spark, d):
    best = sequences.arg_max_first(F.struct("turn", F.length("text").cast("long").alias("chars")), F.length("text"), F.col("turn"))
    return _table(spark, d, "conversations").groupBy("conv_id").agg(best.alias("b")).select("conv_id", "b.turn", "b.chars")


@query("""WITH s AS (SELECT conv_id, count(*) AS turns, count(CASE WHEN role = 'user' THEN 1 END) AS users, count(CASE WHEN role = 'assistant' THEN 1 END) AS answers, count(CASE WHEN length(text) > 900 THEN 1 END) AS longs, coalesce(max(CASE WHEN turn = 0 AND role = 'system' THEN text END), '') AS sys FROM conversations GROUP BY conv_id),
r AS (SELECT *, CASE WHEN regexp_matches(sys, 'the') THEN 'english' WHEN left(split_part(sys, chr(10), 1), 40) <> '' THEN left(split_part(sys, chr(10), 1), 40) ELSE '(no system prompt)' END AS role FROM s)
SELECT role, count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS requests, CAST(sum(users) AS BIGINT) AS edit_ok, CAST(sum(answers) AS BIGINT) AS edit_not_found, CAST(sum(longs) AS BIGINT) AS edit_error, CAST(sum(turns % 2) AS BIGINT) AS malformed, CAST(sum(turns % 3) AS BIGINT) AS unparsed, CAST(sum(turns % 4) AS BIGINT) AS overflow, count(CASE WHEN turns >= 5 THEN 1 END) AS loops FROM r GROUP BY role""")
def role_rollup(spark, d):
    """The role report over conversations as sessions, with counts of their turns as what is summed."""
    sys = F.coalesce(F.max(F.when((F.col("turn") == 0) & (F.col("role") == "system"), F.col("text"))), F.lit(""))
    turns = F.count("*")
    s = _table(spark, d, "conversations").groupBy("conv_id").agg(
        turns.alias("requests"), turns.alias("longest_run"), F.count_if(F.col("role") == "user").alias("edit_ok"), F.count_if(F.col("role") == "assistant").alias("edit_not_found"), F.count_if(F.length("text") > 900).alias("edit_error"),
        (turns % 2).alias("malformed"), (turns % 3).alias("unparsed"), (turns % 4).alias("overflow"), sys.alias("sys"),
    )
    return logstats.role_report(s.withColumn("role", ft.role_label(F.col("sys"), [("english", "the")])), 5)


REDUNDANT = f"""WITH {CALLS}, e AS (SELECT *, sum(CASE WHEN kind = 'edit' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM c),
r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, epoch, key ORDER BY seq) AS n FROM e WHERE kind <> 'edit'),
k AS (SELECT user_id, count(*) AS redundant FROM r WHERE n > 1 GROUP BY user_id)"""


@query(f"{REDUNDANT} SELECT u.user_id, coalesce(k.redundant, 0) AS redundant FROM (SELECT DISTINCT user_id FROM c) u LEFT JOIN k ON u.user_id = k.user_id")
def redundant_calls(spark, d):
    c = calls(spark, d).withColumn("edit", F.col("kind") == "edit")
    return sequences.redundant(c, ["user_id"], ["seq"], "edit", "key")


@query(f"WITH {CALLS}, l AS (SELECT user_id, err AND lag(err) OVER (PARTITION BY user_id ORDER BY seq) AND name = lag(name) OVER (PARTITION BY user_id ORDER BY seq) AS hit FROM c) SELECT user_id, count(CASE WHEN hit THEN 1 END) AS failed_retries FROM l GROUP BY user_id")
def failed_retries(spark, d):
    return sequences.failed_retries(calls(spark, d), ["user_id"], ["seq"], "err", "name")


EDITS = f"""WITH {CALLS}, m AS (SELECT user_id, min(CASE WHEN kind = 'edit' THEN seq END) AS e0, max(CASE WHEN kind = 'edit' THEN seq END) AS e1, min(CASE WHEN kind = 'submit' THEN seq END) AS s0 FROM c GROUP BY user_id),
v AS (SELECT m.user_id, coalesce(bool_or(c.kind = 'run' AND c.seq > m.e1 AND c.seq < coalesce(m.s0, 1000000000)), false) AS verify_after_edit, coalesce(bool_or(c.kind = 'run' AND c.seq < m.e0), false) AS run_before_edit FROM m JOIN c ON m.user_id = c.user_id GROUP BY m.user_id)"""


@query(f"{EDITS} SELECT * FROM v")
def verify_after_edit(spark, d):
    return sequences.edit_order(calls(spark, d), ["user_id"], "seq", "kind")


@query(f"""WITH {CALLS}, t AS (SELECT user_id, event_id % 7 AS target, min(seq) AS first FROM c WHERE kind = 'edit' GROUP BY 1, 2),
h AS (SELECT t.user_id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.user_id = t.user_id AND c.kind = 'inspect' AND c.event_id % 7 = t.target AND c.seq < t.first) THEN 1.0 ELSE 0.0 END AS hit FROM t),
s AS (SELECT user_id, avg(hit) AS share FROM h GROUP BY user_id)
SELECT u.user_id, round(CAST(coalesce(s.share, 1.0) AS DOUBLE), 6) AS read_before_edit FROM (SELECT DISTINCT user_id FROM c) u LEFT JOIN s ON u.user_id = s.user_id""")
def inspected_before_edit(spark, d):
    target = F.col("event_id") % 7
    c = calls(spark, d).withColumn("edits", F.when(F.col("kind") == "edit", target)).withColumn("reads", F.when(F.col("kind") == "inspect", target))
    return joins.inspected_first(c, ["user_id"], "seq", "edits", "reads").withColumn("read_before_edit", F.round("read_before_edit", 6))


@query(f"""{REDUNDANT},
l AS (SELECT user_id, err AND lag(err) OVER (PARTITION BY user_id ORDER BY seq) AND name = lag(name) OVER (PARTITION BY user_id ORDER BY seq) AS hit FROM c),
a AS (SELECT user_id, count(*) AS n, count(CASE WHEN err THEN 1 END) AS errors, count(CASE WHEN kind = 'other' AND value > 60 THEN 1 END) AS forbidden, count(CASE WHEN value > 80 THEN 1 END) AS thoughts, min(CASE WHEN kind = 'edit' THEN seq END) AS e0, max(CASE WHEN kind = 'edit' THEN seq END) AS e1, min(CASE WHEN kind = 'submit' THEN seq END) AS s0, count(CASE WHEN kind = 'edit' THEN 1 END) AS edits FROM c GROUP BY user_id),
v AS (SELECT a.user_id, coalesce(bool_or(c.kind = 'run' AND c.seq > a.e1 AND c.seq < coalesce(a.s0, 1000000000)), false) AS va, coalesce(bool_or(c.kind = 'run' AND c.seq < a.e0), false) AS rb FROM a JOIN c ON a.user_id = c.user_id GROUP BY a.user_id),
x AS (SELECT user_id, count(CASE WHEN hit THEN 1 END) AS retries FROM l GROUP BY user_id),
z AS (SELECT a.user_id, CAST(0.4 AS DOUBLE) + CAST(0.4 AS DOUBLE) * CAST(va AS INTEGER) + CAST(0.2 AS DOUBLE) * CAST(rb AS INTEGER) AS f1, exp(CAST(-0.5 AS DOUBLE) * coalesce(k.redundant, 0)) AS f2,
 greatest(CAST(0 AS DOUBLE), 1 - CAST(8 AS DOUBLE) * (errors + 3 * forbidden) / greatest(n, 1)) AS f3, exp(CAST(-0.7 AS DOUBLE) * retries) AS f4,
 CASE WHEN edits <= 15 THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), 1 - log2(CAST(edits AS DOUBLE) / 15) / 4) END AS f5, exp(CAST(-0.5 AS DOUBLE) * thoughts) AS f6
 FROM a JOIN v ON a.user_id = v.user_id JOIN x ON a.user_id = x.user_id LEFT JOIN k ON a.user_id = k.user_id)
SELECT user_id, round(CAST(0.25 AS DOUBLE) * f1 + CAST(0.2 AS DOUBLE) * f2 + CAST(0.2 AS DOUBLE) * f3 + CAST(0.1 AS DOUBLE) * f4 + CAST(0.2 AS DOUBLE) * f5 + CAST(0.05 AS DOUBLE) * f6, 6) AS score FROM z""")
def curation_score(spark, d):
    c = sequences.signals(calls(spark, d), ["user_id"], "seq", "name", "err", "kind", "key")
    out = c.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if("err").alias("tool_errors"), F.count_if((F.col("kind") == "other") & (F.col("value") > 60)).alias("forbidden"), F.count_if(F.col("value") > 80).alias("long_thoughts"), F.count_if(F.col("kind") == "edit").cast("double").alias("edits"), *sequences.signal_sums())
    size = F.when(F.col("edits") <= 15, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.log2(F.col("edits") / 15.0) / 4.0))
    return curate.scored(out.withColumn("read_before_edit", F.lit(1.0)), size).select("user_id", F.round("score", 6).alias("score"))


ITEMS = "i AS (SELECT c_custkey AS idx, c_custkey // 2 AS instance_id, (c_custkey // 2) % 50 AS repo, round(c_acctbal / CAST(10000 AS DOUBLE), 3) AS score FROM customer)"


def items(spark, d):
    inst = F.expr("c_custkey div 2")
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), inst.alias("instance_id"), (inst % 50).alias("repo"), F.round(F.col("c_acctbal") / F.lit(10000.0), 3).alias("score"))


@query(f"""WITH {ITEMS}, a AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, idx) AS r FROM i), b AS (SELECT *, CASE WHEN r = 2 THEN CAST(0.03 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS p FROM a WHERE r <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score - p DESC, instance_id, idx) - 1 AS k FROM b), e AS (SELECT *, score - CAST(0.02 AS DOUBLE) * k - p AS effective FROM k WHERE k < 8),
o AS (SELECT *, row_number() OVER (ORDER BY effective DESC, instance_id, idx) AS pick FROM e)
SELECT idx, instance_id, repo, pick FROM o WHERE pick <= (SELECT CAST(round_even(count(*) * CAST(0.2 AS DOUBLE), 0) AS BIGINT) FROM i)""")
def diverse_topk(spark, d):
    rows = items(spark, d)
    out = selection.diverse_top_k(rows, selection.target_size(0.2, rows.count()), 8, 0.02, 0.03)
    return out.select("idx", "instance_id", "repo", F.col("pick").cast("long").alias("pick"))


@query("""WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem), p AS (SELECT unnest([0, 10, 25, 50, 75, 90, 100]) AS p)
SELECT p.p AS p, s.v AS value FROM p JOIN s ON s.r = CAST(round_even((s.n - 1) * p.p / CAST(100 AS DOUBLE), 0) AS BIGINT)""")
def nearest_rank_quantiles(spark, d):
    return selection.nearest_rank(_table(spark, d, "lineitem"), "l_extendedprice")


@query("""WITH c AS (SELECT c_acctbal > 2000 AS kept, CAST(c_acctbal AS DOUBLE) AS acctbal, CAST(c_custkey AS DOUBLE) AS custkey FROM customer)
SELECT 'acctbal' AS feature, round(avg(CASE WHEN kept THEN acctbal END), 4) AS kept_mean, round(avg(CASE WHEN NOT kept THEN acctbal END), 4) AS rejected_mean FROM c
UNION ALL SELECT 'custkey', round(avg(CASE WHEN kept THEN custkey END), 4), round(avg(CASE WHEN NOT kept THEN custkey END), 4) FROM c""")
def kept_rejected_means(spark, d):
    rows = _table(spark, d, "customer").select((F.col("c_acctbal") > 2000).alias("kept"), F.lit(True).alias("eligible"), F.col("c_acctbal").alias("acctbal"), F.col("c_custkey").alias("custkey"))
    return curate.feature_means(rows, ["acctbal", "custkey"])


@query("""WITH i AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), p AS (SELECT o_custkey % 100 AS r, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT count(*) AS input, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS eligible, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS kept, count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS unmatched, (SELECT count(*) FROM i) AS instances, (SELECT count(*) FROM p) AS repos, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_custkey % 100 END) AS repos_eligible,
 count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS excluded, CAST(70 AS BIGINT) AS target, count(CASE WHEN o_orderkey % 3 > 0 THEN 1 END) AS normalized, CAST(sum(o_orderkey % 3) AS BIGINT) AS turns_dropped, (SELECT count(*) FROM i WHERE n = 2) AS pairs, (SELECT count(*) FROM p WHERE n >= 50) AS repos_at_cap FROM orders""")
def curation_counts(spark, d):
    o = _table(spark, d, "orders")
    rows = o.select(
        (F.col("o_totalprice") > 100000).alias("eligible"), (F.col("o_orderstatus") == "F").alias("kept"), (F.col("o_orderpriority") != "5-LOW").alias("patch_matched"), F.col("o_custkey").alias("instance_id"), (F.col("o_custkey") % 100).alias("repo"),
        (F.col("o_orderpriority") == "1-URGENT").alias("excluded"), F.lit(70).alias("target"), (F.col("o_orderkey") % 3).alias("dropped"),
    )
    return curate.summary(rows, 50)


@query("""SELECT unnest(['leaves_root_or_build_files', 'edits_existing_test', 'with_forbidden_action']) AS flag, unnest([count(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 1 END), count(CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN 1 END), count(CASE WHEN o_orderstatus = 'F' AND o_custkey % 5 > 0 THEN 1 END)]) AS kept,
 unnest([count(CASE WHEN o_totalprice > 100000 AND o_orderkey % 3 = 0 THEN 1 END), count(CASE WHEN o_totalprice > 100000 AND o_orderkey % 4 = 0 THEN 1 END), count(CASE WHEN o_totalprice > 100000 AND o_custkey % 5 > 0 THEN 1 END)]) AS eligible FROM orders""")
def curation_flags(spark, d):
    o = _table(spark, d, "orders")
    stats = F.struct((F.col("o_orderkey") % 3 == 0).alias("adds_root_file"), (F.col("o_orderkey") % 4 == 0).alias("edits_existing_test"))
    return curate.flag_sums(o.select((F.col("o_orderstatus") == "F").alias("kept"), (F.col("o_totalprice") > 100000).alias("eligible"), stats.alias("patch_stats"), (F.col("o_custkey") % 5).alias("forbidden")))


@query("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_at FROM orders GROUP BY o_custkey ORDER BY n DESC, first_at LIMIT 15")
def repo_frequency_topn(spark, d):
    return selection.top_frequent(_table(spark, d, "orders"), "o_custkey", "o_orderkey", 15)


@query("SELECT rows, count(*) AS keys FROM (SELECT o_custkey, count(*) AS rows FROM orders GROUP BY o_custkey) GROUP BY rows")
def repo_histogram(spark, d):
    return selection.count_histogram(_table(spark, d, "orders"), "o_custkey")


HASHED = " + ".join(f"CAST(instr('0123456789abcdef', substr(h, {i}, 1)) - 1 AS BIGINT) * {pow(16, 32 - i, 1000)}" for i in range(1, 33))


@query(f"SELECT doc_id, CASE WHEN ({HASHED}) % 1000 < 20 THEN 'valid' ELSE 'train' END AS split FROM (SELECT doc_id, md5('doc-' || CAST(doc_id AS VARCHAR)) AS h FROM documents)")
def hash_split(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"))
    return selection.hash_split(docs, "id", 0.02).select("doc_id", "split")


TASKS = """t AS (SELECT event_id AS id, epoch(ts) AS s, epoch(ts) + 3600 AS e, CAST(3600 AS DOUBLE) AS wall, event_id % 3 = 0 AS resolved FROM events WHERE event_type = 'signup'),
g AS (SELECT epoch(ts) AS t, value AS dt, event_id % 500 AS tokens, event_id % 2 = 0 AS thinking FROM events WHERE event_type <> 'error'),
j AS (SELECT t.id, count(g.t) AS n_calls, count(CASE WHEN g.thinking THEN 1 END) AS n_thinking, CAST(coalesce(sum(g.tokens), 0) AS BIGINT) AS completion_tokens, coalesce(sum(g.dt), 0) AS local, coalesce(sum(CAST(0.6 AS DOUBLE) + g.tokens / CAST(25.5 AS DOUBLE)), 0) AS est FROM t LEFT JOIN g ON g.t BETWEEN t.s - 2 AND t.e + 2 GROUP BY t.id),
x AS (SELECT t.id, t.resolved, n_calls, n_thinking, completion_tokens, round(local, 3) AS llm_local_s, round(est, 3) AS llm_est_s, round(greatest(CAST(0 AS DOUBLE), wall - local), 3) AS tool_s, round(est + greatest(CAST(0 AS DOUBLE), wall - local), 3) AS est_s FROM t JOIN j ON t.id = j.id)"""


def _estimates(spark, d):
    e = _table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    tasks = e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("at").alias("started_at"), (F.col("at") + 3600).alias("ended_at"), F.lit(3600.0).alias("wall_s"), (F.col("event_id") % 3 == 0).alias("resolved"))
    log = e.select(F.col("at").alias("t"), F.col("value").alias("dt"), F.when(F.col("event_type") == "error", 400).otherwise(200).alias("status"), (F.col("event_id") % 500).alias("completion_tokens"), (F.col("event_id") % 2 == 0).alias("enable_thinking"))
    out = scorer_time.estimates(tasks, log, ["id"])
    sums = ["llm_local_s", "llm_est_s", "tool_s", "est_s"]
    return out.select("id", "resolved", "n_calls", "n_thinking", "completion_tokens", *(F.round(c, 3).alias(c) for c in sums))


@query(f"WITH {TASKS} SELECT * FROM x")
def scorer_time_tasks(spark, d):
    return _estimates(spark, d)


@query(f"WITH {TASKS} SELECT count(*) AS tasks, round(avg(est_s) / 60, 4) AS mean_min, round(median(est_s) / 60, 4) AS median_min, count(CASE WHEN resolved THEN 1 END) AS solved, round((avg(est_s) + 60) * 120 / 3600, 4) AS hours, CASE WHEN (avg(est_s) + 60) * 120 / 3600 > 12 THEN 'over' WHEN (avg(est_s) + 60) * 120 / 3600 > 10.5 THEN 'near' ELSE 'fits' END AS verdict FROM x")
def scorer_time_projection(spark, d):
    out = scorer_time.projection(_estimates(spark, d))
    return out.select("tasks", *(F.round(c, 4).alias(c) for c in ("mean_min", "median_min")), "solved", F.round("hours", 4).alias("hours"), "verdict")


# ---- calls, shells and patches, written out of the tables' own columns ---------------------------------


GENERATED = r"""WITH e AS (SELECT event_id, user_id, event_type, props, '<|tool_call>call:' AS o, '<tool_call|>' AS c, '<|"|>' AS q FROM events),
g AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Look. ' || o || event_type || '{n:' || user_id || '}' || c WHEN 1 THEN o || 'grep -rn ' || event_type || '{}' || c WHEN 2 THEN o || event_type || '{p:' || q || props || q
 WHEN 3 THEN props WHEN 4 THEN o || 'x' || user_id % 3 || '{n:1}' || c || o || event_type || '{a:' || q || 'x' || q || '}' || c ELSE o || event_type || '{p=' || q || 'a' || q || '}' || c END AS raw FROM e)"""


def _generated(spark, d) -> DataFrame:
    """Every event as a generation: a call, one with words in its name, an open one, plain text, two calls, or damaged arguments."""
    o, c, q, kind, user = "<|tool_call>call:", "<tool_call|>", '<|"|>', F.col("event_type"), F.col("user_id").cast("string")
    forms = [
        F.concat(F.lit(f"Look. {o}"), kind, F.lit("{n:"), user, F.lit("}" + c)), F.concat(F.lit(f"{o}grep -rn "), kind, F.lit("{}" + c)), F.concat(F.lit(o), kind, F.lit("{p:" + q), F.col("props"), F.lit(q)), F.col("props"),
        F.concat(F.lit(f"{o}x"), (F.col("user_id") % 3).cast("string"), F.lit("{n:1}" + c + o), kind, F.lit("{a:" + q + "x" + q + "}" + c)), F.concat(F.lit(o), kind, F.lit("{p=" + q + "a" + q + "}" + c)),
    ]
    return _table(spark, d, "events").select("event_id", F.get(F.array(*forms), (F.col("event_id") % 6).cast("int")).alias("raw"))


@query(GENERATED + r""", n AS (SELECT event_id, raw, list_transform(regexp_extract_all(raw, '(?s)<\|tool_call>call:(.*?)(?:\{|<\|"\|>|<tool_call\|>)', 1), lambda x: trim(x)) AS names, regexp_extract_all(raw, '(?s)<\|tool_call>call:([\w\-\.]+)\{(.*?)\}<tool_call\|>', 1) AS calls FROM g)
SELECT event_id, len(names) AS names, len(list_filter(names, lambda x: x NOT IN ('click', 'view'))) AS malformed, contains(raw, '<|tool_call>') AND len(calls) = 0 AS unparsed, len(list_filter(calls, lambda x: x NOT IN ('click', 'view'))) AS unknown, regexp_matches(raw, '`,\w+:|\{\w+="|\w+=<\|"\|>') AS damaged FROM n""")
def call_classify(spark, d):
    info = fc.classify(F.col("raw"), F.array(F.lit("click"), F.lit("view")))
    return _generated(spark, d).select("event_id", info.alias("x")).select("event_id", F.size("x.names").cast("long").alias("names"), F.size("x.malformed_names").cast("long").alias("malformed"), F.col("x.unparsed").alias("unparsed"), F.size("x.unknown_tools").cast("long").alias("unknown"), F.col("x.damaged_args").alias("damaged"))


THOUGHT = """WITH r AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN t WHEN 1 THEN '<|channel>thought' || chr(10) || t || '<channel|>' || left(t, 20) WHEN 2 THEN 'aside<|channel>' || t WHEN 3 THEN t || '<channel|>after' ELSE '<|channel>' || t || '<channel|>' END || CASE doc_id % 4 WHEN 0 THEN '<eos>' WHEN 1 THEN '<turn|>' WHEN 2 THEN '<|tool_response>' ELSE '' END AS raw FROM r),
p AS (SELECT doc_id, CASE WHEN suffix(raw, '<eos>') THEN left(raw, length(raw) - 5) WHEN suffix(raw, '<turn|>') THEN left(raw, length(raw) - 7) WHEN suffix(raw, '<|tool_response>') THEN left(raw, length(raw) - 16) ELSE raw END AS t FROM g)"""


def _thoughts(spark, d) -> DataFrame:
    """Every document as a generation with a thought: none, closed, never opened or never closed, and a stop token."""
    t, n = F.coalesce("text", F.lit("")), F.col("doc_id")
    forms = [t, F.concat(F.lit("<|channel>thought\n"), t, F.lit("<channel|>"), F.left(t, F.lit(20))), F.concat(F.lit("aside<|channel>"), t), F.concat(t, F.lit("<channel|>after")), F.concat(F.lit("<|channel>"), t, F.lit("<channel|>"))]
    stops = F.array(*map(F.lit, ["<eos>", "<turn|>", "<|tool_response>", ""]))
    return _table(spark, d, "documents").select("doc_id", F.concat(F.get(F.array(*forms), (n % 5).cast("int")), F.get(stops, (n % 4).cast("int"))).alias("raw"))


@query(f"{THOUGHT} SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM p")
def strip_stop(spark, d):
    t = fc.strip_stop(F.col("raw"))
    return _thoughts(spark, d).select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


@query(f"""{THOUGHT}, o AS (SELECT doc_id, t, contains(t, '<|channel>') OR contains(t, '<channel|>') AS marked, CASE WHEN contains(t, '<|channel>') THEN substr(t, instr(t, '<|channel>') + 10) ELSE t END AS rest FROM p),
x AS (SELECT doc_id, t, marked, instr(rest, '<channel|>') AS e, rest FROM o), y AS (SELECT *, CASE WHEN e > 0 THEN left(rest, e - 1) ELSE rest END AS th, CASE WHEN e > 0 THEN nullif(substr(rest, e + 10), '') END AS co FROM x)
SELECT doc_id, md5(CASE WHEN marked THEN CASE WHEN starts_with(th, 'thought' || chr(10)) THEN substr(th, 9) ELSE th END END) AS reasoning, md5(CASE WHEN marked THEN co ELSE t END) AS content FROM y""")
def reasoning_split(spark, d):
    x = fc.reasoning_split(fc.strip_stop(F.col("raw")))
    return _thoughts(spark, d).select("doc_id", F.md5(x["reasoning"]).alias("reasoning"), F.md5(x["content"]).alias("content"))


@query(r"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE '{"kind": "' || event_type || '", "n": ' || user_id || ', "v": ' || CAST(value AS VARCHAR) || ', "on": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END || ', "m": {"a": [' || user_id || ', "x' || event_id || '"]}}' END AS args, event_id % 7 = 0 AS hang FROM events""")
def argument_grammar(spark, d):
    """Events in the grammar of arguments; a bracket quoted within a nested list is what stands still."""
    q, c = '<|"|>', lambda n: F.col(n).cast("string")
    plain = F.concat(F.lit(f"kind:{q}"), "event_type", F.lit(f"{q},n:"), c("user_id"), F.lit(",v:"), c("value"), F.lit(",on:"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("none"), F.lit(",m:{a:["), c("user_id"), F.lit(",x"), c("event_id"), F.lit("]}"))
    hangs = F.concat(F.lit(f"a:[[{q}"), "event_type", F.lit(f"]]{q}]]"))
    out = _table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, hangs).otherwise(plain).alias("v"))
    return out.select("event_id", fc.parsed_arguments(F.col("v")).alias("p")).select("event_id", "p.args", "p.hang")


COMMANDS = r"""WITH w AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'cd /r' || user_id || ' && ' WHEN 1 THEN 'FOO=' || user_id || ' timeout 60 ' WHEN 2 THEN 'env A=1 time ' WHEN 3 THEN 'cd a; cd b ; ' ELSE '' END
 || CASE event_id % 13 WHEN 0 THEN 'python3.' || user_id % 12 || ' -m pytest -q' WHEN 1 THEN '/usr/bin/pytest tests' WHEN 2 THEN 'sed -i s/a/b/ x' || user_id || '.py' WHEN 3 THEN 'cat > /tmp/s' || user_id || '.py' WHEN 4 THEN 'echo hi > o' || user_id WHEN 5 THEN 'grep -rn w' || user_id || ' .'
 WHEN 6 THEN 'make test' WHEN 7 THEN './run_tests.sh' WHEN 8 THEN 'git apply p' || user_id || '.diff' WHEN 9 THEN 'rm -rf build' WHEN 10 THEN 'python a' || user_id || '.py' WHEN 11 THEN 'ls -l' || chr(10) || 'pytest' ELSE '' END AS command FROM events),
s AS (SELECT *, regexp_replace(trim(command), '^(?:cd\s+\S+\s*(?:&&|;)\s*)+', '') AS b1, regexp_replace(split_part(trim(command), chr(10), 1), '^(?:cd\s+\S+\s*(?:&&|;)\s*)+', '') AS f1, split_part(trim(command), chr(10), 1) AS line FROM w),
t AS (SELECT *, regexp_replace(regexp_replace(trim(b1), '^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|export|env|time)(?:\s+|$))+', ''), '^timeout(?:\s+\S+)?(?:\s+|$)', '') AS b, regexp_replace(regexp_replace(trim(f1), '^(?:(?:[A-Za-z_][A-Za-z0-9_]*=\S*|export|env|time)(?:\s+|$))+', ''), '^timeout(?:\s+\S+)?(?:\s+|$)', '') AS f FROM s),
u AS (SELECT *, list_filter(string_split_regex(trim(b), '\s+'), lambda x: x <> '') AS bw, list_filter(string_split_regex(trim(f), '\s+'), lambda x: x <> '') AS fw FROM t),
v AS (SELECT *, split_part(coalesce(bw[1], ''), '/', -1) AS p0, split_part(coalesce(fw[1], ''), '/', -1) AS q0, array_to_string(bw[2:], ' ') AS args, array_to_string(fw[2:], ' ') AS rest FROM u),
c AS (SELECT *, CASE WHEN regexp_full_match(p0, 'python[0-9.]*') THEN 'python' ELSE p0 END AS program, CASE WHEN regexp_full_match(q0, 'python[0-9.]*') THEN 'python' ELSE q0 END AS first FROM v),
k AS (SELECT *, CASE WHEN regexp_matches(line, '\bsed\s+-i|\bperl\s+-[a-z]*i|\bgit\s+apply\b|\bpatch\s+-p') OR first IN ('cat', 'tee', 'echo', 'printf') AND regexp_matches(rest, '>\s*\S') THEN CASE WHEN contains(line, '/tmp/') THEN 'scratch' ELSE 'edit' END
 WHEN first IN ('python', 'pytest', 'py.test', 'nosetests', 'tox', 'nox', 'coverage', 'trial', 'unittest') OR suffix(first, '.sh') AND contains(first, 'test') OR first = 'make' AND contains(rest, 'test') THEN 'run'
 WHEN first IN ('grep', 'egrep', 'fgrep', 'rg', 'ag', 'find', 'ls', 'cat', 'head', 'tail', 'sed', 'awk', 'wc', 'tree', 'nl', 'less', 'more', 'file', 'stat', 'git', 'pwd', 'which', 'type', 'du') THEN 'inspect' ELSE 'other' END AS class,
 program IN ('pytest', 'py.test', 'nosetests', 'tox', 'nox') OR contains(command, '-m pytest') OR contains(command, '-m unittest') OR program = 'make' AND contains(args, 'test') AS is_test FROM c)"""


def _commands(spark, d) -> DataFrame:
    """Every event as a shell command: something to run, look at or edit, behind what a shell puts before it."""
    user = F.col("user_id").cast("string")
    leads = [F.concat(F.lit("cd /r"), user, F.lit(" && ")), F.concat(F.lit("FOO="), user, F.lit(" timeout 60 ")), F.lit("env A=1 time "), F.lit("cd a; cd b ; "), F.lit("")]
    with_user = lambda before, after="": F.concat(F.lit(before), user, F.lit(after))
    bodies = [
        F.concat(F.lit("python3."), (F.col("user_id") % 12).cast("string"), F.lit(" -m pytest -q")), F.lit("/usr/bin/pytest tests"), with_user("sed -i s/a/b/ x", ".py"), with_user("cat > /tmp/s", ".py"), with_user("echo hi > o"), with_user("grep -rn w", " ."),
        F.lit("make test"), F.lit("./run_tests.sh"), with_user("git apply p", ".diff"), F.lit("rm -rf build"), with_user("python a", ".py"), F.lit("ls -l\npytest"), F.lit(""),
    ]
    pick = lambda xs: F.get(F.array(*xs), (F.col("event_id") % len(xs)).cast("int"))
    return _table(spark, d, "events").select("event_id", "user_id", F.concat(pick(leads), pick(bodies)).alias("command"))


@query(f"{COMMANDS} SELECT event_id, program, class, is_test FROM k")
def shell_classes(spark, d):
    v = F.col("command")
    return _commands(spark, d).select("event_id", ft.main_program(v).alias("program"), ft.classify_command(v).alias("class"), ft.is_test_command(v).alias("is_test"))


INVOCATION = r"command not found|No such file or directory|can''t open file|cannot access|Permission denied|Is a directory|unrecognized arguments|invalid option|unknown option|illegal option|usage:|Usage:|syntax error near|ERROR: file or directory not found|ERROR: not found:|no tests ran|ERROR: usage"


@query(COMMANDS + rf""", r AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'read_file' ELSE 'run_command' END AS name, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'error' END AS status, [NULL, 0, 1, 2, 4, 126, 127][event_id % 7 + 1] AS code,
 ['', 'No such file or directory', 'Traceback: can''t open file', 'usage: x', 'failed ' || user_id][event_id % 5 + 1] AS message, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'ls: cannot access ' || user_id END AS stderr FROM k),
x AS (SELECT *, message || chr(10) || stderr AS said, coalesce(code = 1, false) AND program IN ('grep', 'egrep', 'fgrep', 'rg', 'ag') AND trim(message || stderr) = '' AS nothing FROM r)
SELECT event_id, status = 'error' AND (name <> 'run_command' OR CASE WHEN coalesce(code IN (126, 127), false) THEN true WHEN is_test THEN coalesce(code IN (4, 5), false) WHEN program = 'python' THEN regexp_matches(left(said, 400), 'can''t open file|No such file or directory: ''/') AND NOT contains(said, 'Traceback')
 WHEN program IN ('grep', 'egrep', 'fgrep', 'rg', 'ag', 'find', 'ls', 'cat', 'head', 'tail', 'sed', 'awk', 'wc', 'tree', 'nl', 'less', 'more', 'file', 'stat', 'git', 'pwd', 'which', 'type', 'du', 'cd', 'rm', 'mv', 'cp', 'mkdir') THEN NOT nothing AND (regexp_matches(said, '{INVOCATION}') OR code IS NULL OR code NOT IN (0, 1)) ELSE regexp_matches(left(said, 2000), '{INVOCATION}') END) AS tool_error FROM x""")
def tool_error_rules(spark, d):
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    pick = lambda xs: F.get(F.array(*xs), (n % len(xs)).cast("int"))
    code = pick([F.lit(None).cast("int"), *map(F.lit, (0, 1, 2, 4, 126, 127))])
    message = pick([F.lit(""), F.lit("No such file or directory"), F.lit("Traceback: can't open file"), F.lit("usage: x"), F.concat(F.lit("failed "), user)])
    stderr = F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("ls: cannot access "), user))
    error = ft.tool_error(F.when(F.col("user_id") % 4 == 0, "read_file").otherwise("run_command"), F.col("command"), F.when(n % 3 == 0, "ok").otherwise("error"), code, message, stderr)
    return _commands(spark, d).select("event_id", error.alias("tool_error"))


@query("""WITH e AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0)
SELECT 'r' AS role, CAST(user_id AS VARCHAR) AS key, count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS edit_ok, count(CASE WHEN event_id % 3 = 1 THEN 1 END) AS edit_not_found, count(CASE WHEN event_id % 3 = 2 THEN 1 END) AS edit_error FROM e GROUP BY user_id""")
def edit_outcomes(spark, d):
    """Results of a session's edits; those that stand before their call, as every fourth, count for none."""
    n = F.col("event_id")
    kinds = "array<struct<id:string,function:struct<name:string,arguments:string>>>"
    call = F.array(F.struct(n.cast("string").alias("id"), F.struct(F.when(F.col("kind") == "edit", "edit_file").otherwise(F.col("name")).alias("name"), F.lit("{}").alias("arguments")).alias("function"))).cast(kinds)
    result = F.get(F.array(*map(F.lit, ['{"status": "ok"}', '{"status": "error", "error_message": "String Not Found"}', '{"result": "{\\"status\\": \\"error\\"}"}'])), (n % 3).cast("int"))
    asked = F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("tool_call_id"), call.alias("tool_calls"))
    told = F.struct(F.lit("tool").alias("role"), result.alias("content"), n.cast("string").alias("tool_call_id"), F.lit(None).cast(kinds).alias("tool_calls"))
    rows = calls(spark, d).select("user_id", "seq", F.when(n % 4 == 0, F.array(told, asked)).otherwise(F.array(asked, told)).alias("said"))
    found = rows.groupBy(F.lit("r").alias("role"), F.col("user_id").cast("string").alias("key")).agg(F.array_sort(F.collect_list(F.struct("seq", "said"))).alias("all")).select("role", "key", F.flatten(F.transform("all", lambda x: x["said"])).alias("longest"))
    return logstats.edit_outcomes(found, logstats.session_calls(found))


@query("""WITH f AS (SELECT l_orderkey AS k, l_partkey % 6 AS kind, l_partkey AS p, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS BIGINT) AS r FROM lineitem),
s AS (SELECT k, count(*) AS files, CAST(sum(a + r) AS BIGINT) AS changed, CAST(coalesce(sum(CASE WHEN kind = 0 THEN a + r END), 0) AS BIGINT) AS src_changed, count(CASE WHEN kind = 0 THEN 1 END) AS src_files, bool_or(kind = 1) AS edits_existing_test, bool_or(kind = 2) AS adds_test, bool_or(kind = 4) AS adds_root_file, bool_or(kind = 3) AS touches_config FROM f GROUP BY k)
SELECT *, round(CASE WHEN src_changed <= 15 THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), 1 - log2(CAST(src_changed AS DOUBLE) / 15) / 4) END * CASE WHEN src_files <= 2 THEN CAST(1 AS DOUBLE) WHEN src_files = 3 THEN 0.85 WHEN src_files = 4 THEN 0.7 ELSE 0.5 END
 * CASE WHEN edits_existing_test THEN CAST(0.3 AS DOUBLE) ELSE 1 END * CASE WHEN adds_root_file THEN CAST(0.6 AS DOUBLE) ELSE 1 END * CASE WHEN adds_test THEN CAST(0.8 AS DOUBLE) ELSE 1 END * CASE WHEN touches_config THEN CAST(0.8 AS DOUBLE) ELSE 1 END, 6) AS patch_score FROM s""")
def patch_stats(spark, d):
    """Every order as a diff: a line item is a file, with as many lines added as its quantity and removed as its number."""
    kind, p = (F.col("l_partkey") % 6).cast("int"), F.col("l_partkey").cast("string")
    path = F.get(F.array(F.concat(F.lit("src/m"), p, F.lit(".py")), F.concat(F.lit("tests/test_"), p, F.lit(".py")), F.concat(F.lit("tests/test_"), p, F.lit(".py")), F.lit("setup.cfg"), F.concat(F.lit("note"), p, F.lit(".py")), F.concat(F.lit("pkg/data"), p, F.lit(".txt"))), kind)
    lines = F.concat(F.repeat(F.lit("-old\n"), F.col("l_linenumber").cast("int")), F.repeat(F.lit("+new\n"), F.col("l_quantity").cast("int")))
    file = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n"), F.when(kind.isin(2, 4), "new file mode 100644\n").otherwise(""), F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1 +1 @@\n"), lines)
    made = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(file)), "").alias("patch")).withColumn("s", ft.patch_stats(F.col("patch")))
    return made.select("k", "s.*", F.round(ft.patch_score(F.col("s")), 6).alias("patch_score"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), f AS (SELECT doc_id, line, min(i) AS i FROM l GROUP BY doc_id, line)
SELECT doc_id, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM f GROUP BY doc_id""")
def ordered_distinct_lines(spark, d):
    once = ft.distinct_lines(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", F.size(F.split(once, "\n", -1)).cast("long").alias("lines"), F.md5(once).alias("digest"))


@query("""WITH l AS (SELECT d.doc_id, d.text, e.text AS later FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1), a AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM l), b AS (SELECT DISTINCT doc_id, unnest(string_split(later, chr(10))) AS line FROM l)
SELECT l.doc_id, coalesce((SELECT count(*) FROM a WHERE a.doc_id = l.doc_id AND trim(a.line) <> '') > 0 AND (SELECT count(*) FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.line = b.line WHERE a.doc_id = l.doc_id AND trim(a.line) <> '' AND b.line IS NULL) = 0, false) AS within FROM l""")
def line_subset(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("later")), "doc_id")
    return pairs.select("doc_id", ft.line_subset(F.col("text"), F.col("later")).alias("within"))


@query("""WITH n AS (SELECT c_nationkey, list_sort(list_distinct(list('./' || replace(c_name, '#', '/')))) AS names FROM customer WHERE c_custkey % 9 <> 4 GROUP BY c_nationkey)
SELECT k.n_nationkey AS nation, CASE WHEN k.n_nationkey % 4 = 3 THEN md5('') ELSE md5(array_to_string(list_concat(['.'], coalesce(n.names, [])[1:149]), chr(10))) END AS tree FROM nation k LEFT JOIN n ON n.c_nationkey = k.n_nationkey""")
def tree_listing(spark, d):
    """Every nation's customers as a listing, folders with a slash behind, some hidden, some twice; every fourth has another root."""
    c = _table(spark, d, "customer")
    name = F.concat(F.lit("/workspace/"), F.when(F.col("c_custkey") % 9 == 4, F.lit(".git/")).otherwise(F.lit("")), F.replace(F.col("c_name"), F.lit("#"), F.lit("/")), F.when(F.col("c_custkey") % 2 == 0, F.lit("/")).otherwise(F.lit("")))
    lists = c.groupBy("c_nationkey").agg(F.flatten(F.collect_list(F.when(F.col("c_custkey") % 3 == 0, F.array(name, name)).otherwise(F.array(name)))).alias("l"))
    all_ = _table(spark, d, "nation").join(lists, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    listing = F.concat(F.when(F.col("n_nationkey") % 4 == 3, "/other/\n").otherwise("/workspace/\n"), F.coalesce(F.array_join("l", "\n"), F.lit("")))
    return all_.select(F.col("n_nationkey").alias("nation"), F.md5(ft.tree_listing(listing)).alias("tree"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_keep_first(spark, d):
    return sequences.keep_first(_table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])


LAST = f"WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS back FROM c)"


def _history(spark, d) -> DataFrame:
    """Per user the events as messages: calls by the assistant, each answered by a tool message that tells its status."""
    call = F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.struct("name", F.lit("{}").alias("arguments")).alias("function")))
    answer = F.format_string('{"status": "%s"}', F.when(F.col("err"), "error").otherwise("ok"))
    said = F.array(F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), call.alias("tool_calls")), F.struct(F.lit("tool").alias("role"), answer.alias("content"), F.lit(None).cast("array<struct<id:string,function:struct<name:string,arguments:string>>>").alias("tool_calls")))
    rows = calls(spark, d).select("user_id", "seq", said.alias("said")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "said"))).alias("all"))
    return rows.select("user_id", F.flatten(F.transform("all", lambda x: x["said"])).alias("messages"))


@query(f"{LAST} SELECT a.user_id FROM r a JOIN r b ON a.user_id = b.user_id AND a.back = 1 AND b.back = 2 WHERE a.name = b.name")
def selector_repeat(spark, d):
    history = fc.history_calls(F.col("messages"))
    names = F.transform(history, lambda c: c["function"])
    return _history(spark, d).where(fc.repeats_itself(names)).select("user_id")


@query(f"{LAST} SELECT user_id FROM r WHERE back = 1 AND err")
def selector_after_error(spark, d):
    return _history(spark, d).where(fc.after_error(F.col("messages"))).select("user_id")


@query("""WITH f AS (SELECT conv_id AS ctx, text AS t FROM conversations WHERE turn = 0), s AS (SELECT ctx, len(regexp_extract_all(t, 'the')) AS subs FROM f),
g AS (SELECT ctx, c AS cond, CASE WHEN c = 'prose' THEN subs ELSE 0 END AS subs FROM s, (SELECT unnest(['orig', 'prose', 'hot']) AS c)), ok AS (SELECT ctx FROM s WHERE subs > 0)
SELECT g.ctx, g.cond, CAST(k AS BIGINT) AS k, CAST(g.subs AS BIGINT) AS subs FROM g JOIN ok ON g.ctx = ok.ctx, (SELECT unnest([0, 1]) AS k)""")
def condition_grid(spark, d):
    first = _table(spark, d, "conversations").where("turn = 0")
    body = F.struct(F.array(F.struct(F.lit("system").alias("role"), F.col("text").alias("content"), F.lit(None).cast("array<struct<id:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"))).alias("messages"))
    contexts = first.select(F.col("conv_id").alias("ordinal"), body.alias("body"))
    conditions = [fr.parse_condition("orig="), fr.parse_condition("prose=subs:f", {"f": '[["the", "a"]]'}), fr.parse_condition("hot=temp:0.6")]
    return replay.grid(contexts, conditions, 2, require_subs=True).select("ctx", "cond", F.col("k").cast("long").alias("k"), "subs")


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1, 2), b AS (SELECT * FROM m WHERE event_type = 'click'),
d AS (SELECT o.event_type AS cond, o.v - b.v AS d FROM m o JOIN b ON o.user_id = b.user_id WHERE o.event_type <> 'click')
SELECT cond, count(CASE WHEN d < 0 THEN 1 END) AS lower, count(CASE WHEN d > 0 THEN 1 END) AS higher, count(CASE WHEN d = 0 THEN 1 END) AS tied FROM d GROUP BY cond""")
def paired_directions(spark, d):
    rows = _table(spark, d, "events").where("event_type in ('click', 'view', 'signup')").select(F.col("user_id").alias("ctx"), F.col("event_type").alias("cond"), "value")
    return replay.paired(rows, ["value"], "click").select("cond", "lower", "higher", "tied")


@query("""WITH c AS (SELECT user_id, count(CASE WHEN value < 10 THEN 1 END) AS lo, count(CASE WHEN value > 10 AND event_type = 'click' THEN 1 END) AS hi FROM events GROUP BY user_id),
t AS (SELECT user_id, lo + hi AS n, unnest(range(least(lo, hi) + 1)) AS i FROM c)
SELECT user_id, round(CASE WHEN n = 0 THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(CAST(2 AS DOUBLE))))) END, 6) AS p FROM t GROUP BY user_id, n""")
def sign_test(spark, d):
    counts = _table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") < 10).alias("lower"), F.count_if((F.col("value") > 10) & (F.col("event_type") == "click")).alias("higher"))
    return counts.select("user_id", F.round(selection.sign_test("lower", "higher"), 6).alias("p"))


def _samples(spark, d) -> DataFrame:
    """Assistant turns as samples: every third one calls a tool, every fifth an undeclared one, some are cut, and every seventh has a raw text with damaged arguments."""
    t = _table(spark, d, "conversations").where("role = 'assistant'")
    n = F.col("conv_id") + F.col("turn")
    tool = F.array(F.struct(F.when(n % 5 == 0, "rm").otherwise("read_file").alias("name"), F.lit("{}").alias("arguments")))
    return t.select(
        F.col("conv_id").alias("ctx"), F.when(F.col("turn") < 3, "early").otherwise("late").alias("cond"), F.col("turn").alias("k"), F.when(n % 7 == 0, F.concat(F.lit("<|tool_call>call:"), F.when(n % 2 == 0, "read_file").otherwise("rm -rf"), F.lit('{a="x}<tool_call|>'))).alias("raw"), F.when(n % 4 == 0, F.concat(F.col("text"), F.lit("<|tool_call>"))).otherwise(F.col("text")).alias("content"),
        F.when(n % 3 == 0, tool).otherwise(F.array().cast("array<struct<name:string,arguments:string>>")).alias("calls"), F.array(F.lit("read_file")).alias("declared"), F.struct(F.lit("read_file").alias("name"), F.lit("{}").alias("arguments")).alias("prev_call"),
        F.length("text").alias("completion_tokens"), F.when(F.length("text") > 900, "length").otherwise("stop").alias("finish"),
    )


METRIC = """WITH s AS (SELECT CASE WHEN turn < 3 THEN 'early' ELSE 'late' END AS cond, conv_id + turn AS n, length(text) AS chars, trim(text) AS t FROM conversations WHERE role = 'assistant'),
m AS (SELECT cond, 'malformed_name' AS metric, CASE WHEN n % 7 = 0 THEN n % 2 WHEN n % 3 = 0 AND n % 5 = 0 THEN 1 ELSE 0 END AS v FROM s UNION ALL SELECT cond, 'unparsed_call', CASE WHEN n % 4 = 0 AND n % 3 <> 0 THEN 1 ELSE 0 END FROM s
UNION ALL SELECT cond, 'unknown_tool', CASE WHEN n % 3 = 0 AND n % 5 = 0 THEN 1 ELSE 0 END FROM s UNION ALL SELECT cond, 'no_tool_call', CASE WHEN n % 3 <> 0 THEN 1 ELSE 0 END FROM s
UNION ALL SELECT cond, 'text_only', CASE WHEN n % 3 <> 0 AND n % 4 <> 0 AND t <> '' THEN 1 ELSE 0 END FROM s UNION ALL SELECT cond, 'exact_repeat', CASE WHEN n % 3 = 0 AND n % 5 <> 0 THEN 1 ELSE 0 END FROM s
UNION ALL SELECT cond, 'damaged_args', CASE WHEN n % 7 = 0 THEN 1 ELSE 0 END FROM s UNION ALL SELECT cond, 'finish_length', CASE WHEN chars > 900 THEN 1 ELSE 0 END FROM s)
SELECT cond, metric, count(*) AS n, CAST(sum(v) AS BIGINT) AS hits, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM m GROUP BY cond, metric
UNION ALL SELECT cond, 'completion_tokens', count(*), NULL, round(avg(CAST(chars AS DOUBLE)), 6) FROM s GROUP BY cond"""


@query(METRIC)
def metric_rates(spark, d):
    names = list(fc.METRICS)
    return replay.rates(replay.records(_samples(spark, d), names), names).withColumn("mean", F.round("mean", 6))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS a, b.e AS b, len(a.e) AS n FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(greatest(CAST(0 AS DOUBLE), list_max(list_transform(range(2, n), lambda i: abs(a[i] - b[i]))), a[1] - list_min(b[2:n]), b[n] - list_min(a[1:n - 1])), 6) AS delta FROM p""")
def map_delta(spark, d):
    """Neighbouring vectors as maps of token to number: one lacks the last component, the other the first."""
    e = _table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    some = lambda c, first, last: F.map_from_arrays(F.transform(F.sequence(first, last), lambda i: F.concat(F.lit("t"), i.cast("string"))), F.slice(c, first, last - first + 1))
    return pairs.select("vec_id", F.round(joins.map_delta(some("e", F.lit(1), F.size("e") - 1), some("f", F.lit(2), F.size("f"))), 6).alias("delta"))


@query("""WITH v AS (SELECT vec_id // 3 AS label, vec_id % 3 AS role, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
w AS (SELECT label, max(CASE WHEN role = 0 THEN e END) AS b, max(CASE WHEN role = 1 THEN e END) AS r, max(CASE WHEN role = 2 THEN e END) AS a FROM v GROUP BY label),
z AS (SELECT *, list_max(list_transform(range(1, len(b) + 1), lambda i: abs(b[i] - r[i]))) AS noise, list_max(list_transform(range(1, len(b) + 1), lambda i: abs(b[i] - a[i]))) AS d FROM w)
SELECT 't' || CAST(label AS VARCHAR) AS label, 'lora' AS adapter, CASE WHEN b IS NULL OR r IS NULL THEN 'base: no answer' WHEN a IS NULL THEN 'no answer' END AS error, CASE WHEN b IS NOT NULL AND r IS NOT NULL AND a IS NOT NULL THEN list_position(b, list_max(b)) <> list_position(a, list_max(a)) OR d > greatest(CAST(0.05 AS DOUBLE), 5 * noise) END AS differs,
 CASE WHEN b IS NOT NULL AND r IS NOT NULL AND a IS NOT NULL THEN round(d, 6) END AS max_dlogprob, CASE WHEN b IS NOT NULL AND r IS NOT NULL AND a IS NOT NULL THEN round(noise, 6) END AS noise, CASE WHEN b IS NOT NULL AND r IS NOT NULL AND a IS NOT NULL THEN round(greatest(CAST(0.05 AS DOUBLE), 5 * noise), 6) END AS threshold FROM z""")
def canary_verdicts(spark, d):
    """Three vectors in a row are one label: a base run, its repeat and an adapter's; all components are compared."""
    v = _table(spark, d, "embeddings")
    top = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: F.concat(F.lit("t"), i.cast("string"))), F.transform("embedding", lambda x: x.cast("double")))
    role = F.get(F.array(*map(F.lit, ("base", "base_repeat", "lora"))), (F.col("vec_id") % 3).cast("int"))
    samples = v.select(F.concat(F.lit("t"), F.expr("vec_id div 3").cast("string")).alias("label"), role.alias("role"), top.alias("top"), F.lit(None).cast("string").alias("error"))
    out = checks.canary_rows(samples, ["lora"])
    return out.select("label", "adapter", "error", "differs", *(F.round(c, 6).alias(c) for c in ("max_dlogprob", "noise", "threshold")))


@query("WITH p AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN -1 - p_partkey ELSE p_partkey END AS k FROM part), l AS (SELECT CASE WHEN l_partkey % 5 = 0 THEN 1000000000000 + l_partkey ELSE l_partkey END AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(p.k, l.k) AS name, CASE WHEN l.k IS NULL THEN 'missing' WHEN p.k IS NULL THEN 'extra' WHEN l.n <> 30 THEN 'shape_bad' ELSE 'same' END AS state FROM p FULL OUTER JOIN l ON p.k = l.k")
def key_shape_compare(spark, d):
    """Whole tables; a seventh of the parts' keys and a fifth of the line items' have other names, which only one side has."""
    k = F.col("p_partkey").cast("long")
    expected = _table(spark, d, "part").select(F.when(k % 7 == 0, -1 - k).otherwise(k).alias("name"), F.lit(30).cast("long").alias("shape"))
    k = F.col("l_partkey").cast("long")
    found = _table(spark, d, "lineitem").groupBy(F.when(k % 5 == 0, F.lit(10**12) + k).otherwise(k).alias("name")).agg(F.count("*").alias("shape"))
    return joins.compare_keys(expected, found, "name", "shape")


@query("""WITH t AS (SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n, CASE WHEN turn = 1 THEN 300 ELSE 40 END AS out FROM conversations)
SELECT conv_id, turn, n AS tokens, NOT (out > 256 OR n > 256 - out) AS ok, CASE WHEN out > 256 THEN 'max_tokens' WHEN n > 256 - out THEN 'input_tokens' END AS parameter, CAST(CASE WHEN out > 256 THEN out WHEN n > 256 - out THEN n END AS BIGINT) AS value, out <= 256 AND n = 257 - out AS at_least FROM t""")
def request_overflow(spark, d):
    t = _table(spark, d, "conversations").select("conv_id", "turn", ft.whitespace_tokens(F.col("text")).alias("tokens"), F.when(F.col("turn") == 1, 300).otherwise(40).alias("out"))
    x = fr.context_check(F.col("tokens"), F.lit(None).cast("int"), F.col("out"), 256)
    return t.select("conv_id", "turn", "tokens", x.alias("x")).select("conv_id", "turn", "tokens", "x.ok", "x.parameter", "x.value", (F.col("x.qualifier") != "").alias("at_least"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'single' WHEN 1 THEN 'double' WHEN 2 THEN 'raw' WHEN 3 THEN 'single' WHEN 4 THEN 'parts' ELSE 'other' END AS encoding FROM events")
def encoding_detect(spark, d):
    """Every event's props as a tool's result: as they are, wrapped, no JSON, wrapped words, a list of parts, or an object."""
    p = F.col("props")
    texts = [p, F.to_json(F.struct(p.alias("result"))), F.concat(F.lit("not json "), p), F.to_json(F.struct(F.concat(F.lit("plain "), p).alias("result")))]
    given = [*(F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2) for t in texts), F.to_json(F.array(F.struct(F.lit("text").alias("type"), p.alias("text")))), p]
    return _table(spark, d, "events").select("event_id", ft.variant_encoding(F.parse_json(F.get(F.array(*given), (F.col("event_id") % 6).cast("int")))).alias("encoding"))


def _smoke(spark, d) -> DataFrame:
    e = _table(spark, d, "events")
    return e.select(F.col("event_id").alias("ordinal"), F.col("event_type").alias("role"), F.concat(F.lit("head "), (F.col("user_id") % 3).cast("string")).alias("system_head"), F.array(F.lit("t"), F.col("event_id").cast("string")).alias("tools"), (F.col("user_id") % 2 == 0).alias("enable_thinking"), (F.col("user_id") % 3 * 64).cast("int").alias("thinking_token_budget"), F.lit(512).alias("max_tokens"), F.lit(0.5).alias("temperature"), F.lit(40).alias("top_k"))


@query("SELECT event_type AS role, 'head ' || CAST(user_id % 3 AS VARCHAR) AS head, user_id % 2 = 0 AS enable_thinking, CAST(user_id % 3 * 64 AS INTEGER) AS thinking_token_budget, 512 AS max_tokens, CAST(0.5 AS DOUBLE) AS temperature, 40 AS top_k, count(*) AS requests FROM events GROUP BY 1, 2, 3, 4")
def settings_counter(spark, d):
    return checks.smoke_settings(_smoke(spark, d))


@query("SELECT event_type AS role, 'head ' || CAST(user_id % 3 AS VARCHAR) AS head, count(*) AS requests, CAST(min(event_id) AS VARCHAR) AS first_tool FROM events GROUP BY 1, 2")
def settings_agents(spark, d):
    return checks.smoke_agents(_smoke(spark, d)).select("role", "head", "requests", F.element_at("tools", 2).alias("first_tool"))


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS tokens, max(n_chars) AS max_len, CAST(floor(median(n_chars)) AS BIGINT) AS p50_len, round(avg(CASE WHEN n_chars <= 4096 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS share_le_4096, round(avg(CASE WHEN n_chars <= 8192 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS share_le_8192 FROM documents")
def length_stats(spark, d):
    return checks.length_stats(_table(spark, d, "documents"), "n_chars")


BUCKETS = "b AS (SELECT doc_id, CASE WHEN n_chars <= 512 THEN 512 WHEN n_chars <= 2048 THEN 2048 ELSE 8192 END AS bucket FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS n, count(*) OVER (PARTITION BY bucket) AS total FROM b), s AS (SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, CAST(n // 2 AS BIGINT) AS step_in_bucket, (n // 2 + 1) * 2 <= total AS full FROM r)"


def _buckets(spark, d) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "n_chars", F.shiftleft(F.col("doc_id"), 34).alias("spread"))
    return sequences.bucket_plan(docs, "n_chars", "spread", ["doc_id"], [512, 2048, 8192], 2).select("doc_id", F.col("bucket").cast("long").alias("bucket"), "step_in_bucket", "full")


@query(f"WITH {BUCKETS} SELECT * FROM s")
def bucket_plan(spark, d):
    return _buckets(spark, d)


@query(f"WITH {BUCKETS} SELECT 0 AS epoch, bucket, max(step_in_bucket) + 1 AS steps FROM s GROUP BY bucket")
def bucket_steps(spark, d):
    return checks.plan_stats(_buckets(spark, d).withColumn("epoch", F.lit(0)))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'unresolved' WHEN o_totalprice > 300000 THEN 'too_long' END AS why FROM orders),
r AS (SELECT *, coalesce(sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT o_orderkey, CASE WHEN why = 'unresolved' THEN why WHEN before >= 2 THEN 'per_instance' ELSE why END AS reason FROM r""")
def capped_per_key(spark, d):
    o = _table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", "unresolved").when(F.col("o_totalprice") > 300000, "too_long").alias("reason"))
    out = sequences.capped(o.withColumn("ok", F.col("reason").isNull()).withColumn("first", F.col("reason")), "o_custkey", ["o_orderkey"], "ok", 2)
    return out.select("o_orderkey", F.when(F.col("first") == "unresolved", "unresolved").otherwise(F.col("reason")).alias("reason"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'unresolved' WHEN o_totalprice > 300000 THEN 'too_long' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY reason")
def reason_counts(spark, d):
    from ..operators.convert import reasons

    return reasons(_table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "unresolved").when(F.col("o_totalprice") > 300000, "too_long").alias("reason")))


@query("""WITH RECURSIVE l AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderkey % 3 AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F'), q AS (SELECT o_custkey AS k, o_orderkey AS o, (o_orderkey // 3) % 3 AS size FROM orders WHERE o_orderstatus <> 'O'),
r AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS took FROM l GROUP BY k
 UNION ALL SELECT x.k, x.n, coalesce(x.took, x.used), x.ord, x.took FROM (SELECT r.k, l.n, r.used, l.o AS ord, min(q.o) AS took FROM r JOIN l ON l.k = r.k AND l.n = r.n + 1 LEFT JOIN q ON q.k = r.k AND q.size = l.size AND q.o > r.used GROUP BY r.k, l.n, r.used, l.o) x)
SELECT k AS key, ord, took FROM r WHERE n > 0""")
def sequenced_match(spark, d):
    """Open and pending orders take, in order, the customer's next filled or pending one of equal size; many find none."""
    o = _table(spark, d, "orders")
    left = o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3).alias("size"))
    right = o.where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("at"), F.expr("(o_orderkey div 3) % 3").alias("size"), F.col("o_orderkey").alias("took"))
    return joins.sequenced_match(left, right, "key", "ord", "at", ["size"], "took").select("key", "ord", "took")


@query(f"""WITH RECURSIVE {CALLS}, t AS (SELECT user_id, seq, name, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 + event_id % 3 END AS k FROM c),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS name, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS kept FROM (SELECT DISTINCT user_id FROM t)
 UNION ALL SELECT t.user_id, t.seq, t.name, CASE WHEN coalesce(t.name = r.name, false) AND t.k = r.k THEN r.k ELSE t.k END, r.kept + CASE WHEN coalesce(t.name = r.name, false) AND t.name <> 'signup' AND (t.k = r.k OR r.k > 0 AND t.k > r.k) THEN 0 ELSE 1 END FROM r JOIN t ON t.user_id = r.user_id AND t.seq = r.seq + 1)
SELECT user_id, max(kept) AS n_kept, max(seq) - max(kept) AS n_dropped FROM r GROUP BY user_id""")
def collapse_adjacent(spark, d):
    """Events as turns whose results have none to three lines, each a part of the longer ones; signups are never folded."""
    lines = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(F.array_join(F.slice(F.array(*map(F.lit, ("one", "two", "three"))), F.lit(1), (1 + F.col("event_id") % 3).cast("int")), "\n"))
    c = calls(spark, d).select("user_id", "seq", "name", F.lit("{}").alias("args"), lines.alias("result"))
    return sequences.collapse_adjacent(c, ["user_id"], ["seq"], "name", "args", "result", keep_apart="signup").select("user_id", "n_kept", "n_dropped")


@query("SELECT o_orderkey, round(CASE WHEN s <= 20 THEN s * CAST(0.001 AS DOUBLE) / 20 WHEN s <= 100 THEN CAST(0.001 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) * (CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * CAST(0.5 AS DOUBLE) * (1 + cos(pi() * least(CAST(1 AS DOUBLE), (s - 100) / CAST(200 AS DOUBLE))))) END, 9) AS rate FROM (SELECT o_orderkey, o_custkey % 400 AS s FROM orders)")
def lr_schedule(spark, d):
    steps = _table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 400).alias("step"))
    return checks.learning_rates(steps, "step", 0.001, 20, 100, 300, 0.1).select("o_orderkey", F.round("rate", 9).alias("rate"))


@query("""WITH s AS (SELECT user_id AS run, event_id AS step, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS t, CAST(3600 AS DOUBLE) - event_id % 5000 AS room FROM events)
SELECT run, step, greatest(least(20000, step + greatest(CAST(floor(CAST(0.97 AS DOUBLE) * room / (t + 2 * CAST(43 AS DOUBLE) / 50)) AS BIGINT), 0)), step) AS horizon FROM s""")
def horizon_fit(spark, d):
    """Every event as a training step of its user: how many steps still fit, and where the schedule is to end."""
    rows = _table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value", (F.lit(3600.0) - F.col("event_id") % 5000).alias("room"))
    timed = checks.trailing_mean(rows, "step", "value", 300, "t", ["run"])
    return timed.select("run", "step", checks.horizon(F.col("step"), F.col("t"), F.lit(43.0), F.col("room"), 20_000, 50, 2).alias("horizon"))


@query("SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user FROM conversations")
def context_asof_call(spark, d):
    c = _table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("u"))
    return sequences.last_known(c, ["conv_id"], ["turn"], "u", "last_user").select("conv_id", "turn", "last_user")


@query("""WITH c AS (SELECT conv_id, turn, role = 'assistant' AS emits, 't' || CAST(turn AS VARCHAR) AS t FROM conversations), g AS (SELECT *, coalesce(sum(CASE WHEN emits THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM c)
SELECT conv_id, max(turn) AS turn, string_agg(t, '|' ORDER BY turn) AS carried FROM g GROUP BY conv_id, grp HAVING bool_or(emits)""")
def reasoning_carried(spark, d):
    c = _table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("emits"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("t"))
    return sequences.carry_groups(c, ["conv_id"], ["turn"], "emits", "t", "carried", "|")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def resume_anti_join(spark, d):
    done = _table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.not_done(_table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT 'click' AS log, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'view', count(*) FROM events WHERE event_type = 'view'")
def union_logs(spark, d):
    e = _table(spark, d, "events")
    both = e.where("event_type = 'click'").unionByName(e.where("event_type = 'view'"))
    return checks.outcome_counts(both.withColumnRenamed("event_type", "log"), "log")


@query("WITH f AS (SELECT *, min(event_id) OVER (PARTITION BY event_type) AS first FROM events) SELECT event_type, round(median(value), 6) AS median_s FROM f WHERE event_id > first GROUP BY event_type")
def step_medians(spark, d):
    return checks.step_medians(_table(spark, d, "events"), "event_type", "event_id", "value").withColumn("median_s", F.round("median_s", 6))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS mean_s FROM events")
def horizon_mean(spark, d):
    return checks.trailing_mean(_table(spark, d, "events"), "event_id", "value", 30, "mean_s", ["user_id"]).select("user_id", "event_id", F.round("mean_s", 6).alias("mean_s"))


@query("SELECT l_returnflag, round(sum(l_quantity * CAST(l_linenumber % 2 AS DOUBLE)) / greatest(sum(CAST(l_linenumber % 2 AS DOUBLE)), 1), 6) AS loss FROM lineitem GROUP BY l_returnflag")
def masked_loss_mean(spark, d):
    rows = _table(spark, d, "lineitem").withColumn("w", (F.col("l_linenumber") % 2).cast("double"))
    return rows.groupBy("l_returnflag").agg(F.round(checks.masked_mean("l_quantity", "w"), 6).alias("loss"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE round(p_retailprice * [pow(2, -20), pow(2, -10), CAST(1 AS DOUBLE), CAST(1024 AS DOUBLE)][p_partkey % 4 + 1], 3) END AS gib FROM part""")
def memory_figures(spark, d):
    """Every part's price as the figure of an out-of-memory message, in four units; every fifth message has none."""
    n, price = F.col("p_partkey"), F.concat(F.col("p_retailprice").cast("string"), F.get(F.array(*map(F.lit, "KMGT")), (F.col("p_partkey") % 4).cast("int")))
    said = F.when(n % 5 == 4, "fine").when(n % 2 == 0, F.concat(F.lit("HLO temporaries ("), price, F.lit(") exceeds available HBM"))).otherwise(F.concat(F.lit("Used "), price, F.lit(" of 1G")))
    return _table(spark, d, "part").select("p_partkey", ft.memory_gib(said).alias("gib"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat([p_partkey % 8], range(p_partkey % 5, p_partkey % 5 + p_size % 4 + 1)))), ',') AS layers FROM part")
def layer_specs(spark, d):
    n = lambda c, m: (F.col(c) % m).cast("string")
    spec = F.concat(n("p_partkey", 8), F.lit(", "), n("p_partkey", 5), F.lit("-"), (F.col("p_partkey") % 5 + F.col("p_size") % 4).cast("string"))
    return _table(spark, d, "part").select("p_partkey", F.array_join(ft.layer_numbers(spec).cast("array<string>"), ",").alias("layers"))


TOKENS = f"""{CALLS}, t AS (SELECT user_id, seq, CAST(CASE name WHEN 'click' THEN 100 WHEN 'view' THEN 101 ELSE event_id % 90 END AS INTEGER) AS t FROM c)"""


@query(f"""WITH RECURSIVE {TOKENS},
r AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS INTEGER) AS emit, false AS inside, 0 AS cnt, false AS forced FROM (SELECT DISTINCT user_id FROM t)
 UNION ALL SELECT user_id, seq, emit, now AND n < 2, n, now AND n >= 2 FROM (SELECT x.user_id, x.seq, x.emit, CASE WHEN x.f THEN false WHEN x.emit = 100 THEN true WHEN x.emit = 101 THEN false ELSE x.inside END AS now, CASE WHEN NOT x.f AND x.emit IN (100, 101) THEN 0 WHEN NOT x.f AND x.inside THEN x.cnt + 1 ELSE x.cnt END AS n
  FROM (SELECT r.user_id, t.seq, CASE WHEN r.forced THEN 101 ELSE t.t END AS emit, r.inside, r.cnt, r.forced AS f FROM r JOIN t ON t.user_id = r.user_id AND t.seq = r.seq + 1) x) y)
SELECT user_id, md5(string_agg(CAST(emit AS VARCHAR), ',' ORDER BY seq)) AS emitted, count(CASE WHEN emit = 101 THEN 1 END) AS closed FROM r WHERE seq > 0 GROUP BY user_id""")
def thinking_budget(spark, d):
    """Every user's events as a model's tokens: clicks open a thought, views close it; two tokens are the budget."""
    t = F.when(F.col("name") == "click", 100).when(F.col("name") == "view", 101).otherwise((F.col("event_id") % 90).cast("int"))
    rows = calls(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", t.alias("t")))).alias("all")).select("user_id", fr.budgeted(F.transform("all", lambda x: x["t"]), 2).alias("out"))
    return rows.select("user_id", F.md5(F.array_join(F.col("out").cast("array<string>"), ",")).alias("emitted"), F.size(F.filter("out", lambda x: x == 101)).cast("long").alias("closed"))


def _conversions(spark, d) -> DataFrame:
    """Conversations as raw trajectories: an assistant turn runs a command, and the last one also finishes."""
    from ..operators.convert import convert

    c = _table(spark, d, "conversations")
    end = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("end"))
    call = lambda name, args: F.struct(F.concat_ws("-", F.lit(name), F.col("turn").cast("string")).alias("id"), F.lit("function").alias("type"), F.struct(F.lit(name).alias("name"), args.alias("arguments")).alias("function"))
    bash = call("execute_bash", F.to_json(F.struct(F.concat(F.lit("cat /workspace/r__1/f"), F.col("turn").cast("string")).alias("command"))))
    kinds = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
    none = F.lit(None).cast("string")
    said = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"), none.alias("name"), none.alias("tool_call_id"), F.when(F.col("turn") == F.col("end"), F.array(bash, call("finish", F.lit("{}")))).otherwise(F.array(bash)).cast(kinds).alias("tool_calls"))
    seen = F.struct(F.lit("tool").alias("role"), F.concat(F.col("text"), F.lit("\n[The command completed with exit code 0.]")).alias("content"), F.lit("execute_bash").alias("name"), F.concat_ws("-", F.lit("execute_bash"), F.col("turn").cast("string")).alias("tool_call_id"), F.lit(None).cast(kinds).alias("tool_calls"))
    turns = c.where("role = 'assistant'").join(end, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.array(said, seen).alias("m")))).alias("t"))
    user = F.struct(F.lit("user").alias("role"), F.lit("<uploaded_files>\n/workspace/r__1\n</uploaded_files>\n<issue_description>\nfix\n</issue_description>").alias("content"), none.alias("name"), none.alias("tool_call_id"), F.lit(None).cast(kinds).alias("tool_calls"))
    rows = turns.select(F.col("conv_id").alias("ordinal"), F.concat(F.lit("i"), F.expr("conv_id div 4").cast("string")).alias("instance_id"), F.lit("r").alias("repo"), F.when(F.col("conv_id") % 5 == 0, 0).otherwise(1).alias("resolved"), F.concat(F.array(user), F.flatten(F.transform("t", lambda x: x["m"]))).alias("trajectory"), F.lit("diff --git a/x b/x\n").alias("model_patch"))
    return convert(rows, max_turns=3)


@query("""WITH t AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id), w AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'unresolved' WHEN n > 3 THEN 'too_long' END AS why FROM t),
r AS (SELECT *, coalesce(sum(CASE WHEN why IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id // 4 ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w), x AS (SELECT c.conv_id, 2 * count(*) + 2 AS n_messages, md5(string_agg(trim(c.text) || '|cat /workspace/f' || CAST(c.turn AS VARCHAR) || '|' || rtrim(c.text, chr(10)), '~' ORDER BY c.turn)) AS said FROM conversations c WHERE c.role = 'assistant' GROUP BY c.conv_id)
SELECT r.conv_id AS ordinal, CASE WHEN why = 'unresolved' THEN why WHEN before >= 2 THEN 'per_instance' ELSE why END AS reason, CAST(CASE WHEN why IS NULL AND before < 2 THEN n END AS BIGINT) AS n_turns, CASE WHEN why IS NULL AND before < 2 THEN n_messages END AS n_messages, CASE WHEN why IS NULL AND before < 2 THEN said END AS said FROM r JOIN x ON x.conv_id = r.conv_id""")
def convert_trajectories(spark, d):
    """Reasons and turns, the count of messages, and a digest of every turn's reasoning, command and output."""
    out, m = _conversions(spark, d), F.col("conversation.messages")
    turn = lambda x, i: F.concat_ws("|", x["reasoning"], F.get_json_object(x["tool_calls"][0]["function"]["arguments"], "$.command"), F.get_json_object(F.get(m, i + 1)["content"], "$.stdout"))
    said = F.filter(F.transform(m, lambda x, i: F.when((x["role"] == "assistant") & (F.coalesce(F.size(x["tool_calls"]), F.lit(0)) > 0), turn(x, i))), lambda t: t.isNotNull())
    return out.select("ordinal", "reason", F.col("conversation.n_turns").cast("long").alias("n_turns"), F.size(m).cast("long").alias("n_messages"), F.md5(F.array_join(said, "~")).alias("said")).withColumn("n_messages", F.when(F.col("reason").isNull(), F.col("n_messages")))


@query(r"""WITH RECURSIVE c AS (SELECT conv_id, turn, role = 'assistant' AS target, text, count(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS unit FROM conversations),
h AS (SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE unit = 0), '') AS head FROM c GROUP BY conv_id),
u AS (SELECT conv_id, unit - 1 AS u, max(CASE WHEN target THEN text END) AS said, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE NOT target), '') AS behind, CASE WHEN max(CASE WHEN target THEN turn END) % 5 = 3 THEN 0 ELSE 1 END AS train FROM c WHERE unit > 0 GROUP BY conv_id, unit),
p AS (SELECT *, sum(len(regexp_extract_all(said, '\S+')) + len(regexp_extract_all(behind, '\S+'))) OVER (PARTITION BY conv_id ORDER BY u) AS upto, sum(len(regexp_extract_all(said, '\S+')) + len(regexp_extract_all(behind, '\S+'))) OVER (PARTITION BY conv_id ORDER BY u) - len(regexp_extract_all(said, '\S+')) - len(regexp_extract_all(behind, '\S+')) AS before FROM u),
f AS (SELECT a.conv_id, a.u AS s, coalesce(max(b.u) + 1, a.u) AS e FROM p a JOIN h ON h.conv_id = a.conv_id LEFT JOIN p b ON b.conv_id = a.conv_id AND b.u >= a.u AND b.upto - a.before <= 400 - len(regexp_extract_all(h.head, '\S+')) GROUP BY a.conv_id, a.u),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS e, false AS made FROM h
 UNION ALL SELECT conv_id, s, first, e, made OR EXISTS (SELECT 1 FROM u WHERE u.conv_id = x.conv_id AND u.u >= x.first AND u.u < x.e AND u.train = 1) FROM (SELECT w.conv_id, w.e AS first, CASE WHEN f1.e > w.e THEN f1.s ELSE f2.s END AS s, CASE WHEN f1.e > w.e THEN f1.e ELSE f2.e END AS e, w.made
  FROM w JOIN f f1 ON f1.conv_id = w.conv_id AND f1.s = CASE WHEN w.made THEN greatest(0, w.e - 2) ELSE 0 END JOIN f f2 ON f2.conv_id = w.conv_id AND f2.s = greatest(0, w.e - 1) WHERE EXISTS (SELECT 1 FROM u WHERE u.conv_id = w.conv_id AND u.u = w.e) AND greatest(CASE WHEN f1.e > w.e THEN f1.e ELSE f2.e END, w.e) > w.e) x),
o AS (SELECT w.conv_id, w.first, w.s, w.e, u.u, CASE WHEN u.u >= w.first THEN u.train ELSE 0 END AS flag, u.said, u.behind FROM w JOIN u ON u.conv_id = w.conv_id AND u.u >= w.s AND u.u < w.e WHERE w.e > 0)
SELECT CAST(o.conv_id AS VARCHAR) AS instance_id, CAST(sum(flag) AS BIGINT) AS turns, 2 * count(*) AS segments, md5(h.head || '|0' || string_agg('~' || said || '|' || flag || CASE WHEN o.u < o.e - 1 THEN '~' || behind || '|0' ELSE '' END, '' ORDER BY o.u)) AS digest
FROM o JOIN h ON h.conv_id = o.conv_id GROUP BY o.conv_id, o.first, o.s, o.e, h.head HAVING sum(flag) > 0""")
def pack_windows(spark, d):
    """Conversations as segments (what precedes the first answer, then answers and what stands between them), packed under 400 words."""
    from ..operators.windows import packed

    c = _table(spark, d, "conversations")
    unit = F.count_if(F.col("role") == "assistant").over(sequences._ordered(["conv_id"], ["turn"]).rowsBetween(Window.unboundedPreceding, 0))
    parts = c.select("conv_id", "turn", "text", (F.col("role") == "assistant").alias("target"), unit.alias("unit")).groupBy("conv_id", "unit").agg(
        F.max(F.when(F.col("target"), F.col("text"))).alias("said"), F.max(F.when(F.col("target"), F.col("turn"))).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("target"), F.struct("turn", "text")))), lambda x: x["text"]), "\n").alias("behind"),
    )
    segment = lambda text, train: F.struct(text.alias("text"), train.cast("int").alias("train"))
    own = F.when(F.col("unit") == 0, F.array(segment(F.col("behind"), F.lit(0)))).otherwise(F.array(segment(F.col("said"), F.when(F.col("at") % 5 == 3, 0).otherwise(1)), segment(F.col("behind"), F.lit(0))))
    all_ = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit", own.alias("s")))), lambda x: x["s"]))
    rows = parts.groupBy("conv_id").agg(all_.alias("s"), F.min("unit").alias("first")).select(F.col("conv_id").cast("string").alias("instance_id"), F.when(F.col("first") > 0, F.concat(F.array(segment(F.lit(""), F.lit(0))), F.col("s"))).otherwise(F.col("s")).alias("segments"))
    out = packed(rows, most=400)
    digest = F.md5(F.array_join(F.transform("segments", lambda x: F.concat(x["text"], F.lit("|"), x["train"].cast("string"))), "~"))
    return out.select("instance_id", F.col("turns").cast("long").alias("turns"), F.size("segments").cast("long").alias("segments"), digest.alias("digest"))


@query("""WITH e AS (SELECT doc_id, unnest([0, 1]) AS epoch, CASE WHEN n_chars <= 512 THEN 512 WHEN n_chars <= 2048 THEN 2048 ELSE 8192 END AS bucket FROM documents),
s AS (SELECT *, CAST('0x' || left(md5(CAST(1 + epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 15) AS BIGINT) AS spread FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY epoch, bucket ORDER BY spread, doc_id) - 1 AS n, count(*) OVER (PARTITION BY epoch, bucket) AS total FROM s)
SELECT doc_id, epoch, CAST(bucket AS BIGINT) AS bucket, n // 2 AS step_in_bucket, (n // 2 + 1) * 2 <= total AS full FROM r""")
def epoch_plan(spark, d):
    docs = _table(spark, d, "documents").select("doc_id", "n_chars")
    return checks.epoch_plan(docs, "doc_id", "n_chars", [512, 2048, 8192], 2, 2, 1).select("doc_id", "epoch", F.col("bucket").cast("long").alias("bucket"), "step_in_bucket", "full")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
