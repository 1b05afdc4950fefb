"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A window is the shortest run of lines from a line on that has WINDOW lines or CHARS characters, so long lines
are windows by themselves. Of every window the line with the least hash is a fingerprint (of equal ones the last).
Two places with the same window select the same line in it, so every repeated run that holds a window shares a
fingerprint with its earlier occurrence. Fingerprints that occur once are dropped; at the others' positions the
match is extended both ways, over all windows that hold the position, and windows are joined by a 128-bit digest
of their lines. What an earlier window already holds is deleted, so the union of windows deletes whole runs,
however long. Each fingerprint and window meets its first occurrence only, never all its pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved

#: Lines of a window, or characters in fewer of them: runs from this length on are found without fail.
WINDOW, CHARS = 3, 200


def _lined(docs: DataFrame, text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", F.xxhash64(value).alias("_h"), F.split(value, "\n", -1).alias("lines"))


def _reach(window: int, chars: int) -> str:
    """How many lines the window from line s has; 0 where the text ends before it is full."""
    long = [f"when s + {k} <= size(sizes) and {' + '.join(f'sizes[s + {i}]' for i in range(k))} >= {chars} then {k}" for k in range(1, window)]
    return f"case {' '.join(long)} when s + {window} <= size(sizes) then {window} else 0 end"


def fingerprints(docs: DataFrame, text: str = "text", window: int = WINDOW, chars: int = CHARS) -> DataFrame:
    """doc_id, _h (the text's hash), fp, and the windows that hold the fingerprint: structs of s (first line), k (lines) and g (digest).

    Windows without a non-blank line are no windows. Texts without a full window have no rows.
    """
    lined = _lined(docs, text).where(f"size(lines) >= {min(window, 2)} or length(lines[0]) >= {chars}")
    marked = lined.select(
        "doc_id", "_h", "lines", F.expr("transform(lines, l -> length(l))").alias("sizes"), F.expr("transform(lines, (l, i) -> named_struct('v', xxhash64(l), 'p', -i))").alias("marks"),
    )
    reached = marked.select("doc_id", "_h", "lines", "marks", F.expr(f"transform(sequence(0, size(sizes) - 1), s -> {_reach(window, chars)})").alias("ks"))
    least = "transform(filter(transform(ks, (k, s) -> named_struct('s', s, 'k', k)), x -> x.k > 0), x -> -array_min(slice(marks, x.s + 1, x.k)).p)"
    chosen = reached.select("doc_id", "_h", "lines", "marks", "ks", F.explode(F.expr(f"array_distinct({least})")).alias("p"))
    held = "slice(lines, s + 1, ks[s])"
    around = f"transform(filter(sequence(greatest(0, p - {window - 1}), p), s -> s + ks[s] > p), s -> named_struct('s', s, 'k', ks[s], 'g', if(array_join({held}, '') rlike '\\\\S', unhex(md5(array_join({held}, '\n'))), null)))"
    return chosen.select("doc_id", "_h", F.expr("marks[p].v").alias("fp"), F.expr(f"filter({around}, x -> x.g is not null)").alias("windows"))


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW, chars: int = CHARS) -> DataFrame:
    """doc_id, _h, s, k: windows whose lines occur earlier, in the order of doc_id (null last), text hash and line."""
    found = fingerprints(docs, text, window, chars)
    # written first: a join whose sides both come from an exchange is one whose crowded parts Spark splits
    several = saved(found.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
    windows = saved(found.join(several, "fp", "left_semi").select("doc_id", "_h", F.explode("windows").alias("x")).select("doc_id", "_h", "x.s", "x.k", "x.g").distinct())
    order = "struct(doc_id is null as o, doc_id as d, _h as h, s as s)"
    first = saved(windows.groupBy("g").agg(F.expr(f"min({order})").alias("first"), F.count("*").alias("n")).where("n > 1").select("g", "first"))
    return windows.join(first, "g").where(F.expr(f"{order} > first")).select("doc_id", "_h", "s", "k")


def dedup_lines(docs: DataFrame, text: str = "text", window: int = WINDOW, chars: int = CHARS) -> DataFrame:
    """The rows of ``docs`` with the repeated runs of lines deleted, and n_lines_removed.

    A run counts from ``window`` lines or ``chars`` characters on; shorter repeats stay, as they are in most texts by
    chance. Lines are parted by U+000A and compared exactly. The first occurrence in the order of doc_id stays;
    runs within one text count too. A null text stays null and an empty one empty; a text whose lines all go
    becomes empty; texts without repeated runs stay as they are. Rows with equal doc_id and text are one
    document and lose the same lines. Other columns stay, except that one named n_lines_removed gives way.
    """
    own = {n: f"_trajecta_{n}" for n in ("hash", "doc", "h", "gone", "lines")}
    gone = repeated_windows(docs, text, window, chars).groupBy("doc_id", "_h").agg(F.expr("array_distinct(flatten(transform(collect_set(struct(s, k)), x -> sequence(x.s, x.s + x.k - 1))))").alias(own["gone"]))
    gone = gone.select(F.col("doc_id").alias(own["doc"]), F.col("_h").alias(own["h"]), own["gone"])
    joined = docs.withColumn(own["hash"], F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(gone, F.expr(f"{own['hash']} = {own['h']} and doc_id <=> {own['doc']}"), "left")
    # the lines have two readers, so the optimiser keeps them as a column instead of splitting the text anew for every line
    split = joined.withColumn(own["lines"], F.when(F.col(own["gone"]).isNotNull(), F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)))
    cleaned = F.when(F.col(own["gone"]).isNull(), F.col(text)).otherwise(F.expr(f"array_join(transform(array_except(sequence(0, size({own['lines']}) - 1), {own['gone']}), i -> {own['lines']}[i]), '\n')"))
    kept = [c for c in docs.columns if c != "n_lines_removed"]
    return split.select(*(cleaned.alias(c) if c == text else F.col(c) for c in kept), F.coalesce(F.size(own["gone"]), F.lit(0)).alias("n_lines_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("n_lines_removed").cast("long").alias("n_lines_removed"), F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS s, lines FROM l),
k AS (SELECT doc_id, s, lines, CASE WHEN length(lines[s]) >= 200 THEN 1 WHEN s + 1 <= len(lines) AND length(lines[s]) + length(lines[s + 1]) >= 200 THEN 2 WHEN s + 2 <= len(lines) THEN 3 ELSE 0 END AS k FROM w),
g AS (SELECT doc_id, s, k, array_to_string(lines[s:s + k - 1], chr(10)) AS g FROM k WHERE k > 0),
r AS (SELECT doc_id, s, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM g WHERE regexp_matches(g, '\S')),
d AS (SELECT DISTINCT doc_id, s + v.k AS i FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 AND v.k < r.k),
x AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM l),
o AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) FILTER (WHERE d.i IS NULL) AS kept, count(d.i) AS gone
      FROM x LEFT JOIN d ON x.doc_id = d.doc_id AND x.i = d.i GROUP BY x.doc_id)
SELECT doc_id, CAST(gone AS BIGINT) AS n_lines_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars_left, sha256(coalesce(kept, '')) AS text_sha256 FROM o
"""
