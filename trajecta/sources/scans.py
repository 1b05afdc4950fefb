"""Ordered scans: rows with the position they had in their files, which later operators take as their order."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema

TRAJECTORY_COLUMNS = ["instance_id", "repo", "resolved", "trajectory", "model_patch"]
PATCH_COLUMNS = ["instance_id", "resolved", "model_patch"]


#: Bits of an ordinal below a file's rank: row indexes, or a split's mebibyte and the line within its task.
ROW_BITS, SPLIT_BITS, LINE_BITS = 40, 20, 28


def _ranked(rows: DataFrame, bits: int, first: int = 0) -> tuple[DataFrame, int]:
    """Adds _base: the file's rank (from ``first`` on) among the plan's own input files, by path, times 2**bits; and the next rank.

    No row is read for it. Raises ValueError where the ranks do not fit beside ``bits``.
    """
    files = sorted(rows.inputFiles())
    if (first + len(files)) >> (63 - bits):
        raise ValueError(f"{first + len(files)} files are too many to number; join small files")
    bare = r"^(\w+):/+"  # the two tell an empty authority apart: file:/// and file:/
    ranks = rows.sparkSession.createDataFrame([(re.sub(bare, r"\1:/", f), (first + n) << bits) for n, f in enumerate(files)], "_path string, _base long")
    return rows.withColumn("_path", F.regexp_replace("_metadata.file_path", bare, "$1:/")).join(F.broadcast(ranks), "_path"), first + len(files)  # a row per file


def parquet_ordered(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet files below a path with an ordinal: files by path, rows by their index. The columns reach the reader.

    The ordinal counts within a file from the file's rank times 2**40, so no row is counted or moved.
    """
    rows = spark.read.option("recursiveFileLookup", "true").parquet(*([path] if isinstance(path, str) else path))
    chosen = list(columns) if columns else rows.columns
    placed, _ = _ranked(rows.select("_metadata", *chosen), ROW_BITS)
    return placed.select((F.col("_base") + F.col("_metadata.row_index")).alias("ordinal"), *chosen)


def ordered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """ordinal and value of every line: paths in the given order, files by path, splits by their place, lines as they come.

    Lines are read in the JVM; an ordinal only grows, and is not dense.
    """
    out, first = None, 0
    for path in [paths] if isinstance(paths, str) else paths:
        # numbered where they are read: the counter grows within a task, and a split starts at a mebibyte of its own
        within = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 20), LINE_BITS) + (F.monotonically_increasing_id() % F.lit(1 << LINE_BITS))
        placed, first = _ranked(spark.read.text(path).select("_metadata", "value", within.alias("_within")), SPLIT_BITS + LINE_BITS, first)
        one = placed.select((F.col("_base") + F.col("_within")).alias("ordinal"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def jsonl_ordered(spark: SparkSession, paths: str | Sequence[str], ddl: str) -> DataFrame:
    """JSON lines with an ordinal (see ordered_lines); blank lines are skipped."""
    lines = ordered_lines(spark, paths).where("trim(value) <> ''")
    return lines.select("ordinal", F.from_json("value", ddl).alias("_v")).select("ordinal", "_v.*")


def trajectories(spark: SparkSession, path: str, groups: str | None = None) -> DataFrame:
    """Raw trajectories from Parquet (a file or folder) or JSON lines; ``groups`` lo-hi takes those row groups of each file."""
    if path.endswith(".jsonl"):
        return jsonl_ordered(spark, path, schema.RAW_TRAJECTORY)
    rows = parquet_ordered(spark, path, TRAJECTORY_COLUMNS)
    return row_groups(rows, group_ranges(spark, path, *map(int, groups.split("-")))) if groups else rows


def patches(spark: SparkSession, path: str) -> DataFrame:
    """instance_id, resolved and model_patch in the same order as trajectories()."""
    if path.endswith(".jsonl"):
        return jsonl_ordered(spark, path, schema.PATCH)
    return parquet_ordered(spark, path, PATCH_COLUMNS)


def conversations(spark: SparkSession, path: str) -> DataFrame:
    return jsonl_ordered(spark, path, schema.CONVERSATION) if path.endswith(".jsonl") else parquet_ordered(spark, path)


def request_log(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Full request logs."""
    return jsonl_ordered(spark, paths, schema.REQUEST_LOG)


def contexts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Logged or bare requests as ordinal, body, raw: answered ones with messages only. Every line is parsed once, as either."""
    fields = _ddl(schema.BODY[len("struct<") : -1])
    either = jsonl_ordered(spark, paths, f"{schema.REQUEST_LOG}, {fields}")
    own = [f.split(" ", 1)[0] for f in _split(fields)]
    logged = F.col("body").isNotNull()
    kept = either.select("ordinal", F.when(logged, F.col("body")).otherwise(F.struct(*own)).alias("body"), F.when(logged, F.col("raw")).alias("raw"), "status")
    return kept.where((F.coalesce("status", F.lit(200)) == 200) & (F.coalesce(F.size("body.messages"), F.lit(0)) > 0)).drop("status")


def _split(fields: str) -> list[str]:
    """The columns of a table's DDL: cut at commas outside brackets."""
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def _ddl(fields: str) -> str:
    """Fields of a struct type as a table's columns: the commas and colons outside brackets change."""
    out, depth, named = [], 0, False
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            named = False
        if c == ":" and not depth and not named:
            c, named = " ", True
        out.append(c)
    return "".join(out)


def labelled(requests: DataFrame, label: str = "label") -> DataFrame:
    """Gives repeated labels the suffixes #2, #3, ... in the order of ordinal."""
    n = F.row_number().over(Window.partitionBy(label).orderBy("ordinal"))
    return requests.withColumn("_n", n).withColumn(label, F.when(F.col("_n") > 1, F.concat(F.col(label), F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(label))).drop("_n")


def tools_from_log(log: DataFrame, names: Sequence[str]) -> DataFrame:
    """The declarations of ``names``, in that order, of the first request that declares them all (one row, or none)."""
    asked = F.array(*(F.lit(n) for n in names))
    declared = F.transform(F.coalesce("body.tools", F.array()), lambda t: t["function"]["name"])
    first = log.where(F.size(F.array_except(asked, declared)) == 0).orderBy("ordinal").limit(1)
    return first.select(F.transform(asked, lambda n: F.element_at(F.filter("body.tools", lambda t: t["function"]["name"] == n), -1)).alias("tools"))


def _files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the files that it names (itself, a pattern's, or a folder's), by name."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.globStatus(where) or []]
    inside = lambda p: [s.getPath() for s in fs.listStatus(p)] if fs.getFileStatus(p).isDirectory() else [p]
    return fs, sorted((f for p in found for f in inside(p) if not f.getName().startswith(("_", "."))), key=str)


def safetensors_header(spark: SparkSession, path: str) -> DataFrame:
    """name, dtype and shape of the tensors in a file: only its length prefix and JSON header are read."""
    fs, files = _files(spark, path)
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray
    rows = []
    for file in files:
        stream = fs.open(file)
        try:
            size = struct.unpack("<Q", bytes(read(stream, 8)))[0]
            rows += [(k, v["dtype"], v["shape"]) for k, v in json.loads(bytes(read(stream, size))).items() if k != "__metadata__"]
        finally:
            stream.close()
    return spark.createDataFrame(rows, "name string, dtype string, shape array<long>")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """row (from 0, dense) and value of the lines below a path, for positional joins.

    Each split's lines are counted, and their numbers start behind the splits before: no line is moved.
    """
    lines = ordered_lines(spark, path).withColumn("_split", F.shiftright("ordinal", LINE_BITS))
    counts = lines.groupBy("_split").agg(F.count("*").alias("_c"), F.min("ordinal").alias("_first"))
    before = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = counts.select("_split", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    return lines.join(F.broadcast(starts), "_split").select((F.col("_start") + F.col("ordinal") - F.col("_first")).alias("row"), "value")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 and lines (line ends) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.col("content").cast("string")
    lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), lines.cast("long").alias("lines"))


def group_ranges(spark: SparkSession, path: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Of every Parquet file below a path, the first and last row index of row groups lo to hi, from its footer; files without have (0, -1)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for file in sorted(spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles()):
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf))
        try:
            counts = [b.getRowCount() for b in reader.getRowGroups()]
        finally:
            reader.close()
        first = sum(counts[:lo])
        out.append((first, first + sum(counts[lo : hi + 1]) - 1) if lo < len(counts) else (0, -1))
    return out


def row_groups(ordered: DataFrame, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows of parquet_ordered() whose index in their file is within the file's range (see group_ranges)."""
    spans = ordered.sparkSession.createDataFrame([(n, lo, hi) for n, (lo, hi) in enumerate(ranges)], "_file int, _lo long, _hi long")
    row = F.col("ordinal") % F.lit(1 << ROW_BITS)
    return ordered.withColumn("_file", F.shiftright("ordinal", ROW_BITS).cast("int")).join(F.broadcast(spans), "_file").where(row.between(F.col("_lo"), F.col("_hi"))).select(*ordered.columns)


def first_rows(ordered: DataFrame, n: int) -> DataFrame:
    return ordered.orderBy("ordinal").limit(n)


def excluded(df: DataFrame, repos: str, column: str = "repo") -> DataFrame:
    """Rows outside a comma list of repositories; empty items count for nothing."""
    names = [r for r in repos.split(",") if r]
    return df.where(~F.col(column).isin(names)) if names else df


def any_requests(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """label and body (JSON) of the requests in a file: JSON lines, a list, a map of labels, or one request.

    A request under the key body is unwrapped, and one without messages left out. Lines and list items
    have the file's stem and their number as label; repeated labels get #2, #3, ...
    """
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    if path.endswith(".jsonl"):
        each = numbered_lines(spark, path).where("trim(value) <> ''").select(F.col("row").alias("ordinal"), F.concat(F.lit(f"{stem}:"), (F.col("row") + 1).cast("string")).alias("label"), F.parse_json("value").alias("v"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
        listed = F.schema_of_variant("v").startswith("ARRAY")
        single = F.try_variant_get("v", "$.messages", "variant").isNotNull() | F.try_variant_get("v", "$.body", "variant").isNotNull()
        one = whole.where(~listed & single).select(F.lit(0).alias("ordinal"), F.lit(stem).alias("label"), "v")
        many = whole.where(listed | ~single).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("pos").alias("ordinal"), F.coalesce("key", F.concat(F.lit(f"{stem}:"), (F.col("pos") + 1).cast("string"))).alias("label"), F.col("value").alias("v"))
        each = one.union(many)
    body = F.when(F.try_variant_get("v", "$.messages", "variant").isNull(), F.try_variant_get("v", "$.body", "variant")).otherwise(F.col("v"))
    kept = each.select("ordinal", "label", body.alias("v")).where("size(try_variant_get(v, '$.messages', 'array<variant>')) > 0")
    out = labelled(kept.select("ordinal", "label", F.to_json("v").alias("body")))
    return first_rows(out, limit) if limit else out
