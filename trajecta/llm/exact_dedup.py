"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text's UTF-8 bytes are cut into fixed-size blocks. Blocks get integer names: a block goes to a bucket
by a 55-bit hash, and within the bucket the distinct blocks are sorted and numbered. Then adjacent pairs
of names get names in the same way, level after level, until one name is left. Names are collision-free:
every level is checked over the whole corpus, and where a bucket holds more than one value (a few in a million
million for 55 bits), the sorted numbers tell them apart, however many they are. Two texts are equal just when
their byte counts and last names are. Only a bucket's least and greatest value travel, so copies collapse before
the shuffle; and of crowded buckets, which are few and told to all tasks, only their own values and places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, saved

#: Bytes of a block; bytes that are cut out of a long text at once, so that cutting stays linear.
BLOCK, SLAB = 512, 1 << 16
#: Bits of a number within a bucket.
RANK = 8
#: Crowded buckets (16 bytes each) up to which their table is broadcast; beyond, the joins shuffle.
SMALL = 500_000


def _bucket(values: str, bits: int) -> str:
    return f"shiftrightunsigned(xxhash64({values}), {64 - bits})"


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL else table


def _crowded(values: DataFrame) -> DataFrame:
    """level and bucket (written) of the buckets that hold several values."""
    return saved(values.groupBy("level", "bucket").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("level", "bucket"))


def _named(values: DataFrame, crowded: DataFrame) -> DataFrame:
    """level, bucket, value, name (written) of each distinct value in crowded buckets.

    The first values of a bucket get its number and theirs in one name; those beyond get negative names, which count
    on over all such buckets, so a bucket may hold any number of values.
    """
    several = saved(values.join(_small(crowded), ["level", "bucket"], "left_semi").distinct())
    rank = F.row_number().over(Window.partitionBy("level", "bucket").orderBy("value")) - 1
    ranked = several.withColumn("_rank", rank.cast("long"))
    over = ranked.groupBy("level", "bucket").agg((F.max("_rank") - ((1 << RANK) - 1)).alias("_over")).where("_over > 0")
    before = Window.orderBy("level", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket with over 2**RANK values
    starts = over.select("level", "bucket", F.coalesce(F.sum("_over").over(before), F.lit(0)).alias("_start"))
    named = ranked.join(F.broadcast(starts), ["level", "bucket"], "left")
    name = F.when(F.col("_rank") < (1 << RANK), F.shiftleft("bucket", RANK) + F.col("_rank")).otherwise(-1 - F.col("_start") - (F.col("_rank") - (1 << RANK)))
    return saved(named.select("level", "bucket", "value", name.alias("name")))


def _pairs(level: int, names: str, bits: int) -> str:
    return f"transform(sequence(0, cast(size({names}) div 2 as int) - 1, 1), i -> named_struct('level', {level}, 'a', {names}[2 * i], 'b', {names}[2 * i + 1], 'bucket', {_bucket(f'{names}[2 * i], {names}[2 * i + 1]', bits)}))"


def _next(names: str, bits: int) -> Column:
    """The names of a level's pairs; a last name without a partner goes up as it is."""
    return F.expr(f"if(size({names}) < 2, {names}, transform(sequence(0, cast((size({names}) + 1) div 2 as int) - 1), i -> if(2 * i + 1 < size({names}), shiftleft({_bucket(f'{names}[2 * i], get({names}, 2 * i + 1)', bits)}, {RANK}), {names}[2 * i])))")


def name_documents(docs: DataFrame, text: str = "text", block: int = BLOCK, bits: int = 64 - RANK - 1) -> DataFrame:
    """doc_id, n_bytes, text_sha256 and the collision-free integer name of every normalised text.

    White space runs (U+0020, U+0009 to U+000D) count as one space; null counts as empty, whose name is
    null with 0 bytes. ``bits`` is the width of a bucket's hash: any width gives the same groups, a small
    one only makes more buckets that need their sorted numbers.
    """
    slab = max(block, SLAB // block * block)
    norm = docs.select("doc_id", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").alias("norm"))
    cut = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.encode("norm", "UTF-8").alias("b")).select(
        "doc_id", "text_sha256", F.length("b").cast("long").alias("n_bytes"),
        F.expr(f"if(length(b) = 0, array(), transform(sequence(0, cast((length(b) - 1) div {slab} as int)), s -> substring(b, s * {slab} + 1, {slab})))").alias("slabs"),
    )
    pieces = lambda value: f"flatten(transform(slabs, x -> transform(sequence(0, cast((length(x) - 1) div {block} as int)), i -> {value})))"
    here = f"substring(x, i * {block} + 1, {block})"
    named = saved(cut.select("doc_id", "text_sha256", "n_bytes", F.expr(pieces(f"shiftleft({_bucket(here, bits)}, {RANK})")).alias("names")))
    blocks = cut.select("text_sha256", "n_bytes", F.explode(F.expr(pieces(here))).alias("value")).selectExpr("text_sha256", "n_bytes", "0 as level", f"{_bucket('value', bits)} as bucket", "value")
    crowded = _crowded(blocks.select("level", "bucket", "value"))
    if not crowded.isEmpty():
        where = cut.select("text_sha256", "n_bytes", F.posexplode(F.expr(pieces(here))).alias("i", "value")).selectExpr("*", "0 as level", f"{_bucket('value', bits)} as bucket")
        named = saved(_renamed(named, where, crowded, _named(blocks.select("level", "bucket", "value"), crowded), None))
    top = named.agg(F.max(F.size("names"))).first()[0] or 0
    levels = max(0, (top - 1).bit_length())
    # all levels are named at once; only if any of them has a crowded bucket do they go one by one
    climbing = named.select("*", F.col("names").alias("l0"))
    for level in range(levels):
        climbing = climbing.withColumn(f"l{level + 1}", _next(f"l{level}", bits))
    if levels:
        pairs = climbing.select(F.explode(F.concat(*(F.expr(f"if(size(l{k}) < 2, array(), {_pairs(k + 1, f'l{k}', bits)})") for k in range(levels)))).alias("p")).select("p.level", "p.bucket", F.struct("p.a", "p.b").alias("value"))
        if not _crowded(pairs).isEmpty():
            climbing = named.withColumnRenamed("names", "l0")
            for level in range(levels):
                here, up = f"l{level}", f"l{level + 1}"
                each = climbing.select("text_sha256", "n_bytes", F.expr(f"posexplode(if(size({here}) < 2, array(), {_pairs(level + 1, here, bits)}))").alias("i", "p")).select("text_sha256", "n_bytes", "i", "p.level", "p.bucket", F.struct("p.a", "p.b").alias("value"))
                values = each.select("level", "bucket", "value")
                crowded = _crowded(values)
                climbing = saved(_renamed(climbing.withColumn("names", _next(here, bits)).drop(here), each, crowded, _named(values, crowded), up))
    return climbing.select("doc_id", "text_sha256", "n_bytes", F.get(f"l{levels}", F.lit(0)).alias("name"))


def _renamed(named: DataFrame, where: DataFrame, crowded: DataFrame, names: DataFrame, to: str | None) -> DataFrame:
    """``named`` with the names of values in crowded buckets at their places (``where``); other places are not shuffled."""
    found = where.join(_small(crowded), ["level", "bucket"], "left_semi").select("text_sha256", "n_bytes", "i", "level", "bucket", "value").distinct().join(_small(names), ["level", "bucket", "value"])
    fixes = found.groupBy("text_sha256", "n_bytes").agg(F.map_from_entries(F.collect_list(F.struct("i", "name"))).alias("fix"))
    out = named.join(fixes, ["text_sha256", "n_bytes"], "left")
    # `names` keeps its name at level 0; later levels get `to`
    return out.select(*(c for c in named.columns if c != "names"), F.expr("if(fix is null, names, transform(names, (x, i) -> coalesce(try_element_at(fix, i), x)))").alias(to or "names"))


def exact_groups(docs: DataFrame, text: str = "text", block: int = BLOCK, bits: int = 64 - RANK - 1) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the smallest doc_id stays; a null doc_id counts as larger than any, so it
    stays only in a group without other ids. Rows that repeat the kept doc_id with the same text are all
    marked kept, being the same document. Null counts as empty text; an empty table gives no rows.
    """
    named = saved(name_documents(docs, text, block, bits))
    key = [F.col("n_bytes"), F.coalesce("name", F.lit(-1)).alias("name")]
    named = named.select("doc_id", "text_sha256", *key)
    # written first: a join whose sides both come from an exchange is one whose crowded parts Spark splits
    groups = saved(named.groupBy("n_bytes", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    return named.join(groups, ["n_bytes", "name"]).select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of each group of equal normalised texts."""
    keep = exact_groups(docs.select("doc_id", text), text).where("kept").select("doc_id").distinct()
    return docs.join(keep.withColumnRenamed("doc_id", "_trajecta_keep"), F.expr("doc_id <=> _trajecta_keep"), "left_semi")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
