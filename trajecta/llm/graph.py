"""Connected components: edges contracted within bounded tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Edges that one task contracts (16 bytes each).
LOCAL = 1_000_000


def _large(edges: DataFrame) -> DataFrame:
    """Links every vertex's larger neighbours to the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Links every vertex and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    lower = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of edges and the least end that each reaches."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ends))
    while True:
        p, q = label[x], label[y]
        open_ = p != q
        if not open_.any():
            return ends, ends[label]
        np.minimum.at(label, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while not np.array_equal(up := label[label], label):
            label = up


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges as stars, within each of ``parts`` tasks: as many as there are vertices in it at most."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]:
            v, label = least_labels(*(np.concatenate(x) for x in zip(*held)))
            far = v != label
            yield pa.RecordBatch.from_arrays([pa.array(v[far]), pa.array(label[far])], names=["a", "b"])

    dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts, "a", "b")
    return dealt.mapInArrow(stars, "a long, b long")


def components(edges: DataFrame, most: int = 60, local: int = LOCAL) -> DataFrame:
    """v and label for every end of ``edges`` (a, b: long): the least vertex reachable.

    Edges are dealt over as many tasks as hold ``local`` of them each, and every task leaves stars; a single
    task's are the answer. Else rounds of a large and a small star turn what is left into stars around its least
    vertices, in about the squared logarithm of its size. Edges live in written tables; only their count and a
    hash come to the driver. Loops and repeated edges count for nothing; no edges give no rows.
    """
    edges = saved(edges.select("a", "b").where("a <> b"))
    parts = max(1, -(-edges.count() // local))
    now = saved(_contracted(edges, parts))
    before = _mark(now)
    for _ in range(most if before[0] and parts > 1 else 0):
        now = saved(_small(_large(now)))
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        if before[0] and parts > 1:
            raise RuntimeError("components did not settle; raise most")
    return now.select(F.col("a").alias("v"), F.col("b").alias("label")).union(now.select("b").distinct().select(F.col("b").alias("v"), F.col("b").alias("label")))
