"""Approximate nearest neighbours in a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample; every vector then goes to one leaf. A query takes nodes from a
priority queue, the one whose centre has the largest inner product first, opens inner nodes and visits
leaves. How many leaves it visits is calibrated: for a sample of queries the true neighbours over all rows
are known, and the visits widen until the asked recall of them is reached. Scores are exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, hashed_sample, saved

#: Rows that the tree is fitted on at most; children of a node; leaves at most; queries that calibrate.
SAMPLE, BRANCH, LEAVES, CALIBRATORS = 20_000, 16, 4096, 128
#: Vectors and queries that one task multiplies at most; a busier part of the tree is dealt over several.
VECTORS, QUERIES = 16_384, 16_384


@dataclass
class Tree:
    """Nodes by number; 0 is the root. A leaf has no children."""

    centres: np.ndarray
    children: list[list[int]]
    top: list[int]  # of each node, the child of the root above it

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest centres (least distance; of equal ones the first)."""
        at = np.zeros(len(vectors), np.int64)
        while True:
            inner = [n for n in np.unique(at) if self.children[n]]
            if not inner:
                return at
            for n in inner:
                here, kids = np.flatnonzero(at == n), np.array(self.children[n])
                c = self.centres[kids]
                at[here] = kids[np.argmax(vectors[here] @ c.T - (c * c).sum(1) / 2, axis=1)]

    def visits(self, query: np.ndarray, most: int, sizes: np.ndarray, least: int) -> list[int]:
        """Leaves in best-bin-first order: ``most`` that hold rows, and more until they hold ``least`` rows."""
        value = self.centres @ query
        heap = [(-value[n], n) for n in self.children[0]] or [(0.0, 0)]
        heapq.heapify(heap)
        out, held = [], 0
        while heap and (len(out) < most or held < least):
            n = heapq.heappop(heap)[1]
            for kid in self.children[n]:
                heapq.heappush(heap, (-value[kid], kid))
            if not self.children[n] and sizes[n]:
                out.append(n)
                held += sizes[n]
        return out


def fit(sample: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 7) -> Tree:
    """Splits nodes by k-means, the fullest first, until there are about ``leaves`` leaves."""
    rng = np.random.default_rng(seed)
    centres, children, top, rows = [sample.mean(0)], [[]], [0], {0: np.arange(len(sample))}
    n_leaves = 1
    heap = [(-len(sample), 0)]
    while heap and n_leaves < leaves:
        size, n = heapq.heappop(heap)
        here = sample[rows[n]]
        k = min(branch, max(2, leaves - n_leaves + 1), len(here))
        if -size < 2 * k:
            continue
        c = here[rng.choice(len(here), k, replace=False)]
        for _ in range(8):
            own = np.argmax(here @ c.T - (c * c).sum(1) / 2, axis=1)
            c = np.stack([here[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        own = np.argmax(here @ c.T - (c * c).sum(1) / 2, axis=1)
        filled = [i for i in range(k) if (own == i).any()]
        if len(filled) < 2:
            continue
        for i in filled:
            kid = len(centres)
            centres.append(c[i])
            children.append([])
            top.append(kid if n == 0 else top[n])
            children[n].append(kid)
            rows[kid] = rows[n][own == i]
            heapq.heappush(heap, (-len(rows[kid]), kid))
        n_leaves += len(filled) - 1
    return Tree(np.stack(centres), children, top)


def best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k largest inner products: its place, ids, scores. Scores are summed alike for every row, so equal vectors tie."""
    for start in range(0, len(queries), 256):
        rough = queries[start : start + 256] @ vectors.T
        rough[own[start : start + 256, None] == ids[None, :]] = -np.inf
        least = -np.partition(-rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        for i, (row, edge) in enumerate(zip(rough, least)):
            near = np.flatnonzero(row >= edge - 1e-9 * (1 + abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(row))
            exact = (vectors[near] * queries[start + i]).sum(1)
            order = np.lexsort((ids[near], -exact))[:k]
            yield start + i, ids[near][order], exact[order]


def usable(embeddings: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and v (array<double>): vectors that are not null or zero and hold finite numbers only; one row of each id, the least."""
    v = F.col(vector).cast("array<double>")
    good = embeddings.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    return good.groupBy("id").agg(F.min("v").alias("v"))


def search(embeddings: DataFrame, every: int = 20, k: int = 20, recall: float = 0.98, id_column: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, visits: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector whose id is divisible by ``every``.

    Nearest is the largest inner product in double precision, ties to the smaller id; a query's own row is
    no candidate. Vectors that are null, zero or hold null or non-finite components take no part, nor those
    whose length is not the most usual one of the sample, nor rows without an id; of rows with one id the
    one with the least vector counts. With fewer than k candidates all are returned; no rows give no rows.
    ``visits`` sets the number of leaves instead of the calibration.
    """
    spark = embeddings.sparkSession
    rows = saved(usable(embeddings, id_column, vector))
    taken = hashed_sample(rows, "id", sample).select("v").collect()  # at most `sample` rows
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not taken:
        return spark.createDataFrame([], out_schema)
    sizes = pd.Series([len(r["v"]) for r in taken])
    dim = int(sizes.mode()[0])
    rows = rows.where(F.size("v") == dim)
    total = rows.count()
    tree = fit(np.array([r["v"] for r in taken if len(r["v"]) == dim]), int(min(LEAVES, max(1, round(total**0.5)))))

    def assign(given: Iterator[tuple]):
        while block := [r for _, r in zip(range(2_000), given)]:
            for (i, v), leaf in zip(block, tree.leaf_of(np.array([v for _, v in block])).tolist()):
                yield i, v, leaf, tree.top[leaf]

    placed = saved(arrow_map(rows, ["id", "v"], "id long, v array<double>, leaf int, top int", assign, flush=2_000))
    counted = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most LEAVES rows
    held = np.zeros(len(tree.children), np.int64)
    for leaf, n in counted.items():
        held[leaf] = n
    asked = placed.where(f"id % {every} = 0")
    if visits is None:
        visits = calibrated(placed, asked, tree, held, k, recall)

    def bins(given: Iterator[tuple]):
        for i, v in given:
            by: dict[int, list[int]] = {}
            for leaf in tree.visits(np.array(v), visits, held, k + 1):
                by.setdefault(tree.top[leaf], []).append(leaf)
            for top, leaves in by.items():
                yield top, i, v, leaves

    wanted = saved(arrow_map(asked, ["id", "v"], "top int, id long, v array<double>, leaves array<int>", bins, flush=2_000))
    # both sides of a crowded part of the tree are dealt over cells of bounded size
    parts = placed.groupBy("top").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("_vp")).join(wanted.groupBy("top").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_qp")), "top")
    parts = F.broadcast(parts)  # a row per child of the root
    left = wanted.join(parts, "top").withColumn("qp", F.expr("cast(pmod(xxhash64(id), _qp) as int)")).withColumn("vp", F.explode(F.expr("sequence(0, _vp - 1)"))).select("top", "vp", "qp", "id", "v", "leaves")
    right = placed.join(parts, "top").withColumn("vp", F.expr("cast(pmod(xxhash64(id, 1), _vp) as int)")).withColumn("qp", F.explode(F.expr("sequence(0, _qp - 1)"))).select("top", "vp", "qp", "id", "v", "leaf")

    def cell(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        if len(queries) and len(vectors):
            q, qid = np.stack(queries["v"].to_numpy()), queries["id"].to_numpy()
            each = queries["leaves"].explode()
            at = pd.Series(np.repeat(np.arange(len(queries)), queries["leaves"].str.len()), index=each.to_numpy(int))
            for leaf, group in vectors.groupby("leaf"):
                if leaf not in at.index:
                    continue
                who = np.atleast_1d(at.loc[[leaf]].to_numpy())
                for i, ids, scores in best(q[who], qid[who], np.stack(group["v"].to_numpy()), group["id"].to_numpy(), k):
                    found.setdefault(int(who[i]), []).append((ids, scores))
        out = []
        for i, parts in found.items():
            ids, scores = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((ids, -scores))[:k]
            out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[order], "score": scores[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    near = left.groupBy("top", "vp", "qp").cogroup(right.groupBy("top", "vp", "qp")).applyInPandas(cell, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def calibrated(placed: DataFrame, asked: DataFrame, tree: Tree, held: np.ndarray, k: int, recall: float, calibrators: int = CALIBRATORS) -> int:
    """The least number of leaves that holds ``recall`` of the true neighbours of a bounded sample of queries, over all rows."""
    some = hashed_sample(asked, "id", calibrators).select("id", "v").collect()  # at most `calibrators` rows
    if not some:
        return 1
    ids, queries = np.array([r["id"] for r in some]), np.array([r["v"] for r in some])

    def true(given: Iterator[tuple]):
        while block := [r for _, r in zip(range(4_000), given)]:
            own, vectors, leaf = np.array([r[0] for r in block]), np.array([r[1] for r in block]), {r[0]: r[2] for r in block}
            for i, found, scores in best(queries, ids, vectors, own, k):
                for f, s in zip(found.tolist(), scores.tolist()):
                    yield i, f, s, leaf[f]

    near = arrow_map(placed, ["id", "v", "leaf"], "q int, id long, score double, leaf int", true)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    truth = near.withColumn("r", rank).where(f"r <= {k}").select("q", "leaf").collect()  # at most calibrators * k rows
    turn = [{leaf: n for n, leaf in enumerate(tree.visits(q, len(held), held, 0))} for q in queries]
    needed = sorted(turn[r["q"]][r["leaf"]] + 1 for r in truth)
    return needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)] if needed else 1


def op3_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
