"""N-gram Jaccard join by set relations: index lists with blocks by position, answers derived from similar sets.

A text's set is its distinct word shingles as 64-bit numbers. Equal sets are one set (the strongest set
relation: the answers of one are those of all). A set goes into the index lists of its rarest shingles, so
many that two sets over the threshold share a list; entries without a partner of fitting size go at once.

Families first: every set joins two lists, those of its least list under two keyed hashes, where most of its
near copies meet it. Parity bitmaps tell which sets have a partner near enough; only their shingles travel. In
such a block the most central set is the first leader: its overlaps with all others are its answers. A later
leader's answers are derived from the most similar earlier leader's, by the postings of the shingles in which
the two differ alone. Sets that are connected with the first leader need no answers of their own.

Then the lists that still hold sets of different components are gone through by blocks of entries: sizes, the
room behind the positions and 512-bit parity sketches skip whole stretches of a block, and what is left is
checked on finer bitmaps and verified on whole sets. Each filter is exact, so no link between components is
lost; pairs within a component are never formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, arrow_map, documents, saved
from .graph import components

#: Buckets whose document counts order the shingles: fixed, so the table sent to the executors is 2**18 bytes.
ORDER_BITS, PART_BITS = 18, 12
#: Entries of a list that one task looks at; a longer list is cut into cells of two such parts.
CELL = 4096
#: Sets of a block, and shingles (or 64-bit words of bitmaps) after which a block ends, whatever its list holds.
BLOCK, HEAVY = 1024, 2_000_000
#: Times that a shingle comes in a batch of sets before its entries are dealt over more tasks than one, and over how many.
HOT, SALTS = 64, 64
#: Rows up to which a table of ids may be broadcast (some tens of bytes each); beyond, the join shuffles.
SMALL = 500_000
#: 64-bit words of the sketch that goes with an index entry.
SKETCH = 8

_A, _B, _C, _M = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_S = np.uint64(32)


def need(n, m, percent: int):
    """The least overlap of sets of n and m elements with 100 * overlap >= percent * union; of numbers or arrays."""
    return -(-percent * (n + m) // (100 + percent))


class Shingler:
    """A text's set of ``size``-word shingles as sorted 64-bit numbers."""

    def __init__(self, size: int):
        import xxhash

        self.size = size
        self.words = Cache(xxhash.xxh64_digest)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.frombuffer(b"".join(map(self.words.__getitem__, words)), ">u8").astype(np.uint64)
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64) * _C
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _A
            out ^= out >> _S
        out *= _B
        out ^= out >> _S
        return np.unique(out)


def bitmap(shingles: np.ndarray, percent: int = 0) -> bytes:
    """Bit i is the parity of the elements that fall to i; the count of differing bits of two such bitmaps is at most the sets' difference.

    512 bits at least, else two to four for each element; with ``percent`` no more than about half the square of the
    largest difference of linked sets, at which hardly any two elements of a difference share a bit.
    """
    n = len(shingles)
    differ = 2 * n * (100 - percent) // max(percent, 1)
    bits = max(64 * SKETCH, 1 << (min(differ * differ // 2, 2 * n) if percent else 2 * n).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, length: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as those of ``length`` words: parities of halves add up."""
    while words.shape[-1] > length:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def apart(a: int, a_bits: int, b: int, b_bits: int) -> int:
    """A lower bound of the size of two sets' difference, from their bitmaps as integers."""
    least = min(a_bits, b_bits)
    while a_bits > least:
        a_bits >>= 1
        a = (a >> a_bits) ^ (a & ((1 << a_bits) - 1))
    while b_bits > least:
        b_bits >>= 1
        b = (b >> b_bits) ^ (b & ((1 << b_bits) - 1))
    return (a ^ b).bit_count()


def _vertex(text: str):
    """A document's number in the graph: its doc_id, and without one a 64-bit hash of its text."""
    return F.coalesce("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit("no doc_id")))


def describe(docs: DataFrame, size: int, percent: int, text: str = "text") -> DataFrame:
    """A row per document: doc_id, v (its vertex), n, sid (a 128-bit digest of the set), bits; and, with part, document counts of shingle buckets.

    ``bits`` is null where the same task has just sent the set's bitmap.
    """

    def rows(given: Iterator[tuple]):
        shingles, counts, sent = Shingler(size), np.zeros(1 << ORDER_BITS, np.int64), Cache(lambda _: True, 10_000)
        for doc_id, v, value in given:
            s = shingles(value)
            sid = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            counts += np.bincount((s >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts)) if len(s) > 4096 else 0
            if len(s) <= 4096:
                np.add.at(counts, (s >> np.uint64(64 - ORDER_BITS)).astype(np.int64), 1)
            fresh = sid not in sent  # the bitmap of a set that a task has just sent need not go again
            sent[sid]
            yield doc_id, v, len(s), sid, bitmap(s, percent) if fresh else None, None, None
        for part in range(1 << (ORDER_BITS - PART_BITS)):
            yield None, None, None, None, None, part, counts[part << PART_BITS : (part + 1) << PART_BITS].tobytes()

    return arrow_map(docs.select("doc_id", _vertex(text).alias("v"), text), ["doc_id", "v", text], "doc_id long, v long, n long, sid binary, bits binary, part int, counts binary", rows)


def order(described: DataFrame) -> np.ndarray:
    """The rank (0 to 255) of each shingle bucket by how many documents its shingles are in; a fixed 2**18 numbers.

    The tasks' counts are summed as they stream by, so a part is never held as a group.
    """

    def summed(given: Iterator[tuple]):
        sums: dict[int, np.ndarray] = {}
        for part, counts in given:
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
        for part, counts in sums.items():
            yield part, counts.tobytes()

    parts = arrow_map(described.where("part is not null").select("part", "counts").repartition("part"), ["part", "counts"], "part int, counts binary", summed).collect()  # 2**18 numbers in all
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for r in parts:
        counts[r["part"] << PART_BITS : (r["part"] + 1) << PART_BITS] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(255, np.log2(1 + counts / max(float(np.median(counts)), 1.0)) * 16).astype(np.uint8)


def lists(docs: DataFrame, size: int, percent: int, ranks: np.ndarray, text: str = "text") -> DataFrame:
    """token, n, pos, s64 (half the set's digest): the entries of index lists that have a partner of fitting size in their list.

    A token that comes HOT times in a batch of sets has partners beyond doubt: its entries are dealt over SALTS tasks
    and kept unseen, and a mark (n = 0) tells the list's own task to keep the others as well.
    """

    def entries(given: Iterator[tuple]):
        shingles, sent = Shingler(size), Cache(lambda _: True, 10_000)
        held: list[tuple[np.ndarray, int, int]] = []

        def dealt():
            tokens = np.concatenate([t for t, _, _ in held])
            values, counts = np.unique(tokens, return_counts=True)
            hot = values[counts >= HOT]
            for value in hot.tolist():
                yield [value], [0], [0], 0, 0
            for t, n, s64 in held:
                crowded = np.isin(t, hot) if len(hot) else np.zeros(len(t), bool)
                yield t.tolist(), np.where(crowded, 1 + s64 % SALTS, 0).tolist(), list(range(len(t))), n, s64
            held.clear()

        total = 0
        for _, value in given:
            s = shingles(value)
            n = len(s)
            sid = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            if not n or sid in sent:
                continue
            sent[sid]
            k = n - (-(-percent * n // 100)) + 1
            key = (ranks[(s >> np.uint64(64 - ORDER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | ((s * _M) >> np.uint64(8))
            first = np.argpartition(key, k - 1)[:k] if k < n else np.arange(n)
            held.append((s[first[np.argsort(key[first], kind="stable")]].view(np.int64), n, int.from_bytes(sid[:8], "little", signed=True)))
            total += k
            if total > 200_000:
                yield from dealt()
                total = 0
        if held:
            yield from dealt()

    held = arrow_map(docs, ["doc_id", text], "tokens array<long>, salts array<int>, at array<int>, n int, s64 long", entries, flush=2_000)
    each = held.select("n", "s64", F.explode(F.arrays_zip("tokens", "salts", "at")).alias("e")).select(F.col("e.tokens").alias("token"), F.col("e.salts").alias("salt"), "n", F.col("e.at").alias("pos"), "s64")
    dealt = each.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "pos", "s64")

    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keeps an entry if the next or the one before in its list is another set of fitting size; sizes grow, so no other can fit if neither does."""
        rest: pa.RecordBatch | None = None  # the last two rows wait for what follows; the first of them is settled
        marked: int | None = None  # the token of the last mark

        def kept(b: pa.RecordBatch, first: int, last: int) -> pa.RecordBatch:
            nonlocal marked
            token, salt, n = (b.column(i).to_numpy() for i in range(3))
            n = n.astype(np.int64)
            meets = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (n[:-1] > 0) & (100 * n[:-1] >= percent * n[1:])
            keep = salt > 0
            keep[1:] |= meets
            keep[:-1] |= meets
            marks = token[n == 0]
            keep |= np.isin(token, marks if marked is None else np.append(marks, marked))
            if len(marks):
                marked = int(marks[-1])
            return b.slice(first, last - first).filter(pa.array((keep & (n > 0))[first:last])).select([0, 2, 3, 4])

        def once(b: pa.RecordBatch) -> pa.RecordBatch:
            """Without rows that repeat the one before: the same set from several tasks, or a mark."""
            columns = [b.column(i).to_numpy() for i in (0, 1, 2, 4)]
            return b.filter(pa.array(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)]))

        settled = 0
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            if b.num_rows > 1:
                b = once(b)
            if b.num_rows > 1:
                out = kept(b, settled, b.num_rows - 1)
                if out.num_rows:
                    yield out
            settled = min(1, b.num_rows - 1) if b.num_rows > 1 else 0
            rest = b.slice(max(0, b.num_rows - 2))
        if rest is not None and rest.num_rows > 1:
            out = kept(rest, settled, rest.num_rows)
            if out.num_rows:
                yield out

    return dealt.mapInArrow(fitting, "token long, n int, pos int, s64 long")


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it has few rows; beyond, the join shuffles."""
    return F.broadcast(table) if table.count() <= SMALL else table


def _blocks(given: Iterator[tuple], keys: int, weight) -> Iterator[list[tuple]]:
    """Rows of equal first ``keys`` columns, in blocks of bounded size."""
    for _, group in groupby(given, key=lambda r: r[:keys]):
        block, heavy = [], 0
        for row in group:
            block.append(row)
            heavy += weight(row)
            if len(block) >= BLOCK or heavy >= HEAVY:
                yield block
                block, heavy = [], 0
        if block:
            yield block


def near(sizes: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which of the sets have another one that their bitmaps do not tell apart."""
    order = np.argsort(sizes, kind="stable")
    n = sizes[order]
    classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(b) // 8 for b in bits}:
        at = np.flatnonzero([len(bits[i]) // 8 == length for i in order])
        classes[length] = at, np.frombuffer(b"".join(bits[i] for i in order[at]), np.uint64).reshape(len(at), length)
    halves = {length: folded(m, length // 2) for length, (_, m) in classes.items() if length // 2 in classes}
    found = np.zeros(len(n), bool)
    for length, (at, rows) in classes.items():
        for i, row in zip(at.tolist(), rows):
            if found[i]:
                continue  # it is known to have a partner; who has it for a partner finds so itself
            for other in (length, length // 2, length * 2):
                if other not in classes:
                    continue
                where, table = classes[other]
                lo, hi = np.searchsorted(n[where], [-(-percent * int(n[i]) // 100), 100 * int(n[i]) // percent + 1])
                mine = row if other >= length else folded(row, other)
                table = (halves[other] if other > length else table)[lo:hi]
                differ = np.bitwise_count(table ^ mine).sum(1, dtype=np.int64)
                hits = where[lo:hi][differ <= n[i] + n[where[lo:hi]] - 2 * need(n[i], n[where[lo:hi]], percent)]
                hits = hits[hits != i]
                if len(hits):
                    found[hits] = found[i] = True
    out = np.zeros(len(n), bool)
    out[order] = found
    return out


def forest(ids: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links a < b that span the components of the given sets.

    A leader's answers are its overlaps with all sets. The first leader is the most central set; what is linked with
    it, at once or by others, needs no answers. A later leader's answers come from those of the leader it differs
    least from: the postings of what it has more are added, of what it lacks taken away.
    """
    m, n = len(sets), np.array([len(s) for s in sets], np.int64)
    held, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    edges = np.flatnonzero(np.r_[True, held[1:] != held[:-1], True])
    central = np.bincount(owner, np.repeat(np.diff(edges), np.diff(edges)), m) / n

    def postings(elements: np.ndarray) -> np.ndarray:
        """How many of ``elements`` each set has."""
        lo, hi = np.searchsorted(held, elements, "left"), np.searchsorted(held, elements, "right")
        runs = hi - lo
        at = np.arange(runs.sum()) + np.repeat(lo - np.r_[0, np.cumsum(runs)[:-1]], runs)
        return np.bincount(owner[at], minlength=m)

    comp, answers, leaders, main = np.arange(m), np.zeros((0, m), np.int64), [], None
    for y in np.argsort(-central, kind="stable").tolist():
        if main is not None and comp[y] == comp[main]:
            continue
        differ = n[leaders] + n[y] - 2 * answers[:, y] if leaders else np.array([n[y]])
        best = int(np.argmin(differ))
        if leaders and differ[best] < n[y]:
            base = sets[leaders[best]]
            overlap = answers[best] + postings(np.setdiff1d(sets[y], base, assume_unique=True)) - postings(np.setdiff1d(base, sets[y], assume_unique=True))
        else:
            overlap = postings(sets[y])
        if len(leaders) < 256:
            leaders.append(y)
            answers = np.vstack([answers, overlap])
        main = y if main is None else main
        for z in np.flatnonzero(overlap >= need(n[y], n, percent)).tolist():
            if comp[z] != comp[y]:
                comp[comp == comp[z]] = comp[y]
                if ids[y] != ids[z]:
                    yield min(ids[y], ids[z]), max(ids[y], ids[z])


def families(entries: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int, text: str) -> DataFrame:
    """Links a, b (written) of sets that meet in one of two lists each; entries have token, n, pos and id."""
    crowded = _small(saved(entries.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts")).where("_parts > 1")))
    picked = entries.groupBy("id").agg(*(F.min_by("token", F.xxhash64("token", F.lit(r))).alias(f"t{r}") for r in range(2)))
    picked = picked.select("id", F.explode(F.expr("if(t0 = t1, array(struct(0 as r, t0 as token)), array(struct(0 as r, t0 as token), struct(1 as r, t1 as token)))")).alias("p")).select("id", "p.r", "p.token")
    # a crowded list is dealt over blocks at random, anew in each round, so that the rounds connect its blocks
    picked = picked.join(crowded, "token", "left").select("token", "r", F.expr("cast(pmod(xxhash64(id, r), coalesce(_parts, 1)) as int)").alias("part"), "id")
    dealt = picked.join(sets.select("id", "n", "bits"), "id").repartition("token", "r", "part").sortWithinPartitions("token", "r", "part")

    def flagged(given: Iterator[tuple]):
        for block in _blocks(given, 3, lambda row: len(row[5]) // 8):
            if len(block) > 1:
                for row, hit in zip(block, near(np.array([row[4] for row in block], np.int64), [row[5] for row in block], percent)):
                    if hit:
                        yield row[:4]

    cells = saved(arrow_map(dealt, ["token", "r", "part", "id", "n", "bits"], "token long, r int, part int, id long", flagged))
    wanted = cells.groupBy("id").agg(F.collect_set(F.struct("token", "r", "part")).alias("cells"))  # two at most
    held = docs.select(_vertex(text).alias("v"), text).join(_small(saved(wanted)), F.col("v") == F.col("id"))

    def contents(given: Iterator[tuple]):
        shingles = Shingler(size)
        for v, value, where in given:
            s = shingles(value)
            for c in where if len(s) else ():
                yield c["token"], c["r"], c["part"], v, s.tobytes()

    met = arrow_map(held, ["v", text, "cells"], "token long, r int, part int, id long, s binary", contents).repartition("token", "r", "part").sortWithinPartitions("token", "r", "part")

    def linked(given: Iterator[tuple]):
        for block in _blocks(given, 3, lambda row: len(row[4]) // 8):
            distinct = list({(row[3], row[4]): None for row in block})
            if len(distinct) > 1:
                yield from forest([i for i, _ in distinct], [np.frombuffer(s, np.uint64) for _, s in distinct], percent)

    return saved(arrow_map(met, ["token", "r", "part", "id", "s"], "a long, b long", linked))


def _open_pairs(entries: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, cell: int) -> DataFrame:
    """Distinct pairs a < b of ids of different components that share a list and that sizes, positions and bitmaps do not tell apart."""
    held = entries.join(_small(labels.withColumnRenamed("v", "id")), "id", "left").select("token", "id", "n", "pos", F.coalesce("label", "id").alias("comp"))
    mixed = _small(saved(held.groupBy("token").agg(F.count("*").alias("_m"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("token", F.expr(f"cast(ceil(_m / {cell}) as int)").alias("_k"))))
    cells = held.join(mixed, "token").withColumn("own", F.expr("cast(pmod(xxhash64(id), _k) as int)"))
    cells = cells.select("token", "id", "n", "pos", "comp", "own", F.explode(F.expr("sequence(0, _k - 1)")).alias("_o")).select("token", F.expr("least(own, _o)").alias("i"), F.expr("greatest(own, _o)").alias("j"), "n", "pos", "id", "own", "comp")
    dealt = cells.join(sets.select("id", "sketch"), "id").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "pos", "id")

    def rows(given: Iterator[tuple]):
        sent: set = set()
        for (_, i, j), group in groupby(given, key=lambda r: r[:3]):
            _, _, _, n, pos, ids, own, comp, sketch = zip(*group)
            for pair in of_list(np.array(n, np.int64), np.array(pos, np.int64), np.array(ids), np.array(own), np.array(comp), np.frombuffer(b"".join(sketch), np.uint64).reshape(len(n), SKETCH), percent, i != j):
                if pair not in sent:
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add(pair)
                    yield pair

    return arrow_map(dealt, ["token", "i", "j", "n", "pos", "id", "own", "comp", "sketch"], "a long, b long", rows).distinct()


def of_list(n: np.ndarray, pos: np.ndarray, ids: np.ndarray, own: np.ndarray, comp: np.ndarray, sketch: np.ndarray, percent: int, cross: bool, block: int = 64) -> Iterator[tuple[int, int]]:
    """The open pairs of one list (or cell of a long one), entries in order of size: block against block, as far as sizes may fit."""
    room, ends = n - pos, np.searchsorted(n, 100 * n // percent, "right")  # behind its end sizes are too large for an entry
    for i in range(0, len(n), block):
        rows = slice(i, min(i + block, len(n)))
        for j in range(i, int(ends[rows.stop - 1]), 4 * block):
            cols = slice(j, min(j + 4 * block, int(ends[rows.stop - 1])))
            fits = (comp[rows, None] != comp[None, cols]) & (np.arange(cols.start, cols.stop)[None] > np.arange(rows.start, rows.stop)[:, None])
            fits &= np.minimum(room[rows, None], room[None, cols]) >= need(n[rows, None], n[None, cols], percent)
            if cross:
                fits &= own[rows, None] != own[None, cols]
            a, b = np.nonzero(fits)
            if not len(a):
                continue  # the block is skipped whole
            a, b = a + i, b + j
            close = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64) <= n[a] + n[b] - 2 * need(n[a], n[b], percent)
            x, y = ids[a[close]], ids[b[close]]
            for pair in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()):
                if pair[0] != pair[1]:
                    yield pair


def _texts(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """doc_id (the vertex) and text of the documents in ``ids`` (id, distinct and written)."""
    return docs.select(_vertex(text).alias("doc_id"), text).join(_small(ids), F.col("doc_id") == F.col("id"), "left_semi")


def closer(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b (written) that whole bitmaps do not tell apart."""

    def rows(given: Iterator[tuple]):
        for a, b, n, m, x, y in given:
            if apart(int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little"), 8 * len(y)) <= n + m - 2 * need(n, m, percent):
                yield a, b

    of = lambda e, n, x: sets.select(F.col("id").alias(e), F.col("n").alias(n), F.col("bits").alias(x))
    both = pairs.join(of("a", "_n", "_x"), "a").join(of("b", "_m", "_y"), "b")
    return arrow_map(both, ["a", "b", "_n", "_m", "_x", "_y"], "a long, b long", rows).distinct()


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, text: str = "text") -> DataFrame:
    """The pairs a, b of doc_ids whose whole sets are linked."""
    held = _texts(docs, saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), text)

    def sets(given: Iterator[tuple]):
        shingles = Shingler(size)
        for doc_id, value in given:
            yield doc_id, shingles(value).tobytes()

    whole = saved(arrow_map(held, ["doc_id", text], "id long, s binary", sets))

    def linked(given: Iterator[tuple]):
        for a, b, x, y in given:
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(np.intersect1d(p, q, assume_unique=True)) >= need(len(p), len(q), percent):
                yield a, b

    both = pairs.join(whole.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(whole.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return arrow_map(both, ["a", "b", "x", "y"], "a long, b long", linked)


def _sketched(sets: DataFrame) -> DataFrame:
    """Adds s64 (the first half of sid) and sketch (the bitmap folded to SKETCH words)."""

    def rows(given: Iterator[tuple]):
        for sid, named, v, n, bits in given:
            yield sid, named, v, n, bits, int.from_bytes(sid[:8], "little", signed=True), folded(np.frombuffer(bits, np.uint64), SKETCH).tobytes()

    return arrow_map(sets, ["sid", "named", "id", "n", "bits"], "sid binary, named long, id long, n long, bits binary, s64 long, sketch binary", rows)


def _labelled(docs: DataFrame, size: int, percent: int, text: str, cell: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, v (its vertex), n, component (the vertex of least doc_id reachable, or of a text where no doc_id is), real (component is a doc_id)."""
    described = saved(describe(docs, size, percent, text))
    each = described.where("part is null").select("doc_id", "v", "n", "sid", "bits")
    # a set goes by its least doc_id, and only where it has none by a text's hash
    sets = each.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("named"), F.min("v").alias("v"), F.first("n").alias("n"), F.max("bits").alias("bits"))
    sets = saved(_sketched(sets.select("sid", "named", F.coalesce("named", "v").alias("id"), "n", "bits")))
    entries = saved(lists(docs, size, percent, order(described), text).join(sets.select("s64", "id"), "s64").select("token", "n", "pos", "id"))
    links = families(entries, sets, docs, size, percent, text)
    labels = components(links)
    pairs = saved(_open_pairs(entries, labels, sets, percent, cell))
    pairs = saved(closer(pairs, sets, percent))
    labels = components(links.union(verified(pairs, docs, size, percent, text)))
    copies = sets.join(labels.withColumnRenamed("v", "id"), "id", "left").select("sid", "named", F.coalesce("label", "id").alias("_least"))
    if not sets.where("named is null").isEmpty():  # the least vertex may be a text without a doc_id: a component's least doc_id goes before it
        copies = saved(copies)  # written, as is what it meets, so that a crowded component can be split
        least = saved(copies.groupBy("_least").agg(F.min("named").alias("_named")))
        copies = copies.join(least, "_least").select("sid", F.col("_named").alias("named"), F.coalesce("_named", "_least").alias("_least"))
    # one doc_id may stand for several texts: its rows share the least component
    out = each.join(copies, "sid", "left")
    real = F.when(F.col("_least").isNull(), F.col("doc_id").isNotNull()).otherwise(F.col("named").isNotNull())
    return out.select("doc_id", "v", "n", F.coalesce("_least", "v").alias("component"), real.alias("real"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", cell: int = CELL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Words are what ASCII white space parts, with A-Z lower-cased; a text with fewer than ``size`` words is one
    shingle; null, empty and blank texts have none and are linked with nothing. Documents link when
    100 * intersection >= percent * union; component_id is the least doc_id reachable. Rows that repeat a
    doc_id are one document (linked by any of its texts); of rows without one each text is a document of its own.
    Null is the component_id only where no doc_id is reachable. No rows give no rows.
    """
    out = _labelled(docs, size, percent, text, cell)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("real"), F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id, and documents without shingles.

    Of a component without any doc_id one row stays.
    """
    vertex = "_trajecta_vertex"
    gone = saved(_labelled(docs.select("doc_id", text), size, percent, text, CELL).where("v <> component").select(F.col("v").alias("_trajecta_gone")).distinct())
    kept = docs.withColumn(vertex, _vertex(text)).join(gone, F.col(vertex) == F.col("_trajecta_gone"), "left_anti")
    if docs.where("doc_id is null").isEmpty():
        return kept.drop(vertex)
    copies = F.col("doc_id").isNull() & F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")  # of one text without a doc_id, one
    one = kept.where(copies).groupBy(vertex).agg(F.first(F.struct(*docs.columns)).alias("_trajecta_row"))
    return kept.where(~copies).select(*docs.columns).union(one.select(*(F.col("_trajecta_row")[c].alias(c) for c in docs.columns)))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), 3, 90)


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT c.v AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.u AS component_id FROM (SELECT v, min(u) AS u FROM r GROUP BY v) c LEFT JOIN n ON n.doc_id = c.v
"""
