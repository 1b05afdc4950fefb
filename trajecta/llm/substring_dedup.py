"""Substring deduplication by content-defined chunks under a gear rolling hash.

The gear hash at a byte depends on the 32 bytes up to it. A chunk ends where the hash is the greatest within
``RADIUS`` bytes on both sides, so boundaries depend on near content alone and fall into step again at most
32 + RADIUS bytes behind an insertion. Chunks have more than RADIUS bytes and average twice as many; where
content repeats so evenly that no greatest value stands out, a chunk ends after LONGEST bytes. Chunks are
deduplicated by a 128-bit digest: the document with the least doc_id keeps a chunk, and within a document
its first occurrence. A document is a doc_id with a text, the latter by a 64-bit hash.

Every text is cut once, and chunks travel once: sorted by digest and document they stream by, so no digest's chunks
are gathered. A chunk that comes HOT times in a batch of texts is dealt over SALTS tasks; each of them sees the
batch's first one as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents

#: Bytes on both sides that a boundary's hash must exceed; the longest chunk; the shortest repeated run that is reported:
#: about a third of fifty words, as much as is surely left of such a passage when its ends go with other chunks.
RADIUS, LONGEST, SHORTEST = 24, 1024, 100
#: Chunks of a batch; times that a digest comes in one to be dealt over more tasks; how many.
BATCH, HOT, SALTS = 50_000, 64, 32
#: The gear table: 256 numbers of 32 bits by rule.
GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


def gear(raw: bytes) -> np.ndarray:
    """The rolling hash h = (h << 1) + gear[byte] at every byte, mod 2**32, so 32 bytes deep."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for k in range(5):  # from 2**k bytes deep to 2**(k + 1)
        d = 1 << k
        if len(h) > d:
            h[d:] = h[d:] + (h[:-d] << np.uint32(d))
    return h


def boundaries(raw: bytes, radius: int = RADIUS, longest: int = LONGEST) -> np.ndarray:
    """The ends of the chunks of ``raw``, the last one included."""
    n = len(raw)
    if not n:
        return np.empty(0, np.int64)
    h = (gear(raw) * np.uint32(0x9E3779B1)).astype(np.int64)
    top = np.full(n + 2 * radius, -1, np.int64)
    top[radius : radius + n] = h
    width, most = 1, top
    while 2 * width <= radius:  # greatest of `width` values from each place on
        most = np.maximum(most[: len(most) - width], most[width:])
        width *= 2
    span = lambda at: np.maximum(most[at : at + n], most[at + radius - width : at + radius - width + n])  # noqa: E731  greatest of `radius` values
    left, right = span(0), span(radius + 1)
    loose = np.flatnonzero((h >= left) & (h >= right)) + 1
    strict = h[loose - 1] > left[loose - 1]
    if strict.all():
        cut = loose
    else:  # in content that repeats itself, equal greatest values end chunks too, so far apart that steps are whole periods
        taken, last = [], 0
        for at, single in zip(loose.tolist(), strict.tolist()):
            if single or at - last > radius:
                taken.append(at)
                last = at
        cut = np.array(taken, np.int64)
    cut = cut[(cut > radius) & (cut < n)]  # the start of a text is no greatest value's neighbour
    ends = np.append(cut, n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > longest:
        ends = np.concatenate([np.append(np.arange(e - g + longest, e, longest), e) for e, g in zip(ends.tolist(), gaps.tolist())])
    return ends


def _hash(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


_CHUNK = "d1 long, d2 long, salt int, o int, d long, h long, start int, length int, lead boolean"


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """d1, d2 (the digest), salt, o (no doc_id), d (the doc_id), h (the text's hash), start, length (bytes of UTF-8), lead.

    A digest that is crowded in its batch has its first chunk with salt 0, the others with salts from 1 on, and for each of
    those a copy of the first as a lead. Null and empty texts have no chunks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, docs_, ends, counts, total = [], [], [], [], 0
        for b in batches:
            for doc_id, h, value in zip(*(c.to_pylist() for c in b.columns)):
                raw = (value or "").encode("utf-8", "replace")
                at = boundaries(raw)
                if not len(at):
                    continue
                start = 0
                for end in at.tolist():
                    digests.append(hashlib.blake2b(raw[start:end], digest_size=16).digest())
                    start = end
                docs_.append((int(doc_id is None), doc_id or 0, h))
                ends.append(at)
                counts.append(len(at))
                total += len(at)
                if total >= BATCH:
                    yield from dealt(digests, docs_, ends, counts)
                    digests, docs_, ends, counts, total = [], [], [], [], 0
        if total:
            yield from dealt(digests, docs_, ends, counts)

    def dealt(digests: list[bytes], docs_: list[tuple], ends: list[np.ndarray], counts: list[int]) -> Iterator[pa.RecordBatch]:
        d1, d2 = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2).T
        o, d, h = (np.repeat(np.array(c, np.int64), counts) for c in zip(*docs_))
        start = np.concatenate([np.r_[0, e[:-1]] for e in ends])
        length = np.concatenate(ends) - start
        salt, lead = np.zeros(len(d1), np.int64), np.zeros(len(d1), bool)
        values, inverse, times = np.unique(d1, return_inverse=True, return_counts=True)
        crowded = np.flatnonzero(times[inverse] >= HOT)
        extra = np.empty(0, np.int64)
        if len(crowded):
            crowded = crowded[np.lexsort((start[crowded], h[crowded], d[crowded], o[crowded], d2[crowded], d1[crowded]))]
            same = lambda *cs: np.all([c[crowded][1:] == c[crowded][:-1] for c in cs], axis=0)
            new = np.r_[True, ~same(d1, d2)]
            first = crowded[np.maximum.accumulate(np.where(new, np.arange(len(crowded)), 0))]
            behind = np.any([c[crowded] != c[first] for c in (o, d, h, start)], axis=0)
            salt[crowded[behind]] = 1 + (h[crowded[behind]] + start[crowded[behind]]) % SALTS
            extra = crowded[new]
        rows = np.concatenate([np.arange(len(d1)), np.repeat(extra, SALTS)])
        salt = np.concatenate([salt, np.tile(np.arange(1, SALTS + 1), len(extra))])
        lead = np.concatenate([lead, np.ones(SALTS * len(extra), bool)])
        small = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(d1[rows]), pa.array(d2[rows]), small(salt), small(o[rows]), pa.array(d[rows]), pa.array(h[rows]), small(start[rows]), small(length[rows]), pa.array(lead)], names=["d1", "d2", "salt", "o", "d", "h", "start", "length", "lead"])

    return docs.select("doc_id", _hash(text).alias("_h"), text).mapInArrow(cut, _CHUNK)


def repeated_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """o, d, h, start, length and source (the doc_id of an earlier one, so): every chunk but the first of its digest.

    The source is the first document that has the chunk; of a crowded chunk, the first in one of its batches.
    """
    order = ["d1", "d2", "salt", "o", "d", "h", "start"]

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(8)]
            lead = b.column(8).to_numpy(zero_copy_only=False)
            n = b.num_rows
            if not n:
                continue
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)]
            if first is not None and all(c[0] == x for c, x in zip(cols[:3], first)):
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            head = [np.where(at < 0, first[i] if first is not None else 0, c[np.maximum(at, 0)]) for i, c in enumerate(cols[:7])]
            later = ~lead & np.any([c != x for c, x in zip(cols[3:7], head[3:])], axis=0)
            first = tuple(x[-1] for x in head)
            if later.any():
                source = pa.array(head[4][later], mask=head[3][later] > 0)
                yield pa.RecordBatch.from_arrays([*(pa.array(cols[i][later]) for i in range(3, 8)), source], names=["o", "d", "h", "start", "length", "source"])

    return chunks(docs, text).repartition("d1", "d2", "salt").sortWithinPartitions(*order).mapInArrow(behind, "o int, d long, h long, start int, length int, source long")


def repeated_spans(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """doc_id, _h (the text's hash), spans: sorted structs of start, length and source (the doc_id that keeps the span's first chunk).

    A span is a run of neighbouring repeated chunks of at least ``shortest`` bytes; bytes count in UTF-8.
    Documents without such a span have no row.
    """
    gone = repeated_chunks(docs, text).groupBy("o", "d", "h").agg(F.collect_set(F.struct("start", "length", "source")).alias("found"))

    def rows(given: Iterator[tuple]):
        for o, d, h, spans in given:
            runs: list[dict] = []
            for x in sorted(spans, key=lambda x: x["start"]):
                if runs and runs[-1]["start"] + runs[-1]["length"] >= x["start"]:
                    runs[-1]["length"] = max(runs[-1]["length"], x["start"] + x["length"] - runs[-1]["start"])
                else:
                    runs.append(dict(x))
            runs = [x for x in runs if x["length"] >= shortest]
            if runs:
                yield None if o else d, h, runs

    return arrow_map(gone, ["o", "d", "h", "found"], "doc_id long, _h long, spans array<struct<start:int,length:int,source:bigint>>", rows, flush=2_000)


def dedup_substrings(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` with repeated spans cut out of the text, and the column spans (null where nothing is cut).

    The document with the least doc_id (null last) keeps a passage, and within a document its first occurrence
    stays. Spans are widened inward to whole characters. Rows with an equal doc_id and text are one document and lose
    the same; rows with an equal (or null) doc_id and different texts are documents in the order of the texts'
    hashes. Null texts stay null; no rows give no rows; other columns stay, except that one named spans gives way.
    """
    kept = [c for c in docs.columns if c != "spans"]
    found = repeated_spans(docs, text, shortest).select(F.col("doc_id").alias("_trajecta_doc"), F.col("_h").alias("_trajecta_h"), "spans")
    joined = docs.select(*kept, _hash(text).alias("_trajecta_hash")).join(found, F.expr("_trajecta_hash = _trajecta_h and doc_id <=> _trajecta_doc"), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans)], dtype=object)

    return joined.select(*(F.when(F.col("spans").isNull(), F.col(c)).otherwise(cut(text, "spans")).alias(c) if c == text else F.col(c) for c in kept), "spans")


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None:
        return text
    raw, out, at = text.encode("utf-8", "replace"), [], 0
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80  # noqa: E731  amid a character
    for x in spans:
        start, end = x["start"], min(x["start"] + x["length"], len(raw))
        while inside(start):
            start += 1
        while inside(end):
            end -= 1
        if start < end:
            out.append(raw[at:start])
            at = end
    return b"".join([*out, raw[at:]]).decode()


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document that loses a passage: doc_id, source_doc_ids, spans, n_bytes_removed and the text that is left."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_substrings(docs).where("spans is not null").select(
        "doc_id", F.expr("array_sort(array_distinct(spans.source))").alias("source_doc_ids"), "spans",
        F.expr("aggregate(spans, 0L, (a, x) -> a + x.length)").alias("n_bytes_removed"), "text",
    )
