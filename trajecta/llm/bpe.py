"""Byte-level BPE by overlapping chunks, word-level BPE by the tokenizers library, and exact token counts.

Vocabulary files belong to the installed public tokenizers; their paths are parameters.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Cache, arrow_map, documents, saved

#: Characters of a chunk, and of the part that it shares with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stitched(text: str, find, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pre-tokens of ``text``, from chunks that are split on their own.

    A pre-token depends on the text from its start to one character past its end only. So a boundary
    that both the left chunk (before its very end) and the right chunk have is one of the whole text, and
    behind it the right chunk's pre-tokens are those of the whole text. Where the shared part has no
    common boundary, the text from the last known boundary is split anew.
    """
    if len(text) <= chunk + overlap:
        return find(text)
    starts = range(0, len(text), chunk)
    split = [(s, min(s + chunk + overlap, len(text)), find(text[s : s + chunk + overlap])) for s in starts]
    ends: list[int] = []
    for n, (start, limit, tokens) in enumerate(split):
        own = [start, *(start + e for e in accumulate(map(len, tokens)))]
        if n:
            # ends[-1] lies in or before the shared part; known boundaries from `start` on are candidates
            known = set(own)
            at = next((i for i in range(_first(ends, start), len(ends)) if ends[i] in known), None)
            if at is None:
                last = ends[-1] if ends else 0
                own = [last + e for e in accumulate(map(len, find(text[last:limit])))]
            else:
                del ends[at + 1 :]
                own = own[_first(own, ends[at] + 1) :]
        else:
            own = own[1:]
        ends += own if limit == len(text) else [e for e in own if e < limit]
        if limit == len(text):
            break
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _first(values: list[int], least: int) -> int:
    from bisect import bisect_left

    return bisect_left(values, least)


class ByteBpe:
    """Encodes and decodes by a rank file; ids are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(PATTERN).findall
        core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        piece = core._core_bpe.encode_single_piece
        self.pieces = Cache(lambda token: array("I", piece(token.encode())).tobytes())
        self.decode_ids = core.decode_bytes

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, stitched(text, self.find)))

    def decode(self, ids: bytes) -> bytes:
        values = array("I")
        values.frombytes(ids)
        return self.decode_ids(values.tolist())


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


#: The byte-to-letter table of byte-level vocabularies, by its rule (printable bytes stand for themselves).
def _letters() -> dict[int, str]:
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordBpe:
    """Encodes by a tokenizers file whose white space is dropped; ids as bytes of little-endian unsigned 32-bit integers.

    Such a tokenizer never joins what plain white space parts, so a text's ids are those of its
    space-separated parts, which are cached. Parts in Latin letters go to the library's model directly
    after the file's normaliser and pre-tokeniser steps; all others go through the whole library call.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        first = spec["pre_tokenizer"]["pretokenizers"][0]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and first["type"] == "Split" and not spec["model"]["dropout"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.find = regex.compile(first["pattern"]["Regex"]).findall if self.plain else None
        self.table = {b: ord(c) for b, c in _letters().items()}
        self.latin = re.compile(r"[\x21-Ȱ]+").fullmatch
        model = self.whole.model.tokenize
        self.words = Cache(lambda w: array("I", [t.id for t in model(w.encode().decode("latin-1").translate(self.table))]).tobytes())
        self.parts = Cache(self._part, 300_000)

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        if self.plain and part.isascii():  # nearly all parts: letters, with one mark behind or none
            if part.isalpha():
                return self.words[part.lower()]
            if part[-1] in ".,;:!?" and part[:-1].isalpha():
                return self.words[part[:-1].lower()] + self.words[part[-1]]
        if self.plain and self.latin(part) and "<|" not in part and "İ" not in part and unicodedata.is_normalized("NFC", part) and not any(c in "\x7f\x85\xa0" for c in part):
            return b"".join(map(self.words.__getitem__, self.find(part.lower())))
        return array("I", self.whole.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Special tokens that stand in the text are found by the library as it always does."""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")))


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text, decodes the ids again and returns one row per input row.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids (array<int>) on request. Null counts as
    an empty text and has no tokens; repeated rows each have a row; other columns are not read.
    """

    def rows(given: Iterator[tuple]):
        bpe = byte_bpe(path)
        for doc_id, value in given:
            ids = bpe.encode(value or "")
            out = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield (*out, array("i", ids).tolist()) if with_ids else out

    return arrow_map(docs, ["doc_id", text], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, rows, flush=2_000)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) to doc_id and text; the bytes of the ids are concatenated. Null ids give an empty text."""

    def rows(given: Iterator[tuple]):
        bpe = byte_bpe(path)
        for doc_id, ids in given:
            yield doc_id, bpe.decode(array("i", ids or []).tobytes()).decode("utf-8", "replace")

    return arrow_map(encoded, ["doc_id", "ids"], "doc_id long, text string", rows, flush=2_000)


def token_lengths(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text; null counts as empty, with 0 tokens."""

    def rows(given: Iterator[tuple]):
        bpe = byte_bpe(path)
        for doc_id, value in given:
            yield doc_id, len(bpe.encode(value or "")) // 4

    return arrow_map(docs, ["doc_id", text], "doc_id long, n_tokens long", rows)


def length_histogram(lengths: DataFrame, block: int = 256) -> DataFrame:
    """The exact histogram of n_tokens with suffix sums: a row for each length that occurs.

    docs and tokens have that length; docs_at_least and tokens_at_least are suffix sums; truncated_tokens
    is what all documents keep under a context limit of n_tokens; docs_up_to gives quantiles (the q-quantile
    is the least length with docs_up_to >= q * all documents). Null lengths are left out; no rows give no
    rows. Sums go by blocks of lengths first, so no task sees all lengths: one row per block meets in
    one task, and each block's rows in another. The histogram itself is written, so texts are encoded once.
    """
    hist = saved(lengths.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("docs"))).withColumn("block", F.expr(f"n_tokens div {block}")).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    total = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("block", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c, w in (("d_after", "d", after), ("t_after", "t", after), ("d_before", "d", before), ("t_before", "t", before))))
    up, down = Window.partitionBy("block").orderBy("n_tokens"), Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = hist.join(total, "block").select(
        "n_tokens", "docs", "tokens",
        (F.sum("docs").over(down) + F.col("d_after")).alias("docs_at_least"),
        (F.sum("tokens").over(down) + F.col("t_after")).alias("tokens_at_least"),
        (F.sum("docs").over(up) + F.col("d_before")).alias("docs_up_to"),
        (F.sum("tokens").over(up) + F.col("t_before")).alias("tokens_up_to"),
    )
    return out.withColumn("truncated_tokens", F.col("tokens_up_to") + F.col("n_tokens") * (F.col("docs_at_least") - F.col("docs")))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for context limits, from the histogram alone: documents that fit, and tokens kept in all."""
    each = histogram.select("n_tokens", "docs", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))).alias("context"))
    return each.groupBy("context").agg(
        F.sum(F.expr("if(n_tokens <= context, docs, 0L)")).alias("docs_that_fit"),
        F.sum(F.expr("least(n_tokens, context) * docs")).alias("truncated_tokens"),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents under the 50k byte-level vocabulary."""
    return length_histogram(token_lengths(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"))
