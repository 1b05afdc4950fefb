"""The corpus pipeline: quality classifier, line dedup, n-gram Jaccard join, personal data, best-fit packing.

Every stage works on all that its predecessor kept. Null texts and empty tables pass through as each
operator's docstring says; columns besides those of ``documents`` stay until the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import common, line_dedup, ngram_join, packing, pii, quality
from trajecta.llm.bpe import vocabulary


def _edited(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` with the text that ``operator`` leaves; n_chars follows it, where the table has that column.

    Other columns go under names that no operator adds, and come back under their own.
    """
    aside = {c: f"_stage_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = operator(docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(a) for c, a in aside.items())))
    back = {c: F.length("text").cast("long") if c == "n_chars" else F.col(a) for c, a in aside.items()}
    return out.select(*(back.get(c, F.col(c)).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are deleted from the texts; every document stays."""
    return _edited(docs, line_dedup.dedup_lines)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, a similarity of 0.8 or more)."""
    return ngram_join.keep_one(docs, 5, 80)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced."""
    return _edited(docs, pii.surrogates)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' pieces and their places in sequences."""
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the surrogates and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again.

    What a stage wrote on its way, and the result before it, goes when its own result is written.
    """
    docs, paths = common.documents(spark, sf_dir), ()
    for _, stage in STAGES[:-1]:
        docs, path = common.settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), *paths)
        paths = (path,)
    return STAGES[-1][1](spark, docs, sf_dir)
