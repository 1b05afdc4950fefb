"""The pipeline's stages on a small table, each against brute force on its own input."""

import os

import pytest

import corpus_pipeline
from trajecta.llm import pii, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(80)
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        if name != "best_fit_packing":
            assert out.columns == columns
            texts = {r["doc_id"]: r["text"] for r in before}
            if name in ("line_dedup", "pii_surrogates"):
                assert sorted(r["doc_id"] for r in after) == sorted(texts)
                assert all(r["n_chars"] == len(r["text"]) for r in after)
            else:
                assert all(r["text"] == texts[r["doc_id"]] for r in after) and len(after) <= len(before)
            if name == "pii_surrogates":
                assert all(r["text"] == pii.masked(texts[r["doc_id"]])[0] for r in after)
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
        seen.append((name, len(after)))
        docs = out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "quality_classifier")).collect()}
    told = [i for i in labels if i < 80]
    assert sum((i in kept) == bool(labels[i]) for i in told) >= 0.9 * len(told)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, DATA)
        said = con.execute(sql)
        names = [x[0] for x in said.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(map(str, r)) for r in said.fetchall())


def test_run_against_brute_force(spark, tmp_path):
    import shutil
    import zlib

    import numpy as np
    from test_dedup import jaccard, lines_left
    from tokenizers import Tokenizer

    from trajecta.llm import bpe, quality

    shutil.copy(f"{DATA}/labels.parquet", tmp_path / "labels.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = quality.train(quality.with_features(docs), spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score(quality.features(r["text"])) >= 0.5]
    left = lines_left(rows)
    rows = [(i, left[i, t][0]) for i, t in rows]
    components, _ = jaccard(rows, 5, 80)
    tok = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    want = set()
    for i, t in rows:
        if components[i] == i:
            ids = np.array(tok.encode(pii.masked(t)[0], add_special_tokens=False).ids + [0], "<u4")
            want |= {(i, n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for n, a in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    places: dict = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_columns_with_the_operators_names_stay(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd write to x.y@z.org", 3, "p", 7, "s"), (2, "a\nb\nc\nother", 3, "q", 8, "t"), (3, None, 0, "r", 9, "u")], "doc_id long, text string, n_chars long, pii string, n_lines_removed int, `a.b` string")
    for _, stage in corpus_pipeline.STAGES[1:4:2]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert sorted((r["doc_id"], r["pii"], r["n_lines_removed"], r["a.b"]) for r in out.collect()) == [(1, "p", 7, "s"), (2, "q", 8, "t"), (3, "r", 9, "u")]
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
