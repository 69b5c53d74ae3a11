"""The pipeline on a small corpus: each stage's contract, and the whole against its stages."""

from __future__ import annotations

import random

import pytest
import __spark_entry__
import corpus_pipeline
from quire.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    syllable = ["th", "er", "an", "on", "in", "re", "ed", "ha", "st", "ou"]
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    passage = [word() + str(k) for k in range(60)]
    for i in range(240):
        body = [word() + (str(rng.randrange(999)) if k % 2 else "") for k in range(rng.randrange(70, 160))]
        toxic = i % 6 == 0
        if toxic:
            body[5] = "moronic"
        if i % 8 == 1:
            body[10:10] = passage
        text = " ".join(body)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, rows[7][1], "en", "s", 1), (1001, rows[8][1] + " tail", "en", "s", 1), (1002, "too short", "en", "s", 1), (1003, None, None, None, None), (None, rows[9][1] + " again here", "en", "s", 1)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_in_order(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, corpus).collect(), DOCS)
        assert docs.columns == columns
        ids[name] = {r.doc_id: r for r in docs.collect()}
    q, t, n, s = (ids[name] for name, _ in corpus_pipeline.STAGES[:-1])
    assert 1002 not in q and 1003 not in q and len(q) >= 240
    assert set(t) <= set(q) and sum(i is not None and i < 240 and i % 6 == 0 for i in t) <= 4 and sum(i is not None and i < 240 and i % 6 != 0 for i in t) >= 195
    assert 1000 not in n and 1001 not in n and set(n) <= set(t)
    assert set(s) == set(n)
    cut = [i for i in s if s[i].text != n[i].text]
    assert cut and all(s[i].n_chars == len(s[i].text) < n[i].n_chars for i in cut)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, corpus).collect()
    assert {p.doc_id for p in pieces} == set(s)
    whole = {(p.doc_id, p.start, p.length, p.ids_crc32) for p in corpus_pipeline.run(spark, corpus).collect()}
    assert whole == {(p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces}


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.queries()} and {"pipeline"} <= names
    assert set(queries.oracle_sql()) <= names


def test_queries_match_sql(spark):
    """Where SQL can say the same, on the smallest driver tables."""
    import duckdb

    d = __spark_entry__.SMOKE_DIR
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, d)
        want = con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns)
        got = sorted(tuple(map(str, r)) for r in df.select(*want.columns).collect())
        assert got == sorted(tuple(map(str, r)) for r in want.fetchall()), name
