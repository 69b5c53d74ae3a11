"""Merges into buckets: what they write, when they are seen, and what a repeated or failing one leaves."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import tables
from quire.operators.bucketed import BucketedTable
from quire.streaming import events

SCHEMA = "k int, s string, v int, w int"


@pytest.fixture
def made(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 7}", i, 0) for i in range(200)], SCHEMA)
    table = BucketedTable.create(spark, str(tmp_path / "t"), df.schema, ["k"], 20)
    assert table.read().count() == 0
    assert table.upsert(df, "first", ["k"]) == 1
    return table


def content(df):
    return sorted(map(str, map(tuple, df.collect())))


def written_files(table):
    return {str(p): p.stat().st_size for p in Path(table.path, "data").rglob("*.parquet")}


def test_upserts_equal_the_operator(spark, made):
    rng, want = random.Random(1), made.read()
    for n in range(3):
        rows = [(rng.randrange(300), f"n{n}", rng.randrange(9), i) for i in range(30)] + [(None, "null key", n, 99)]
        batch = spark.createDataFrame(rows, "k long, s string, v int, seq int")
        want = spark.createDataFrame(tables.upsert(want, batch, ["k"], [F.col("seq")]).collect(), SCHEMA)
        assert made.upsert(batch, f"b{n}", ["k"], [F.col("seq")]) == n + 2
        assert content(made.read()) == content(want)
    assert content(made.read(1)) == content(spark.createDataFrame([(i, f"s{i % 7}", i, 0) for i in range(200)], SCHEMA))


def test_bytes_follow_the_batch(spark, made):
    before = written_files(made)
    made.upsert(spark.createDataFrame([(3, "new", 1, 1), (3000, "new", 1, 1)], SCHEMA), "small", ["k"])
    after = written_files(made)
    new = {p for p in after if p not in before}
    assert set(before) <= set(after) and len({Path(p).parent for p in new}) <= 2
    assert sum(after[p] for p in new) < 0.25 * sum(before.values())


def test_a_repeated_batch_changes_nothing(spark, made):
    batch = spark.createDataFrame([(3, "x", 1, 1)], SCHEMA)
    version, files = made.upsert(batch, "b", ["k"]), written_files(made)
    assert made.upsert(spark.createDataFrame([(4, "other", 1, 1)], SCHEMA), "b", ["k"]) == version
    assert written_files(made) == files and made.manifest()["version"] == version


def test_a_failing_batch_is_not_seen(spark, made):
    before = content(made.read())
    boom = F.when(F.col("k") == 5, F.raise_error(F.lit("broken row"))).otherwise(F.col("v"))
    with pytest.raises(Exception, match="broken row"):
        made.change(spark.createDataFrame([(i, "x", 1, 1) for i in range(9)], SCHEMA), "bad", lambda rows, new: rows.withColumn("v", boom))
    assert content(made.read()) == before and made.manifest()["version"] == 1
    assert made.upsert(spark.createDataFrame([(5, "good", 1, 1)], SCHEMA), "bad", ["k"]) == 2
    assert [tuple(r) for r in made.lookup(k=5).collect()] == [(5, "good", 1, 1)]


def test_two_writers_of_one_version(spark, made):
    other = BucketedTable(spark, made.path)

    def slow(rows, new):
        other.upsert(spark.createDataFrame([(1, "fast", 1, 1)], SCHEMA), "fast", ["k"])
        return tables.upsert(rows, new, ["k"])

    with pytest.raises(RuntimeError, match="there already"):
        made.change(spark.createDataFrame([(1, "slow", 1, 1)], SCHEMA), "slow", slow)
    assert [r.s for r in made.lookup(k=1).collect()] == ["fast"]


def test_rows_stay_in_their_buckets(spark, made):
    with pytest.raises(Exception, match="moved a row"):
        made.change(spark.createDataFrame([(1, "x", 1, 1)], SCHEMA), "b", lambda rows, new: rows.withColumn("k", F.col("k") + F.lit(1000) + F.col("v")))
    with pytest.raises(ValueError, match="no keys"):
        made.upsert(spark.createDataFrame([(1, "x", 1, 1)], SCHEMA), "b", ["s"])
    with pytest.raises(ValueError, match="cannot deal"):
        BucketedTable.create(spark, made.path + "2", made.read().schema, ["nope"], 3)


def test_empty_batches_and_vacuum(spark, made):
    assert made.upsert(spark.createDataFrame([], SCHEMA), "none", ["k"]) == 2
    for n in range(3):
        made.upsert(spark.createDataFrame([(i, f"again{n}", 0, 0) for i in range(200)], SCHEMA), f"all{n}", ["k"])
    want = content(made.read())
    before = made.read(made.manifest()["version"] - 1)
    assert made.vacuum(keep=2) > 0 and made.vacuum(keep=2) == 0
    assert content(made.read()) == want and before.count() == 200
    assert len(list(Path(made.path, "manifests").glob("v=*"))) == 2


def test_deactivation_rewrites_the_documents_of_a_run(spark, tmp_path):
    first = spark.createDataFrame([(s, d, True, "r1") for d in ("a", "b") for s in range(3)], "seg int, doc string, is_active boolean, run string").withColumnRenamed("run", "last_import_run_id")
    made = BucketedTable.create(spark, str(tmp_path / "e"), first.schema, ["doc"], 8)
    made.change(first, "r1", lambda rows, new: new)
    run = spark.createDataFrame([(0, "a"), (7, "a")], "seg int, doc string")
    made.change(run, "r2", lambda rows, new: tables.deactivate_unseen(rows, new, ["seg", "doc"], "doc", "r2"))
    got = sorted((r.doc, r.seg, r.is_active, r.last_import_run_id) for r in made.read().collect())
    assert got == [("a", 0, True, "r2"), ("a", 1, False, "r2"), ("a", 2, False, "r2"), ("a", 7, True, "r2"), ("b", 0, True, "r1"), ("b", 1, True, "r1"), ("b", 2, True, "r1")]


def test_a_stream_merges_its_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 13, float(i)) for i in range(60)], "event_id long, user_id int, value double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    table = BucketedTable.create(spark, str(tmp_path / "out"), df.schema, ["user_id"], 5)
    sink = events.merging(table.path, ["user_id"], "event_id")
    q = events.read(spark, str(tmp_path / "in"), df, 1).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    want = sorted(max((i, u) for i in range(60) if i % 13 == u) for u in range(13))
    assert sorted((r.event_id, r.user_id) for r in table.read().collect()) == want
    version = table.manifest()["version"]
    sink(df.limit(0), 0)  # a batch that is run again
    assert table.manifest()["version"] == version
