"""Trigram search against a scan, and shared headwords against all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from quire.operators import sharing, trigrams


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = "Wine wine OXYMEL of the Ἄγνος ἄγνος root 50% a_b İ naïve 𝛼𝛽𝛾 aaa".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice([None, "", "hot", "Dry and hot"])) for i in range(200)]
    return rows + [(200, None, None), (201, "", "wi"), (202, "wine", "wine"), (202, "wine", None), (203, "win", "ewin"), (204, "long " * 30_000 + "needle", None)]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    df = spark.createDataFrame(corpus, "id int, text string, note string").repartition(3)
    path = str(tmp_path_factory.mktemp("trigrams") / "index")
    trigrams.build(df, "id", ["text", "note"], path)
    return df, path


@pytest.mark.parametrize("lookup", [1000, 2])
@pytest.mark.parametrize("needle", ["WINE", "wine o", "xyz", "wi", "", "ἌΓΝΟΣ", "50%", "a_b", "y and H", "𝛼𝛽𝛾", "needle", "aaa aaa", "newin", "win"])
def test_search_equals_a_scan(index, corpus, monkeypatch, needle, lookup):
    df, path = index
    monkeypatch.setattr(trigrams, "LOOKUP", lookup)
    got = Counter(tuple(r) for r in trigrams.search(df, path, "id", ["text", "note"], needle).collect())
    want = Counter(r for r in corpus if any(c is not None and needle.lower() in c.lower() for c in r[1:]))
    assert got == want
    scan = df.filter(trigrams.contains_any(["text", "note"], needle))
    assert got == Counter(tuple(r) for r in scan.collect())


def test_candidates_are_read_by_their_keys(spark, index, tmp_path):
    df, path = index
    df.orderBy("id").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = trigrams.search(stored, path, "id", ["text", "note"], "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id, [204])" in plan or "PushedFilters: [IsNotNull(id), EqualTo(id,204)" in plan, plan
    read = trigrams.candidates(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(trigram" in read


def test_postings_are_in_order(spark, index):
    rows = [(r.trigram, k) for r in spark.read.parquet(f"{index[1]}/postings").collect() for k in r["keys"]]
    assert len(rows) == len(set(rows)) + len(trigrams.trigrams("wine"))  # id 202 is there twice
    counts = {r.trigram: r.n for r in spark.read.parquet(f"{index[1]}/frequency").collect()}
    assert counts == Counter(g for g, _ in rows)


def brute(links, most=3):
    heads = defaultdict(set)
    for e, h in links:
        if e is not None and h is not None:
            heads[e].add(h)
    out = []
    for a in heads:
        shared = sorted((-len(heads[a] & heads[b]), b) for b in heads if b != a and heads[a] & heads[b])
        out += [(a, b, -n) for n, b in shared[:most]]
    return sorted(out)


@pytest.mark.parametrize(("heavy", "block"), [(1000, 1024), (5, 1024), (5, 3), (0, 7)])
@pytest.mark.parametrize("seed", [1, 2])
def test_sharing_equals_all_pairs(spark, monkeypatch, heavy, block, seed):
    monkeypatch.setattr(sharing, "BLOCK", block)
    rng = random.Random(seed)
    links = [(e, f"h{int(rng.paretovariate(0.7)) % 60}") for e in range(70) for _ in range(rng.randrange(8))]
    links += [(e, "everywhere") for e in range(70)] + [(None, "h1"), (3, None), (4, "h1"), (4, "h1"), (900, "alone")]
    df = spark.createDataFrame(links, "entry int, head string")
    got = sorted(tuple(r) for r in sharing.sharing(df, "entry", "head", 3, heavy).collect())
    assert got == brute(links)


def test_a_headword_of_all_entries_makes_no_pairs(spark):
    """3,000 entries with one headword in common would be 9 million pairs; the result is three of each."""
    links = spark.range(3000).selectExpr("id AS entry", "'everywhere' AS head").union(spark.range(3000).selectExpr("id", "concat('h', id div 4)"))
    got = sharing.sharing(links, "entry", "head", 3, heavy=100)
    assert got.count() == 9000
    assert [tuple(r) for r in got.filter("a in (0, 2001)").orderBy("a", "b").collect()] == [(0, 1, 2), (0, 2, 2), (0, 3, 2), (2001, 2000, 2), (2001, 2002, 2), (2001, 2003, 2)]


def test_sharing_of_no_links(spark):
    assert sharing.sharing(spark.createDataFrame([], "entry int, head string"), "entry", "head").collect() == []


@pytest.mark.parametrize(("wide", "heavy", "pairs", "columns", "rounds"), [(3, 5, 1 << 20, 4096, 3), (128, 1000, 7, 2, 1), (1, 1000, 50, 4096, 2), (5, 12, 50, 3, 4)])
def test_sharing_in_any_division(spark, monkeypatch, wide, heavy, pairs, columns, rounds):
    for name, value in (("WIDE", wide), ("PAIRS", pairs), ("COLUMNS", columns), ("ROUND", 0), ("ROUNDS", rounds), ("SMALL", 3)):
        monkeypatch.setattr(sharing, name, value)
    rng = random.Random(wide)
    links = [(f"e{e}", f"h{int(rng.paretovariate(0.7)) % 40}") for e in range(60) for _ in range(rng.randrange(9))]
    links += [(f"e{e}", f"same{k}") for e in range(50, 60) for k in range(4)] + [(f"e{e}", "everywhere") for e in range(0, 60, 2)]
    got = sorted(tuple(r) for r in sharing.sharing(spark.createDataFrame(links, "entry string, head string"), "entry", "head", 3, heavy).collect())
    assert got == brute(links)


def test_postings_over_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        links = [(e, h) for e in range(40) for h in (e % 2, 2 + e // 3, 100 + e // 20, 1000 + e)]
        got = sorted(tuple(r) for r in sharing.sharing(spark.createDataFrame(links, "entry int, head int"), "entry", "head").collect())
        assert got == brute(links)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def shuffled(spark) -> int:
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_a_light_headword_are_not_shuffled(spark):
    """Ten headwords of 400 entries each: 1.6 million pairs, of which three an entry are needed."""
    links = spark.range(4000).selectExpr("id AS entry", "id % 10 AS head").union(spark.range(4000).selectExpr("id", "100 + id div 20"))
    before = shuffled(spark)
    got = sharing.sharing(links, "entry", "head").collect()
    assert shuffled(spark) - before < 100_000
    assert sorted((r.b, r.n_shared) for r in got if r.a == 2013) == [(3, 1), (13, 1), (2003, 2)]


def test_entries_are_not_broadcast(spark):
    """A table of 150,000 entries with their heavy headwords is small in a file and large in a driver."""
    links = spark.range(150_000).selectExpr("id AS entry", "explode(array(repeat('a', 90), repeat('b', 90), repeat('c', 90), concat('h', id div 2))) AS head")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "40m")
    try:
        assert sharing.sharing(links, "entry", "head", 3, heavy=100).filter("n_shared = 4").count() == 150_000
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
