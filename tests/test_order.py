"""Lines numbered over splits, and the order of JSON values."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions.jsonorder import json_key, sort_bytes
from quire.sources import readers


@pytest.fixture
def splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "499")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_lines_are_numbered_over_splits(spark, tmp_path, splits):
    rng, want = random.Random(1), []
    for name, n in (("a", 150), ("b", 1), ("c", 0), ("d", 40)):
        lines = ["" if rng.random() < 0.2 else "λέξη " * rng.randrange(30) + str(i) for i in range(n)]
        (tmp_path / name).write_bytes("".join(x + rng.choice(["\n", "\r\n"]) for x in lines).encode())
        want += [(name, i, x) for i, x in enumerate(lines, 1)]
    (tmp_path / "e").write_text("no line end")
    rows = readers.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = sorted((r.path.rsplit("/", 1)[1], r.line_no, r.line) for r in rows.collect())
    assert got == sorted([*want, ("e", 1, "no line end")])


def test_records_and_ids_over_splits(spark, tmp_path, splits):
    lines = [json.dumps({"source_a_entry_id": f"e{i}"}) if i % 7 else ("" if i % 2 else "{broken") for i in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = sorted((r.line_no, r.source_a_entry_id, r.error) for r in readers.json_lines(spark, str(tmp_path / "a.jsonl")).collect())
    assert got == [(i + 1, f"e{i}" if i % 7 else None, None if i % 7 else "invalid_json") for i, x in enumerate(lines) if x]
    (tmp_path / "ids").write_text("# head\n" + "".join(f" id{i} \n" for i in range(90)))
    assert sorted(map(tuple, readers.id_list(spark, str(tmp_path / "ids")).collect())) == [(i + 1, f"id{i}") for i in range(90)]


def compare(x, y) -> int:
    """By type, then value, written down without keys."""
    kinds = [type(None), bool, int, float, str, list, dict]
    a, b = kinds.index(type(x)), kinds.index(type(y))
    if a != b:
        return -1 if a < b else 1
    if isinstance(x, dict):
        x, y = [[k, v] for k, v in sorted(x.items())], [[k, v] for k, v in sorted(y.items())]
    if isinstance(x, list):
        for u, v in zip(x, y, strict=False):
            if c := compare(u, v):
                return c
        return (len(x) > len(y)) - (len(x) < len(y))
    return 0 if x is None else (x > y) - (x < y)


def value(rng: random.Random, depth: int = 0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind < 3:
        return [None, rng.random() < 0.5, rng.choice([0, 1, -1, 255, 256, -256, rng.randrange(-(10**25), 10**25), rng.randrange(-300, 300)])][kind]
    if kind == 3:
        return rng.choice([0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, rng.gauss(0, 100), math.inf, -math.inf])
    if kind == 4:
        return "".join(rng.choices("a\0b\x01é￿𝛼\x7f", k=rng.randrange(4)))
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["", "a", "a\0", "b", "é"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def test_keys_order_as_values_do():
    rng = random.Random(3)
    values = [value(rng) for _ in range(400)]
    for _ in range(40_000):
        x, y = rng.choice(values), rng.choice(values)
        a, b = sort_bytes(x), sort_bytes(y)
        assert (a > b) - (a < b) == compare(x, y), (x, y)


def test_spark_sorts_mixed_values(spark):
    import functools

    rng = random.Random(5)
    values = [value(rng) for _ in range(300)]
    texts = [json.dumps(v) for v in values]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("{broken",)], "x string").repartition(4)
    got = [r.x for r in df.orderBy(json_key("x"), "x").collect()]
    assert set(got[:2]) == {None, "{broken"}
    order = sorted(values, key=functools.cmp_to_key(compare))
    assert [sort_bytes(json.loads(t)) for t in got[2:]] == [sort_bytes(v) for v in order]
    variant = spark.createDataFrame([('[1, "a"]',), ("[1]",), ("2",), ('{"b": null}',)], "x string").select(F.to_json(F.parse_json("x")).alias("x"))
    assert [r.x for r in variant.orderBy(json_key("x")).collect()] == ["2", "[1]", '[1,"a"]', '{"b":null}']
