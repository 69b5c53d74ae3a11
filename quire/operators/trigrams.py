"""Substring search over several text columns by a stored index of trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.storage import dropped, written

#: A task turns so many rows into postings at a time; a posting row has at most so many keys.
ROWS = 1000
#: A search intersects the postings of so many of its trigrams, the rarest.
RAREST = 4
#: Up to so many candidates are looked up by their keys, which a scan takes as a filter; more are joined.
LOOKUP = 1000


def trigrams(text: str | None) -> set[str]:
    """The runs of three code points."""
    return {text[i : i + 3] for i in range(len(text) - 2)} if text else set()


def build(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Writes the index of the lower-cased text columns: ``postings`` (trigram, keys), in order, a row for the keys of a
    run of ROWS rows, and ``frequency`` (trigram, n). Posting rows are dealt by ranges of trigram and first key, so a
    trigram of most rows takes several files. Rows of a null key are left out."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                places: dict[str, list[int]] = {}
                for i, row in enumerate(zip(*[c.to_pylist() for c in part.columns[1:]], strict=True)):
                    for gram in set().union(*map(trigrams, row)):
                        places.setdefault(gram, []).append(i)
                ends = pa.array([0, *accumulate(map(len, places.values()))], pa.int32())
                keys = part.column(0).take(pa.array(list(chain.from_iterable(places.values())), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(places), pa.string()), pa.ListArray.from_arrays(ends, keys)], names=["trigram", "keys"])

    rows = df.filter(F.col(key).isNotNull()).select(key, *[F.lower(F.col(c)) for c in columns])
    # a table, as dealing by ranges reads its rows twice
    rows = written(rows.mapInArrow(run, f"trigram string, keys array<{df.schema[key].dataType.simpleString()}>"), "postings")
    order = "trigram", F.col("keys")[0]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/postings")
    dropped(rows)
    stored = df.sparkSession.read.parquet(f"{path}/postings")
    counts = stored.groupBy("trigram").agg(F.sum(F.size("keys")).alias("n"))
    counts.repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(f"{path}/frequency")


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """(key) of the rows that hold the rarest trigrams of a needle, perhaps apart; None for a needle of fewer than
    three code points, of which the index says nothing."""
    grams = sorted(trigrams(spark.range(1).select(F.lower(F.lit(needle))).first()[0]))
    if not grams:
        return None
    found = spark.read.parquet(f"{path}/frequency").filter(F.col("trigram").isin(grams)).collect()
    postings = spark.read.parquet(f"{path}/postings")
    if len(found) < len(grams):
        return postings.select(F.explode("keys").alias("key")).limit(0)
    rarest = [r.trigram for r in sorted(found, key=lambda r: (r.n, r.trigram))[:RAREST]]
    rows = postings.filter(F.col("trigram").isin(rarest)).select("trigram", F.explode("keys").alias("key"))
    if len(rarest) == 1:
        return rows.select("key").distinct()
    return rows.groupBy("key").agg(F.count_distinct("trigram").alias("m")).filter(F.col("m") == len(rarest)).select("key")


def contains_any(columns: list[str], needle: str) -> Column:
    """Whether a column has the needle, without regard to case; ``%`` and ``_`` stand for themselves."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(needle))), F.lit(False))
    return out


def search(df: DataFrame, path: str, key: str, columns: list[str], needle: str) -> DataFrame:
    """The rows of ``df`` with the needle in one of the indexed columns, as a scan finds them. Few candidates are read
    by their keys, a filter that reaches the scan; of many the keys are joined; all are verified on their texts. A
    needle of fewer than three code points is looked for in all rows. Rows of a null key are in no index."""
    keys = candidates(df.sparkSession, path, needle)
    if keys is None:
        return df.filter(contains_any(columns, needle))
    few = [r[0] for r in keys.limit(LOOKUP + 1).collect()]
    if len(few) <= LOOKUP:
        rows = df.filter(F.col(key).isin(few)) if few else df.limit(0)
    else:
        rows = df.join(keys.withColumnRenamed("key", "__key"), F.col(key) == F.col("__key"), "left_semi")
    return rows.filter(contains_any(columns, needle))
