"""Streams of events: windowed counts and keyed upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.bucketed import BucketedTable
from quire.operators.tables import last_wins


def read(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Counts and sums per event type in tumbling windows; events later than the watermark are dropped."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    counts = stamped.withWatermark(time, late).groupBy(F.window(time, length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def upserting(path: str, keys: list[str], order: str, first: int = 0) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: merges each batch into a table of versions; of a key the row
    that is last by ``order`` stays, whichever batch it came in. A batch
    that is run again writes the same version, so restarts do no harm. Batch ``first`` starts from an empty
    table; for any other a missing version is an error, not an empty table."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = f"{path}/v={number:012d}"
        before = batch.limit(0) if number == first else spark.read.parquet(f"{path}/v={number - 1:012d}")
        last_wins(before.unionByName(batch), keys, [F.col(order)]).write.mode("overwrite").parquet(new)

    return merge


def merging(path: str, keys: list[str], order: str, query: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink into a ``BucketedTable``: of a key the row that is last by ``order`` stays, and each batch
    rewrites only the buckets of its keys. A batch that is run again is known by its number and changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        BucketedTable(batch.sparkSession, path).keep_last(batch, f"{query}-{number}", keys, order)

    return merge
