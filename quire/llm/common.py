"""What the operators share: tables in the shared folder, bounded slices of Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import ship
from quire.storage import dropped, freed_shuffles, shared_folder, written  # noqa: F401

#: A slice of a batch holds about so many bytes of text; numpy's temporaries are some thirty times that, twice an executor.
SLICE_BYTES = 1_000_000
BATCH_BYTES, DEFAULT_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches small: an executor holds several of them at a time, outside its heap.
    A size that the session was given is kept."""
    ship(spark)
    if spark.conf.get(BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, str(8 << 20))


def slices(batches: Iterator, column: str, most: int = SLICE_BYTES) -> Iterator:
    """Each batch in runs of rows with about ``most`` bytes of ``column``; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what an operator reads, under names of its own, so other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Where a task gathers a partition, one has about so many bytes of the input's files.
PARTITION_BYTES = 32 << 20


def partitions(spark: SparkSession, read: DataFrame | None = None) -> int:
    """The session's number of shuffle partitions; more where ``read`` is so large, by the optimizer's estimate from the
    sizes of its files, that a task of that many partitions would gather too much."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if read is not None:
        size = int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < 1 << 60:  # an unknown size is given as a huge one
            n = max(n, -(-size // PARTITION_BYTES))
    return min(n, 1 << 20)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, label)``, the label a node of the component.

    Each round points every node at its smallest neighbour, follows the pointers twice and contracts
    the edges, so rounds grow with the logarithm of the longest path. Only distributed joins and
    minima; a hub's minimum is combined before the shuffle, and each round is a table in the shared
    folder. Nodes without an edge are not returned; no rows in, none out.
    """
    live = written(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    labels = None
    for _ in range(most_rounds):
        if not live.take(1):
            break
        both = live.select(F.col("a").alias("n"), F.col("b").alias("m")).union(live.select(F.col("b"), F.col("a")))
        # a table, so that the joins below deal both of their sides and can split a hub's rows
        base = written(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")), "smallest")
        hop, point = base.select(F.col("n").alias("p"), F.col("p").alias("q")), base
        for _ in range(2):
            point = point.join(hop, "p", "left").select("n", F.coalesce("q", "p").alias("p"))
        point = written(point, "pointers")
        to = point.select(F.col("n").alias("label"), F.col("p"))
        if labels is None:
            new = point.select(F.col("n").alias("node"), F.col("p").alias("label"))
        else:
            new = labels.join(to, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
        new = written(new, "labels")
        moved = (
            live.join(point.select(F.col("n").alias("a"), F.col("p").alias("x")), "a")
            .join(point.select(F.col("n").alias("b"), F.col("p").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        old = [live, base, point] + ([labels] if labels is not None else [])
        live, labels = written(moved, "edges"), new
        for table in old:
            dropped(table)
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
