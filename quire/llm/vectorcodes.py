"""Vector code compression: product quantization by exact integer k-means.

Vectors become blocks, each a NumPy array with a row per dimension, in a table that every round reads.
Distances to a codebook grow dimension by dimension over a slice of a block that fits a core's cache. A
round is one ``treeAggregate``: tasks add components and counts into int64 tensors of the codebooks' size,
which merge through a tree, so the driver gets a few tensors whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components beyond this could overflow a 64-bit distance of up to 128 dimensions a part.
MOST = 1 << 27
#: So many vectors are compared with a codebook at a time; the distances are 512 KB of 32-bit integers.
SLICE = 512


def whole_vectors(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector): components as floor(scale * x). Vectors that are null or empty or hold null or
    non-finite components go."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    clean = vectors.filter(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(odd, F.lit(True)))
    return clean.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("vector"))


def columnar(column, width: int) -> np.ndarray:
    """An Arrow column of integer vectors as a row per dimension."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (sizes != width).any():
        raise ValueError(f"all vectors need {width} components, as the first has")
    if len(flat) and max(flat.max(), -flat.min()) > MOST:
        raise ValueError(f"scaled components must lie within {MOST}")
    return np.ascontiguousarray(flat.reshape(len(sizes), width).T.astype(np.int32))


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block (dimensions, n) and codebooks (parts, dimensions a part, entries): the index of the nearest entry,
    ties to the lower, and its squared distance, both (parts, n)."""
    parts, width, entries = books.shape
    n = block.shape[1]
    codes, errors = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    furthest = int(np.abs(block).max(initial=0)) + int(np.abs(books).max(initial=0))
    kind = np.int32 if furthest * furthest * width < 1 << 31 else np.int64
    block, books = block.astype(kind, copy=False), books.astype(kind)
    total, step = np.empty((SLICE, entries), kind), np.empty((SLICE, entries), kind)
    for at in range(0, n, SLICE):
        m = min(SLICE, n - at)
        for p in range(parts):
            total[:m] = 0
            for j in range(width):
                np.subtract(block[p * width + j, at : at + m, None], books[p, j], out=step[:m])
                np.multiply(step[:m], step[:m], out=step[:m])
                np.add(total[:m], step[:m], out=total[:m])
            best = total[:m].argmin(1)
            codes[p, at : at + m] = best
            errors[p, at : at + m] = total[np.arange(m), best]
    return codes, errors


def trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks after so many rounds of assignment and flooring means over all blocks (data: dimensions x n)."""
    context = blocks.sparkSession.sparkContext
    parts, width, entries = books.shape
    arrays = blocks.select("data").rdd.map(lambda r: np.frombuffer(r[0], np.int32).reshape(parts * width, -1))
    for _ in range(rounds):
        shared = context.broadcast(books)

        def add(held: tuple, block: np.ndarray, shared=shared) -> tuple:
            sums, counts = held
            codes, _ = nearest(block, shared.value)
            for p in range(parts):
                np.add.at(counts[p], codes[p], 1)
                for j in range(width):
                    np.add.at(sums[p, j], codes[p], block[p * width + j].astype(np.int64))
            return sums, counts

        def merge(x: tuple, y: tuple) -> tuple:
            return x[0] + y[0], x[1] + y[1]

        sums, counts = arrays.treeAggregate((np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)), add, merge)
        shared.unpersist()
        used = counts[:, None, :] > 0
        books = np.where(used, sums // np.maximum(counts, 1)[:, None, :], books)
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, error) of each vector and the codebooks (parts, entries, dimensions a part).

    Vectors as in ``whole_vectors`` are cut into ``parts`` equal parts. Each position's codebook starts as that part
    of the vectors with the smallest ids, null ids last, equal ids by their components; a table of fewer vectors than
    ``entries`` gives smaller codebooks. Rounds assign to the nearest entry (ties to the lower index) and take
    flooring means; unused entries stay. ``codes`` are the indexes in the order of parts, ``error`` the squared
    distances summed. Repeated rows each count. Vectors of another length than the first one's, a length that parts
    do not divide, or components beyond ``MOST`` raise ValueError. Of no vectors there are no rows and no entries.
    """
    rows = whole_vectors(vectors, scale, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    width = len(first[0][0]) if first else 0
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    for r in first:
        if len(r[0]) != width:
            raise ValueError(f"all vectors need {width} components, as the first has")
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 2, 0)
    books = np.ascontiguousarray(books)

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([columnar(batch.column(0), width).tobytes()], pa.binary())], names=["data"])

    if first:
        blocks = written(rows.select("vector").mapInArrow(pack, "data binary"), "blocks")
        books = trained(blocks, books, rounds)
        dropped(blocks)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = nearest(columnar(batch.column(2), width), books)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * parts), pa.array(codes.T.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(errors.sum(0))], names=["vec_id", "label", "codes", "error"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    coded = rows.mapInArrow(assign, f"vec_id {kind['vec_id']}, label {kind['label']}, codes array<int>, error long")
    return coded, books.transpose(0, 2, 1)


def decoded(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with the vector that each code stands for, as doubles of the original size."""
    spark, (parts, entries, width) = coded.sparkSession, books.shape
    shared = spark.sparkContext.broadcast(books)
    names = coded.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            codes = batch.column(names.index("codes")).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            vectors = shared.value[np.arange(parts), codes].reshape(len(codes), parts * width) / scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts * width), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{fields}, decoded array<double>")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of equal labels summed, nulls together. Errors are summed before
    the shuffle and both sides of the join are tables, so a label of most rows is split."""
    rows = written(coded, "codes")
    sums = written(rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position, as decimals joined by commas."""
    import hashlib

    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
