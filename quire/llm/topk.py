"""Exact top-k by inner product.

Candidates are dealt by descending length into chunks. All vectors are rotated by the right singular
vectors of the candidates, so the first coordinates carry most of an inner product; the rest is at most
the product of the lengths of the remainders (Cauchy-Schwarz). Each query starts from a lower bound, its
k-th score among a handful of the longest candidates, which every task has. A query passes over a chunk whose
longest vector cannot reach the bound; a chunk is taken in runs that double, so that the bound rises early, and
in a run the partial sum grows prefix by prefix, and after each prefix the pairs whose sum and residual bound
stay below are dropped. What is left is scored exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import dropped, partitions, written

#: Candidates a chunk, queries a block, and queries that meet a chunk in one task.
CHUNK, QUERIES, GROUP = 2048, 512, 16_384
#: The share of the coordinates that is summed before each look at the bounds.
STEPS = 8
#: Candidates whose scores are a query's first bound, and the first run of a chunk.
SEED = 32


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as longs. Null vectors, vectors with a null or
    non-finite component and null ids are left out."""
    x = F.col("e")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(fine).select("vec_id", F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows; shorter ones are padded with zeros."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dim), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all rows, by descending singular value, from the sum of v v'. Tasks
    give a partial sum each; dim * dim sums reach the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim).astype(float)
            total += m.T @ m
        i, j = np.divmod(np.arange(dim * dim, dtype=np.int32), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"])

    total = np.zeros((dim, dim))
    for r in rows.select("v").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    total = np.nan_to_num(total, posinf=1e300, neginf=-1e300)
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()


class Top:
    """The k best (score, id) of each query of a block so far, ties to the smaller id.

    ``least`` is what a score must reach to count: a lower bound of the k-th best score of all."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int, least: np.ndarray | None = None, spent: int = 0):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.turned = vectors @ turn
        self.length = np.sqrt((self.turned**2).sum(1))
        self.cuts = sorted({-(-turn.shape[1] * i // STEPS) for i in range(1, STEPS + 1)})
        self.rests = remainders(self.turned, self.cuts)
        self.score = np.zeros(0, np.int64)
        self.found = np.zeros(0, np.int64)
        self.query = np.zeros(0, np.int64)  # the row of the query of each score
        self.least = np.full(len(ids), -np.inf) if least is None else least.astype(float)
        self.pairs, self.scored = 0, spent  # pairs seen, and exact scores, those for ``least`` included

    def add(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray) -> None:
        """A chunk of candidates."""
        at, size = 0, SEED
        while at < len(ids):
            self._run(ids[at : at + size], vectors[at : at + size], turn)
            at, size = at + size, 2 * size

    def _run(self, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray) -> None:
        self.pairs += len(self.ids) * len(ids)
        turned = vectors @ turn
        length = np.sqrt((turned**2).sum(1))
        most = float(length.max(initial=0.0))
        slack = 1e-6 * self.length * most + 1e-6  # rounding of the rotated sums
        live = np.flatnonzero(self.length * most + slack >= self.least)
        if not len(live):
            return
        rests = remainders(turned, self.cuts)
        need = (self.least - slack)[live]
        total, at, pairs = np.zeros((len(live), len(ids))), 0, None
        for cut, mine, theirs in zip(self.cuts, self.rests, rests, strict=True):
            if pairs is None:
                total += self.turned[live, at:cut] @ turned[:, at:cut].T
                can = total + mine[live, None] * theirs[None, :] >= need[:, None]
                if can.sum() < 0.1 * can.size or cut == self.cuts[-1]:  # few are left: go on pair by pair
                    row, col = np.nonzero(can)
                    pairs, total = (row, col), total[row, col]
            else:
                row, col = pairs
                total = total + np.einsum("ij,ij->i", self.turned[live[row], at:cut], turned[col, at:cut])
                keep = total + mine[live[row]] * theirs[col] >= need[row]
                pairs, total = (row[keep], col[keep]), total[keep]
            at = cut
        row, col = pairs
        row = live[row]
        own = self.ids[row] != ids[col]
        row, col = row[own], col[own]
        self.scored += len(row)
        if len(row):
            self.keep(row, exact(self.vectors, vectors, row, col, float(self.length.max()) * most), ids[col])

    def keep(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate((self.query, row)), np.concatenate((self.score, score)), np.concatenate((self.found, ids))
        order = np.lexsort((ids, ~score, row))  # ~score descends without overflow
        row, score, ids = row[order], score[order], ids[order]
        begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(row)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(row)]))))
        best = place < self.k
        last = place == self.k - 1
        self.least[row[last]] = np.maximum(self.least[row[last]], score[last])
        self.query, self.score, self.found = row[best], score[best], ids[best]


def remainders(turned: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """For each cut the length of what lies behind it."""
    tail = np.concatenate((np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(turned), 1))), axis=1)
    return [np.sqrt(np.maximum(tail[:, c], 0)) for c in cuts]


def exact(left: np.ndarray, right: np.ndarray, row: np.ndarray, col: np.ndarray, most: float) -> np.ndarray:
    """Integer inner products of pairs of rows; beyond a long they saturate. ``most`` bounds their size."""
    out = np.zeros(len(row), np.int64)
    for at in range(0, len(row), 1 << 16):
        a, b = left[row[at : at + (1 << 16)]], right[col[at : at + (1 << 16)]]
        if most < 2**62:
            out[at : at + (1 << 16)] = np.einsum("ij,ij->i", a, b)
        else:
            sums = (a.astype(object) * b.astype(object)).sum(1)
            out[at : at + (1 << 16)] = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in sums]
    return out


def longest_first(rows: DataFrame, dim: int, most: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the ``most`` longest rows: a bounded table, which every task gets."""
    got = rows.orderBy(F.col("len").desc(), "vec_id").limit(most).select("vec_id", "v").toArrow()
    return got["vec_id"].to_numpy().astype(np.int64), _matrix(got["v"].combine_chunks(), dim)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query with all other rows,
    ties to the smaller id.

    ``vectors`` is (vec_id long, v array of longs), as ``quantized`` gives it; ``is_query`` says which rows
    are queries. A row is told apart by its id: candidates with the query's id are its own row, and a
    query's id that repeats is one query, with the smallest of its vectors. Shorter vectors count as padded
    with zeros. Scores beyond a long saturate. Empty tables and tables without queries give no rows.
    Groups of about GROUP queries meet stripes of chunks, so each chunk moves once for GROUP queries; a task
    holds a group and a chunk.
    """
    return searched(vectors, is_query, k)[0]


def searched(vectors: DataFrame, is_query: Column, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """What ``top_k`` gives, and (pairs, scored): the pairs of a query and a candidate, and how many exact
    scores were computed, first bounds included."""
    spark = vectors.sparkSession
    parts = partitions(spark)
    rows = written(vectors.withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).withColumn("asks", is_query), "vectors")
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n"), F.count_if("asks").alias("asked")).first()
    dim = max(size.dim or 0, 1)
    turn = rotation(rows, dim)
    first = longest_first(rows, dim)
    groups = max(1, -(-size.asked // GROUP))
    stripes = max(1, min(-(-size.n // CHUNK), -(-parts // groups)))

    def chunks(most: int, query: bool):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                ids, m = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)
                longest = batch.column(2).to_numpy(zero_copy_only=False)
                for at in range(0, len(ids), most):
                    some = slice(at, at + most)
                    least, spent = np.full(len(ids[some]), -np.inf), 0
                    if query:  # what the k-th of some candidates reaches, that of all will
                        top = Top(ids[some], m[some], turn, k)
                        top.add(*first, turn)
                        least, spent = top.least, top.scored
                    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids[some], m[some], least)]
                    yield pa.RecordBatch.from_arrays([pa.array([float(longest[some].max())]), *blobs, pa.array([spent], pa.int64())], names=["longest", "ids", "data", "least", "spent"])

        return run

    schema = "longest double, ids binary, data binary, least binary, spent long"
    asked = rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", F.lit(0.0).alias("len"))
    queries = asked.repartition(max(1, min(parts, -(-size.asked // QUERIES))), "vec_id").mapInArrow(chunks(QUERIES, True), schema)
    given = rows.repartitionByRange(parts, F.col("len").desc(), F.col("vec_id")).sortWithinPartitions(F.col("len").desc(), F.col("vec_id")).select("vec_id", "v", "len").mapInArrow(chunks(CHUNK, False), schema)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")).withColumn("stripe", every(stripes)).withColumn("longest", F.lit(float("inf")))
    left = left.withColumn("spent", F.when(F.col("stripe") == 0, F.col("spent")).otherwise(F.lit(0)))  # counted once
    right = given.withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int")).withColumn("group", every(groups))

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(tops: list[Top]):
            for top in tops:
                n = len(top.score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((top.ids[top.query], [-1]))), pa.array(np.concatenate((top.found, [top.pairs]))), pa.array(np.concatenate((top.score, [top.scored]))), pa.array(np.arange(n + 1) == n)], names=["query_id", "vec_id", "score", "sums"])

        unit, tops = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if key != unit:
                    yield from out(tops)
                    unit, tops = key, []
                ids = np.frombuffer(batch.column(3)[i].as_py(), np.int64)
                data = np.frombuffer(batch.column(4)[i].as_py(), np.int64).reshape(len(ids), dim)
                if batch.column(2)[i].as_py() == float("inf"):
                    tops.append(Top(ids, data, turn, k, np.frombuffer(batch.column(5)[i].as_py(), np.float64), batch.column(6)[i].as_py()))
                else:
                    for top in tops:
                        top.add(ids, data, turn)
        yield from out(tops)

    names = ["group", "stripe", "longest", "ids", "data", "least", "spent"]
    # a unit's queries come first: their "longest" is infinite
    dealt = left.select(*names).union(right.select(*names)).repartition(parts, "group", "stripe").sortWithinPartitions("group", "stripe", F.col("longest").desc())
    found = written(dealt.mapInArrow(search, "query_id long, vec_id long, score long, sums boolean"), "found")
    dropped(rows)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.filter("not sums").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    work = found.filter("sums").agg(F.sum("vec_id").alias("pairs"), F.sum("score").alias("scored"))
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score"), work
