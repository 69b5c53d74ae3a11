"""Entries that share the most headwords, where some headwords are in most entries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.storage import dropped, written

#: A headword of more entries is heavy; the entries of others, of each headword at once, are compared in a task.
HEAVY = 1000
#: Sets of heavy headwords are compared in blocks of so many.
BLOCK = 1024
#: An entry of more headwords is wide: the others of each of its links are not sent along, its pairs come from a join.
WIDE = 128
#: Pairs that a task holds at once, and columns of a matrix.
PAIRS, COLUMNS = 1 << 20, 4096
#: What may be broadcast, in rows of the heavy headwords or of the sets' nearest entries; tables of entries never are.
SMALL = 20_000
#: Of more headwords sent along than this, and their results, a quarter of the postings and entries is shuffled at a time.
ROUND, ROUNDS = 1 << 24, 4


def _first(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each group; no more than that a task and group are shuffled."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__k", rank).filter(F.col("__k") <= most).drop("__k")


def _beside(table: DataFrame, n: int) -> DataFrame:
    """The right side of a join, broadcast by its rows: compressed files are no measure of what a driver holds."""
    return F.broadcast(table) if n <= SMALL else table.hint("merge")


def _in_rounds(rows: DataFrame, by: str, n: int, work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``work`` makes of rows, whose groups ``by`` it keeps apart: written for one share of them after the other, so
    shuffle files of one share are there at a time."""
    share = F.pmod(F.xxhash64(by), F.lit(n))
    return reduce(DataFrame.union, [written(work(rows.filter(share == k) if n > 1 else rows), name) for k in range(n)])


def _nearest(sets: DataFrame, n: int, most: int) -> DataFrame:
    """Of the n sets (s, heads, ids: the smallest ``most`` entries of each): for each the ``most`` entries (s, b, n) with
    the largest overlaps n above 0, equal ones by id. A task compares two blocks as matrices of 0 and 1."""
    blocks = max(1, -(-n // BLOCK))
    mine = F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = sets.select(mine.alias("i"), every.alias("j"), F.lit(0).alias("side"), "s", "heads", "ids")
    right = sets.select(every.alias("i"), mine.alias("j"), F.lit(1).alias("side"), "s", "heads", "ids")

    def run(frame):
        import numpy as np
        import pandas as pd

        places = {h: k for k, h in enumerate({h for heads in frame["heads"] for h in heads})}
        matrix = np.zeros((len(frame), len(places)), np.float32)
        for row, heads in enumerate(frame["heads"]):
            matrix[row, [places[h] for h in heads]] = 1
        ids, side = frame["ids"].tolist(), frame["side"].to_numpy()
        x, y = np.flatnonzero(side == 0), np.array(sorted(np.flatnonzero(side), key=lambda k: ids[k][0]), int)
        shared = (matrix[x] @ matrix[y].T).astype(np.int64)
        out = []
        for row, a in enumerate(x):
            # an entry of a later set has ``most`` others before it, one of each of these
            first = [k for k in np.argsort(-shared[row], kind="stable")[:most] if shared[row, k]]
            best = sorted((-int(shared[row, k]), b) for k in first for b in ids[y[k]])[:most]
            out += [(frame["s"].iat[a], b, -n) for n, b in best]
        return pd.DataFrame(out, columns=["s", "b", "n"])

    kind = sets.schema["ids"].dataType.elementType.simpleString()
    found = left.union(right).groupBy("i", "j").applyInPandas(run, f"s string, b {kind}, n long")
    return _first(found, "s", [F.col("n").desc(), "b"], most)


def _counted(start, rows, columns, lo: int, hi: int):
    """Of the rows lo to hi of a posting whose first row is ``start`` and whose last is before ``rows``: how many of the
    columns each shares with each row of the posting; ``columns`` has (row, column) pairs."""
    import numpy as np

    total = np.zeros((hi - lo, rows - start), np.float32)
    row, column = columns
    for c in range(0, int(column[-1]) + 1, COLUMNS):
        these = (column >= c) & (column < c + COLUMNS) if column[-1] >= COLUMNS else slice(None)
        matrix = np.zeros((rows - start, min(COLUMNS, int(column[-1]) + 1 - c)), np.float32)
        matrix[row[these] - start, column[these] - c] = 1
        total += matrix[lo - start : hi - start] @ matrix.T
    return total.ravel().astype(np.int64)


def _of_postings(table, most: int):
    """Rows (a, b, n) of whole postings (h, a, items) in order of h and a: of each a the ``most`` other entries of the
    posting that share most, h and items counted, equal ones by order."""
    import numpy as np
    import pyarrow as pa

    h, cells = table["h"].to_numpy(), table["items"].combine_chunks()
    cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[first, len(h)])
    posting = np.repeat(np.arange(len(first)), sizes)

    # items that two entries of a posting have are columns of its matrix
    lengths = np.diff(cells.offsets.to_numpy())
    row, value = np.repeat(np.arange(len(h)), lengths), cells.flatten().to_numpy()
    order = np.lexsort((value, posting[row]))
    row, value = row[order], value[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (posting[row[1:]] != posting[row[:-1]])][: len(row)]
    run = np.cumsum(new) - 1
    kept = np.bincount(run, minlength=1)[run] > 1 if len(run) else np.zeros(0, bool)
    row, run = row[kept], run[kept]
    run = np.cumsum(np.r_[0, run[1:] != run[:-1]])[: len(run)]
    at = np.searchsorted(posting[row], np.arange(len(first) + 1))
    full = np.flatnonzero(at[1:] > at[:-1])

    found, ends, lo = [], np.cumsum(sizes[posting]), 0
    while lo < len(h):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        m, start = sizes[posting[lo:hi]], first[posting[lo:hi]]
        begin = np.cumsum(m) - m
        n = np.ones(int(m.sum()), np.int64)
        for p in full[np.searchsorted(full, posting[lo]) : np.searchsorted(full, posting[hi - 1], "right")]:
            s, e = int(first[p]), int(first[p] + sizes[p])
            x, y, columns = max(lo, s), min(hi, e), slice(at[p], at[p + 1])
            n[begin[x - lo] : begin[x - lo] + (y - x) * (e - s)] += _counted(s, e, (row[columns], run[columns] - run[at[p]]), x, y)
        # larger for more in common, then for an earlier place
        key = (n << 32) - (np.arange(len(n)) - np.repeat(begin, m))
        key[begin + np.arange(lo, hi) - start] = -1
        for _ in range(most):
            best = np.maximum.reduceat(key, begin)
            here = np.flatnonzero(best > 0)
            n = -(-best[here] >> 32)
            place = (n << 32) - best[here]
            key[begin[here] + place] = -1
            found.append((here + lo, start[here] + place, n))
        lo = hi
    a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
    ids = table["a"].combine_chunks()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(n.astype(np.int32))], ["a", "b", "n"])


def _within(postings: DataFrame, most: int) -> DataFrame:
    """(a, b, n) of the entries of each posting: rows (h, a, items), one posting in one task, in order."""

    def run(batches):
        import pyarrow as pa

        kept = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            cut = int((h != h[-1]).sum())  # the last posting may go on
            if kept and (cut or kept[-1].column("h")[-1].as_py() != h[0]):
                whole = pa.Table.from_batches([*kept, batch.slice(0, cut)])
                kept = []
                yield _of_postings(whole.combine_chunks(), most)
            elif cut:
                yield _of_postings(pa.Table.from_batches([batch.slice(0, cut)]).combine_chunks(), most)
            kept.append(batch.slice(cut))
        if kept:
            yield _of_postings(pa.Table.from_batches(kept).combine_chunks(), most)

    kind = postings.schema["a"].dataType.simpleString()
    return postings.repartition("h").sortWithinPartitions("h", "a").mapInArrow(run, f"a {kind}, b {kind}, n int")


def _coded(links: DataFrame) -> DataFrame:
    """(a, h): headwords as 64-bit integers, of which no two are equal: their values or hashes."""
    if links.schema["l"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return links.select("a", F.col("l").cast("long").alias("h"))
    heads, seed = links.select("l").distinct(), 0
    while heads.groupBy(F.xxhash64("l", F.lit(seed)).alias("h")).count().filter("count > 1").take(1):
        seed += 1
    return links.select("a", F.xxhash64("l", F.lit(seed)).alias("h"))


def _sets(links: DataFrame) -> DataFrame:
    """(a, wide, heads): the distinct headwords of an entry in rows of at most ``WIDE``, by one shuffle."""
    rank = F.dense_rank().over(Window.partitionBy("a").orderBy("h"))
    rows = links.repartition("a").withColumn("r", rank).withColumn("wide", F.max("r").over(Window.partitionBy("a")) > WIDE)
    part = F.floor((F.col("r") - 1) / WIDE).alias("part")
    return rows.groupBy("a", part, "wide").agg(F.sort_array(F.collect_set("h")).alias("heads")).drop("part")


def sharing(links: DataFrame, entry: str, lemma: str, most: int = 3, heavy: int = HEAVY) -> DataFrame:
    """(a, b, n_shared): for each entry the up to ``most`` entries that share the most headwords, ties to the smaller
    id. Repeated links count once, null entries and headwords not at all.

    The entries of a headword of at most ``heavy`` meet in a task, each with its later light headwords and all its heavy
    ones. Of each entry the first ``most`` others there are kept: at the first light headword of a pair all they share is
    there, elsewhere less, so what is among the first of all is among the first there, and nothing else goes before it.
    No pair beyond these is a row. Pairs with an entry of more than ``WIDE`` headwords come from a join. Headwords of
    more than ``heavy`` entries make no pairs: entries with the same set of them are one set, sets are compared with
    sets, and an entry whose only common headwords are heavy can be among the first only if it is among the first of its
    overlap with the set.
    """
    sets = written(_sets(_coded(links.select(F.col(entry).alias("a"), F.col(lemma).alias("l")).dropna())), "sets")
    rows = sets.select("a", "wide", F.explode("heads").alias("h"))
    hot = written(rows.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > heavy).select("h"), "heavy")
    n_hot = hot.count()
    entries = sets.filter("not wide").select("a", "wide", F.col("heads").alias("light"), F.array().cast("array<bigint>").alias("heavy"))
    if n_hot:
        marked = rows.join(_beside(hot.withColumn("hot", F.lit(True)), n_hot), "h", "left")
        some = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("h"))))
        entries = written(marked.groupBy("a", "wide").agg(some(F.expr("hot is null and not wide")).alias("light"), some(F.col("hot")).alias("heavy")), "entries")
    narrow = entries.filter("not wide")
    size = narrow.agg(F.sum(F.size("light") * (F.size("light") / 2 + F.size("heavy") + 4))).first()[0] or 0
    rounds = ROUNDS if size > ROUND else 1
    rest = F.expr("concat(slice(light, i + 2, size(light)), heavy)").alias("items")
    postings = narrow.select("a", "light", "heavy", F.posexplode("light").alias("i", "h"))
    best = lambda pairs: _first(pairs.repartition("a").groupBy("a", "b").agg(F.max("n").alias("n")), "a", [F.col("n").desc(), "b"], most)
    met = [_in_rounds(postings, "h", rounds, lambda some: _within(some.select("h", "a", rest), most), "near")]
    if sets.filter("wide").take(1):
        light = rows.join(_beside(hot, n_hot), "h", "left_anti")
        pairs = light.filter("wide").select("h", "a").join(light.select("h", F.col("a").alias("b")).hint("merge"), "h").filter("a <> b").groupBy("a", "b").agg(F.count("*").cast("int").alias("n"))
        if n_hot:
            side = lambda c: entries.select(F.col("a").alias(c), F.col("heavy").alias(f"heavy_{c}")).hint("merge")
            pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("n") + F.size(F.array_intersect("heavy_a", "heavy_b"))).alias("n"))
        both = F.explode(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n"))).alias("p")
        met.append(written(best(pairs.select(both).select("p.*")), "wide"))
    dropped(sets)
    if n_hot:
        heads = entries.filter(F.size("heavy") > 0).select("a", F.col("heavy").alias("heads"), F.to_json("heavy").alias("s"))
        few = written(_first(heads, "s", ["a"], most + 1).groupBy("s").agg(F.first("heads").alias("heads"), F.sort_array(F.collect_list("a")).alias("ids")), "few")
        n_sets = few.count()
        # an entry may be among the nearest of its own set
        nearest = written(_nearest(few, n_sets, most + 1), "nearest")
        near = heads.select("a", "s").join(_beside(nearest, n_sets * (most + 1)), "s").filter("a <> b")
        met.append(near.select("a", "b", F.col("n").cast("int")))
    out = _in_rounds(reduce(DataFrame.union, met), "a", rounds, best, "best")
    return out.select("a", "b", F.col("n").cast("long").alias("n_shared"))
