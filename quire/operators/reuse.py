"""Reused passages: winnowed fingerprints as seeds, extended along their diagonals, chained over small gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.mentions import mentions

#: Seeds are runs of GRAM tokens; of WINDOW neighbouring ones that with the smallest hash is kept.
GRAM, WINDOW = 4, 5


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` token hashes."""
    n = len(tokens) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 1, np.uint64)
    for k in range(gram):
        out = (out ^ tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """The places of the smallest hash of each ``window`` neighbours, of equal ones the last; none of fewer hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    last = window - 1 - views[:, ::-1].argmin(1)
    return np.unique(np.arange(n) + last)


def fingerprints(texts: DataFrame, key: str, hashed: str, gram: int, window: int) -> DataFrame:
    """(key, pos, fp, gap, before): the kept seeds of each array of token hashes, with the distance to the seed before
    and its hash, 0 where there is none."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().fill_null(0).to_numpy().cumsum()
            rows, places, prints, gaps, before = [], [], [], [], []
            for i, end in enumerate(ends):
                h = gram_hashes(flat[ends[i - 1] if i else 0 : end], gram)
                at = winnowed(h, window)
                if len(at):
                    rows.append(np.full(len(at), i))
                    places.append(at)
                    prints.append(h[at])
                    gaps.append(np.diff(at, prepend=at[0]))
                    before.append(np.concatenate((np.zeros(1, np.uint64), h[at][:-1])))
            if rows:
                whole = lambda x, kind: pa.array(np.concatenate(x).astype(kind, copy=False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(whole(rows, np.int64)), whole(places, np.int32), pa.array(np.concatenate(prints).view(np.int64)), whole(gaps, np.int32), pa.array(np.concatenate(before).view(np.int64))],
                    names=[key, "pos", "fp", "gap", "before"],
                )

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, hashed).mapInArrow(run, f"`{key}` {kind}, pos int, fp long, gap int, before long")


def runs(items: DataFrame, texts: DataFrame, item: str, text: str, x: str, y: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(item, text, item_start, text_start, n_tokens): the longest runs of equal tokens of arrays ``x`` of ``items`` and
    ``y`` of ``texts``, all those of ``gram + window - 1`` tokens or more, wherever they begin, in both; of an item with
    fewer tokens every place where all of it stands.

    Both sides keep one seed of each ``window``, so equal runs share one. Seeds meet by equality, and a pair whose
    seeds before stand at the same distance and are equal is left to those: a passage of many seeds is one row and
    not one for each. Tokens are compared as 64-bit hashes, short items as text. Keys are unique in their tables and
    their names differ. Null and empty arrays have no runs.
    """
    least = gram + window - 1
    hashed = lambda df, key, c, name: df.select(F.col(key).alias(name), F.transform(c, lambda t: F.xxhash64(t)).alias(f"{name}_h"))
    a, b = hashed(items.filter(F.size(x) >= least), item, x, "__item"), hashed(texts.filter(F.size(y) >= least), text, y, "__text")
    p, q = fingerprints(a, "__item", "__item_h", gram, window), fingerprints(b, "__text", "__text_h", gram, window)
    q = q.select("__text", F.col("pos").alias("__pos"), "fp", F.col("gap").alias("__gap"), F.col("before").alias("__before"))
    # seeds at most a gram apart leave no token between them, so both lie in one run
    inner = (F.col("gap") == F.col("__gap")) & F.col("gap").between(1, gram) & (F.col("before") == F.col("__before"))
    seeds = p.join(q, "fp").filter(~inner).select("__item", "__text", "pos", "__pos")
    both = seeds.join(a, "__item").join(b, "__text")

    def extend(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep, out = [], []
            for i, (at, to, u, v) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True)):
                u, v = u.values.to_numpy(), v.values.to_numpy()
                if (u[at : at + gram] != v[to : to + gram]).any():
                    continue  # two seeds with one hash
                m, n = min(at, to), min(len(u) - at, len(v) - to)
                left = np.flatnonzero(u[at - m : at][::-1] != v[to - m : to][::-1])
                right = np.flatnonzero(u[at : at + n] != v[to : to + n])
                back = int(left[0]) if len(left) else m
                length = back + (int(right[0]) if len(right) else n)
                if length >= least:
                    keep.append(i)
                    out.append((at - back, to - back, length))
            if keep:
                rows = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array([r[k] for r in out], pa.int32()) for k in range(3)]], names=["item", "text", "item_start", "text_start", "n_tokens"])

    kinds = items.schema[item].dataType.simpleString(), texts.schema[text].dataType.simpleString()
    wide = both.select("__item", "__text", "pos", "__pos", "__item_h", "__text_h")
    found = wide.mapInArrow(extend, f"item {kinds[0]}, text {kinds[1]}, item_start int, text_start int, n_tokens int").distinct()
    short = items.filter((F.size(x) > 0) & (F.size(x) < least)).select(F.col(item).alias("lemma_id"), F.array_join(x, " ").alias("alias_normalized"))
    placed = mentions(texts.select(F.col(text).alias("__text"), F.col(y).alias("__y")), short, "__text", "__y")
    found = found.union(placed.select("lemma_id", "__text", F.lit(0), "token_index", "n_tokens"))
    return found.select(F.col("item").alias(item), F.col("text").alias(text), "item_start", "text_start", "n_tokens")


def passages(found: DataFrame, item: str, text: str, most_gap: int = 10) -> DataFrame:
    """Runs that follow one another in both, with at most ``most_gap`` other tokens between, as one passage:
    (item, text, item_start, item_end, text_start, text_end, n_equal, n_runs), ends exclusive. Runs are taken in the
    order of the text; one that overlaps the run before it, or goes back in the item, begins a passage."""
    order = Window.partitionBy(item, text).orderBy("text_start", "item_start")
    gap = lambda c: F.col(c) - F.lag(F.col(c) + F.col("n_tokens")).over(order)
    joins = F.coalesce(gap("text_start").between(0, most_gap) & gap("item_start").between(0, most_gap), F.lit(False))
    rows = found.withColumn("__new", F.when(joins, 0).otherwise(1)).withColumn("__chain", F.sum("__new").over(order))
    ends = [F.min("item_start").alias("item_start"), F.max(F.col("item_start") + F.col("n_tokens")).alias("item_end"), F.min("text_start").alias("text_start"), F.max(F.col("text_start") + F.col("n_tokens")).alias("text_end")]
    return rows.groupBy(item, text, "__chain").agg(*ends, F.sum("n_tokens").cast("int").alias("n_equal"), F.count("*").cast("int").alias("n_runs")).drop("__chain")
