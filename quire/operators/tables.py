"""Mutations and ordered operations as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.fingerprints import same_rows  # noqa: F401  # an operator of tables too
from quire.storage import written


def union_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """All sheets, each row with its sheet's name; columns that a sheet lacks are null."""
    out = None
    for name, df in sheets.items():
        df = df.withColumn("sheet", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sheets")
    return out


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last by ``order``. Rows of a key meet as one aggregate, not as a sorted group."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("__r")).select(*keys, *(F.col("__r")[c].alias(c) for c in rest)).select(*df.columns)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Merge on conflict: new keys are added, of known keys the columns that the batch has are overwritten.

    ``order`` ranks rows of one key inside the batch, the last wins; without it the batch has unique keys."""
    if order:
        batch = last_wins(batch, keys, order)
    new = batch.select(*(F.col(c).alias(f"__n_{c}") for c in batch.columns), F.lit(True).alias("__hit"))
    joined = target.join(new, [F.col(k).eqNullSafe(F.col(f"__n_{k}")) for k in keys], "full")
    value = lambda c: F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)) if c in batch.columns else F.col(c)
    return joined.select(*(value(c).alias(c) for c in target.columns))


def upsert_two_pass(target: DataFrame, batch: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """A self-referencing load in one write: the merged table, and the rows whose parent does not exist."""
    merged = upsert(target, batch, [key])
    ids = merged.select(F.col(key).alias("__id"))
    return merged, merged.filter(F.coalesce(F.col(parent), F.lit("")) != "").join(ids, F.col(parent) == F.col("__id"), "left_anti")


def deactivate_unseen(previous: DataFrame, current: DataFrame, keys: list[str], scope: str, run_id: str) -> DataFrame:
    """Upsert of a run, and soft deletion of what its documents (``scope``) had before and no longer have."""
    seen = current.select(F.col(scope).alias("__scope")).distinct()
    now = upsert(previous, current.withColumns({"is_active": F.lit(True), "last_import_run_id": F.lit(run_id)}), keys)
    mark = current.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.lit(True).alias("__seen")).distinct()
    out = now.join(mark, [F.col(k) == F.col(f"__k_{k}") for k in keys], "left").join(seen, F.col(scope) == F.col("__scope"), "left")
    gone = F.col("__seen").isNull() & F.col("__scope").isNotNull() & F.col("is_active")
    return out.withColumn("last_import_run_id", F.when(gone, F.lit(run_id)).otherwise(F.col("last_import_run_id"))).withColumn("is_active", F.col("is_active") & ~gone).select(*previous.columns)


def update_where(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def checked(value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of {', '.join(allowed)}")
    return value


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Rewrites what differs, null-safe, and says in ``changed`` which rows did."""
    changed = ~F.col(column).eqNullSafe(value)
    return df.withColumn("changed", changed).withColumn(column, F.when(changed, value).otherwise(F.col(column)))


def batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """batch_id of consecutive rows. Ranks come from range partitions and their sizes, not from one sorted task."""
    # a table, so that both of its readers see the same partitions
    parts = written(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("__p").orderBy(*order)
    ranked = parts.withColumn("__i", F.row_number().over(within))
    sizes = parts.groupBy("__p").agg(F.count("*").alias("n"))
    # one row a partition, so this window stays small
    base = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return ranked.join(base, "__p").withColumn("batch_id", F.floor((F.col("__base") + F.col("__i") - 1) / size)).drop("__p", "__i", "__base")


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return last_wins(df, keys, [F.col(version)])


def next_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def exploded_links(df: DataFrame, key: str, cell: str, out: str) -> DataFrame:
    """A comma-separated cell as rows (key, out, position, is_primary): trimmed, blanks and repeats dropped,
    the first is primary."""
    items = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(cell), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(key, F.posexplode(items).alias("position", out)).withColumn("is_primary", F.col("position") == 0)


def previous_in(df: DataFrame, partition: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.select("*", *(F.lag(c).over(w).alias(f"previous_{c}") for c in columns))


def context(tokens: Column, start: Column, end: Column, around: int) -> Column:
    """Up to ``around`` tokens on either side of the half-open token span, with the span."""
    first = F.greatest(start - around, F.lit(0))
    return F.slice(tokens, first + 1, end + around - first)


def top_groups(df: DataFrame, size: str, key: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.col(size).desc(), F.col(key)).limit(n)


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) over a tree's edges, to any depth, by joins that double the reach: log2(depth) rounds,
    each a table in the shared folder. A node that is its own ancestor raises an error."""
    step = edges.filter(F.col(parent).isNotNull()).select(F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    known = grown = written(step, "closure")
    reach = 1
    while grown.take(1):
        loop = grown.filter("node = ancestor").take(1)
        if loop:
            raise ValueError(f"{loop[0].node!r} is its own ancestor")
        if grown is not known:
            known = known.union(grown)
        right = known.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"), F.col("depth").alias("more"))
        far = known.filter(F.col("depth") == reach).join(right, "ancestor")
        grown = written(far.select("node", F.col("further").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")), "closure")
        reach *= 2
    return known


def numbered(sheets: list[DataFrame], order: list[Column], out: str = "row_id") -> DataFrame:
    """Rows of several sheets, one sheet after the other, each in order, with a number that runs on over all (from 1)."""
    rows = None
    for k, df in enumerate(sheets):
        df = df.withColumn("__sheet", F.lit(k))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    return batches(rows, [F.col("__sheet"), *order], 1).withColumn(out, F.col("batch_id") + 1).drop("__sheet", "batch_id")
