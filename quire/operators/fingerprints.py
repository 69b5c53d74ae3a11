"""Whether two tables hold the same bag of rows, and where not: sums of hashes of key ranges, then rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows are dealt into so many ranges of their keys' hashes; a comparison reads and compares as many sums.
RANGES = 4096
_PARTS = 4


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the names and types that a union of them has, as rows are compared by position."""
    if len(a.columns) != len(b.columns):
        raise ValueError(f"{len(a.columns)} columns against {len(b.columns)}")
    both = a.limit(0).union(b.limit(0)).schema
    same = lambda df: df.toDF(*both.names).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in both])
    return same(a), same(b)


def _range(df: DataFrame, by: list[str] | None, ranges: int):
    return F.pmod(F.xxhash64(*(by or df.columns)), F.lit(ranges)).cast("int")


def fingerprints(df: DataFrame, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """(range, n, s0 .. s3): the number of rows in each range of the hashes of ``by`` (all columns without it) and the
    sums of the four halves of two 64-bit hashes of the whole row. Sums take no notice of the order of rows and, other
    than exclusive or, count repeated rows as often as they are there; they are combined before the shuffle."""
    words = [F.xxhash64(F.lit(seed), *df.columns) for seed in (1, 2)]
    halves = [x for w in words for x in (w.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(w, 32))]
    rows = df.select(_range(df, by, ranges).alias("range"), *[h.alias(f"h{i}") for i, h in enumerate(halves)])
    return rows.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(f"h{i}").alias(f"s{i}") for i in range(_PARTS)])


def differing_ranges(a: DataFrame, b: DataFrame, by: list[str] | None = None, ranges: int = RANGES) -> list[int]:
    """The ranges whose rows differ, at most ``ranges`` numbers."""
    a, b = _aligned(a, b)
    x, y = fingerprints(a, by, ranges), fingerprints(b, by, ranges)
    values = ["n", *[f"s{i}" for i in range(_PARTS)]]
    other = y.select(F.col("range").alias("other"), *[F.col(c).alias(f"o_{c}") for c in values])
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    rows = x.join(other, F.col("range") == F.col("other"), "full").filter(~same)
    return sorted(r[0] for r in rows.select(F.coalesce("range", "other")).collect())


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two runs gave the same bag of rows; only sums are shuffled. Other bags pass with a chance of about
    2 to the power of -128."""
    return not differing_ranges(a, b)


def differences(a: DataFrame, b: DataFrame, by: list[str] | None = None, ranges: int = RANGES) -> DataFrame:
    """The columns of ``a``, ``side`` and ``n``: each row that ``a`` holds n times more often (side ``a``) or ``b`` does
    (side ``b``). Only rows of differing ranges are shuffled; ``by`` keeps a row and its successor in one range."""
    a, b = _aligned(a, b)
    changed = differing_ranges(a, b, by, ranges)
    some = lambda df: df.filter(_range(df, by, ranges).isin(changed)) if changed else df.limit(0)
    rows = some(a).withColumn("__d", F.lit(1)).union(some(b).withColumn("__d", F.lit(-1)))
    found = rows.groupBy(*a.columns).agg(F.sum("__d").alias("__d")).filter("__d <> 0")
    return found.select(*a.columns, F.when(F.col("__d") > 0, "a").otherwise("b").alias("side"), F.abs("__d").alias("n"))
