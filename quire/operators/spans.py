"""Half-open spans of code points: interval joins by bins, and spans of tokens against offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points a bin; a span has a row for each bin that it touches.
BIN = 256


def _binned(df: DataFrame, start: str, end: str, width: int, out: str) -> DataFrame:
    bins = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    return df.filter(F.col(start) < F.col(end)).withColumn(out, F.explode(bins))


def overlapping(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN) -> DataFrame:
    """Each pair of rows of one ``key`` whose spans have a code point in common, once, with the columns of both; but
    for the key, their names must differ. Spans are cut at the borders of bins and meet by equality of key and bin; a
    pair is kept in the bin where the later of the two starts. Empty spans and null offsets overlap nothing."""
    clash = set(left.columns) & set(right.columns) - {key}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    (a, b), (c, d) = left_span, right_span
    x, y = _binned(left, a, b, width, "__bin"), _binned(right, c, d, width, "__bin")
    first = F.floor(F.greatest(a, c) / width)
    return x.join(y, [key, "__bin"]).filter((F.col(a) < F.col(d)) & (F.col(c) < F.col(b)) & (F.col("__bin") == first)).drop("__bin")


def within(inner: tuple[str, str], outer: tuple[str, str]) -> Column:
    """Of a row of ``overlapping``: whether the first span lies in the second."""
    return (F.col(outer[0]) <= F.col(inner[0])) & (F.col(inner[1]) <= F.col(outer[1]))


def covering_tokens(spans: DataFrame, tokens: DataFrame, key: str, span_id: str, span: tuple[str, str] = ("start_offset", "end_offset")) -> DataFrame:
    """(key, span_id, start_token, end_token, n_inside): the half-open token indices that cover each span and how many
    tokens lie wholly in it; a span that touches no token has nulls and 0."""
    t = tokens.select(key, "token_index", F.col("start_offset").alias("__s"), F.col("end_offset").alias("__e"))
    s = spans.select(key, span_id, F.col(span[0]).alias("__a"), F.col(span[1]).alias("__b"))
    hits = overlapping(s, t, key, ("__a", "__b"), ("__s", "__e"))
    found = hits.groupBy(key, span_id).agg(F.min("token_index").alias("start_token"), (F.max("token_index") + 1).alias("end_token"), F.count_if(within(("__s", "__e"), ("__a", "__b"))).alias("n_inside"))
    return spans.select(key, span_id).join(found, [key, span_id], "left").na.fill(0, ["n_inside"])


def by_tokens(anchors: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """``anchors`` (key, start_token, end_token, start_offset, end_offset) with the offsets that their tokens have now,
    as tokens decide: ``status`` is ``agree``, ``moved`` where offsets were others, or ``lost`` where a token is not
    there or the span is empty; a lost anchor keeps its offsets."""
    at = lambda offset, name: tokens.select(F.col(key).alias(f"__k{name}"), F.col("token_index").alias(f"__i{name}"), F.col(offset).alias(f"__{name}"))
    first, last = at("start_offset", "from"), at("end_offset", "to")
    rows = anchors.join(first, (F.col(key) == F.col("__kfrom")) & (F.col("start_token") == F.col("__ifrom")), "left")
    rows = rows.join(last, (F.col(key) == F.col("__kto")) & (F.col("end_token") - 1 == F.col("__ito")), "left")
    lost = F.col("__from").isNull() | F.col("__to").isNull() | (F.col("start_token") >= F.col("end_token"))
    same = F.col("__from").eqNullSafe(F.col("start_offset")) & F.col("__to").eqNullSafe(F.col("end_offset"))
    status = F.when(lost, "lost").when(same, "agree").otherwise("moved")
    kept = {c: F.col(c) for c in anchors.columns} | {"start_offset": F.when(lost, F.col("start_offset")).otherwise(F.col("__from")), "end_offset": F.when(lost, F.col("end_offset")).otherwise(F.col("__to"))}
    return rows.select(*[c.alias(name) for name, c in kept.items()], status.alias("status"))
