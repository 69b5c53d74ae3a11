"""Sinks: CSV, deterministic JSON lines, export bundles, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, order: list[str] | None = None, single: bool = False) -> None:
    """UTF-8 with a header, quotes where needed, line feeds. ``single`` writes one file, for tables that a
    person reads; with ``order`` the bytes are the same in every run."""
    df = df.orderBy(*order) if order else df
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, lineSep="\n", quoteAll=False, escape='"', emptyValue="")


def json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """A JSON object a line, nulls kept, rows in order: range partitions are written in order, so the files, read
    by name, are in order too."""
    rows = df.orderBy(*order)
    rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def bundle(tables: dict[str, tuple[DataFrame, list[str]]], path: str, meta: dict[str, str]) -> None:
    """All datasets of an export, each in its own order, and a row of meta data with their counts."""
    spark = next(iter(tables.values()))[0].sparkSession
    counts = {}
    for name, (df, order) in tables.items():
        json_lines(df, f"{path}/{name}", order)
        counts[name] = spark.read.text(f"{path}/{name}").count()
    rows = sorted({**meta, **{f"count.{k}": str(v) for k, v in counts.items()}}.items())
    json_lines(spark.createDataFrame(rows, "key string, value string"), f"{path}/meta", ["key"])


def stored_prefix(df: DataFrame, path: str, text: str, partition: str | None = None) -> None:
    """A table with its prefix column, sorted by it in each file, so that statistics let a search skip files."""
    from quire.operators.facets import with_prefix

    out = with_prefix(df, text)
    keys = [partition, "prefix"] if partition else ["prefix"]
    writer = out.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def report(title: str, sections: dict[str, DataFrame], most: int = 20) -> str:
    """A report in Markdown: the first rows of each section, which are small tables of counts."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most).collect()
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"
