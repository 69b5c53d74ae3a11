"""Sources: tables of text cells, JSON lines, result folders, markup, vocabularies, configuration."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import normalize

# Fixed values.
WORKBOOKS = ("simples.xlsx", "Simples.xlsx", "simples.xlsm", "Simples.xlsm")

APPLIES_TO = "struct<kind:string,lemma_normalized:string,substance_lemma_normalized:string,part_lemma_normalized:string>"
RESULT = f"""source_id string,
terms array<struct<label:string,display:string,normalized:string,lemma_gr:string,lemma_normalized:string,is_multiword:boolean,head_lemma_normalized:string,substance_lemma_normalized:string,part_lemma_normalized:string,variant_place_lemma_normalized:string,applies_to:{APPLIES_TO},confidence:double,lemma_confidence:double>>,
qualities array<struct<axis:string,degree:string,intensity:string,hedge:string,evidence_display:string,evidence_normalized:string,variant_place_lemma_normalized:string,applies_to:{APPLIES_TO},confidence:double>>"""
ALIGNMENT = "source_a_entry_id string, source_b_entry_id string, alignment_type string, confidence double, evidence string, curator string, source string, _corrupt string"


def find_workbook(folder: str) -> Path:
    for name in WORKBOOKS:
        if (Path(folder) / name).exists():
            return Path(folder) / name
    raise FileNotFoundError(f"no workbook in {folder}: tried {', '.join(WORKBOOKS)}")


def csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """All cells as text, empty instead of null. Columns that are required and missing raise an error."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).na.fill("")
    missing = sorted(set(required or []) - set(df.columns))
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def workbook(spark: SparkSession, path: str, sheets: list[str]) -> dict[str, DataFrame]:
    """The sheets of an Office Open XML workbook, each a DataFrame of text cells with its row number.

    A workbook is one zip file of at most about a million rows a sheet, so it is read in one go on the
    driver, with the standard library."""
    import re
    import zipfile
    from xml.etree import ElementTree

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    out = {}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        named = {s.get("name"): targets[s.get(rel)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", ns)}
        missing = [s for s in sheets if s not in named]
        if missing:
            raise ValueError(f"{path} lacks sheets {', '.join(missing)}")
        for sheet in sheets:
            rows = []
            target = named[sheet].lstrip("/")
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{ns['m']}}}row"):
                cells = {}
                for c in row.findall("m:c", ns):
                    letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    v, kind = c.find("m:v", ns), c.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    elif v is None or v.text is None:
                        value = None
                    else:
                        value = shared[int(v.text)] if kind == "s" else v.text
                    cells[at - 1] = value
                rows.append(cells)
            head = rows[0] if rows else {}
            names = [head.get(i) or f"column_{i + 1}" for i in range(max(head, default=-1) + 1)]
            schema = T.StructType([T.StructField("row", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in names)])
            out[sheet] = spark.createDataFrame([(k, *(r.get(i) for i in range(len(names)))) for k, r in enumerate(rows[1:], 1)], schema)
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, numbered from 1 in each, read by as many tasks as they have splits.

    A first pass counts the lines of each split; a line's number is that of its split's first line, from running
    totals over the splits, and its place there. Lines end in a line feed, before which a carriage return goes.
    """
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    # both passes read one listing of the files, so rows have the same ids in both
    rows = spark.read.option("lineSep", "\n").text(path).select("value", *place, F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = splits.select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(splits, ["path", "start"]).select("path", (F.col("id") + F.col("shift") + 1).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str = ALIGNMENT) -> DataFrame:
    """Rows with line_no, the fields, and error (invalid_json) where a line does not parse; blank lines go."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    parsed = lines.select("line_no", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.select("line_no", "r.*").withColumn("error", F.when(F.col("_corrupt").isNotNull(), "invalid_json")).drop("_corrupt")


def results(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """One extraction result per file, under its source_id or else the file's stem."""
    rows = spark.read.schema(RESULT).json(f"{folder}/{prefix}*.json", multiLine=True).withColumn("file", F.input_file_name())
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.json$", "")
    return rows.withColumn("source_id", F.coalesce("source_id", F.url_decode(stem))).orderBy("source_id")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file in order; blank lines and comments go."""
    lines = numbered_lines(spark, path).select((F.col("line_no") - 1).alias("seq"), F.trim("line").alias("id"))
    return lines.filter((F.col("id") != "") & ~F.col("id").startswith("#"))


def fetched(ids: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The documents of all ids; one that is missing raises an error when it is read."""
    rows = ids.join(docs.withColumn("__hit", F.lit(True)), key, "left")
    return rows.filter(F.when(F.col("__hit"), True).otherwise(F.raise_error(F.concat(F.lit("missing document "), F.col(key))))).drop("__hit")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def markup(spark: SparkSession, path: str) -> DataFrame:
    """(tei_doc_id, content): files with markup under their stems."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("tei_doc_id"), "content")


def config(text: str) -> dict[str, str]:
    """A flat configuration of ``key: value`` lines, quotes and comments off; nested keys become dotted."""
    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip() or ":" not in body:
            continue
        depth = len(body) - len(body.lstrip())
        key, _, value = body.strip().partition(":")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            out[".".join([*(k for _, k in stack), key])] = value.strip().strip("\"'")
        else:
            stack.append((depth, key))
    return out


def checked_config(text: str, required: tuple[str, ...] = ("tei_doc_id", "source_code", "segment_xpath"), id_pattern: str = r"[a-z0-9_]+") -> dict[str, str]:
    import re

    found = config(text)
    missing = [k for k in required if k not in found]
    if missing:
        raise ValueError(f"configuration lacks {', '.join(missing)}")
    if "#" in found[required[0]] or not re.fullmatch(id_pattern, found[required[0]]):
        raise ValueError(f"bad id {found[required[0]]!r}")
    return found


def scan(spark: SparkSession, table: str, columns: list[str] | None = None, where: dict[str, object] | None = None, limit: int | None = None) -> DataFrame:
    """Selected columns of a table's rows that equal the given values."""
    df = spark.table(table)
    for c, v in (where or {}).items():
        df = df.filter(F.col(c) == v)
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit is not None else df


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(domain, english, greek, translit, form) from tables in Markdown under numbered headings: a row for
    each of the comma-separated Greek terms, the transliteration in parentheses."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    from pyspark.sql import Window

    head = F.regexp_extract("line", r"^#{2,}\s*\d+\.\s*(.+)$", 1)
    rows = lines.withColumn("domain", F.last(F.nullif(F.trim(head), F.lit("")), ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.col("line").rlike(r"^\|\s*\*\*")).select("domain", F.trim(F.regexp_replace(F.split("line", r"\|")[1], r"\*\*", "")).alias("english"), F.explode(F.split(F.split("line", r"\|")[2], ",")).alias("term"))
    greek = F.trim(F.regexp_replace("term", r"\(.*\)", ""))
    return rows.select("domain", "english", greek.alias("greek"), F.regexp_extract("term", r"\(([^)]*)\)", 1).alias("translit"), normalize(greek).alias("form")).filter("greek <> ''")
