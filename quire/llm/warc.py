"""A content-addressed WARC archive.

Record headers and payloads are two Parquet tables. A payload of at least ``inline_below`` bytes is
stored once under its SHA-256; shorter ones lie inline with their header. Reading joins them back by
digest and checks every payload against the digest in its header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EOL = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", inline_below: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """One WARC record per row, in ``path/headers`` and ``path/payloads``.

    Of rows with equal payloads of at least ``inline_below`` bytes those of the smallest page id are
    responses and the others revisits of it; a row that repeats the smallest id is a response too. A
    null payload is empty, a null url has no target line, a null id never is a revisit's target: if
    a group has no other ids all its rows are responses. Line ends in a url are percent-encoded. An
    empty table gives an empty archive. Equal digests whose payloads differ in length or in a second
    hash raise an error. Payload copies meet per task before the shuffle; headers of a hot payload
    are joined by a skew-splitting join.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n")
    )
    second = F.struct(F.xxhash64("payload"), F.col("n"))
    store = (
        base.filter(F.col("n") >= inline_below)
        .groupBy("digest")
        .agg(F.first("payload").alias("payload"), F.min("page_id").alias("first_id"), F.min(second).alias("lo"), F.max(second).alias("hi"))
        .select("digest", F.when(F.col("lo") == F.col("hi"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under digest "), "digest"))).alias("payload"), "first_id")
    )
    store.write.option("compression", "zstd").parquet(f"{path}/payloads")
    spark = pages.sparkSession
    firsts = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("of"), "first_id")
    slim = base.select("page_id", "url", "digest", "n", F.when(F.col("n") < inline_below, F.col("payload")).alias("inline"))
    rows = slim.join(firsts, (F.col("digest") == F.col("of")) & (F.col("n") >= inline_below), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1" + EOL),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("first_id"))), _line("WARC-Profile", F.lit(REVISIT)))).otherwise(F.lit("")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit(EOL),
    )
    rows.select(F.encode(header, "UTF-8").alias("header"), F.when(F.col("n") >= inline_below, F.col("digest")).alias("store_digest"), "inline").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The records: page_id, url, record_type, refers_to, payload_digest, payload (in full, revisits
    too) and record, the exact bytes of the WARC record. A payload that is missing or does not have
    its header's digest raises an error. Fields come from the stored header bytes."""
    heads = spark.read.parquet(f"{path}/headers")
    store = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("store_digest"), "payload")
    full = heads.join(store, "store_digest", "left").select("header", F.decode("header", "UTF-8").alias("text"), F.coalesce("inline", "payload").alias("payload"))
    field = lambda name: F.nullif(F.regexp_extract("text", rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    urn = lambda name: F.nullif(F.regexp_extract("text", rf"\r\n{name}: <urn:page:([^>]*)>\r\n", 1), F.lit("")).cast(id_type)
    kind = field("WARC-Type")
    digest = F.sha2("payload", 256)
    whole = field("WARC-Payload-Digest") == F.concat(F.lit("sha256:"), digest)
    end = F.encode(F.lit(EOL + EOL), "UTF-8")
    return full.select(
        urn("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        urn("WARC-Refers-To").alias("refers_to"),
        F.when(whole, digest).otherwise(F.raise_error(F.lit("a payload does not match its digest"))).alias("payload_digest"),
        "payload",
        F.when(kind == "revisit", F.concat("header", end)).otherwise(F.concat("header", "payload", end)).alias("record"),
    )
