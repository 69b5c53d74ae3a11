"""The registered queries over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, collocations, licenses, minhash, nearjoin, packing, quality, substrings, tokencount, topk, toxicity, vectorcodes, warc
from quire.llm.common import prepare, shared_folder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    pages = table(spark, sf_dir, "pages")
    path = f"{shared_folder(spark)}/quire/warc-{uuid.uuid4().hex}"
    warc.write_archive(pages, path)
    records = warc.read_archive(spark, path, pages.schema["page_id"].dataType.simpleString())
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, 5)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.strip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    found = vectorcodes.label_errors(coded.select("vec_id", "label", code.alias("code"), "error"))
    return found.select("vec_id", "code", "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_topk, op3_licenses, op4_quality, op5_bpe, op6_packing, op7_tokencount, op8_toxicity, op9_substrings, op10_nearjoin, op11_minhash, op12_collocations, op13_vectorcodes)}


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha256(body) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.h AS payload_digest,
       CASE WHEN d.n >= 100 AND d.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.n >= 100 AND d.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h
"""

OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 19)) AS p, ws FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 19], ' ')) AS k FROM s),
l AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 19)) AS p FROM l WHERE n > 1),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, CASE WHEN ps IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i)), lambda i: ws[i]) END AS kept FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""


OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, len(g) AS n FROM s),
i AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM i x JOIN i y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a WHERE r.root < e.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.root) AS component_id, min(r.root) = n.doc_id AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM t),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p WHERE len(ws) > 0),
f AS MATERIALIZED (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM i, (VALUES (1), (2), (3)) s(size) WHERE i + size - 1 <= len(ws) GROUP BY 1, 2, 3),
c AS MATERIALIZED (SELECT lang, size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE size > 1 AND f >= 10),
u AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
k AS (SELECT u.lang, u.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.head JOIN f y ON y.lang = u.lang AND y.phrase = u.tail),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
m AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a FROM c WHERE size = 3) GROUP BY 1, 2),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY 1),
x AS (SELECT b.* FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT x.*, n.n, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x JOIN n USING (lang)) WHERE rank <= 2000
"""


def _op13_sql() -> str:
    """Each round: distances of every part to every entry, the least of distance * 256 + entry, then flooring means."""
    steps = []
    for k in range(5):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.c) + list_dot_product(b.c, b.c))::BIGINT * 256 + b.entry) AS best
  FROM p JOIN b{k} b ON p.part = b.part GROUP BY p.row, p.vec_id, p.label, p.part)""")
        if k < 4:
            steps.append(f"""
m{k} AS (SELECT part, best % 256 AS entry, j, floor(sum(x[j]) / count(*)) AS c FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY 1, 2, 3),
l{k} AS (SELECT part, entry, list(c ORDER BY j) AS c FROM m{k} GROUP BY 1, 2),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(l{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN l{k} USING (part, entry))""")
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS MATERIALIZED (SELECT row, vec_id, label, k AS part, e[k * len(e) // 4 + 1:(k + 1) * len(e) // 4] AS x FROM v, range(4) t(k)),
b0 AS (SELECT part, row - 1 AS entry, x AS c FROM p WHERE row <= 256),{",".join(steps)},
o AS (SELECT vec_id, label, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a4 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_topk": OP2_SQL, "op9_substrings": OP9_SQL, "op11_minhash": OP11_SQL, "op12_collocations": OP12_SQL, "op13_vectorcodes": _op13_sql()}
