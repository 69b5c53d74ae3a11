"""The registered queries: every operator on the driver's tables, with the SQL that says the same.

Analogies: documents are entries, their source is the source, labels are assertions, pages are markup,
conversations are lines of print, event properties are JSON payloads, parts are headwords and vocabulary,
orders with their line items are entries with links, nations and regions are documents and sources.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import ship
from quire.functions import cells, citations, jsonorder, text
from quire.operators import anchoring, bucketed, checks, facets, fingerprints, linking, marginal, markup, mentions, reuse, sharing, spans, tables, trigrams
from quire.sources import readers, sinks
from quire.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NORM = "strip_accents(lower(coalesce(text, '')))"

# ---- text -------------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({NORM}) AS normalized_sha256, length({NORM})::INTEGER AS n_chars FROM documents")
def normalize_text(spark, d):
    n = text.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(n, 256).alias("normalized_sha256"), F.char_length(n).alias("n_chars"))


@query(f"SELECT doc_id, sha256(text) AS raw_hash, sha256({NORM}) AS normalized_hash FROM documents")
def dual_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.raw_hash(F.col("text")).alias("raw_hash"), text.normalized_hash(F.col("text")).alias("normalized_hash"))


_TOKENS = r"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\p{L}\p{N}]*[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*') AS segs FROM documents),
u AS (SELECT doc_id, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i FROM s),
t AS (SELECT doc_id, i, regexp_extract(seg, '[\p{L}\p{N}].*$', 0, 's') AS token, sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM u)
"""


@query(_TOKENS + "SELECT doc_id, count(*) AS n_tokens, sum(stop - length(token))::BIGINT AS sum_start, sum(stop)::BIGINT AS sum_end, max(i)::INTEGER AS last_index FROM t GROUP BY doc_id")
def tokenize_offsets(spark, d):
    t = text.tokens(table(spark, d, "documents"), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("start_offset").alias("sum_start"), F.sum("end_offset").alias("sum_end"), (F.max("token_index") + 1).alias("last_index"))


@query(_TOKENS + "SELECT strip_accents(lower(token)) AS token, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 50")
def token_index_counts(spark, d):
    words = table(spark, d, "documents").select(F.explode(text.token_texts(F.col("text"))).alias("t"))
    return words.groupBy(text.normalize(F.col("t")).alias("token")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(50)


@query(f"SELECT doc_id, source, left({NORM}, 512) AS prefix FROM documents WHERE starts_with(left({NORM}, 512), 'the th') ORDER BY source, doc_id LIMIT 100")
def prefix_search(spark, d):
    docs = facets.with_prefix(table(spark, d, "documents"), "text")
    return facets.search(docs, " Thé  TH", ["source", "doc_id"]).select("doc_id", "source", "prefix")


@query("SELECT doc_id, source FROM documents WHERE false")
def short_query(spark, d):
    docs = facets.with_prefix(table(spark, d, "documents"), "text")
    return facets.search(docs, "th", ["source", "doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, source, lang, n_chars FROM documents ORDER BY source, doc_id LIMIT 50")
def browse_first_page(spark, d):
    return facets.search(table(spark, d, "documents"), None, ["source", "doc_id"]).select("doc_id", "source", "lang", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE (source, doc_id) > ('src1', 100) ORDER BY source, doc_id LIMIT 50")
def next_page(spark, d):
    return facets.page_after(table(spark, d, "documents"), ["source", "doc_id"], ("src1", 100)).select("doc_id", "source")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id = 42")
def entry_detail(spark, d):
    return facets.lookup(table(spark, d, "documents"), "doc_id", 42)


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS n_words, sha256(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), '\n')) AS single_line_sha256, CASE WHEN length(text) > 180 THEN left(text, 177) || '...' ELSE text END AS clipped FROM documents")
def text_cells(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.word_count(t).alias("n_words"), F.sha2(text.single_line(t), 256).alias("single_line_sha256"), text.clip(t, 180).alias("clipped"))


@query(r"""
WITH w AS (SELECT source, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, n_chars FROM documents),
t AS (SELECT source, count(*) AS n_docs, sum(n)::BIGINT AS n_words, sum(n_chars)::BIGINT AS n_chars FROM w GROUP BY source)
SELECT *, abs(n_words * 6.5 - n_chars) > 0.05 * n_chars AS alert FROM t""")
def word_counts_by_source(spark, d):
    rows = table(spark, d, "documents").select("source", text.word_count(F.col("text")).alias("n"), "n_chars")
    out = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"), F.sum("n_chars").alias("n_chars"))
    return out.withColumn("alert", F.abs(F.col("n_words") * 6.5 - F.col("n_chars")) > 0.05 * F.col("n_chars"))


# ---- identities, mutations, order -------------------------------------------------------------


@query("""
WITH i AS (SELECT c_custkey, c_nationkey::VARCHAR || '.' || c_mktsegment AS ident FROM customer)
SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY ident) > 1 THEN ident || '~' || row_number() OVER (PARTITION BY ident ORDER BY c_custkey) ELSE ident END AS entry_id FROM i""")
def dedupe_ids(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), F.lit("."), "c_mktsegment").alias("ident"))
    return cells.dedupe_ids(rows, "ident", ["c_custkey"]).select("c_custkey", "entry_id")


@query(r"""
WITH r AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'null_contents' WHEN trim(text) = '' THEN 'blank_contents' WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 50 THEN 'too_short' END AS reason FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS i FROM r WHERE reason IS NOT NULL)
SELECT reason, count(*) AS n, string_agg(CASE WHEN i <= 3 THEN doc_id::VARCHAR END, ',' ORDER BY doc_id) AS examples FROM n GROUP BY reason""")
def skip_reasons(spark, d):
    return checks.skip_counts(table(spark, d, "documents"), checks.skip_reason(F.col("text"), 50), "doc_id")


@query("""
WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS ln, min(l_suppkey) AS sk FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ln, l_partkey) - 1 AS pos FROM f)
SELECT l_orderkey, l_partkey::VARCHAR AS part_id, pos::INTEGER AS position, pos = 0 AS is_primary FROM p""")
def link_explode_primary(spark, d):
    seen = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    cell = F.array_join(F.transform(seen, lambda x: x["l_partkey"].cast("string")), ", ")
    return tables.exploded_links(table(spark, d, "lineitem").groupBy("l_orderkey").agg(cell.alias("cell")), "l_orderkey", "cell", "part_id")


@query("""
WITH l AS (SELECT 'L' || lpad(p_partkey::VARCHAR, 6, '0') AS lemma_id, p_partkey, strip_accents(lower(p_name)) AS h FROM part)
SELECT arg_min(lemma_id, p_partkey) AS canonical_lemma_id, h AS headword_normalized, string_agg(lemma_id, ',' ORDER BY p_partkey) AS member_lemma_ids, count(*)::INTEGER AS n_members FROM l GROUP BY h HAVING count(*) > 1""")
def canonical_clusters(spark, d):
    """Keys of seven digits lose the last in an id, so members go by key."""
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("L"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("lemma_id"), text.normalize(F.col("p_name")).alias("headword_normalized"))
    return linking.clusters(rows, "p_partkey")


@query("""
SELECT lower(p_name) AS headword, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, headword LIMIT 20""")
def top_groups(spark, d):
    rows = table(spark, d, "part").groupBy(F.lower("p_name").alias("headword")).agg(F.count("*").alias("n"))
    return tables.top_groups(rows, "n", "headword", 20)


def _halves(spark, d):
    c = table(spark, d, "customer")
    target = c.filter("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    batch = c.filter("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    again = c.filter("c_custkey % 10 = 0").select("c_custkey", F.lower("c_name").alias("c_name"), (F.col("c_acctbal") + 2).alias("c_acctbal"))
    return target, batch.withColumn("seq", F.lit(1)).union(again.withColumn("seq", F.lit(2)))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN lower(c_name) WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 2 WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS c_nationkey
FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""")
def upsert_merge(spark, d):
    target, batch = _halves(spark, d)
    return tables.upsert(target, batch, ["c_custkey"], [F.col("seq")])


@query("""
WITH a AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem),
b AS (SELECT l_orderkey, l_partkey, CASE WHEN l_orderkey % 97 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_partkey % 101 <> 0),
d AS (SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT l_orderkey, l_partkey, l_quantity, side, count(*) AS n FROM d GROUP BY 1, 2, 3, 4""")
def bag_differences(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    more = F.when(F.col("l_orderkey") % 97 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    b = a.filter("l_partkey % 101 <> 0").withColumn("l_quantity", more)
    return fingerprints.differences(a, b, ["l_orderkey"])


def _bucketed(spark, target, by, name):
    """A bucketed table in the shared folder that holds ``target``."""
    made = bucketed.BucketedTable.create(spark, f"{shared_folder(spark)}/quire/{name}-{uuid.uuid4().hex}", target.schema, by, 16)
    made.change(target, "first", lambda rows, new: new)
    return made


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN lower(c_name) WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name,
       CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 2 WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
       CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS c_nationkey
FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""")
def bucketed_upsert(spark, d):
    target, batch = _halves(spark, d)
    made = _bucketed(spark, target, ["c_custkey"], "customers")
    for again in ("batch", "batch"):  # the second run is known and changes nothing
        made.upsert(batch, again, ["c_custkey"], [F.col("seq")])
    return made.read()


@query("""
SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 10 AND c_custkey % 4 = 0 THEN false ELSE true END AS is_active,
       CASE WHEN c_nationkey < 10 THEN 'run2' ELSE 'run1' END AS last_import_run_id
FROM customer""")
def bucketed_deactivate(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    made = _bucketed(spark, c.withColumns({"is_active": F.lit(True), "last_import_run_id": F.lit("run1")}), ["c_nationkey"], "entries")
    run = c.filter("c_nationkey < 10 and c_custkey % 4 <> 0")
    made.change(run, "run2", lambda rows, new: tables.deactivate_unseen(rows, new, ["c_custkey", "c_nationkey"], "c_nationkey", "run2"))
    return made.read()


@query("""
SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 10 AND c_custkey % 4 = 0 THEN false ELSE true END AS is_active,
       CASE WHEN c_nationkey < 10 THEN 'run2' ELSE 'run1' END AS last_import_run_id
FROM customer""")
def deactivate_unseen(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    before = c.withColumns({"is_active": F.lit(True), "last_import_run_id": F.lit("run1")})
    run = c.filter("c_nationkey < 10 and c_custkey % 4 <> 0")
    return tables.deactivate_unseen(before, run, ["c_custkey", "c_nationkey"], "c_nationkey", "run2")


@query(f"""
SELECT doc_id, sha256({NORM}) AS stored_hash, sha256({NORM}) IS DISTINCT FROM CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'old' ELSE sha256({NORM}) END AS changed FROM documents""")
def backfill_distinct_from(spark, d):
    now = text.normalized_hash(F.col("text"))
    rows = table(spark, d, "documents").withColumn("stored_hash", F.when(F.col("doc_id") % 3 == 1, "old").when(F.col("doc_id") % 3 == 2, now))
    return tables.backfill(rows, "stored_hash", now).select("doc_id", "stored_hash", "changed")


@query("""
SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'final' ELSE c_mktsegment END AS status FROM customer""")
def keyed_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("status"))
    return tables.update_where(rows, F.col("c_custkey") == 7, {"status": F.lit(tables.checked("final", checks.GEN1_STATUS))})


@query("""
SELECT batch_id, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key
FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch_id FROM orders) GROUP BY batch_id""")
def load_batches(spark, d):
    rows = tables.batches(table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 500)
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_version(spark, d):
    return tables.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, coalesce(max(event_id), 0) + 1 AS next_version FROM events GROUP BY user_id")
def next_version(spark, d):
    return tables.next_version(table(spark, d, "events"), ["user_id"], "event_id")


@query("""
SELECT conv_id, turn, lag(turn) OVER w AS previous_turn, sha256(lag(text) OVER w) AS previous_sha256 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prev_context(spark, d):
    rows = tables.previous_in(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], ["turn", "text"])
    return rows.select("conv_id", "turn", "previous_turn", F.sha2("previous_text", 256).alias("previous_sha256"))


@query(r"""
WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*') AS ts FROM conversations)
SELECT conv_id, turn, array_to_string(ts[greatest(1, 8 - 3):8 + 3], ' ') AS around FROM t""")
def token_context(spark, d):
    ts = text.token_texts(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tables.context(ts, F.lit(7), F.lit(8), 3), " ").alias("around"))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0),
c AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.node, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child)
SELECT node, ancestor, depth FROM c""")
def recursive_closure(spark, d):
    edges = table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 2).alias("parent"))
    return tables.closure(edges, "child", "parent")


# ---- linking ----------------------------------------------------------------------------------

VOCABULARY = [("P1", "ring", "shape"), ("P2", "widget", "shape"), ("P3", "red", "colour"), ("P4", "small", "size"), ("P5", "large", "size"), ("P6", "blue", "colour"), ("P7", "ring", "jewel")]
_VOCAB_SQL = "v(prep_id, form, domain, rule) AS (VALUES " + ", ".join(f"('{i}', '{w}', '{g}', {k})" for k, (i, w, g) in enumerate(VOCABULARY)) + ")"


def _vocabulary(spark):
    return spark.createDataFrame([(i, w, g, k) for k, (i, w, g) in enumerate(VOCABULARY)], "prep_id string, form string, domain string, rule int")


def _part_words(spark, d):
    words = table(spark, d, "part").select("p_partkey", "p_type", F.posexplode(F.split(text.normalize(F.col("p_name")), " ")).alias("pos", "token"))
    return words.select("p_partkey", "p_type", F.lit("p_name").alias("field"), F.lit(0).alias("field_no"), "pos", F.col("token").alias("surface"), "token")


_WORDS_SQL = "w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token, generate_subscripts(string_split(lower(p_name), ' '), 1) - 1 AS pos FROM part)"


@query(f"""
WITH {_VOCAB_SQL}, {_WORDS_SQL},
f AS (SELECT form, arg_min(prep_id, rule) AS prep_id FROM v GROUP BY form),
m AS (SELECT p_partkey, prep_id, min(pos) AS pos, arg_min(token, pos) AS token FROM w JOIN f ON token = form GROUP BY 1, 2)
SELECT p_partkey, prep_id, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) = 1 AS is_primary, 'matched_in=p_name; token=' || token AS notes FROM m""")
def vocab_link_first_match(spark, d):
    return linking.first_matches(_part_words(spark, d), _vocabulary(spark), "p_partkey")[0]


@query(f"""
WITH {_VOCAB_SQL}, {_WORDS_SQL},
f AS (SELECT form, min(prep_id) AS one, count(*) AS n FROM v GROUP BY form),
h AS (SELECT p_partkey, CASE WHEN n = 1 THEN one WHEN p_type = 'ECONOMY' THEN 'P7' WHEN p_type = 'SMALL' THEN 'P1' END AS part_id FROM w JOIN f ON token = form JOIN part USING (p_partkey))
SELECT p_partkey, min(part_id) AS part_id FROM h WHERE part_id IS NOT NULL GROUP BY p_partkey HAVING count(DISTINCT part_id) = 1""")
def unique_part_assignment(spark, d):
    words = _part_words(spark, d).select("p_partkey", "p_type", F.col("token").alias("form"))
    return linking.unique_targets(words, _vocabulary(spark).withColumnRenamed("prep_id", "part_id"), "p_partkey", "p_type", {"ECONOMY": "P7", "SMALL": "P1", "PROMO": "P3"})


@query(f"WITH {_VOCAB_SQL}, {_WORDS_SQL} SELECT token, count(*) AS n, min(p_partkey) AS example FROM w WHERE token NOT IN (SELECT form FROM v) GROUP BY token")
def unmatched_terms(spark, d):
    return linking.term_counts(linking.first_matches(_part_words(spark, d), _vocabulary(spark), "p_partkey")[1], "p_partkey")


@query(f"""
WITH {_VOCAB_SQL}, {_WORDS_SQL}, h AS (SELECT DISTINCT p_partkey, domain, form FROM w JOIN v ON token = form)
SELECT p_partkey, domain, string_agg(form, ',' ORDER BY form) AS terms FROM h GROUP BY 1, 2""")
def vocab_facets(spark, d):
    vocabulary = _vocabulary(spark).withColumn("english", F.col("form"))
    return linking.vocabulary_facets(table(spark, d, "part"), "p_partkey", "p_name", vocabulary)


@query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 5 = 0 THEN p_name || ' x' ELSE p_name END AS name FROM part),
c AS (SELECT CASE WHEN name IN (SELECT p_name FROM part) THEN 'exact' WHEN lower(trim(name)) IN (SELECT lower(p_name) FROM part) THEN 'variant' ELSE 'new' END AS match FROM n)
SELECT match, count(*) AS n FROM c GROUP BY match""")
def match_classes(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" x"))).otherwise(F.col("p_name")).alias("name"))
    return linking.match_classes(names, p.select(F.col("p_name").alias("name"))).groupBy("match").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT DISTINCT p_name AS form_normalized, p_brand AS lemma_id FROM part)
SELECT form_normalized, count(*) AS n_lemmata, CASE WHEN count(*) > 1 THEN 'needs_review' ELSE 'merged' END AS status FROM f GROUP BY 1""")
def form_merge(spark, d):
    return linking.form_merge(table(spark, d, "part").select(F.col("p_name").alias("form_normalized"), F.col("p_brand").alias("lemma_id")))


# ---- facets -----------------------------------------------------------------------------------


@query("""
SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey
WHERE e.event_type = 'click' AND json_extract_string(e.props, '$.k') = '7' AND c.c_acctbal > 0""")
def facet_quality(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("assertion_type"), F.col("props").alias("payload"), F.col("user_id").alias("tei_entry_id"), F.lit(False).alias("is_stale"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", (F.col("c_acctbal") > 0).alias("is_active"))
    return facets.facet(e, c, "click", {"k": "7"}, keep=["event_id"]).select("event_id", "c_name")


@query("""
SELECT DISTINCT 'order~' || o.o_orderkey AS display_entry_id, p.p_brand AS form_normalized, p.p_name AS headword_normalized
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey
WHERE starts_with(p.p_name, 'red wi') AND o.o_orderstatus = 'F'""")
def facet_substance(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order~"), F.col("o_orderkey").cast("string")).alias("display_entry_id"), (F.col("o_orderstatus") == "F").alias("is_active"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tei_entry_id"), F.col("l_partkey").alias("lemma_form_id"))
    parts = table(spark, d, "part")
    forms = parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("form_normalized"), F.col("p_name").alias("lemma_id"))
    heads = parts.select(F.col("p_name").alias("id"), F.col("p_name").alias("headword_normalized")).distinct()
    return facets.facet_substance(orders, links, forms, heads, "Red wi")


@query("""
SELECT coalesce(d.source, '(all)') AS source, count(*) AS n, count(l.doc_id) AS n_labelled, count(*) FILTER (WHERE l.toxic = 1) AS n_stale
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (d.source)""")
def facet_counts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels").withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l"), "left")
    return rows.rollup("source").agg(F.count("*").alias("n"), F.count("l").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_stale")).withColumn("source", F.coalesce("source", F.lit("(all)")))


@query("""
SELECT c.c_custkey, count(DISTINCT o.o_orderkey) AS n_translations, coalesce(a.n, 0) AS n_assertions, coalesce(a.s, false) AS has_stale
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT user_id, count(*) AS n, bool_or(event_type = 'error') AS s FROM events GROUP BY 1) a ON a.user_id = c.c_custkey
GROUP BY c.c_custkey, a.n, a.s""")
def badges(spark, d):
    return facets.badges(
        table(spark, d, "customer"),
        table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"),
        table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), (F.col("event_type") == "error").alias("is_stale")),
        "c_custkey",
    )


@query("""
SELECT p.p_name AS lemma_id, count(DISTINCT p.p_partkey) AS n_forms, count(DISTINCT l.l_orderkey) AS n_entries
FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey GROUP BY 1""")
def lemma_counts(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("lemma_id"), F.col("p_partkey").alias("form_id"))
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("form_id"), F.col("l_orderkey").alias("entry_id"))
    return facets.lemma_counts(p.select("lemma_id").distinct(), p, links)


@query("SELECT coalesce(event_type, '(all)') AS assertion_type, count(*) AS n, count(*) FILTER (WHERE value < 5) AS n_stale FROM events GROUP BY ROLLUP (event_type)")
def assertion_totals(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("assertion_type"), (F.col("value") < 5).alias("is_stale"))
    return facets.totals(e).withColumn("assertion_type", F.coalesce("assertion_type", F.lit("(all)")))


@query("""
SELECT c_custkey, c_nationkey FROM customer c WHERE c_nationkey IN (1, 2, 3)
AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')""")
def semi_has_link(spark, d):
    c = table(spark, d, "customer").withColumn("source", F.col("c_nationkey").cast("string"))
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = facets.list_filter(c, ["1", "2", "3"], None, {"has": (o.filter("o_orderstatus = 'F'"), True), "not": (o.filter("o_orderpriority = '1-URGENT'"), False)}, "c_custkey")
    return out.select("c_custkey", "c_nationkey")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def text_contains(spark, d):
    return facets.list_filter(table(spark, d, "documents"), active=None, key="doc_id", contains=("text", "LICENSE")).select("doc_id", "source")


_NEEDLES = ("License", "und die", "%", "th", "src1", "qqqxz", "Ü")


@query(f"SELECT needle, doc_id FROM documents JOIN (VALUES {', '.join(f"('{n}')" for n in _NEEDLES)}) v(needle) ON contains(lower(text), lower(needle)) OR contains(lower(source), lower(needle))")
def trigram_search(spark, d):
    docs, columns, path = table(spark, d, "documents"), ["text", "source"], f"{shared_folder(spark)}/quire/trigrams-{uuid.uuid4().hex}"
    trigrams.build(docs, "doc_id", columns, path)
    found = [trigrams.search(docs, path, "doc_id", columns, n).select(F.lit(n).alias("needle"), "doc_id") for n in _NEEDLES]
    return reduce(DataFrame.union, found)


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS p FROM lineitem),
s AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM l a JOIN l b ON a.p = b.p AND a.e <> b.e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM s)
SELECT a, b, n AS n_shared FROM r WHERE k <= 3""")
def compare_shared(spark, d):
    return sharing.sharing(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 3)


@query("""
WITH l AS (SELECT DISTINCT o_custkey AS e, unnest([o_orderpriority, o_orderstatus, o_orderkey // 20 || '']) AS p FROM orders),
s AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM l a JOIN l b ON a.p = b.p AND a.e <> b.e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM s)
SELECT a, b, n AS n_shared FROM r WHERE k <= 3""")
def compare_ubiquitous(spark, d):
    """Priorities and states are shared by most customers, the twenty orders around one by few."""
    near = F.floor(F.col("o_orderkey") / 20).cast("string")
    links = table(spark, d, "orders").select("o_custkey", F.explode(F.array("o_orderpriority", "o_orderstatus", near)).alias("head"))
    return sharing.sharing(links, "o_custkey", "head", 3, heavy=50)


@query("""
WITH x AS (SELECT DISTINCT p.p_name, s.s_nationkey FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)
SELECT p_name, count(*) AS n_sources FROM x GROUP BY 1 HAVING count(*) >= 2""")
def shared_across_sources(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return facets.shared_headwords(rows, "p_name", "s_nationkey")


@query(r"""
WITH a AS (SELECT item_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS x FROM benchmark),
b AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS y FROM documents),
p AS (SELECT doc_id, y, unnest(generate_series(1, len(y) - 5)) AS i FROM b WHERE len(y) > 5),
t AS (SELECT item_id, doc_id, list_distinct(x) AS x, list_distinct(y[i:i + len(x) - 1]) AS y FROM a JOIN p ON array_to_string(x[1:6], ' ') = array_to_string(y[i:i + 5], ' ') WHERE len(x) > 5)
SELECT item_id, doc_id, round(max(len(list_intersect(x, y)) / greatest(len(x) + len(y) - len(list_intersect(x, y)), 1)), 6) AS similarity FROM t GROUP BY 1, 2""")
def passage_overlap(spark, d):
    a = table(spark, d, "benchmark").select("item_id", facets.token_list(F.col("text")).alias("x")).filter(F.size("x") > 5)
    b = table(spark, d, "documents").select("doc_id", facets.token_list(F.col("text")).alias("y"))
    hits = facets.passages(a, "x", b, "y", 6, "doc_id")
    return hits.groupBy("item_id", "doc_id").agg(F.round(F.max(facets.jaccard(F.col("x"), F.col("run"))), 6).alias("similarity"))


_REUSE = r"""
WITH a AS (SELECT item_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS x FROM benchmark),
b AS (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS y FROM documents),
p AS (SELECT item_id, i, array_to_string(x[i:i + 7], ' ') AS g FROM (SELECT item_id, x, unnest(range(1, len(x) - 6)) AS i FROM a WHERE len(x) > 7)),
q AS (SELECT doc_id, j, array_to_string(y[j:j + 7], ' ') AS g FROM (SELECT doc_id, y, unnest(range(1, len(y) - 6)) AS j FROM b WHERE len(y) > 7)),
s AS (SELECT item_id, doc_id, i, j, i - row_number() OVER (PARTITION BY item_id, doc_id, j - i ORDER BY i) AS island FROM p JOIN q USING (g)),
k AS (SELECT doc_id, y, unnest(range(1, len(y) + 1)) AS j FROM b),
r AS (SELECT item_id, doc_id, min(i) - 1 AS item_start, min(j) - 1 AS text_start, count(*) + 7 AS n_tokens FROM s GROUP BY item_id, doc_id, j - i, island
  UNION ALL SELECT item_id, doc_id, 0, j - 1, len(x) FROM a JOIN k ON len(x) BETWEEN 1 AND 7 AND y[j:j + len(x) - 1] = x)
"""


def _token_lists(spark, d):
    tokens = facets.token_list(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", tokens.alias("x")), table(spark, d, "documents").select("doc_id", tokens.alias("y"))


@query(_REUSE + "SELECT item_id, doc_id, item_start::INTEGER AS item_start, text_start::INTEGER AS text_start, n_tokens::INTEGER AS n_tokens FROM r")
def reused_runs(spark, d):
    return reuse.runs(*_token_lists(spark, d), "item_id", "doc_id", "x", "y")


@query(_REUSE + """,
l AS (SELECT *, lag(item_start + n_tokens) OVER w AS pi, lag(text_start + n_tokens) OVER w AS pt FROM r WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY text_start, item_start)),
c AS (SELECT *, sum(CASE WHEN text_start - pt BETWEEN 0 AND 10 AND item_start - pi BETWEEN 0 AND 10 THEN 0 ELSE 1 END) OVER (PARTITION BY item_id, doc_id ORDER BY text_start, item_start) AS chain FROM l)
SELECT item_id, doc_id, min(item_start)::INTEGER AS item_start, max(item_start + n_tokens)::INTEGER AS item_end, min(text_start)::INTEGER AS text_start, max(text_start + n_tokens)::INTEGER AS text_end,
  sum(n_tokens)::INTEGER AS n_equal, count(*)::INTEGER AS n_runs FROM c GROUP BY item_id, doc_id, chain""")
def reused_passages(spark, d):
    return reuse.passages(reused_runs(spark, d), "item_id", "doc_id")


@query("""
SELECT t.name AS table_name, r.role, r.role IN ('authenticated', 'viewer', 'editor', 'service') AS can_read,
       t.writer <> '' AND (r.role = 'service' OR r.role = t.writer) AS can_write
FROM (VALUES ('translations', 'editor'), ('assertions', 'editor'), ('lemmata', 'editor'), ('lemma_forms', 'editor'), ('entry_lemma_forms', 'editor'), ('lemma_aliases', 'editor'), ('entry_alignments', 'editor'), ('entries', 'service'), ('tokens', 'service'), ('entry_refs', 'service'), ('import_runs', 'service'), ('sources', ''), ('docs', ''), ('quality_vocab', ''), ('parts_vocab', ''), ('process_vocab', '')) t(name, writer),
     (VALUES ('anonymous'), ('authenticated'), ('viewer'), ('editor'), ('service')) r(role)""")
def policy_matrix(spark, d):
    roles = ("anonymous", "authenticated", "viewer", "editor", "service")
    return spark.createDataFrame([(t, r, facets.may(t, r), facets.may(t, r, True)) for t in facets.POLICIES for r in roles], "table_name string, role string, can_read boolean, can_write boolean")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def secured_scan(spark, d):
    seen = facets.secured(table(spark, d, "nation"), "docs", "viewer").filter("n_regionkey = 1")
    hidden = facets.secured(table(spark, d, "nation"), "docs", None)
    return seen.union(hidden).select("n_nationkey", "n_name")


# ---- quality, provenance, comparison ----------------------------------------------------------


@query("""
SELECT 'lineitem.part' AS fk, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 5)
UNION ALL SELECT 'orders.customer', count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT 'labels.documents', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id = l.doc_id)""")
def fk_violations(spark, d):
    found = [
        ("lineitem.part", checks.orphans(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part").filter("p_size > 5"), "p_partkey")),
        ("orders.customer", checks.orphans(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey")),
        ("labels.documents", checks.orphans(table(spark, d, "labels"), "doc_id", table(spark, d, "documents"), "doc_id")),
    ]
    out = None
    for name, rows in found:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("fk"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS bad_status, count(*) FILTER (WHERE o_totalprice < 1000) AS low_price,
       round(100.0 * count(*) FILTER (WHERE o_orderpriority <> '5-LOW') / count(*), 1) AS coverage,
       (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS n_repeated FROM orders""")
def validation_metrics(spark, d):
    o = table(spark, d, "orders")
    one = o.agg(F.count("*").alias("n"), F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("bad_status"), F.count_if(F.col("o_totalprice") < 1000).alias("low_price"), checks.coverage(F.col("o_orderpriority") != "5-LOW").alias("coverage"))
    return one.join(checks.duplicate_keys(o, "o_custkey").agg(F.count("*").alias("n_repeated")))


@query("""
WITH a AS (SELECT least(x.l_partkey, y.l_partkey) AS a, greatest(x.l_partkey, y.l_partkey) AS b, x.l_returnflag AS t, x.l_orderkey * 100 + x.l_linenumber AS line_no, x.l_quantity AS confidence
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 AND x.l_partkey <> y.l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, t ORDER BY line_no DESC, confidence DESC) AS n FROM a)
SELECT a, b, t AS alignment_type, confidence, line_no FROM r WHERE n = 1""")
def align_last_wins(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    y = x.select(F.col("l_orderkey").alias("o"), (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("p"))
    rows = x.join(y, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("n"))).filter("l_partkey <> p")
    rows = rows.select(F.least("l_partkey", "p").alias("a"), F.greatest("l_partkey", "p").alias("b"), F.col("l_returnflag").alias("alignment_type"), F.col("l_quantity").alias("confidence"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"))
    return tables.last_wins(rows, ["a", "b", "alignment_type"], [F.col("line_no"), F.col("confidence")])


@query("""
SELECT id, count(*) AS n FROM (SELECT l_partkey AS id FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY id""")
def alignment_endpoints(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.lit("x").alias("alignment_type"))
    return facets.aligned(rows).groupBy(F.col("entry").alias("id")).agg(F.count("*").alias("n"))


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount > 0.08 THEN 'confidence_range' END AS c1, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'unknown_type' END AS c2, CASE WHEN l_partkey = l_suppkey THEN 'self_pair' END AS c3 FROM lineitem)
SELECT concat_ws(',', c2, c3, c1) AS errors, count(*) AS n FROM e GROUP BY 1""")
def alignment_errors(spark, d):
    key = lambda c: F.concat(F.lit("x~"), F.col(c).cast("string"))
    rows = table(spark, d, "lineitem").select(key("l_partkey").alias("source_a_entry_id"), key("l_suppkey").alias("source_b_entry_id"), F.col("l_returnflag").alias("alignment_type"), F.when(F.col("l_discount") > 0.08, 2.0).otherwise(0.5).alias("confidence"), F.lit("run").alias("source"))
    return rows.groupBy(F.array_join(checks.alignment_errors(rows, ("A", "N")), ",").alias("errors")).agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS p FROM lineitem WHERE l_linenumber <> 2), b AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS p FROM lineitem WHERE l_linenumber <> 5),
k AS (SELECT DISTINCT l_orderkey AS id FROM lineitem),
x AS (SELECT id, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY id), y AS (SELECT id, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY id)
SELECT k.id, coalesce(x.n, 0)::INTEGER AS terms_added, coalesce(y.n, 0)::INTEGER AS terms_removed, coalesce(x.n, 0) + coalesce(y.n, 0) > 0 AS changed FROM k LEFT JOIN x ON k.id = x.id LEFT JOIN y ON k.id = y.id""")
def run_diff(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_linenumber")
    side = lambda n: li.groupBy("id").agg(F.collect_set(F.when(F.col("l_linenumber") != n, F.col("l_partkey"))).alias("terms"))
    return checks.run_diff(side(2), side(5), li.select("id").distinct(), "id", ["terms"])


@query("""
WITH v AS (SELECT event_type, event_id, event_id % 5 AS t, CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'false' WHEN 2 THEN (event_id % 997 - 500)::VARCHAR WHEN 3 THEN '"' || user_id || '"' ELSE '[' || (event_id % 89 - 40) || ',"' || user_id || '"]' END AS value FROM events),
o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY t, CASE t WHEN 2 THEN event_id % 997 - 500 WHEN 4 THEN event_id % 89 - 40 ELSE 0 END, value) AS k, row_number() OVER (PARTITION BY event_type, value ORDER BY event_id) AS again FROM v),
r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY k) AS place FROM o WHERE again = 1)
SELECT event_type, value, place::INTEGER AS place FROM r""")
def json_order(spark, d):
    e, text_of = table(spark, d, "events"), lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    number = lambda n, shift: (F.col("event_id") % n - shift).cast("string")
    kinds = F.array(F.lit("null"), F.lit("false"), number(997, 500), text_of("user_id"), F.concat(F.lit("["), number(89, 40), F.lit(","), text_of("user_id"), F.lit("]")))
    values = e.select("event_type", kinds[(F.col("event_id") % 5).cast("int")].alias("value")).distinct().withColumn("key", jsonorder.json_key("value"))
    return values.select("event_type", "value", F.row_number().over(Window.partitionBy("event_type").orderBy("key")).alias("place"))


@query(f"""
SELECT doc_id, sha256({NORM}) <> CASE WHEN doc_id % 5 = 0 THEN sha256('x' || {NORM}) ELSE sha256({NORM}) END AS is_stale FROM documents""")
def stale_assertions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", text.normalized_hash(F.col("text")).alias("now"))
    marks = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat(F.lit("x"), text.normalize(F.col("text"))), 256)).otherwise(F.col("now")).alias("then"))
    return checks.stale(marks, docs, "doc_id", "doc_id", "then", "now").select("doc_id", "is_stale")


@query("""
WITH q AS (SELECT doc_id, text, substr(text, 11, 20) AS quote, CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 3 END AS st FROM documents WHERE length(text) >= 40),
i AS (SELECT *, instr(text, quote) AS p FROM q)
SELECT doc_id, CASE WHEN substr(text, st + 1, 20) = quote THEN 'stable' WHEN p > 0 AND instr(substr(text, p + 1), quote) = 0 THEN 'reanchored' ELSE 'needs_review' END AS outcome,
  CASE WHEN substr(text, st + 1, 20) = quote THEN st WHEN p > 0 AND instr(substr(text, p + 1), quote) = 0 THEN p - 1 END::INTEGER AS start_offset FROM i""")
def reanchor(spark, d):
    q = table(spark, d, "documents").filter(F.char_length("text") >= 40).withColumn("quote", F.substring("text", 11, 20)).withColumn("st", F.when(F.col("doc_id") % 2 == 0, 10).otherwise(3))
    return q.select("doc_id", checks.reanchor(F.col("quote"), F.col("st"), F.col("text")).alias("r")).select("doc_id", "r.outcome", F.col("r.start").alias("start_offset"))


@query("""
WITH q AS (SELECT doc_id, text, substr(text, 41, 30) AS quote, substr(text, 21, 20) || substr(text, 41, 30) || substr(text, 71, 20) AS whole FROM documents WHERE length(text) >= 100),
m AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'new ' || text END AS now FROM q),
i AS (SELECT *, instr(now, whole) AS p FROM m),
r AS (SELECT doc_id, CASE WHEN substr(now, 41, 30) = quote THEN 'stable' WHEN instr(substr(now, p + 1), whole) = 0 THEN 'reanchored' ELSE 'needs_review' END AS outcome, p FROM i)
SELECT doc_id, outcome, CASE outcome WHEN 'stable' THEN 40 WHEN 'reanchored' THEN p + 19 END::INTEGER AS start_offset, 1.0::DOUBLE AS score FROM r""")
def reanchor_in_context(spark, d):
    docs = table(spark, d, "documents").filter(F.char_length("text") >= 100)
    part = lambda at, n: F.substring("text", at, n)
    anchors = docs.select("doc_id", part(41, 30).alias("quote"), part(21, 20).alias("prefix_context"), part(71, 20).alias("suffix_context"), F.lit(40).alias("start_offset"))
    now = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("new "), "text")).alias("now"))
    found = anchoring.reanchored(anchors, now, "doc_id", "id", "now")
    return found.select("doc_id", "anchor.outcome", F.col("anchor.start").alias("start_offset"), "anchor.score")


def _spans(spark, d):
    """Spans of 750 code points that overlap by 250, from the start of each text past its end."""
    starts = F.explode(F.sequence(F.lit(0), F.char_length("text"), F.lit(500)))
    return table(spark, d, "documents").select("doc_id", starts.alias("start_offset")).select("doc_id", "start_offset", F.col("start_offset").alias("span_id"), (F.col("start_offset") + 750).alias("end_offset"))


@query(_TOKENS + """,
x AS (SELECT doc_id, i - 1 AS k, stop - length(token) AS a, stop AS b FROM t),
sp AS (SELECT doc_id, unnest(range(0, length(text) + 1, 500)) AS span_id FROM documents)
SELECT sp.doc_id, sp.span_id::INTEGER AS span_id, min(k)::INTEGER AS start_token, (max(k) + 1)::INTEGER AS end_token, count(*) FILTER (WHERE a >= span_id AND b <= span_id + 750) AS n_inside
FROM sp LEFT JOIN x ON x.doc_id = sp.doc_id AND a < span_id + 750 AND span_id < b GROUP BY 1, 2""")
def span_tokens(spark, d):
    return spans.covering_tokens(_spans(spark, d), text.tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "span_id")


@query(_TOKENS + """,
x AS (SELECT doc_id, i, stop - length(token) AS a, stop AS b FROM t),
m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 3 END AS s, CASE WHEN doc_id % 5 = 0 THEN 12 ELSE 20 END AS e FROM documents)
SELECT m.doc_id, coalesce(CASE WHEN f.a IS NOT NULL AND l.b IS NOT NULL THEN f.a END, 0)::INTEGER AS start_offset, coalesce(CASE WHEN f.a IS NOT NULL AND l.b IS NOT NULL THEN l.b END, 100)::INTEGER AS end_offset,
  CASE WHEN f.a IS NULL OR l.b IS NULL THEN 'lost' WHEN f.a = 0 AND l.b = 100 THEN 'agree' ELSE 'moved' END AS status
FROM m LEFT JOIN x f ON f.doc_id = m.doc_id AND f.i = s + 1 LEFT JOIN x l ON l.doc_id = m.doc_id AND l.i = e""")
def tokens_decide(spark, d):
    docs = table(spark, d, "documents")
    start, end = F.when(F.col("doc_id") % 4 == 0, 0).otherwise(3), F.when(F.col("doc_id") % 5 == 0, 12).otherwise(20)
    anchors = docs.select("doc_id", start.alias("start_token"), end.alias("end_token"), F.lit(0).alias("start_offset"), F.lit(100).alias("end_offset"))
    return spans.by_tokens(anchors, text.tokens(docs, "doc_id", "text"), "doc_id").drop("start_token", "end_token")


@query("""
WITH f AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT min(doc_id) AS a FROM f WHERE quality = 0), e AS (SELECT min(doc_id) AS b FROM f WHERE toxic = 1 AND doc_id <> (SELECT a FROM c)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM f WHERE doc_id NOT IN ((SELECT a FROM c), (SELECT b FROM e))),
s AS (SELECT doc_id FROM r WHERE i % greatest(1, n // 18) = 0 ORDER BY doc_id LIMIT 18)
SELECT a AS doc_id FROM c UNION ALL SELECT b FROM e UNION ALL SELECT doc_id FROM s""")
def deterministic_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return checks.covering_sample(rows, "doc_id", [F.coalesce(F.col("quality") == 0, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))], 20)


@query()
def hash_sample(spark, d):
    return checks.hash_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 10, 42)


# ---- references, markup, lines of print -------------------------------------------------------


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR || '.' || l_linenumber || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN ':' || l_partkey WHEN 2 THEN ':' || l_partkey || '.' || l_suppkey ELSE '.' || l_partkey || '.8.' || l_suppkey END AS ref FROM lineitem)
SELECT ref, split_part(ref, '.', 1) AS book, CASE WHEN contains(ref, ':') THEN split_part(split_part(ref, ':', 1), '.', 2) ELSE split_part(ref, '.', 2) END AS chapter,
  CASE WHEN contains(ref, ':') THEN split_part(split_part(ref, ':', 2), '.', 1) ELSE split_part(ref, '.', 3) END AS section,
  CASE WHEN contains(ref, ':') THEN '' ELSE split_part(ref, '.', 4) END AS subsection, CASE WHEN contains(ref, ':') THEN split_part(split_part(ref, ':', 2), '.', 2) ELSE split_part(ref, '.', 5) END AS line FROM r""")
def parse_reference(spark, d):
    kind = F.col("l_linenumber") % 4
    tail = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit(":"), F.col("l_partkey").cast("string"))).when(kind == 2, F.concat(F.lit(":"), F.concat_ws(".", "l_partkey", "l_suppkey"))).otherwise(F.concat(F.lit("."), F.concat_ws(".", "l_partkey", F.lit("8"), "l_suppkey")))
    rows = table(spark, d, "lineitem").select(F.concat(F.concat_ws(".", "l_orderkey", "l_linenumber"), tail).alias("ref"))
    return rows.select("ref", *(c.alias(n) for n, c in citations.split_reference(F.col("ref")).items()))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey::VARCHAR END AS s, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey::VARCHAR || '.' || l_linenumber END AS e, l_orderkey || '.' || l_linenumber AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, st || ' (Kühn' || coalesce(' ' || CASE WHEN s IS NULL THEN e WHEN e IS NULL THEN s ELSE s || '–' || e END, '') || ')' AS citation FROM p""")
def format_citation(spark, d):
    n = F.col("l_linenumber")
    path = F.array(F.struct(F.col("l_orderkey").cast("string").alias("n"), F.lit(None).cast("string").alias("head")), F.struct(F.lit("").alias("n"), n.cast("string").alias("head")))
    edition = citations.edition_ref(F.lit("Kühn"), F.when(n % 3 > 0, F.col("l_partkey").cast("string")), F.lit(None).cast("string"), F.when(n % 2 == 0, F.col("l_suppkey").cast("string")), F.when(n % 2 == 0, n.cast("string")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", citations.combined_ref(citations.structure_ref(path), edition).alias("citation"))


@query(r"""
WITH t AS (SELECT conv_id, string_agg('1.' || conv_id || ':1.' || (turn // 3) || '.' || (turn % 3 + 1) || chr(10) || regexp_replace(text, '\s+', ' ', 'g'), chr(10) ORDER BY turn) AS s FROM conversations WHERE turn >= 0 GROUP BY conv_id),
g AS (SELECT conv_id, turn // 3 AS u, string_agg(regexp_replace(text, '\s+', ' ', 'g'), ' ' ORDER BY turn) AS body FROM conversations GROUP BY 1, 2)
SELECT conv_id AS doc_id, '1.' || conv_id || ':1.' || u || '.1' AS reference, sha256(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS contents_sha256 FROM g""")
def marginal_units(spark, d):
    c = table(spark, d, "conversations")
    ref = F.concat(F.lit("1."), F.col("conv_id").cast("string"), F.lit(":1."), F.floor(F.col("turn") / 3).cast("string"), F.lit("."), (F.col("turn") % 3 + 1).cast("string"))
    page = F.concat(ref, F.lit("\n"), F.regexp_replace("text", r"\s+", " "))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    return marginal.cut_units(docs, "conv_id", compat=True).groupBy("doc_id", "reference").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", F.when(F.col("part_no") == 0, F.col("contents")).otherwise(F.concat(F.lit("– "), "contents")).alias("c")))), lambda x: x["c"]), " ").alias("t")).select("doc_id", "reference", F.sha2("t", 256).alias("contents_sha256"))


@query()
def marginal_entries(spark, d):
    c = table(spark, d, "conversations")
    line = F.concat((F.col("conv_id") + 1).cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit("\n"), "text")
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("p")))), lambda x: x["p"]), "\n").alias("text"))
    return marginal.cut_lines(docs, "conv_id").withColumnRenamed("doc_id", "conv_id")


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(t, '(?s)<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM b),
e AS (SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM c)
SELECT page_id, length(t)::INTEGER AS n_chars, sha256(t) AS text_sha256 FROM e""")
def reading_text_html(spark, d):
    t = markup.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.char_length(t).alias("n_chars"), F.sha2(t, 256).alias("text_sha256"))


@query(r"""
SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', ''), '<', ''), '>', ''), '[\x00-\x08\x0B-\x1F]', '', 'g') AS raw,
  sha256(trim(regexp_replace(regexp_replace(replace(replace(replace(text, '&', ''), '<', ''), '>', ''), '[\x00-\x08\x0B-\x1F]', '', 'g'), '\s+', ' ', 'g'))) AS reading_sha256
FROM documents""")
def tei_segments(spark, d):
    clean = F.regexp_replace(F.translate("text", "&<>", ""), "[\\x00-\\x08\\x0B-\\x1F]", "")
    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div n="1"><div n="2" xml:id="s'), F.col("doc_id").cast("string"), F.lit('"><pb n="1"/>'), clean, F.lit("<note>left out</note></div></div></body></text></TEI>"))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("tei_doc_id"), F.encode(xml, "UTF-8").alias("content"), clean.alias("raw"))
    found = markup.segments(rows, keep=["raw"]).filter("reading_text is not null")
    return found.select(F.col("tei_doc_id").cast("long").alias("doc_id"), "raw", F.sha2("reading_text", 256).alias("reading_sha256"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE floor(p_retailprice)::BIGINT::VARCHAR END AS price_text,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS size_int, CASE p_type WHEN 'ECONOMY' THEN 'vegetable' ELSE '' END AS category, p_partkey AS id_number, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS display, p_partkey % 5 = 0 AS is_null
FROM part""")
def typed_coercions(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    price = cells.to_intish(F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.floor("p_retailprice").cast("double")))
    cell = F.when(k % 4 == 0, "x").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".7 ")))
    kind = F.when(F.col("p_type") == "ECONOMY", " Plant").otherwise(F.col("p_type"))
    null = F.when(k % 10 == 0, " NULL ").when(k % 5 == 0, "(null)").otherwise("root")
    return p.select("p_partkey", price.alias("price_text"), cells.to_int(cell).alias("size_int"), cells.category(kind).alias("category"), cells.id_number(F.concat(F.lit("L"), F.lpad(k.cast("string"), 7, "0"))).alias("id_number"), cells.display(F.when(k % 2 == 0, F.col("p_name")).otherwise(""), F.col("p_brand")).alias("display"), cells.is_nullish(null).alias("is_null"))


@query("SELECT count(*) AS n, count(DISTINCT k) AS n_keys, sum(CASE WHEN s = 'a' THEN 1 ELSE 0 END)::BIGINT AS n_a FROM (SELECT c_custkey AS k, 'a' AS s FROM customer UNION ALL SELECT s_suppkey, 'b' FROM supplier)")
def union_sheets(spark, d):
    sheets = {"a": table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), "b": table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))}
    return tables.union_sheets(sheets).agg(F.count("*").alias("n"), F.count_distinct("k").alias("n_keys"), F.count_if(F.col("sheet") == "a").alias("n_a"))


_LOADED = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _LOADED))
def load_counts(spark, d):
    return checks.table_counts({t: table(spark, d, t) for t in _LOADED})


@query("""
WITH b AS (SELECT p_name AS old, min(p_partkey) AS new_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
r AS (SELECT p.p_partkey, b.new_id FROM part p LEFT JOIN b ON p.p_name = b.old WHERE p.p_size > 10)
SELECT p_partkey, new_id, new_id IS NULL AS queued FROM r""")
def bridge_lookup(spark, d):
    p = table(spark, d, "part")
    bridge = p.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("old"), F.col("p_partkey").alias("new_id"))
    found, queue = linking.bridged(p.filter("p_size > 10").select("p_partkey", "p_name"), "p_name", bridge, "old", "new_id")
    return found.select("p_partkey", "new_id", F.lit(False).alias("queued")).union(queue.select("p_partkey", F.lit(None).cast("bigint"), F.lit(True)))


_LEMMA_SQL = """l AS (SELECT 'L' || lpad(p_partkey::VARCHAR, 6, '0') AS id, lower(p_name) AS h FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT h, min(id) AS id FROM l GROUP BY h),
i AS (SELECT p_partkey, p_name, p_brand FROM part)"""


def _lemma_cells(spark, d):
    p = table(spark, d, "part")
    entries = p.select("p_partkey", F.concat(F.upper("p_name"), F.lit("; "), "p_brand", F.lit(" , "), "p_name").alias("cell"), "p_type")
    lemmata = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("L"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("lemma_id"), F.lower("p_name").alias("headword_normalized"))
    return linking.link_lemmata(entries, lemmata, "p_partkey", "cell", F.col("p_type"))


@query(f"WITH {_LEMMA_SQL} SELECT p_partkey, coalesce(c.id, '') AS lemma_ids FROM i LEFT JOIN c ON c.h = p_name")
def left_link_default(spark, d):
    return _lemma_cells(spark, d)[0]


@query(f"""WITH {_LEMMA_SQL} SELECT p_partkey, p_brand AS unmatched_term, p_type || ': ' || upper(p_name) || '; ' || p_brand || ' , ' || p_name AS context FROM part
UNION ALL SELECT p_partkey, x AS unmatched_term, p_type || ': ' || upper(p_name) || '; ' || p_brand || ' , ' || p_name FROM part, unnest([p_name, upper(p_name)]) u(x) WHERE p_name NOT IN (SELECT h FROM c)""")
def unmatched_lemmata(spark, d):
    return _lemma_cells(spark, d)[1]


@query("""
WITH w AS (SELECT event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE CASE event_type WHEN 'click' THEN k IS NOT NULL WHEN 'view' THEN false ELSE true END) AS n_valid FROM w GROUP BY 1""")
def payload_checks(spark, d):
    valid = checks.payload_valid(F.col("event_type"), F.col("props"), {"click": ["k"], "view": ["k", "missing"]})
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"))


@query("""
SELECT trim(lang) AS lang, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'license')) AS n_licensed FROM documents GROUP BY 1""")
def source_audit(spark, d):
    docs = table(spark, d, "documents").withColumn("lang", F.concat(F.when(F.col("doc_id") % 2 == 0, " ").otherwise(""), "lang", F.lit(" ")))
    return checks.value_audit(docs, "lang", {"n_licensed": F.contains(F.lower("text"), F.lit("license"))})


_HEADS_SQL = """h AS (SELECT 'L' || lpad(p_partkey::VARCHAR, 7, '0') AS id, p_name AS n FROM part
  UNION ALL SELECT 'L' || lpad((1000000 + p_partkey)::VARCHAR, 7, '0'), p_name || ' ' || lower(p_type) FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'L' || lpad((2000000 + p_partkey)::VARCHAR, 7, '0'), p_name || ' ' || lower(p_type) || ' of ' || lower(p_brand) FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT n, min(id) AS id FROM h GROUP BY n),
w AS (SELECT id, string_split(n, ' ') AS ws FROM h),
x AS (SELECT id, array_to_string(ws[1:k], ' ') AS pre, k FROM w, unnest(generate_series(1, len(ws) - 1)) u(k)),
m AS (SELECT x.id AS lemma_id, arg_max(c.id, k) AS parent_lemma FROM x JOIN c ON x.pre = c.n WHERE length(pre) >= 4 GROUP BY x.id)"""


def _headwords(spark, d):
    p = table(spark, d, "part")
    ident = lambda k: F.concat(F.lit("L"), F.lpad((F.col("p_partkey") + k).cast("string"), 7, "0")).alias("lemma_id")
    long = p.filter("p_partkey % 3 = 0").select(ident(1_000_000), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("headword_normalized"))
    longer = p.filter("p_partkey % 2 = 0").select(ident(2_000_000), F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("of"), F.lower("p_brand")).alias("headword_normalized"))
    return p.select(ident(0), F.col("p_name").alias("headword_normalized")).union(long).union(longer)


@query(f"WITH {_HEADS_SQL} SELECT lemma_id, parent_lemma FROM m")
def prefix_parents(spark, d):
    return linking.parent_lemmata(_headwords(spark, d))


@query(f"""WITH {_HEADS_SQL.replace("h AS (", "h AS (SELECT 'L9000000' AS id, 'small' AS n UNION ALL ", 1)},
f AS (SELECT id AS lemma_id, 'L9000000' AS parent_lemma FROM w WHERE list_contains(ws, 'small') AND len(ws) > 1)
SELECT lemma_id, parent_lemma, 'family' AS relationship FROM f
UNION ALL SELECT lemma_id, parent_lemma, 'prefix' FROM m WHERE lemma_id NOT IN (SELECT lemma_id FROM f)""")
def assigned_parents(spark, d):
    head = spark.createDataFrame([("L9000000", "small")], "lemma_id string, headword_normalized string")
    return linking.assigned_parents(_headwords(spark, d).union(head), ("small",))


# ---- operators that only unit tests used to reach ---------------------------------------------


@query("""
WITH a AS (SELECT source, sum(n_chars)::BIGINT AS l FROM documents GROUP BY 1), b AS (SELECT source, sum(n_chars)::BIGINT AS r FROM documents WHERE doc_id % 9 <> 0 GROUP BY 1)
SELECT source, l AS left_total, coalesce(r, 0) AS right_total, abs(l - coalesce(r, 0)) > 0.05 * l AS alert FROM a LEFT JOIN b USING (source)""")
def reconciled_sources(spark, d):
    docs = table(spark, d, "documents")
    return checks.reconcile(docs, docs.filter("doc_id % 9 <> 0"), "source", "n_chars")


_ALIGN_SQL = """r AS (SELECT l_orderkey * 10 + l_linenumber AS line_no, 'p~' || l_partkey AS sa, 'p~' || (l_partkey * 7 + l_suppkey) % 2500 AS sb, CASE l_linenumber % 3 WHEN 0 THEN 'excerpt' WHEN 1 THEN 'independent' ELSE 'other' END AS t, l_discount AS c FROM lineitem),
s AS (SELECT * FROM r WHERE t <> 'other' AND sa <> sb),
e AS (SELECT 'p~' || p_partkey AS i, p_partkey AS id FROM part)"""


def _resolved(spark, d):
    k = F.col("l_linenumber") % 3
    ident = lambda c: F.concat(F.lit("p~"), c.cast("string"))
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), ident(F.col("l_partkey")).alias("source_a_entry_id"), ident((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 2500).alias("source_b_entry_id"),
        F.when(k == 0, "excerpt").when(k == 1, "independent").otherwise("other").alias("alignment_type"), F.col("l_discount").alias("confidence"), F.lit("e").alias("evidence"), F.lit("c").alias("curator"), F.lit("run").alias("source"),
    )
    return checks.resolve_alignments(rows, table(spark, d, "part").select(ident(F.col("p_partkey")).alias("display_entry_id"), F.col("p_partkey").alias("id")))


@query(f"""WITH {_ALIGN_SQL}, g AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, t, max(line_no) AS line_no FROM s JOIN e x ON sa = x.i JOIN e y ON sb = y.i GROUP BY 1, 2, 3)
SELECT a, b, t AS alignment_type, line_no FROM g""")
def resolved_alignments(spark, d):
    return _resolved(spark, d)[0].select("a", "b", "alignment_type", "line_no")


@query(f"""WITH {_ALIGN_SQL}, g AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, t FROM s JOIN e x ON sa = x.i JOIN e y ON sb = y.i)
SELECT t AS alignment_type, count(*) AS n FROM g GROUP BY 1""")
def alignment_type_counts(spark, d):
    return facets.type_counts(_resolved(spark, d)[0])


@query(f"""WITH {_ALIGN_SQL}, u AS (SELECT sa AS id FROM s WHERE sa NOT IN (SELECT i FROM e) UNION SELECT sb FROM s WHERE sb NOT IN (SELECT i FROM e)) SELECT id FROM u ORDER BY id LIMIT 10""")
def unresolved_ids(spark, d):
    return checks.first_of(_resolved(spark, d)[2], "id")


_ALIASES = [("A1", "the"), ("A2", "of the"), ("A3", "in that the"), ("A4", "de la")]


@query(rf"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{Mn}}]*'), lambda x: strip_accents(lower(x))) AS ts FROM conversations),
p AS (SELECT id, ts, unnest(generate_series(1, len(ts))) AS i FROM t WHERE len(ts) > 0),
a AS (SELECT lemma_id, string_split(alias, ' ') AS ws FROM (VALUES {", ".join(map(str, _ALIASES))}) v(lemma_id, alias))
SELECT id, (i - 1)::INTEGER AS token_index, lemma_id, len(ws)::INTEGER AS n_tokens FROM p JOIN a ON ts[i:i + len(ws) - 1] = ws""")
def alias_mentions(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    normal = F.transform(text.token_texts(F.col("text")), lambda t: text.normalize(t))
    return mentions.mentions(rows.select("id", normal.alias("tokens")), spark.createDataFrame(_ALIASES, "lemma_id string, alias_normalized string"), "id", "tokens")


@query("""
SELECT l_orderkey, bool_or(l_returnflag = 'R') AS has_substance_part, bool_or(l_linenumber = 3) AS has_place, bool_or(l_returnflag = 'A' AND l_linestatus = 'F') AS has_linked_action, bool_or(l_quantity > 40) AS has_quality
FROM lineitem GROUP BY 1""")
def result_features(spark, d):
    flag = F.col("l_returnflag")
    term = F.struct(
        F.when(flag == "R", "SUBSTANCE_PART").when(flag == "A", "PROCESS").otherwise("OTHER").alias("label"),
        F.when(F.col("l_linenumber") == 3, "λημνος").when(F.col("l_linenumber") == 4, "").alias("variant_place_lemma_normalized"),
        F.when(F.col("l_linestatus") == "F", F.struct(F.lit("TERM").alias("kind"))).when(F.col("l_linenumber") == 1, F.struct(F.lit("UNSPECIFIED").alias("kind"))).alias("applies_to"),
    )
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(term).alias("terms"), F.collect_list(F.when(F.col("l_quantity") > 40, "q")).alias("qualities"))
    return rows.select("l_orderkey", *(c.alias(n) for n, c in checks.result_features(F.col("terms"), F.col("qualities")).items()))


@query("SELECT count(DISTINCT p_partkey) FILTER (WHERE p_partkey IN (1, 7, 19)) = 3 AS has_all FROM part UNION ALL SELECT count(DISTINCT p_partkey) FILTER (WHERE p_partkey IN (1, -5)) = 2 FROM part")
def id_subset(spark, d):
    p = table(spark, d, "part")
    return checks.has_all(p, "p_partkey", [1, 7, 19]).union(checks.has_all(p, "p_partkey", [1, -5]))


@query("SELECT s_suppkey, (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3') AS edition_id FROM supplier")
def constant_lookup(spark, d):
    return linking.constant_lookup(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "nation"), F.col("n_name") == "NATION_3", "n_nationkey", "edition_id")


@query(f"""
WITH {_VOCAB_SQL}, {_WORDS_SQL}, h AS (SELECT DISTINCT p_partkey, domain, form FROM w JOIN v ON token = form WHERE domain <> 'jewel')
SELECT p_partkey, string_agg(form, ',' ORDER BY CASE domain WHEN 'size' THEN 1 WHEN 'shape' THEN 2 ELSE 3 END, form) AS terms FROM h GROUP BY 1""")
def heading_terms(spark, d):
    return linking.heading_terms(table(spark, d, "part"), "p_partkey", "p_name", _vocabulary(spark).withColumn("english", F.col("form")), ("size", "shape", "colour"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '5-LOW')")
def list_filters(spark, d):
    return facets.list_filter(table(spark, d, "orders"), active=None, equals={"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "5-LOW"]}).select("o_orderkey")


@query("""
SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey
WHERE e.event_type = 'view' AND json_extract_string(e.props, '$.k') = '7' AND c.c_acctbal > 0 AND c.c_mktsegment IN ('HOUSEHOLD', 'BUILDING') AND e.event_id % 2 = 0""")
def facet_status(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("assertion_type"), "props", F.col("user_id").alias("tei_entry_id"), F.lit(False).alias("is_stale"), F.when(F.col("event_id") % 2 == 0, "reviewed").otherwise("draft").alias("status"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", (F.col("c_acctbal") > 0).alias("is_active"), F.col("c_mktsegment").alias("source"))
    joined = e.withColumn("payload", F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").alias("k"))))
    found = facets.facet(joined, c, "view", {"k": "7"}, sources=["HOUSEHOLD", "BUILDING"], statuses=["reviewed"])
    return found.select(F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), "c_name")


@query("""
SELECT row_number() OVER (ORDER BY k, id) AS row_id, id FROM (SELECT 0 AS k, s_suppkey AS id FROM supplier UNION ALL SELECT 1, p_partkey FROM part)""")
def numbered_rows(spark, d):
    sheets = [table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), table(spark, d, "part").select(F.col("p_partkey").alias("id"))]
    return tables.numbered(sheets, [F.col("id")]).select("row_id", "id")


@query(r"""
WITH x AS (SELECT unnest([p_name, p_brand, p_type]) AS c FROM part)
SELECT DISTINCT unnest(list_filter(regexp_split_to_array(strip_accents(lower(c)), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS token FROM x""")
def distinct_tokens(spark, d):
    return facets.distinct_tokens(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@query("""
WITH e AS (SELECT p_partkey // 2 AS i, CASE p_partkey % 3 WHEN 0 THEN 'draft' WHEN 1 THEN '' ELSE 'odd' END AS st, 'P' || p_size AS part, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'L' || (p_partkey + 3) || ', L1' END AS l, p_name || CASE WHEN p_partkey % 11 = 0 THEN chr(10) || 'x' ELSE '' END AS g, p_partkey FROM part),
n AS (SELECT count(*) AS n FROM part), lemma AS (SELECT 'L' || p_partkey AS id FROM part)
SELECT 'duplicate_entry_id' AS rule, (SELECT count(*) FROM (SELECT i FROM e GROUP BY i HAVING count(*) > 1))::DOUBLE AS n
UNION ALL SELECT 'trans_status', count(*) FILTER (WHERE st = 'odd') FROM e
UNION ALL SELECT 'part_fk', count(*) FILTER (WHERE part NOT IN (SELECT 'P' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)) FROM e
UNION ALL SELECT 'lemma_fk', (SELECT count(DISTINCT i) FROM e, unnest(string_split(l, ', ')) u(x) WHERE l <> '' AND x NOT IN (SELECT id FROM lemma))
UNION ALL SELECT 'embedded_newline', count(*) FILTER (WHERE p_partkey % 11 = 0) FROM e
UNION ALL SELECT 'greek_normalized', count(*) FILTER (WHERE p_partkey % 13 = 0) FROM e
UNION ALL SELECT 'no_accented_alpha', 1 UNION ALL SELECT 'accented_alpha_not_plain', 0
UNION ALL SELECT 'prep_fk', count(*) FILTER (WHERE s_suppkey >= 50) FROM supplier
UNION ALL SELECT 'lemma_coverage', round(100.0 * count(*) FILTER (WHERE l <> '') / count(*), 1) FROM e""")
def validation_rules(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    s = table(spark, d, "supplier")
    greek = F.concat("p_name", F.when(k % 11 == 0, "\nx").otherwise(""))
    entries = p.select(
        F.floor(k / 2).cast("string").alias("entry_id"), F.when(k % 3 == 0, "draft").when(k % 3 == 1, "").otherwise("odd").alias("trans_status"), F.concat(F.lit("P"), F.col("p_size").cast("string")).alias("part_id"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("L"), (k + 3).cast("string"), F.lit(", L1"))).alias("lemma_ids"), F.lit("").alias("chapter_title_gr"), F.lit("").alias("translation"), greek.alias("greek"),
        F.concat(F.when(k % 13 == 0, "X").otherwise(""), text.normalize(greek)).alias("greek_normalized"),
    )
    lemmata = p.select(F.concat(F.lit("L"), k.cast("string")).alias("lemma_id"))
    parts = s.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("part_id"))
    links = s.select(F.col("s_suppkey").cast("string").alias("prep_id"))
    found, _ = checks.validate(entries, lemmata, parts, links.filter(F.col("prep_id").cast("int") < 50), links)
    return spark.createDataFrame([(rule, float(n)) for rule, n in found.items()], "rule string, n double")


# ---- files and cells --------------------------------------------------------------------------


def _fresh(spark, name):
    return f"{shared_folder(spark)}/quire/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR AS doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(source, '') AS source FROM documents")
def csv_round_trip(spark, d):
    path = _fresh(spark, "csv")
    sinks.csv(table(spark, d, "documents").select("doc_id", "text", "source"), path, ["doc_id"])
    return readers.csv(spark, path, ["doc_id", "text"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "source")


@query("""
WITH l AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n % 5 = 0 THEN NULL ELSE sha256(text) END AS text_sha256, CASE WHEN n % 5 = 0 THEN 'invalid_json' END AS error, count(*) AS n FROM (SELECT n, CASE WHEN n % 5 <> 0 THEN conv_id END AS conv_id, CASE WHEN n % 5 <> 0 THEN turn END AS turn, text FROM l) GROUP BY 1, 2, 3, 4""")
def json_lines_round_trip(spark, d):
    """Every fifth line is cut off, so that it does not parse."""
    rows, path = table(spark, d, "conversations").select("conv_id", "turn", "text"), _fresh(spark, "lines")
    sinks.json_lines(rows, f"{path}/whole", ["conv_id", "turn"])
    lines = tables.batches(rows, [F.col("conv_id"), F.col("turn")], 1).select((F.col("batch_id") + 1).alias("n"), F.to_json(F.struct("conv_id", "turn", "text")).alias("value"))
    whole = spark.read.text(f"{path}/whole").join(lines.filter("n % 5 <> 0"), "value", "left_semi").union(lines.filter("n % 5 = 0").select(F.left("value", F.lit(9))))
    whole.write.text(f"{path}/cut")
    read = readers.json_lines(spark, f"{path}/cut", "conv_id long, turn long, text string, _corrupt string")
    return read.groupBy("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), "error").agg(F.count("*").alias("n"))


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 10 > 1")
def id_list_round_trip(spark, d):
    ids, path = F.col("doc_id"), _fresh(spark, "ids")
    line = F.when(ids % 10 == 0, F.concat(F.lit("# "), ids.cast("string"))).when(ids % 10 == 1, "  ").otherwise(F.concat(F.lit("  "), ids.cast("string"), F.lit(" ")))
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return readers.id_list(spark, path).select("id")


@query("""SELECT 'count.nation' AS key, (SELECT count(*) FROM nation)::VARCHAR AS value UNION ALL SELECT 'count.orders', (SELECT count(*) FROM orders)::VARCHAR UNION ALL SELECT 'run', 'r1'
UNION ALL SELECT 'nation.' || n_nationkey, n_name FROM nation""")
def export_bundle(spark, d):
    path, nation = _fresh(spark, "bundle"), table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.bundle({"nation": (nation, ["n_nationkey"]), "orders": (table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])}, path, {"run": "r1"})
    rows = spark.read.schema("n_nationkey int, n_name string").json(f"{path}/nation")
    return spark.read.schema("key string, value string").json(f"{path}/meta").union(rows.select(F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")), "n_name"))


@query(f"SELECT doc_id, source, left({NORM}, 512) AS prefix FROM documents WHERE starts_with(left({NORM}, 512), 'the th') ORDER BY source, doc_id LIMIT 100")
def prefix_search_stored(spark, d):
    path = _fresh(spark, "prefix")
    sinks.stored_prefix(table(spark, d, "documents"), path, "text")
    return facets.search(spark.read.parquet(path), " Thé  TH", ["source", "doc_id"]).select("doc_id", "source", "prefix")


@query(f"SELECT doc_id, sha256({NORM}) AS normalized_sha256, sha256(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{{00A0}}]+', ' ', 'g'))) AS squashed_sha256 FROM documents")
def legacy_normalization(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalize(t, "1.0"), 256).alias("normalized_sha256"), F.sha2(text.squash(t), 256).alias("squashed_sha256"))


@query(r"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(text, ''), 'qu', 'q-' || chr(10) || '  u') AS t FROM conversations)
SELECT conv_id, turn, sha256(regexp_replace(t, '(\p{L})-\s*\n\s*(\p{L})', '\1\2', 'g')) AS joined_sha256 FROM t""")
def dehyphenated(spark, d):
    cut = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("qu"), F.lit("q-\n  u"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.dehyphenate(cut), 256).alias("joined_sha256"))


@query(r"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey || '.' || l_linenumber || CASE l_partkey % 4 WHEN 0 THEN '.t.1' WHEN 1 THEN ' x' WHEN 2 THEN ':' || l_suppkey ELSE '.' END AS ref FROM lineitem),
m AS (SELECT *, regexp_full_match(trim(ref), '[0-9]([0-9.:,t]*[0-9])?') AND contains(ref, '.') AS is_marker FROM r)
SELECT l_orderkey, l_linenumber, ref, is_marker, is_marker AND contains(ref, '.t.') AS is_title, regexp_replace(ref, '\.[^.]*$', '') AS head, try_cast(regexp_extract(ref, '([^.]*)$', 1) AS INTEGER) AS number FROM m""")
def marker_lines(spark, d):
    tail = F.when(F.col("l_partkey") % 4 == 0, ".t.1").when(F.col("l_partkey") % 4 == 1, " x").when(F.col("l_partkey") % 4 == 2, F.concat(F.lit(":"), F.col("l_suppkey").cast("string"))).otherwise(".")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), tail).alias("ref"))
    head, number = citations.entry_key(F.col("ref"))
    return rows.select("*", citations.is_marker(F.col("ref")).alias("is_marker"), citations.is_title_marker(F.col("ref")).alias("is_title"), head.alias("head"), number.alias("number"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE (l_orderkey % 7)::VARCHAR END AS book, CASE l_partkey % 5 WHEN 0 THEN 'PR' WHEN 1 THEN '' ELSE (l_partkey % 5)::VARCHAR END AS chapter,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE ' ' || l_suppkey % 3 END AS section FROM lineitem),
c AS (SELECT *, array_to_string(list_filter([book, chapter, trim(coalesce(section, ''))], lambda x: x <> ''), '.') AS dotted FROM p)
SELECT l_orderkey, l_linenumber, CASE WHEN dotted = '' THEN 'row' || l_linenumber ELSE dotted END AS legacy,
  CASE WHEN chapter = 'PR' AND book = '' THEN 'prooimion' WHEN chapter = 'PR' THEN book || '.prooimion' WHEN dotted = '' THEN 'row' || l_linenumber ELSE dotted END AS ref FROM c""")
def refs_from_parts(spark, d):
    book = F.when(F.col("l_orderkey") % 7 == 0, "").otherwise((F.col("l_orderkey") % 7).cast("string"))
    chapter = F.when(F.col("l_partkey") % 5 == 0, "PR").when(F.col("l_partkey") % 5 == 1, "").otherwise((F.col("l_partkey") % 5).cast("string"))
    section = F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit(" "), (F.col("l_suppkey") % 3).cast("string")))
    none, row = F.lit(None).cast("string"), F.col("l_linenumber")
    made = lambda legacy: cells.build_ref(legacy, book, chapter, section, none, none, none, row)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", made(True).alias("legacy"), made(False).alias("ref"))
