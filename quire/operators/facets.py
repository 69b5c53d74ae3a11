"""Search, list filters, facets, counts and access rules over an annotated corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize, prefix_key, search_key

#: What a join may broadcast.
BROADCAST_BYTES = 8 << 20

# Fixed values.
LIST_PAGE, SEARCH_PAGE, LEAST_CHARS = 50, 100, 3
#: table -> (roles that read, roles that write); the rest only the loading service writes.
POLICIES = {
    "translations": ("authenticated", "editor"),
    "assertions": ("authenticated", "editor"),
    "lemmata": ("authenticated", "editor"),
    "lemma_forms": ("authenticated", "editor"),
    "entry_lemma_forms": ("authenticated", "editor"),
    "lemma_aliases": ("authenticated", "editor"),
    "entry_alignments": ("authenticated", "editor"),
    "entries": ("authenticated", "service"),
    "tokens": ("authenticated", "service"),
    "entry_refs": ("authenticated", "service"),
    "import_runs": ("authenticated", "service"),
    "sources": ("authenticated", ""),
    "docs": ("authenticated", ""),
    "quality_vocab": ("authenticated", ""),
    "parts_vocab": ("authenticated", ""),
    "process_vocab": ("authenticated", ""),
}


def with_prefix(df: DataFrame, text: str, out: str = "prefix") -> DataFrame:
    """Adds the column that prefix search reads. Written with the table, it takes the pushed-down filter."""
    return df.withColumn(out, prefix_key(F.col(text)))


def search(df: DataFrame, query: str | None, order: list[str], prefix: str = "prefix", compat: bool = False) -> DataFrame:
    """The list page of a query: the first rows without one, none below three characters, else the first rows
    whose stored prefix begins with the normalized query. ``order`` should end in a unique column."""
    key = search_key(query, compat)
    if not key:
        return df.orderBy(*order).limit(LIST_PAGE)
    if len(key) < LEAST_CHARS:
        return df.limit(0)
    return df.filter(F.col(prefix).startswith(key)).orderBy(*order).limit(SEARCH_PAGE)


def page_after(df: DataFrame, order: list[str], last: tuple | None, size: int = LIST_PAGE) -> DataFrame:
    """The next page behind the row whose order columns are ``last``: a filter, not an offset."""
    if last is not None:
        after, same = F.lit(False), F.lit(True)
        for c, v in zip(order, last, strict=True):
            after, same = after | (same & (F.col(c) > v)), same & (F.col(c) == v)
        df = df.filter(after)
    return df.orderBy(*order).limit(size)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none; two raise an error."""
    found = df.filter(F.col(key) == value).limit(2)
    n = found.agg(F.count("*").alias("__n"))
    return found.join(n).filter(F.when(F.col("__n") < 2, True).otherwise(F.raise_error(F.lit("more than one row")))).drop("__n")


def list_filter(entries: DataFrame, sources: list[str] | None = None, active: bool | None = True, linked: dict[str, tuple[DataFrame, bool]] | None = None, key: str = "entry_id", contains: tuple[str, str] | None = None, equals: dict[str, list] | None = None) -> DataFrame:
    """Filters of the list view. ``linked`` maps a name to a table with the key and whether a row must be there;
    ``equals`` a column (book, chapter, status, category) to the values that are wanted."""
    for column, values in (equals or {}).items():
        entries = entries.filter(F.col(column).isin(*values))
    if sources:
        entries = entries.filter(F.col("source").isin(*sources))
    if active is not None:
        entries = entries.filter(F.col("is_active") == active)
    if contains:
        column, words = contains
        entries = entries.filter(F.contains(F.lower(F.col(column)), F.lit(words.lower())))
    for other, must in (linked or {}).values():
        entries = entries.join(other.select(key), key, "left_semi" if must else "left_anti")
    return entries


def facet(assertions: DataFrame, entries: DataFrame, kind: str, where: dict[str, str], stale: bool = False, payload: str = "payload", fk: str = "tei_entry_id", sources: list[str] | None = None, statuses: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Active entries with an assertion of a kind whose JSON payload has the given texts; of the given sources (of the
    entry) and statuses (of the assertion) alone. Each has the payload and the assertion's columns in ``keep``."""
    rows = assertions.filter(F.col("assertion_type") == kind)
    if statuses:
        rows = rows.filter(F.col("status").isin(*statuses))
    if sources:
        entries = entries.filter(F.col("source").isin(*sources))
    if not stale:
        rows = rows.filter(~F.coalesce(F.col("is_stale"), F.lit(False)))
    for path, value in where.items():
        rows = rows.filter(F.get_json_object(payload, f"$.{path}") == value)
    return rows.join(entries.filter("is_active"), F.col(fk) == F.col("id")).select(entries["*"], rows[payload], *[rows[c] for c in keep or []])


def facet_substance(entries: DataFrame, links: DataFrame, forms: DataFrame, lemmata: DataFrame, prefix: str) -> DataFrame:
    """Active entries that are linked through a form to a headword with a prefix; the filter comes first, so
    each join starts from few rows."""
    heads = lemmata.filter(F.col("headword_normalized").startswith(search_key(prefix))).select(F.col("id").alias("l_id"), "headword_normalized")
    some = forms.join(heads, F.col("lemma_id") == F.col("l_id")).select(F.col("id").alias("f_id"), "form_normalized", "headword_normalized")
    hits = links.join(some, F.col("lemma_form_id") == F.col("f_id")).select("tei_entry_id", "form_normalized", "headword_normalized")
    return hits.join(entries.filter("is_active"), F.col("tei_entry_id") == F.col("id")).select("display_entry_id", "form_normalized", "headword_normalized").distinct()


def badges(entries: DataFrame, translations: DataFrame, assertions: DataFrame, key: str) -> DataFrame:
    """Per entry: n_translations, n_assertions, has_stale."""
    t = translations.groupBy(key).agg(F.count("*").alias("n_translations"))
    a = assertions.groupBy(key).agg(F.count("*").alias("n_assertions"), F.bool_or("is_stale").alias("has_stale"))
    out = entries.select(key).join(t, key, "left").join(a, key, "left")
    return out.na.fill(0, ["n_translations", "n_assertions"]).na.fill(False, ["has_stale"])


def lemma_counts(lemmata: DataFrame, forms: DataFrame, links: DataFrame) -> DataFrame:
    """Per headword: n_forms and n_entries, each entry once. (lemma_id; form_id, lemma_id; form_id, entry_id)"""
    n = forms.join(links, "form_id", "left").groupBy("lemma_id").agg(F.count_distinct("form_id").alias("n_forms"), F.count_distinct("entry_id").alias("n_entries"))
    return lemmata.select("lemma_id").join(n, "lemma_id", "left").na.fill(0, ["n_forms", "n_entries"])


def totals(assertions: DataFrame) -> DataFrame:
    """n and n_stale per assertion type, and in the row with a null type of all."""
    return assertions.rollup("assertion_type").agg(F.count("*").alias("n"), F.count_if("is_stale").alias("n_stale"))


def shared_headwords(links: DataFrame, lemma: str, source: str, least: int = 2) -> DataFrame:
    """Headwords attested in several sources: (lemma, n_sources)."""
    return links.groupBy(lemma).agg(F.count_distinct(source).alias("n_sources")).filter(F.col("n_sources") >= least)


def type_counts(alignments: DataFrame) -> DataFrame:
    """(alignment_type, n) in order of the type."""
    return alignments.groupBy("alignment_type").agg(F.count("*").alias("n")).orderBy("alignment_type")


def distinct_tokens(df: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct normalized tokens of many columns: (token)."""
    cells = F.array(*[F.col(c).cast("string") for c in columns])
    tokens = F.flatten(F.transform(cells, lambda c: token_list(c)))
    return df.select(F.explode(F.array_distinct(tokens)).alias("token")).distinct()


def aligned(alignments: DataFrame) -> DataFrame:
    """Both directions of undirected pairs: (entry, other, alignment_type)."""
    return alignments.select(F.col("a").alias("entry"), F.col("b").alias("other"), "alignment_type").union(alignments.select("b", "a", "alignment_type"))


def token_list(text: Column) -> Column:
    return F.filter(F.split(normalize(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def jaccard(x: Column, y: Column) -> Column:
    """Similarity of two arrays as sets."""
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def passages(items: DataFrame, x: str, texts: DataFrame, y: str, lead: int, key: str) -> DataFrame:
    """Items beside the runs of tokens in texts that begin like them: equal first ``lead`` tokens, looked up by a
    64-bit hash of each window and then compared. An item of fewer tokens has no such beginning and no row;
    ``reuse.runs`` finds items of any length, and reuse that begins anywhere. ``run`` is as long as the item. Items of at most
    ``BROADCAST_BYTES`` are broadcast, so texts are read once and not shuffled; of others the windows' hashes and
    places are, and the texts of hits join again."""
    starts = F.when(F.size(y) >= lead, F.sequence(F.lit(1), F.size(y) - lead + 1)).otherwise(F.array().cast("array<int>"))
    windows = F.posexplode(F.transform(starts, lambda i: F.xxhash64(F.slice(y, i, F.lit(lead))))).alias("__pos", "__k")
    keyed = items.filter(F.size(x) >= lead).withColumn("__k", F.xxhash64(F.slice(x, F.lit(1), F.lit(lead))))
    if estimated_bytes(items) <= BROADCAST_BYTES:
        hits = texts.select(key, y, windows).join(F.broadcast(keyed), "__k")
    else:
        hits = texts.select(key, windows).join(keyed, "__k").join(texts.select(key, y), key)
    same = F.slice(y, F.col("__pos") + 1, F.lit(lead)) == F.slice(x, F.lit(1), F.lit(lead))
    return hits.filter(same).withColumn("run", F.slice(y, F.col("__pos") + 1, F.size(x))).drop("__pos", "__k", y)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate from the sizes of the files; huge where it has none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def may(table: str, role: str | None, write: bool = False) -> bool:
    """Whether a role may read or write: signed-in roles read all, editors write annotations, the service loads."""
    if table not in POLICIES or role is None:
        return False
    reads, writes = POLICIES[table]
    if not write:
        return role in ("authenticated", "viewer", "editor", "service")
    return bool(writes) and (role == "service" or role == writes)


def secured(df: DataFrame, table: str, role: str | None) -> DataFrame:
    """What a role sees of a table: all of it or nothing."""
    return df if may(table, role) else df.filter(F.lit(False))


def guard_write(table: str, role: str | None) -> None:
    if not may(table, role, write=True):
        raise PermissionError(f"{role} may not write {table}")
