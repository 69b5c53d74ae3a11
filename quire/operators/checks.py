"""Data quality, provenance, run comparison, staleness and samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import NORMALIZATION_VERSION, TOKENIZER_VERSION, normalize

# Fixed values.
GEN1_STATUS = ("draft", "review", "final", "")
GEN2_STATUS = ("draft", "reviewed", "published")
ALIGNMENT_TYPES = ("chapter_parallel", "excerpt", "rearrangement", "independent")
PAYLOAD_KEYS = {"quality": ["axis", "degree"], "part": ["part"], "process": ["process"]}


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def skip_reason(text: Column, least: int = 1) -> Column:
    """Why a row is left out, null if it is not."""
    from quire.functions.text import word_count

    return F.when(text.isNull(), "null_contents").when(F.trim(text) == "", "blank_contents").when(word_count(text) < least, "too_short")


def skip_counts(df: DataFrame, reason: Column, example: str) -> DataFrame:
    """(reason, n, examples): counts, and the three smallest ids as examples; no more than three a task and reason
    are shuffled for them."""
    rows = df.select(reason.alias("reason"), F.col(example).alias("x")).filter("reason is not null")
    counts = rows.groupBy("reason").agg(F.count("*").alias("n"))
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("x"))).filter("k <= 3")
    shown = few.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(shown, "reason").select("reason", "n", "examples")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table after a load."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def value_audit(df: DataFrame, column: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """The spellings of a column and how often each stands, white space at the ends aside; more counts by name."""
    more = [F.count_if(c).alias(name) for name, c in (counts or {}).items()]
    return df.groupBy(F.trim(F.col(column)).alias(column)).agg(F.count("*").alias("n"), *more)


def has_all(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """One row, ``has_all``: whether every wanted id is in the column."""
    return df.agg((F.count_distinct(F.when(F.col(key).isin(*wanted), F.col(key))) == len(set(wanted))).alias("has_all"))


def first_of(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first values by order, for a report."""
    return df.select(column).distinct().orderBy(column).limit(n)


def result_features(terms: Column, qualities: Column) -> dict[str, Column]:
    """What a sample of extraction results should cover: any quality, a substance's part, a place, an action that is
    linked to something. Missing arrays have none."""
    any_ = lambda p: F.coalesce(F.exists(terms, p), F.lit(False))
    place = lambda t: F.coalesce(t["variant_place_lemma_normalized"], F.lit("")) != ""
    linked = lambda t: t["label"].isin("PROCESS", "ADMINISTRATION") & (F.coalesce(t["applies_to"]["kind"], F.lit("UNSPECIFIED")) != "UNSPECIFIED")
    return {
        "has_quality": F.coalesce(F.size(qualities) > 0, F.lit(False)),
        "has_substance_part": any_(lambda t: F.coalesce(t["label"] == "SUBSTANCE_PART", F.lit(False))),
        "has_place": any_(place),
        "has_linked_action": any_(lambda t: F.coalesce(linked(t), F.lit(False))),
    }


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Children whose non-empty key has no parent."""
    known = parent.select(F.col(key).alias("__k"))
    return child.filter(F.coalesce(F.col(fk).cast("string"), F.lit("")) != "").join(known, F.col(fk) == F.col("__k"), "left_anti")


def coverage(hit: Column) -> Column:
    """Percent of rows, to one place; 0 of no rows."""
    n = F.count("*")
    return F.round(F.when(n > 0, 100.0 * F.count_if(hit) / n).otherwise(0.0), 1)


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, most: float = 0.05) -> DataFrame:
    """Totals of two loads side by side; alert where they differ by more than a share."""
    x, y = a.groupBy(key).agg(F.sum(value).alias("left_total")), b.groupBy(key).agg(F.sum(value).alias("right_total"))
    rows = x.join(y, key, "full").na.fill(0, ["left_total", "right_total"])
    return rows.withColumn("alert", F.abs(F.col("left_total") - F.col("right_total")) > most * F.col("left_total"))


def validate(entries: DataFrame, lemmata: DataFrame, parts: DataFrame, preparations: DataFrame, entry_preparations: DataFrame, statuses: tuple = GEN1_STATUS) -> tuple[dict[str, int | float], str | None]:
    """All counters, and the first class of errors in the order of severity (None: valid)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    norm = text("greek_normalized")
    accented = text("greek").rlike("^[ἀ-ἇᾰᾱὰά]")
    ids = entries.filter(F.size(F.filter(F.split(text("lemma_ids"), ","), lambda x: F.trim(x) != "")) > 0)
    ids = ids.select("entry_id", F.explode(F.filter(F.transform(F.split("lemma_ids", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("l"))
    rules = {
        "trans_status": F.count_if(~text("trans_status").isin(*statuses)),
        "embedded_newline": F.count_if(text("chapter_title_gr").contains("\n") | text("greek").contains("\n") | text("translation").contains("\n")),
        "greek_normalized": F.count_if(norm != normalize(F.col("greek"))),
        "no_accented_alpha": (F.count_if(accented) == 0).cast("long"),
        "accented_alpha_not_plain": F.count_if(accented & ~norm.startswith("α")),
        "lemma_coverage": coverage(text("lemma_ids") != ""),
    }
    broken = {
        "duplicate_entry_id": duplicate_keys(entries, "entry_id"),
        "part_fk": orphans(entries, "part_id", parts, "part_id"),
        "lemma_fk": orphans(ids, "l", lemmata, "lemma_id").select("entry_id").distinct(),
        "prep_fk": orphans(entry_preparations, "prep_id", preparations, "prep_id"),
    }
    # one job: its parts run beside each other, and rules of single rows share a scan
    each = entries.agg(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[c.cast("double") for c in rules.values()])).alias("m")).select(F.explode("m").alias("rule", "n"))
    for name, rows in broken.items():
        each = each.union(rows.agg(F.lit(name).alias("rule"), F.count("*").cast("double").alias("n")))
    got = {r.rule: r.n for r in each.collect()}
    order = ("duplicate_entry_id", "trans_status", "part_fk", "lemma_fk", "embedded_newline", "greek_normalized", "no_accented_alpha", "accented_alpha_not_plain", "prep_fk")
    found: dict[str, int | float] = {k: int(got[k]) for k in order}
    failed = next((k for k, n in found.items() if n), None)
    return found | {"lemma_coverage": got["lemma_coverage"]}, failed


def alignment_errors(row: DataFrame, types: tuple = ALIGNMENT_TYPES) -> Column:
    """The error codes of an alignment row, empty if it is sound."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    codes = [F.when(empty(F.col(c)), f"missing_{c}") for c in ("source_a_entry_id", "source_b_entry_id", "alignment_type", "source")]
    codes += [
        F.when(~F.col("alignment_type").isin(*types), "unknown_type"),
        F.when(F.col("source_a_entry_id") == F.col("source_b_entry_id"), "self_pair"),
        F.when(~F.col("confidence").between(0, 1), "confidence_range"),
        F.when(~(F.col("source_a_entry_id").contains("~") & F.col("source_b_entry_id").contains("~")), "not_a_display_id"),
    ]
    return F.filter(F.array(*codes), lambda c: c.isNotNull())


def resolve_alignments(rows: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, rejected, unresolved ids): sound rows with both ids found, smaller id first; of one pair and
    type the last line counts."""
    from quire.operators.tables import last_wins

    checked = rows.withColumn("errors", alignment_errors(rows))
    sound, rejected = checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)
    ids = entries.select("display_entry_id", "id")
    joined = sound
    for side in ("a", "b"):
        joined = joined.join(ids.select(F.col("display_entry_id").alias(f"source_{side}_entry_id"), F.col("id").alias(side)), f"source_{side}_entry_id", "left")
    good = joined.filter("a is not null and b is not null")
    ordered = good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "alignment_type", "confidence", "evidence", "curator", "source", "line_no")
    missing = joined.filter("a is null").select(F.col("source_a_entry_id").alias("id")).union(joined.filter("b is null").select("source_b_entry_id")).distinct()
    return last_wins(ordered, ["a", "b", "alignment_type"], [F.col("line_no")]), rejected, missing


def applies_to(c: Column) -> Column:
    """Four fields; a missing struct is of kind UNSPECIFIED."""
    return F.when(c.isNull(), F.struct(F.lit("UNSPECIFIED").alias("kind"), *[F.lit(None).cast("string").alias(n) for n in ("lemma", "substance", "part")])).otherwise(F.struct(c["kind"].alias("kind"), c["lemma_normalized"].alias("lemma"), c["substance_lemma_normalized"].alias("substance"), c["part_lemma_normalized"].alias("part")))


def term_signatures(terms: Column) -> Column:
    keys = ["label", "normalized", "lemma_normalized", "head_lemma_normalized", "substance_lemma_normalized", "part_lemma_normalized"]
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(terms, F.array()), lambda t: F.struct(*[t[k].alias(k) for k in keys], applies_to(t["applies_to"]).alias("applies_to")))))


def quality_signatures(qualities: Column) -> Column:
    keys = ["axis", "degree", "intensity", "hedge", "variant_place_lemma_normalized"]
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(qualities, F.array()), lambda q: F.struct(*[q[k].alias(k) for k in keys], applies_to(q["applies_to"]).alias("applies_to")))))


def run_diff(a: DataFrame, b: DataFrame, ids: DataFrame, key: str, sets: list[str]) -> DataFrame:
    """Per id what run b added to and removed from each signature array of run a, in counts, and whether
    anything changed. An id that a run lacks raises an error; a repeated id counts as often."""
    x = a.select(key, *[F.col(s).alias(f"a_{s}") for s in sets], F.lit(1).alias("in_a"))
    y = b.select(key, *[F.col(s).alias(f"b_{s}") for s in sets], F.lit(1).alias("in_b"))
    rows = ids.join(x, key, "left").join(y, key, "left")
    rows = rows.filter(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("no result for "), F.col(key).cast("string")))))
    counts = {}
    for s in sets:
        counts[f"{s}_added"] = F.size(F.array_except(f"b_{s}", f"a_{s}"))
        counts[f"{s}_removed"] = F.size(F.array_except(f"a_{s}", f"b_{s}"))
    out = rows.select(*ids.columns, *[v.alias(k) for k, v in counts.items()])
    changed = F.lit(False)
    for k in counts:
        changed = changed | (F.col(k) > 0)
    return out.withColumn("changed", changed)


def diff_totals(diff: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in diff.columns if c.endswith(("_added", "_removed"))]
    return diff.agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), *sums)


def unified_diff(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, diff): the unified diff of two texts, for rows where they differ."""
    @F.pandas_udf("string")
    def diff(k: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        return pd.Series(["\n".join(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), f"{i}.a", f"{i}.b", lineterm="")) for i, x, y in zip(k, a, b, strict=True)])

    rows = df.filter(~F.col(left).eqNullSafe(F.col(right)))
    return rows.select(key, diff(F.col(key).cast("string"), left, right).alias("diff"))


def stale(assertions: DataFrame, entries: DataFrame, fk: str, key: str, then: str, now: str) -> DataFrame:
    """Sets is_stale where the hash that an assertion was anchored to is no longer its entry's."""
    current = entries.select(F.col(key).alias("__k"), F.col(now).alias("__now"))
    return assertions.join(current, F.col(fk) == F.col("__k"), "left").withColumn("is_stale", ~F.col(then).eqNullSafe(F.col("__now"))).drop("__k", "__now")


def reanchor(quote: Column, start: Column, text: Column) -> Column:
    """(outcome, start): stable where the quote still stands at its offset, reanchored where it stands once
    elsewhere, else needs_review."""
    here = F.substring(text, start + 1, F.char_length(quote)) == quote
    at = F.instr(text, quote)
    again = F.instr(F.substring(text, at + 1, F.char_length(text)), quote)
    outcome = F.when(here, "stable").when((at > 0) & (again == 0), "reanchored").otherwise("needs_review")
    return F.struct(outcome.alias("outcome"), F.when(here, start).when((at > 0) & (again == 0), at - 1).cast("int").alias("start"))


def span_matches(text: Column, start: Column, end: Column, quote: Column) -> Column:
    return F.substring(text, start + 1, end - start) == quote


def payload_valid(kind: Column, payload: Column, required: dict[str, list[str]] | None = None) -> Column:
    """Whether the JSON payload has the keys that its assertion type needs."""
    out = F.lit(True)
    for k, keys in (PAYLOAD_KEYS if required is None else required).items():
        has = F.lit(True)
        for name in keys:
            has = has & F.get_json_object(payload, f"$.{name}").isNotNull()
        out = F.when(kind == k, has).otherwise(out)
    return out


def fenced_json(text: Column) -> Column:
    """The JSON object in an answer that may be fenced."""
    t = F.trim(text)
    return F.when(t.startswith("```"), F.regexp_extract(t, r"(?s)(\{.*\})", 1)).otherwise(t)


def import_run(counts: dict[str, Column], df: DataFrame, run_id: str, mode: str) -> DataFrame:
    """One provenance row with versions and counts."""
    return df.agg(*[v.alias(k) for k, v in counts.items()]).select(F.lit(run_id).alias("id"), F.current_timestamp().alias("finished_at"), F.lit(NORMALIZATION_VERSION).alias("normalization_version"), F.lit(TOKENIZER_VERSION).alias("tokenizer_version"), F.lit(mode).alias("mode"), F.to_json(F.struct(*counts)).alias("counts"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def covering_sample(df: DataFrame, key: str, features: list[Column], n: int) -> DataFrame:
    """n ids in order: for each feature the smallest id that has it and is not chosen yet, then every k-th of
    the rest. Chosen ids are a handful, picked by minima; the rest are numbered in one pass."""
    chosen: list = []
    for feature in features:
        found = df.filter(feature & ~F.col(key).isin(*chosen) if chosen else feature).agg(F.min(key)).first()[0]
        if found is not None and len(chosen) < n:
            chosen.append(found)
    rest = df.filter(~F.col(key).isin(*chosen)).select(key) if chosen else df.select(key)
    left = n - len(chosen)
    if left > 0:
        from quire.operators.tables import batches

        step = max(1, rest.count() // left)
        stride = batches(rest, [F.col(key)], 1).filter(F.col("batch_id") % step == 0).select(key).orderBy(key).limit(left)
    else:
        stride = rest.limit(0)
    spark = df.sparkSession
    first = spark.createDataFrame([(c,) for c in chosen], df.select(key).schema) if chosen else df.select(key).limit(0)
    return first.union(stride).orderBy(key)


def distinct_terms(terms: Column) -> Column:
    """Terms without repeats, in order: one of each label and headword (or surface where none is known), of
    substance parts one of each substance and part."""
    substance = lambda t: t["label"] == "SUBSTANCE_PART"
    first = lambda t: F.when(substance(t), t["substance_lemma_normalized"]).otherwise(F.coalesce(t["lemma_normalized"], t["normalized"]))
    second = lambda t: F.when(substance(t), t["part_lemma_normalized"])
    key = lambda t: F.to_json(F.struct(t["label"].alias("a"), first(t).alias("b"), second(t).alias("c")))
    keys = F.transform(terms, key)
    return F.filter(terms, lambda t, i: F.array_position(keys, key(t)) == i + 1)
