"""Linking entries to vocabularies: headwords, parts, preparations, canonical clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.cells import id_order, is_nullish
from quire.functions.text import clip, greek_tokens, normalize

# Inflected forms of part nouns, normalized.
PART_FORMS = {
    "ριζα": ("ριζα", "ριζης", "ριζαν", "ριζαι", "ριζων", "ριζας"),
    "φυλλον": ("φυλλον", "φυλλα", "φυλλων", "φυλλοις", "φυλλοι"),
    "σπερμα": ("σπερμα", "σπερματος", "σπερματι", "σπερματα", "σπερματων"),
    "καρπος": ("καρπος", "καρπου", "καρπον", "καρποι", "καρπων"),
    "ανθος": ("ανθος", "ανθους", "ανθει", "ανθη", "ανθων"),
    "φλοιος": ("φλοιος", "φλοιου", "φλοιον", "φλοιοι", "φλοιων"),
    "χυλος": ("χυλος", "χυλου", "χυλον", "χυλοι", "χυλων"),
    "οπος": ("οπος", "οπου", "οπον", "οποι", "οπων"),
    "κλαδος": ("κλαδος", "κλαδου", "κλαδον", "κλαδοι", "κλαδων"),
    "βλαστος": ("βλαστος", "βλαστου", "βλαστον", "βλαστοι", "βλαστων"),
    "τεφρα": ("τεφρα", "τεφρας"),
    "αιμα": ("αιμα", "αιματος"),
    "γαλα": ("γαλα", "γαλακτος", "γαλακτι"),
    "χολη": ("χολη", "χολης"),
    "πιμελη": ("πιμελη", "πιμελης"),
    "μυελος": ("μυελος", "μυελου"),
    "ηπαρ": ("ηπαρ", "ηπατος"),
    "κοπρος": ("κοπρος", "κοπρου"),
    "ουρον": ("ουρον", "ουρου"),
    "οστουν": ("οστουν", "οστα", "οστου", "οστων"),
    "κερας": ("κερας", "κερατος", "κερατα", "κερατων"),
    "δερμα": ("δερμα", "δερματος"),
    "ονυξ": ("ονυξ", "ονυχος", "ονυχες"),
    "ωον": ("ωον", "ωου", "ωα"),
    "λιθος": ("λιθος", "λιθου", "λιθον", "λιθοι", "λιθων"),
    "σποδος": ("σποδος", "σποδου", "σποδον", "σποδοι", "σποδων"),
}
# Process words that are no substances; tokens that are no preparations.
NOT_SUBSTANCES = ("βρεξαντα", "εψησις", "εψησεως")
NOT_PREPARATIONS = ("ωμοτριβες", "ξηρα")
# Part ids that a category decides on when a form is ambiguous.
CATEGORY_PARTS = {"mineral": "P302", "vegetable": "P005", "animal": "P005"}
# Base -> (forms that always count, prefix of attested forms that count, forms that count if attested).
PREPARATION_FORMS = {
    "κεκαυμενος": (("κεκαυμενος", "κεκαυμενη", "κεκαυμενον"), "κεκαυμε", ()),
    "εψησις": (("εψησις", "εψησεως"), "εψησ", ()),
    "πεπλυμενος": (("πεπλυμενον",), "πεπλυμε", ()),
    "αφεψημα": (("αφεψημα",), None, ("αφεψηματος", "αφεψηματι", "αφεψηματα", "αφεψηματων")),
}
# Stems of preparation-like words, in the order in which they are tried.
STEMS = {"εψη": "boiled/cooked family", "πεπλυ": "washed family", "εκπιεσ": "expressed/pressed family", "τετριμ": "ground family", "κοπαν": "pounded family", "ξηρ": "dried family"}
BURNT_STEM = "κεκαυμε"


def lemma_items(cell: Column) -> Column:
    """The items of a headword cell. Semicolons and commas part items; in a cell that is a list, by such a
    sign or by three or more conjunctions, an unaccented or grave conjunction parts them too."""
    cell = F.trim(F.coalesce(cell, F.lit("")))
    parts = F.filter(F.transform(F.split(cell, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda word: F.size(F.split(normalize(cell, "1.0"), f" {word} ", -1)) - 1
    listed = cell.rlike("[;,]") | (count("και") + count("τε και") >= 3)
    inner = lambda p: F.filter(F.transform(F.split(p, r"\s+(?:τε\s+)?κα(?:ὶ|ι)\s+"), lambda x: F.trim(x)), lambda x: x != "")
    deep = F.flatten(F.transform(parts, lambda p: F.when(F.size(inner(p)) > 0, inner(p)).otherwise(F.array(p))))
    return F.when(is_nullish(cell), F.array().cast("array<string>")).when(listed, deep).otherwise(parts)


def canonical_ids(lemmata: DataFrame) -> DataFrame:
    """(norm, canonical_id): of each normalized headword the id of the smallest number."""
    rows = lemmata.filter((F.trim("headword_normalized") != "") & (F.trim("lemma_id") != ""))
    return rows.groupBy(F.trim("headword_normalized").alias("norm")).agg(F.min_by("lemma_id", F.struct(id_order(F.col("lemma_id")), "lemma_id")).alias("canonical_id"))


def clusters(lemmata: DataFrame, order: str | None = None) -> DataFrame:
    """Headwords that several ids share: canonical_lemma_id, headword_normalized, member_lemma_ids, n_members.

    Members stand by the column ``order`` (ids cut to a fixed width do not tell their own), else by their numbers."""
    by = F.sort_array(F.collect_list(F.struct((F.col(order) if order else id_order(F.col("lemma_id"))).alias("o"), "lemma_id")))
    rows = lemmata.filter(F.coalesce(F.trim("headword_normalized"), F.lit("")) != "").groupBy("headword_normalized").agg(by.alias("m")).filter(F.size("m") > 1)
    return rows.select(F.col("m")[0]["lemma_id"].alias("canonical_lemma_id"), "headword_normalized", F.array_join(F.transform("m", lambda x: x["lemma_id"]), ",").alias("member_lemma_ids"), F.size("m").alias("n_members"))


def link_lemmata(entries: DataFrame, lemmata: DataFrame, key: str, cell: str, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, lemma_ids) in order of first match, and unmatched (key, unmatched_term, context)."""
    items = entries.select(key, F.col(cell).alias("__cell"), (where if where is not None else F.lit("")).alias("__where"), F.posexplode(lemma_items(F.col(cell))).alias("pos", "item"))
    items = items.withColumn("norm", normalize(F.col("item"), "1.0", strip=True)).filter(~F.col("norm").isin(*NOT_SUBSTANCES))
    joined = items.join(canonical_ids(lemmata), "norm", "left")
    first = joined.filter("canonical_id is not null").groupBy(key, "canonical_id").agg(F.min("pos").alias("pos"))
    linked = first.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "canonical_id"))), lambda x: x["canonical_id"]), ",").alias("lemma_ids"))
    out = entries.select(key).join(linked, key, "left").select(key, F.coalesce("lemma_ids", F.lit("")).alias("lemma_ids"))
    unmatched = joined.filter("canonical_id is null").select(key, F.col("item").alias("unmatched_term"), F.concat_ws(": ", F.nullif("__where", F.lit("")), "__cell").alias("context"))
    return out, unmatched


def part_forms(parts: DataFrame) -> DataFrame:
    """(form, part_id): known inflections of each part's word, or the word itself."""
    table = F.create_map(*[x for base, forms in PART_FORMS.items() for x in (F.lit(base), F.array(*map(F.lit, forms)))])
    base = normalize(F.col("greek"), "1.0", strip=True)
    rows = parts.filter((F.trim("part_id") != "") & (F.trim("greek") != ""))
    return rows.select(F.explode(F.coalesce(F.try_element_at(table, base), F.array(base))).alias("form"), F.trim("part_id").alias("part_id")).distinct()


def assign_parts(entries: DataFrame, parts: DataFrame, key: str, cell: str, category: str) -> DataFrame:
    """(key, part_id) where the Greek tokens of a cell point at exactly one part. A form of several parts counts
    for the one that the entry's category decides on, else for none."""
    words = entries.select(key, category, F.explode(F.transform(greek_tokens(F.col(cell)), lambda t: normalize(t, "1.0"))).alias("form"))
    return unique_targets(words, part_forms(parts), key, category, CATEGORY_PARTS)


def unique_targets(words: DataFrame, forms: DataFrame, key: str, category: str, decides: dict[str, str]) -> DataFrame:
    """(key, part_id) of words(key, category, form) and forms(form, part_id): where all words point at one part."""
    forms = forms.groupBy("form").agg(F.collect_set("part_id").alias("ids"))  # as many as one form has parts
    wanted = F.create_map(*[F.lit(x) for kv in decides.items() for x in kv])
    choice = F.try_element_at(wanted, F.col(category))
    one = F.when(F.size("ids") == 1, F.col("ids")[0]).when(F.array_contains("ids", choice), choice)
    found = words.join(forms, "form").select(key, one.alias("part_id")).filter("part_id is not null")
    return found.groupBy(key).agg(F.min("part_id").alias("part_id"), F.max("part_id").alias("__m")).filter("part_id = __m").drop("__m")


def preparation_forms(preparations: DataFrame, attested: DataFrame) -> DataFrame:
    """(form, prep_id, rule): forms by vocabulary order. ``attested(token)`` has the normalized tokens in use."""
    base = normalize(F.col("greek"), "1.0", strip=True)
    rules = preparations.select(F.trim("prep_id").alias("prep_id"), "rule", base.alias("base"))
    fixed = F.create_map(*[x for b, (always, _, _) in PREPARATION_FORMS.items() for x in (F.lit(b), F.array(*map(F.lit, always)))])
    always = rules.select(F.explode(F.coalesce(F.try_element_at(fixed, F.col("base")), F.array("base"))).alias("form"), "prep_id", "rule")
    seen = attested.select(F.col("token").alias("form")).distinct()
    out = always
    for b, (_, prefix, listed) in PREPARATION_FORMS.items():
        hit = F.col("form").startswith(prefix) if prefix else F.col("form").isin(*listed)
        out = out.union(seen.filter(hit).join(F.broadcast(rules.filter(F.col("base") == b)).select("prep_id", "rule")))  # one rule
    return out.groupBy("form", "prep_id").agg(F.min("rule").alias("rule"))


def field_tokens(entries: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, field_no, pos, surface, token) of the Greek tokens in several cells."""
    cells = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(f).alias("field"), greek_tokens(F.coalesce(F.col(f), F.lit(""))).alias("ts"), F.col(f).alias("cell")) for i, f in enumerate(fields)])
    rows = entries.select(key, F.explode(cells).alias("c")).select(key, "c.field", F.col("c.no").alias("field_no"), "c.cell", F.posexplode("c.ts").alias("pos", "surface"))
    return rows.withColumn("token", normalize(F.col("surface"), "1.0"))


def stem_reason(token: Column, reasons: dict[str, str] = STEMS) -> Column:
    """The reason of the first stem that a token begins with."""
    out = None
    for stem, why in reasons.items():
        out = F.when(token.startswith(stem), why) if out is None else out.when(token.startswith(stem), why)
    return out


def link_preparations(entries: DataFrame, preparations: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, prep_id, is_primary, notes) and unmatched (key, token, context) of preparation-like words.

    A token matches the first rule that has its form; a preparation is noted where it is first seen."""
    words = field_tokens(entries, key, fields).filter(~F.col("token").isin(*NOT_PREPARATIONS))
    forms = preparation_forms(preparations, words.select("token"))
    linked, rest = first_matches(words, forms, key)
    loose = rest.filter(stem_reason(F.col("token")).isNotNull())
    return linked, loose.select(key, F.col("surface").alias("token"), clip(F.col("cell"), 180).alias("context"))


def first_matches(words: DataFrame, forms: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Words (key, field, field_no, pos, surface, token) against forms (form, prep_id, rule): (key, prep_id, is_primary,
    notes), noted where first seen, and the words that no form matches."""
    rule = forms.groupBy("form").agg(F.min_by("prep_id", F.struct("rule", "prep_id")).alias("prep_id"))
    joined = words.join(rule, words["token"] == rule["form"], "left")
    place = F.struct("field_no", "pos")
    first = joined.filter("prep_id is not null").groupBy(key, "prep_id").agg(F.min(place).alias("at"), F.min_by(F.concat(F.lit("matched_in="), "field", F.lit("; token="), "surface"), place).alias("notes"))
    order = Window.partitionBy(key).orderBy("at")
    linked = first.select(key, "prep_id", (F.row_number().over(order) == 1).alias("is_primary"), "notes")
    return linked, joined.filter(F.col("prep_id").isNull()).select(*words.columns)


def term_counts(words: DataFrame, key: str) -> DataFrame:
    """(token, n, example): how often each word stands, and the smallest key that has it."""
    return words.groupBy("token").agg(F.count("*").alias("n"), F.min(key).alias("example"))


def review_candidates(entries: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(greek, context, reason, suggested_scope, n): words that look like preparations and are not known."""
    words = field_tokens(entries, key, fields)
    why = stem_reason(F.col("token"))
    new = words.filter(~F.col("token").isin(*NOT_PREPARATIONS) & ~F.col("token").startswith(BURNT_STEM) & why.isNotNull()).join(known.select(F.col("form").alias("token")), "token", "left_anti")
    first = F.min_by("cell", F.struct(key, "field_no", "pos"))
    rows = new.groupBy("token").agg(F.count("*").alias("n"), first.alias("cell"), F.min(why).alias("reason"))
    return rows.select(F.col("token").alias("greek"), clip(F.col("cell"), 180).alias("context"), "reason", F.lit("all").alias("suggested_scope"), "n").orderBy(F.col("n").desc(), "greek")


def parent_lemmata(lemmata: DataFrame, least: int = 4) -> DataFrame:
    """(lemma_id, parent_lemma): the headword that is the longest proper word-prefix of another. Prefixes are
    exploded, one per word of a headword, and joined by equality."""
    words = F.split("headword_normalized", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
    short = lemmata.filter(F.size(words) > 1).select("lemma_id", F.explode(cuts).alias("norm")).filter(F.char_length("norm") >= least)
    found = short.join(canonical_ids(lemmata), "norm")
    return found.groupBy("lemma_id").agg(F.max_by("canonical_id", F.char_length("norm")).alias("parent_lemma")).filter("lemma_id <> parent_lemma")


def family_parents(lemmata: DataFrame, head: str) -> DataFrame:
    """(lemma_id, parent_lemma): headwords that have the word ``head`` beside others belong to it, as oils do to oil."""
    words = F.split("headword_normalized", " ")
    parent = canonical_ids(lemmata).filter(F.col("norm") == head).select(F.col("canonical_id").alias("parent_lemma"))
    members = lemmata.filter((F.size(words) > 1) & F.array_contains(words, head)).select("lemma_id", F.lit(head).alias("norm"))
    return members.join(parent.withColumn("norm", F.lit(head)), "norm").select("lemma_id", "parent_lemma")


def assigned_parents(lemmata: DataFrame, heads: tuple[str, ...] = ("ελαιον",), least: int = 4) -> DataFrame:
    """(lemma_id, parent_lemma, relationship): the families come first, then the longest prefix."""
    out = None
    for head in heads:
        one = family_parents(lemmata, head)
        out = one if out is None else out.union(one.join(out, "lemma_id", "left_anti"))
    prefix = parent_lemmata(lemmata, least).join(out.select("lemma_id"), "lemma_id", "left_anti")
    return out.withColumn("relationship", F.lit("family")).union(prefix.withColumn("relationship", F.lit("prefix")))


def constant_lookup(df: DataFrame, lookup: DataFrame, where: Column, value: str, out: str) -> DataFrame:
    """``df`` with a column that has the one value that a small table gives for a code; none or two raise an error."""
    found = lookup.filter(where).select(value).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} rows for the constant {out}")
    return df.withColumn(out, F.lit(found[0][0]))


def match_classes(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, match): exact, variant (equal only when normalized) or new."""
    exact = known.select(F.col("name").alias("__e")).distinct()
    alike = known.select(normalize(F.col("name"), strip=True).alias("__v")).distinct()
    rows = names.join(exact, F.col("name") == F.col("__e"), "left").join(alike, normalize(F.col("name"), strip=True) == F.col("__v"), "left")
    return rows.withColumn("match", F.when(F.col("__e").isNotNull(), "exact").when(F.col("__v").isNotNull(), "variant").otherwise("new")).drop("__e", "__v")


def form_merge(forms: DataFrame) -> DataFrame:
    """(form_normalized, status, n_lemmata): a form that only one headword has is merged, another needs review."""
    rows = forms.groupBy("form_normalized").agg(F.count_distinct("lemma_id").alias("n_lemmata"))
    return rows.withColumn("status", F.when(F.col("n_lemmata") > 1, "needs_review").otherwise("merged"))


def vocabulary_facets(texts: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, domain, terms): the distinct vocabulary terms of a heading by domain, comma-joined."""
    words = texts.select(key, F.explode(F.array_distinct(F.split(normalize(F.col(text)), r"[^\p{L}\p{N}]+"))).alias("form"))
    hits = words.join(vocabulary.select("form", "domain", "english"), "form").select(key, "domain", "english").distinct()
    return hits.groupBy(key, "domain").agg(F.array_join(F.sort_array(F.collect_list("english")), ",").alias("terms"))


def heading_terms(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, order: tuple[str, ...] = ("part", "product", "variety", "state")) -> DataFrame:
    """(key, terms): the vocabulary terms of a heading in one cell, by the order of their domains, then by name."""
    facets = vocabulary_facets(texts, key, text, vocabulary)
    place = F.array_position(F.array(*map(F.lit, order)), F.col("domain"))
    rows = facets.filter(place > 0).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), "terms"))).alias("m"))
    return rows.select(key, F.array_join(F.transform("m", lambda x: x["terms"]), ",").alias("terms"))


def bridged(rows: DataFrame, key: str, bridge: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Rows under the ids that a bridge table has for their old ones, and the queue of rows without."""
    known = bridge.groupBy(F.col(old).alias("__old")).agg(F.min(new).alias(new))
    joined = rows.join(known, F.col(key) == F.col("__old"), "left").drop("__old")
    return joined.filter(F.col(new).isNotNull()), joined.filter(F.col(new).isNull()).drop(new)


def supplement(rows: DataFrame, text: str, vocabulary: DataFrame, form: str, ident: str) -> tuple[DataFrame, DataFrame]:
    """A supplement's rows with the vocabulary id of their normalized text, and the residue for review."""
    return bridged(rows.withColumn("__form", normalize(F.col(text), strip=True)), "__form", vocabulary, form, ident)
