"""Typed coercions of text cells and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import normalize

# Fixed values.
NULLISH = ("", "null", "(null)", "nan")
CATEGORIES = {"plant": "vegetable", "animal": "animal", "mineral": "mineral"}
NO_NUMBER = 1_000_000_000
SHEETS = {"SMT": "GAL_SMT", "Alim.Fac": "GAL_ALIM", "Oribasius CM 15": "ORIB_CM", "Aetius I-II": "AET_LM"}
PROOIMION = "προοιμιον"


def is_nullish(cell: Column) -> Column:
    return F.lower(F.trim(F.coalesce(cell, F.lit("")))).isin(*NULLISH)


def to_int(cell: Column) -> Column:
    """Integer part of a number in a text cell; null for anything else."""
    number = F.trim(cell).try_cast("double")
    return F.when(F.abs(number) < 2147483648, number).cast("int")


def to_intish(cell: Column) -> Column:
    """A double cell as text, whole numbers without a point; null and NaN are empty."""
    whole = cell == F.floor(cell)
    return F.when(cell.isNull() | F.isnan(cell), "").when(whole, cell.cast("bigint").cast("string")).otherwise(cell.cast("string"))


def id_number(ident: Column) -> Column:
    """The digits of an id such as L012 as a number, else a value that sorts last."""
    digits = F.regexp_replace(F.substring(F.trim(ident), 2, 1000), r"\D", "")
    return F.when(F.trim(ident).rlike("^[Ll]") & (digits != ""), digits.try_cast("bigint")).otherwise(F.lit(None)).cast("bigint")


def id_order(ident: Column) -> Column:
    return F.coalesce(id_number(ident), F.lit(NO_NUMBER).cast("bigint"))


def category(cell: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(cell, F.lit(""))))), F.lit(""))


def category_from_words(text: Column) -> Column:
    """A coarse category from tell-tale words of a heading; empty without one."""
    t = normalize(text)
    return F.when(t.rlike("λιθος|γη(?![α-ω])|χαλκ|θει"), "mineral").when(t.rlike("γαλα|αιμα|χολη|στεαρ|κοπρος"), "animal").when(t.rlike("βοτανη|ριζα|φυλλ|σπερμ|καρπ"), "vegetable").otherwise("")


def display(en: Column, gr: Column) -> Column:
    """The English title, or the Greek one where that is missing or empty."""
    return F.coalesce(F.nullif(en, F.lit("")), gr)


def dialects(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Each wanted column from the first of its names that the sheet has and that is not null there."""
    return df.select(*(F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in df.columns], F.lit(None).cast("string")).alias(name) for name, names in wanted.items()))


def build_ref(legacy: bool, book: Column, chapter: Column, section: Column, subsection: Column, chapter_gr: Column, section_gr: Column, row: Column) -> Column:
    """A dotted reference from its parts, ``row<n>`` without any; ``book.prooimion`` for a preface."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    parts = [clean(c) for c in ((book, chapter, section) if legacy else (book, chapter, section, subsection))]
    dotted = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ".")
    plain = F.when(dotted == "", F.concat(F.lit("row"), row.cast("string"))).otherwise(dotted)
    if legacy:
        return plain
    preface = F.when(parts[0] == "", F.lit("prooimion")).otherwise(F.concat(parts[0], F.lit(".prooimion")))
    title = normalize(F.coalesce(F.nullif(clean(section_gr), F.lit("")), chapter_gr), "1.0", strip=True)
    untitled = parts[1].isin("0", "") & parts[2].isin("0", "") & (parts[0] != "") & (title == PROOIMION)
    return F.when(F.lower(parts[1]) == "pr", preface).when(untitled, preface).otherwise(plain)


def chapter_title_en(title: Column) -> Column:
    """A literal rendering: Prooimion for a preface, ``On X`` for a title that begins with the Greek for about."""
    rest = F.trim(F.regexp_extract(title, r"^\s*(?:Περὶ|περὶ|περι)\s+(.*?)\s*$", 1))
    return F.when(normalize(title, "1.0", strip=True) == PROOIMION, "Prooimion").when(rest != "", F.concat(F.lit("On "), rest)).otherwise("")


def dedupe_ids(df: DataFrame, ident: str, order: list, out: str = "entry_id") -> DataFrame:
    """Ids made unique: each member of a repeated id gets ``~1`` and so on, in order. One shuffle by id."""
    group = Window.partitionBy(ident)
    n = F.count("*").over(group)
    return df.withColumn(out, F.when(n > 1, F.concat(F.col(ident), F.lit("~"), F.row_number().over(group.orderBy(*order)))).otherwise(F.col(ident)))


def display_entry_id(doc: Column, segment: Column) -> Column:
    """``doc~segment``; a hash sign in either is an error."""
    bad = doc.contains("#") | segment.contains("#")
    return F.when(bad, F.raise_error(F.lit("'#' is not allowed in ids"))).otherwise(F.concat(doc, F.lit("~"), segment))
