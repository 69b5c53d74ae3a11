"""Statements about the four primary qualities, found by rules: an axis, a degree or an intensity, a hedge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normalize

# Fixed values, normalized: stems of the axes, ordinals of the degrees, markers of intensity from the strongest on.
AXES = {"HOT": "θερμ", "COLD": "ψυχ|ψυξ", "DRY": "ξηρ", "WET": "υγρ"}
DEGREES = {"πρωτην": 1, "δευτεραν": 2, "τριτην": 3, "τεταρτην": 4}
INTENSITIES = {"ακρως": "extreme", "σφοδρως": "strong", "εν τω μεσω|συμμετ[ροςν]+ .*κατα υγροτητα και ξηροτητα": "balanced", "μετριως|συμμετρως": "moderate", "ουκ ισχυρως": "weak"}
HEDGE = "που"


def first_of(table: dict[str, object], clause: Column) -> Column:
    out = F.lit(None)
    for pattern, value in reversed(table.items()):
        out = F.when(clause.rlike(rf"(?:^|[^\p{{L}}])(?:{pattern})"), F.lit(value)).otherwise(out)
    return out


def statements(text: Column) -> Column:
    """An array of (axis, degree, intensity, hedge, evidence): per clause one for each axis that is named beside
    a degree or an intensity. Clauses end at full stops, middle dots and semicolons."""
    clauses = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.·;]"), lambda c: F.trim(c)), lambda c: c != "")

    def read(clause: Column) -> Column:
        n = F.regexp_replace(normalize(clause), r"\s+", " ")
        degree = F.when(n.rlike(r"κατα την "), first_of(DEGREES, n)).cast("int")
        intensity = first_of(INTENSITIES, n).cast("string")
        hedge = F.when(degree.isNotNull() & n.rlike(rf"(?:^| ){HEDGE}(?: |,|$)"), F.lit(HEDGE)).cast("string")
        named = F.array(*[F.when(n.rlike(rf"(?:^|[^\p{{L}}])(?:{stem})"), F.lit(axis)) for axis, stem in AXES.items()])
        found = F.filter(named, lambda a: a.isNotNull() & (degree.isNotNull() | intensity.isNotNull()))
        return F.transform(found, lambda a: F.struct(a.alias("axis"), degree.alias("degree"), intensity.alias("intensity"), hedge.alias("hedge"), clause.alias("evidence")))

    return F.flatten(F.transform(clauses, read))


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.inline(statements(F.col(text))))
