"""References and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EN_DASH = "–"


def split_reference(ref: Column) -> dict[str, Column]:
    """book, chapter, section, subsection, line of a reference such as ``1.2:3.4.5`` or ``1.2.3.4.5``.

    What follows the chapter, behind a colon or a dot, is section, then line, and all between the two is
    the subsection. Missing parts are empty."""
    ref = F.trim(ref)
    colon = ref.contains(":")
    head = F.split(F.substring_index(ref, ":", 1), r"\.")
    dotted = F.split(ref, r"\.")
    rest = F.when(colon, F.split(F.substring(ref, F.instr(ref, ":") + 1, F.length(ref)), r"\.")).otherwise(F.slice(dotted, 3, F.greatest(F.size(dotted) - 2, F.lit(0))))
    n = F.size(rest)
    part = lambda a, i: F.coalesce(F.get(a, F.lit(i)), F.lit(""))
    return {
        "book": part(head, 0),
        "chapter": part(head, 1),
        "section": part(rest, 0),
        "subsection": F.when(n >= 3, F.array_join(F.slice(rest, 2, F.greatest(n - 2, F.lit(0))), ".")).otherwise(""),
        "line": F.when(n >= 2, F.element_at(rest, -1)).otherwise(""),
    }


def is_marker(line: Column) -> Column:
    line = F.trim(line)
    return line.rlike(r"^[0-9](?:[0-9.:,t]*[0-9])?$") & line.contains(".")


def is_title_marker(line: Column) -> Column:
    return is_marker(line) & line.contains(".t.")


def entry_key(ref: Column) -> tuple[Column, Column]:
    """What is before the last dot, and the number behind it."""
    return F.regexp_replace(ref, r"\.[^.]*$", ""), F.regexp_extract(ref, r"([^.]*)$", 1).try_cast("int")


def structure_ref(path: Column) -> Column:
    """Numbers of a path of (n, head) structs, heads where a number is missing, joined by dots."""
    labels = F.transform(path, lambda p: F.coalesce(F.nullif(p["n"], F.lit("")), F.nullif(p["head"], F.lit(""))))
    return F.array_join(F.filter(labels, lambda x: x.isNotNull()), ".")


def edition_ref(edition: Column, start_pb: Column, start_lb: Column, end_pb: Column, end_lb: Column) -> Column:
    """``Edition page.line`` to page.line: without an end only the start, without both the edition."""
    place = lambda pb, lb: F.nullif(F.concat_ws(".", F.nullif(pb, F.lit("")), F.nullif(lb, F.lit(""))), F.lit(""))
    start, end = place(start_pb, start_lb), place(end_pb, end_lb)
    span = F.when(start.isNull(), end).when(end.isNull() | (start == end), start).otherwise(F.concat(start, F.lit(EN_DASH), end))
    return F.when(edition.isNotNull(), F.concat_ws(" ", edition, span))


def combined_ref(structure: Column, edition: Column) -> Column:
    return F.when(edition.isNull() | (edition == ""), structure).otherwise(F.concat(structure, F.lit(" ("), edition, F.lit(")")))
