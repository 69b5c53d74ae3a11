"""TEI markup: segments, reading texts, references and findings."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
TEI = "{http://www.tei-c.org/ns/1.0}"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
LEFT_OUT = ("note", "add", "del")
GAP = "[...]"

SEGMENT = "tei_doc_id string, seq int, tei_segment_id string, reading_text string, path array<struct<type:string,n:string,xml_id:string,head:string>>, events array<struct<kind:string,n:string,ed:string,offset:int>>, severity string, code string"


def _name(node) -> str:
    """The local name; comments and processing instructions have none."""
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


class Reader:
    """Collects the reading text of a segment and the milestones with their offsets in it.

    White space runs become one space as the text grows, so offsets hold in the finished text. A gap's
    sign stands apart from the words beside it."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size, self.tail = 0, ""  # of what has been put, and its last characters
        self.events: list[dict] = []
        self.findings: list[str] = []

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def put(self, piece: str) -> None:
        self.parts.append(piece)
        self.size += len(piece)
        self.tail = (self.tail + piece)[-len(GAP) :]

    def add(self, piece: str | None) -> None:
        for i, word in enumerate((piece or "").split()):
            space = self.size and (i or piece[0].isspace() or self.tail == GAP) and not self.tail.endswith(" ")
            if self.tail == GAP and not (i or piece[0].isspace()) and not word[0].isalnum():
                space = False  # no space before punctuation
            self.put((" " if space else "") + word)
        if piece and piece[-1].isspace() and self.size and not self.tail.endswith(" "):
            self.put(" ")

    def walk(self, node) -> None:
        name = _name(node)
        if not name or name in LEFT_OUT:
            return
        if name in ("pb", "lb"):
            self.events.append({"kind": name, "n": node.get("n"), "ed": node.get("ed"), "offset": self.size})
        elif name == "gap":
            self.put((" " if self.size and not self.tail.endswith(" ") else "") + GAP)
        elif name in ("choice", "app"):
            self.choose(node, name)
        else:
            self.add(node.text)
            for child in node:
                self.walk(child)
                self.add(child.tail)

    def choose(self, node, name: str) -> None:
        """One reading of several: the regular or expanded form, the lemma, else the first."""
        inner = {_name(c): c for c in reversed(list(node)) if _name(c)}
        wanted = ("reg", "expan") if name == "choice" else ("lem", "rdg")
        if name == "choice":
            self.findings += [f"{a}_without_{b}" for a, b in (("orig", "reg"), ("abbr", "expan")) if a in inner and b not in inner]
        elif "lem" not in inner:
            self.findings.append("app_without_lem")
        pick = next((inner[w] for w in wanted if w in inner), None)
        if pick is None and name == "choice":
            pick = next((c for c in node if _name(c)), None)
        if pick is not None:
            self.walk(pick)


def read_segment(node) -> tuple[str, list[dict], list[str]]:
    import unicodedata

    reader = Reader()
    reader.walk(node)
    text = reader.text.rstrip()
    composed = unicodedata.normalize("NFC", text)
    for e in reader.events:
        e["offset"] = min(len(unicodedata.normalize("NFC", text[: e["offset"]])), len(composed))
    return composed, reader.events, reader.findings


def parse(doc_id: str, content: bytes | str, unit: str = "div", leaf_type: str | None = None, allow_empty: bool = False) -> Iterator[tuple]:
    """Rows of SEGMENT: a row for each leaf division, and a row for each finding (severity and code set)."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        yield doc_id, -1, None, None, [], [], "error", f"parse_error: {e}"
        return
    seen: set[str] = set()
    number = 0

    def visit(node, path: list[dict]) -> Iterator[tuple]:
        nonlocal number
        here = path
        if _name(node) == unit:
            head = next((c for c in node if _name(c) == "head"), None)
            here = [*path, {"type": node.get("type"), "n": node.get("n"), "xml_id": node.get(XML_ID), "head": " ".join("".join(head.itertext()).split()) if head is not None else None}]
            leaf = not any(_name(d) == unit and (leaf_type is None or d.get("type") == leaf_type) for d in node.iter() if d is not node)
            if leaf and (leaf_type is None or node.get("type") == leaf_type):
                ident = node.get(XML_ID)
                text, events, findings = read_segment(node)
                yield doc_id, number, ident, text, here, events, None, None
                problems = [("error", "missing_xml_id")] if not ident else [("error", "duplicate_xml_id")] if ident in seen else []
                problems += [("error", "hash_in_xml_id")] if ident and "#" in ident else []
                problems += [("error", "empty_segment")] if not text and not allow_empty else []
                for severity, code in problems + [("warning", f) for f in findings]:
                    yield doc_id, number, ident, None, [], [], severity, code
                seen.add(ident)
                number += 1
                return
        for child in node:
            yield from visit(child, here)

    yield from visit(root, [])
    if not number:
        yield doc_id, -1, None, None, [], [], "error", "zero_segments"


def selection(xpath: str) -> tuple[str, str | None]:
    """(element, type) of a configuration's expression for segments: all elements of a name, of a type if one is given,
    that have no such element inside them. Other expressions raise an error."""
    found = re.fullmatch(r"//(?:\w+:)?(\w+)(\[@type='([^']*)'\])?\[not\((?:descendant::|\.//)(?:\w+:)?(\w+)(\[@type='([^']*)'\])?\)\]", xpath.strip())
    if not found or found[1] != found[4] or found[3] != found[6]:
        raise ValueError(f"no selection of innermost elements: {xpath}")
    return found[1], found[3]


def segments(docs: DataFrame, doc_id: str = "tei_doc_id", content: str = "content", unit: str = "div", leaf_type: str | None = None, allow_empty: bool = False, xpath: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """All segments and findings of documents with markup. One document is one task's unit; order is kept in seq.
    ``xpath``, from a document's configuration, stands for unit and type; a document in which it selects nothing
    has the finding zero_segments. Columns in ``keep`` go through with each of a document's rows."""
    if xpath is not None:
        unit, leaf_type = selection(xpath)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, owner = [], []
            for i, (name, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                found = [dict(zip(names, r, strict=True)) for r in parse(name, data, unit, leaf_type, allow_empty)]
                rows += found
                owner += [i] * len(found)
            if rows:
                columns = pa.RecordBatch.from_pylist(rows, schema=schema).columns
                kept = [c.take(pa.array(owner)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*columns, *kept], names=[*names, *(keep or [])])

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.sparkSession.createDataFrame([], SEGMENT).schema
    names, schema = kind.names, to_arrow_schema(kind)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep or [])
    return docs.select(F.col(doc_id).cast("string"), content, *(keep or [])).mapInArrow(run, SEGMENT + kinds)


def summary_ref(events, edition: str | None = None):
    """(start_pb, start_lb, end_pb, end_lb) of the milestones of an edition: the first page and its first line,
    the last page and the last line after it, or the last line at all."""
    mine = F.filter(events, lambda e: (e["ed"] == edition) if edition else e["ed"].isNull())
    n = lambda kind, xs: F.transform(F.filter(xs, lambda e: e["kind"] == kind), lambda e: e["n"])
    last_pb = F.coalesce(F.array_max(F.transform(mine, lambda e, i: F.when(e["kind"] == "pb", i))), F.lit(-1))
    after = F.filter(mine, lambda e, i: i > last_pb)
    ends = F.when(F.size(n("lb", after)) > 0, n("lb", after)).otherwise(n("lb", mine))
    return F.struct(F.try_element_at(n("pb", mine), F.lit(1)).alias("start_pb"), F.try_element_at(n("lb", mine), F.lit(1)).alias("start_lb"), F.try_element_at(n("pb", mine), F.lit(-1)).alias("end_pb"), F.try_element_at(ends, F.lit(-1)).alias("end_lb"))


def html_text(html):
    """The visible text of a web page, by expressions: scripts, styles, comments and tags go, entities are read."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|head)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))
