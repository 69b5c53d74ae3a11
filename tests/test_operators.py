from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.operators import checks, facets, linking, marginal, markup, tables


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# ---- tables ----


def test_upsert_and_last_wins(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    batch = spark.createDataFrame([(2, "B", 1), (2, "C", 2), (3, "D", 1)], "k int, v string, seq int")
    assert rows(tables.upsert(target, batch, ["k"], [F.col("seq")])) == [(1, "a", "x"), (2, "C", "y"), (3, "D", None)]
    again = tables.upsert(tables.upsert(target, batch, ["k"], [F.col("seq")]), batch, ["k"], [F.col("seq")])
    assert tables.same_rows(again, tables.upsert(target, batch, ["k"], [F.col("seq")]))
    merged, orphans = tables.upsert_two_pass(spark.createDataFrame([("a", "")], "id string, parent string"), spark.createDataFrame([("b", "a"), ("c", "z")], "id string, parent string"), "id", "parent")
    assert merged.count() == 3 and rows(orphans) == [("c", "z")]


def test_deactivate_is_idempotent(spark):
    before = spark.createDataFrame([("d1", "s1", True, "r0"), ("d1", "s2", True, "r0"), ("d2", "s1", True, "r0")], "doc string, seg string, is_active boolean, last_import_run_id string")
    run = spark.createDataFrame([("d1", "s1"), ("d1", "s3")], "doc string, seg string")
    out = tables.deactivate_unseen(before, run, ["doc", "seg"], "doc", "r1")
    assert rows(out) == [("d1", "s1", True, "r1"), ("d1", "s2", False, "r1"), ("d1", "s3", True, "r1"), ("d2", "s1", True, "r0")]
    assert tables.same_rows(tables.deactivate_unseen(out, run, ["doc", "seg"], "doc", "r1"), out)


def test_small_tables(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert rows(tables.batches(df, [F.col("k")], 4).groupBy("batch_id").count()) == [(0, 4), (1, 4), (2, 2)]
    links = tables.exploded_links(spark.createDataFrame([("e", "b, a,,b , c")], "e string, c string"), "e", "c", "id")
    assert rows(links, "position") == [("e", 0, "b", True), ("e", 1, "a", False), ("e", 2, "c", False)]
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 9)], "c int, p int")
    assert tables.closure(edges, "c", "p").count() == 36 and tables.closure(edges.limit(0), "c", "p").count() == 0
    union = tables.union_sheets({"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([(2,)], "y int")})
    assert rows(union, "sheet") == [(1, "a", None), (None, "b", 2)]
    filled = tables.backfill(spark.createDataFrame([("A", None), ("B", "b")], "t string, n string"), "n", F.lower("t"))
    assert rows(filled, "t") == [("A", "a", True), ("B", "b", False)]
    assert rows(tables.next_version(spark.createDataFrame([("a", 3), ("b", None)], "k string, v int"), ["k"], "v")) == [("a", 4), ("b", 1)]
    with pytest.raises(ValueError):
        tables.checked("x", ("a", "b"))


# ---- linking ----


def test_lemma_items(spark):
    cases = {"ἀψίνθιον": ["ἀψίνθιον"], "a; b, c": ["a", "b", "c"], "x καὶ y": ["x καὶ y"], "a, b καὶ c": ["a", "b", "c"], "a καὶ b καὶ c καὶ d": ["a", "b", "c", "d"], " NULL ": [], None: [], "a, b καί c": ["a", "b καί c"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.o for r in df.select("t", linking.lemma_items(F.col("t")).alias("o")).collect()} == cases


def test_clusters(spark):
    df = spark.createDataFrame([("L828", "αστηρ αττικος"), ("L103", "αστηρ αττικος"), ("L986", "αστηρ αττικος"), ("L127", "αστηρ αττικος"), ("L1", "x"), ("L2", ""), ("L3", "")], "lemma_id string, headword_normalized string")
    assert rows(linking.clusters(df)) == [("L103", "αστηρ αττικος", "L103,L127,L828,L986", 4)]
    assert linking.clusters(df.limit(0)).count() == 0


def test_link_lemmata(spark):
    lemmata = spark.createDataFrame([("L10", "ριζα"), ("L2", "ριζα"), ("L3", "οξος")], "lemma_id string, headword_normalized string")
    entries = spark.createDataFrame([("e1", "ὄξος, ῥίζα; ὄξος, ἄλλο"), ("e2", "ἕψησις"), ("e3", None)], "entry_id string, cell string")
    linked, loose = linking.link_lemmata(entries, lemmata, "entry_id", "cell")
    assert rows(linked) == [("e1", "L3,L2"), ("e2", ""), ("e3", "")]
    assert [r.unmatched_term for r in loose.collect()] == ["ἄλλο"]


def test_assign_parts(spark):
    parts = spark.createDataFrame([("P001", "ῥίζα"), ("P005", "ἄνθος"), ("P302", "ἄνθος"), ("P009", "ξύλον")], "part_id string, greek string")
    entries = spark.createDataFrame([("a", "τὰς ῥίζας", "vegetable"), ("b", "ἄνθη", "mineral"), ("c", "ἄνθους", "vegetable"), ("d", "ῥίζα ξύλον", "vegetable"), ("e", "ἄνθη", ""), ("f", None, "")], "k string, t string, category string")
    assert rows(linking.assign_parts(entries, parts, "k", "t", "category")) == [("a", "P001"), ("b", "P302"), ("c", "P005")]


def test_link_preparations(spark):
    preparations = spark.createDataFrame([("PR001", "κεκαυμένος", 0), ("PR002", "ἕψησις", 1), ("PR003", "ὠμός", 2)], "prep_id string, greek string, rule int")
    entries = spark.createDataFrame([("e1", "κεκαυμένῳ ὠμός", "ἕψησις"), ("e2", "ξηρὰ ξηρόν", None), ("e3", None, "ὠμοῦ")], "k string, lemma string, chapter string")
    linked, loose = linking.link_preparations(entries, preparations, "k", ["lemma", "chapter"])
    assert [(r.k, r.prep_id, r.is_primary) for r in linked.orderBy("k", "prep_id").collect()] == [("e1", "PR001", True), ("e1", "PR002", False), ("e1", "PR003", False)]
    assert linked.filter("prep_id = 'PR001'").first().notes == "matched_in=lemma; token=κεκαυμένῳ"
    assert [r.token for r in loose.collect()] == ["ξηρόν"]
    known = linking.preparation_forms(preparations, spark.createDataFrame([("x",)], "token string"))
    review = linking.review_candidates(entries, known, "k", ["lemma", "chapter"])
    assert [(r.greek, r.reason, r.n) for r in review.collect()] == [("ξηρον", "dried family", 1)]


def test_parents_and_merges(spark):
    lemmata = spark.createDataFrame([("L1", "ελαιον"), ("L2", "ελαιον ροδινον"), ("L3", "ελαιον ροδινον νεον"), ("L4", "οξος")], "lemma_id string, headword_normalized string")
    assert rows(linking.parent_lemmata(lemmata)) == [("L2", "L1"), ("L3", "L2")]
    forms = spark.createDataFrame([("a", "L1"), ("a", "L2"), ("b", "L1"), ("b", "L1")], "form_normalized string, lemma_id string")
    assert rows(linking.form_merge(forms)) == [("a", 2, "needs_review"), ("b", 1, "merged")]
    names = spark.createDataFrame([("Ῥίζα",), ("ρίζα",), ("x",)], "name string")
    assert {r.name: r.match for r in linking.match_classes(names, spark.createDataFrame([("Ῥίζα",)], "name string")).collect()} == {"Ῥίζα": "exact", "ρίζα": "variant", "x": "new"}


# ---- facets ----


def test_search_gate_and_pushdown(spark, tmp_path):
    df = facets.with_prefix(spark.createDataFrame([(i, f"s{i % 3}", t) for i, t in enumerate(["Ῥίζα τῆς", "ῥίζαι", "ἄλλο", None])], "id int, source string, t string"), "t")
    assert [r.id for r in facets.search(df, "ριζα", ["source", "id"]).collect()] == [0, 1]
    assert facets.search(df, "ρι", ["id"]).count() == 0 and facets.search(df, " ", ["id"]).count() == 4
    df.write.parquet(str(tmp_path / "t"))
    plan = facets.search(spark.read.parquet(str(tmp_path / "t")), "ριζα", ["source", "id"])._jdf.queryExecution().toString()
    assert "StringStartsWith(prefix" in plan and "TakeOrderedAndProject" in plan


def test_facets(spark):
    entries = spark.createDataFrame([(1, "d~1", True), (2, "d~2", False), (3, "d~3", True)], "id long, display_entry_id string, is_active boolean")
    marks = spark.createDataFrame([(1, "quality", '{"axis":"HOT","degree":"3"}', False), (2, "quality", '{"axis":"HOT","degree":"3"}', False), (3, "quality", '{"axis":"HOT","degree":"3"}', True), (3, "part", '{"part":"ῥίζα"}', False)], "tei_entry_id long, assertion_type string, payload string, is_stale boolean")
    assert [r.id for r in facets.facet(marks, entries, "quality", {"axis": "HOT", "degree": "3"}).collect()] == [1]
    assert sorted(r.id for r in facets.facet(marks, entries, "quality", {"axis": "HOT"}, stale=True).collect()) == [1, 3]
    assert [r.id for r in facets.facet(marks, entries, "part", {"part": "ῥίζα"}).collect()] == [3]
    links = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "tei_entry_id long, lemma_form_id long")
    forms = spark.createDataFrame([(7, "αψινθιου", 5), (8, "οξους", 6)], "id long, form_normalized string, lemma_id long")
    lemmata = spark.createDataFrame([(5, "αψινθιον"), (6, "οξος")], "id long, headword_normalized string")
    assert rows(facets.facet_substance(entries, links, forms, lemmata, "Ἀψίνθ")) == [("d~1", "αψινθιου", "αψινθιον")]


@pytest.mark.parametrize("most", [-1, 8 << 20])
def test_passages(spark, monkeypatch, most):
    monkeypatch.setattr(facets, "BROADCAST_BYTES", most)
    items = spark.createDataFrame([("i", "a b c d".split()), ("short", ["a"]), ("none", None), ("j", "b c".split())], "item string, x array<string>")
    texts = spark.createDataFrame([(1, "z a b q a b c".split()), (2, ["a"]), (3, []), (4, None), (5, "b c".split())], "doc int, y array<string>")
    got = rows(facets.passages(items, "x", texts, "y", 2, "doc").select("item", "doc", F.array_join("run", " ").alias("run")))
    assert got == sorted([("i", 1, "a b q a"), ("i", 1, "a b c"), ("j", 1, "b c"), ("j", 5, "b c")])


def test_policies(spark):
    assert facets.may("translations", "editor", True) and not facets.may("translations", "viewer", True)
    assert facets.may("entries", "viewer") and not facets.may("entries", "editor", True) and facets.may("entries", "service", True)
    assert not facets.may("sources", "service", True) and not facets.may("entries", None) and not facets.may("nothing", "editor")
    with pytest.raises(PermissionError):
        facets.guard_write("lemmata", "viewer")
    assert facets.secured(spark.range(3), "tokens", None).count() == 0


# ---- checks ----


def test_validation(spark):
    columns = "entry_id string, trans_status string, part_id string, lemma_ids string, chapter_title_gr string, greek string, translation string, greek_normalized string"
    good = ("e1", "draft", "P1", "L1,L2", "t", "ἄλφα", "", "αλφα")
    lemmata, parts, preps, links = (spark.createDataFrame([(x,) for x in v], f"{c} string") for c, v in (("lemma_id", ["L1", "L2"]), ("part_id", ["P1"]), ("prep_id", ["PR1"]), ("prep_id", ["PR1"])))
    assert checks.validate(spark.createDataFrame([good], columns), lemmata, parts, preps, links)[1] is None
    for change, name in ((("trans_status", "bad"), "trans_status"), (("part_id", "P9"), "part_fk"), (("lemma_ids", "L1,L9"), "lemma_fk"), (("greek", "ἄλ\nφα"), "embedded_newline"), (("greek_normalized", "x"), "greek_normalized")):
        row = dict(zip([c.split()[0] for c in columns.split(", ")], good, strict=True)) | {"entry_id": "e2", change[0]: change[1]}
        assert checks.validate(spark.createDataFrame([good, tuple(row.values())], columns), lemmata, parts, preps, links)[1] == name
    assert checks.validate(spark.createDataFrame([good, good], columns), lemmata, parts, preps, links)[1] == "duplicate_entry_id"


def test_alignments(spark):
    entries = spark.createDataFrame([("d~1", 1), ("d~2", 2)], "display_entry_id string, id long")
    data = [("d~2", "d~1", "excerpt", 0.5, "s", 1), ("d~1", "d~2", "excerpt", 0.9, "s", 2), ("d~1", "d~1", "excerpt", None, "s", 3), ("d~1", "d~9", "excerpt", None, "s", 4), ("d~1", "d~2", "odd", 1.5, "s", 5), ("d~1", "d~2", "excerpt", None, None, 6)]
    df = spark.createDataFrame(data, "source_a_entry_id string, source_b_entry_id string, alignment_type string, confidence double, source string, line_no int").withColumns({"evidence": F.lit(None).cast("string"), "curator": F.lit(None).cast("string")})
    good, bad, missing = checks.resolve_alignments(df, entries)
    assert [(r.a, r.b, r.confidence) for r in good.collect()] == [(1, 2, 0.9)]
    assert {r.line_no: r.errors for r in bad.collect()} == {3: ["self_pair"], 5: ["unknown_type", "confidence_range"], 6: ["missing_source"]}
    assert rows(missing) == [("d~9",)]


def test_run_diff(spark):
    from quire.sources.readers import RESULT

    def side(terms):
        return spark.createDataFrame([(i, [{"label": x, "confidence": c, "applies_to": None} for x, c in t], []) for i, t in terms.items()], RESULT).select("source_id", checks.term_signatures(F.col("terms")).alias("terms"), checks.quality_signatures(F.col("qualities")).alias("qualities"))

    a, b = side({"e1": [("x", 0.1), ("x", 0.9)], "e2": [("x", 0.5)]}), side({"e1": [("x", 0.7)], "e2": [("y", 0.5), ("z", 0.1)]})
    ids = spark.createDataFrame([("e1",), ("e2",), ("e2",)], "source_id string")
    diff = checks.run_diff(a, b, ids, "source_id", ["terms", "qualities"])
    assert sorted((r.source_id, r.terms_added, r.terms_removed, r.changed) for r in diff.collect()) == [("e1", 0, 0, False), ("e2", 2, 1, True), ("e2", 2, 1, True)]
    assert checks.diff_totals(diff).first().terms_added == 4
    with pytest.raises(Exception, match="no result for"):
        checks.run_diff(a, b, spark.createDataFrame([("e9",)], "source_id string"), "source_id", ["terms"]).collect()


def test_unified_diff_and_fences(spark):
    df = spark.createDataFrame([("k", "a\nb", "a\nc"), ("same", "x", "x")], "k string, l string, r string")
    out = checks.unified_diff(df, "k", "l", "r").collect()
    assert len(out) == 1 and out[0].diff.splitlines()[-2:] == ["-b", "+c"]
    fenced = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"b": 2}',)], "t string").select(checks.fenced_json(F.col("t")).alias("o"))
    assert [r.o for r in fenced.collect()] == ['{"a": 1}', '{"b": 2}']


def test_samples(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = [r.k for r in checks.covering_sample(df, "k", [F.col("k") == 57, F.col("k") > 56, F.lit(False)], 6).collect()]
    assert got == sorted(got) and {57, 58} <= set(got) and len(got) == 6
    assert checks.hash_sample(df, "k", 10, 1).collect() == checks.hash_sample(df.repartition(7), "k", 10, 1).collect()


def test_stale_and_reanchor(spark):
    df = spark.createDataFrame([("abc def", "abc", 0), ("x abc", "abc", 0), ("abc abc", "abc", 1), ("zzz", "abc", 0)], "t string, q string, s int")
    got = [(r.o.outcome, r.o.start) for r in df.select(checks.reanchor(F.col("q"), F.col("s"), F.col("t")).alias("o")).collect()]
    assert got == [("stable", 0), ("reanchored", 2), ("needs_review", None), ("needs_review", None)]


# ---- lines of print, markup ----


def test_cut_lines():
    def read(t):
        return marginal.Cutter().read(t.splitlines())

    assert read("before\n1.1.1\nFirst line\nends here.\n1.1.2\nSecond one.") == [("1.1.1", "First line ends here."), ("1.1.2", "Second one.")]
    assert read("1.1\nκόπ-\nτειν") == [("1.1", "κόπτειν")]
    assert read("1.1\nalpha – beta") == [("1.1", "alpha"), ("1.1", "beta")]
    assert read("Book 1\n1.1\na\n1.t.1\nTitle\n1.2\nb") == [("1.1", "a"), ("1.2", "b")]
    assert read("1.1\nopen text\n1.2\nrest of it. Next begins") == [("1.1", "open text rest of it."), ("1.2", "Next begins")]
    assert read("1.1\nopen text\n1.2\nrest. καὶ more") == [("1.1", "open text rest. καὶ more")]
    assert read("") == []


def test_cut_units(spark):
    t = "1.1:1.1.1\nlead. Alpha words\n1.1:1.1.2\nmore al-\npha – Beta\n1.1:1.2.1\nGamma"
    df = spark.createDataFrame([("d", t), ("e", None), ("f", "no marks")], "doc_id string, text string")
    got = [(r.reference, r.contents) for r in marginal.cut_units(df).orderBy("unit_no", "part_no").collect()]
    assert got == [("1.1:1.1.1", "Alpha words more alpha"), ("1.1:1.1.1", "Beta"), ("1.1:1.2.1", "Gamma")]


TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><div n="6" type="book"><div n="1" xml:id="a" type="chapter">{a}</div><div n="2" xml:id="b" type="chapter">{b}</div></div></body></text></TEI>'


def test_reading_text():
    def read(x):
        return [(r[2], r[3], [(e["kind"], e["n"], e["offset"]) for e in r[5]]) for r in markup.parse("d", TEI.format(a=x, b="<p>z</p>")) if r[6] is None][0][1:]

    assert read("<p>λέγει <choice><orig>ψυχρὸς</orig><reg>ψυχρός</reg></choice>.</p>")[0] == "λέγει ψυχρός."
    assert read("<p>λέγει <gap/> ὅτι</p>")[0] == "λέγει [...] ὅτι" and read("<p>λέγει<gap/>ὅτι</p>")[0] == "λέγει [...] ὅτι"
    assert read('<p><pb n="XI.123"/><lb n="4"/>λέγει ψυχρός</p>') == ("λέγει ψυχρός", [("pb", "XI.123", 0), ("lb", "4", 0)])
    assert read("<p>a<note>gone</note> b <!-- no --><add>x</add>c<app><rdg>r</rdg><lem>l</lem></app></p>")[0] == "a b cl"


def test_segments_and_findings(spark):
    docs = spark.createDataFrame([("d1", TEI.format(a="<p>x<choice><orig>o</orig></choice></p>", b="")), ("d2", "<broken"), ("d3", TEI.format(a="<p>x</p>", b="<p>y</p>").replace('"b"', '"a"'))], "tei_doc_id string, content string")
    out = markup.segments(docs).collect()
    assert sorted((r.tei_doc_id, r.code.split(":")[0]) for r in out if r.code) == [("d1", "empty_segment"), ("d1", "orig_without_reg"), ("d2", "parse_error"), ("d3", "duplicate_xml_id")]
    first = next(r for r in out if r.tei_doc_id == "d1" and r.seq == 0 and r.reading_text is not None)
    assert [(p.type, p.n) for p in first.path] == [("book", "6"), ("chapter", "1")] and first.reading_text == "xo"


def test_summary_ref(spark):
    events = [{"kind": k, "n": n, "ed": None, "offset": 0} for k, n in (("pb", "123"), ("lb", "4"), ("lb", "5"), ("pb", "124"), ("lb", "2"))]
    df = spark.createDataFrame([(events,), ([],)], "e array<struct<kind:string,n:string,ed:string,offset:int>>")
    got = [tuple(r.o) for r in df.select(markup.summary_ref(F.col("e")).alias("o")).collect()]
    assert got == [("123", "4", "124", "2"), (None, None, None, None)]


def test_html_text(spark):
    df = spark.createDataFrame([("<head><title>t</title></head><script>var t='<p>'</script><p>a &amp; b</p><!-- x --><b>c</b>",), (None,)], "h string")
    assert [r.o for r in df.select(markup.html_text(F.col("h")).alias("o")).collect()] == ["a & b c", ""]


def test_overlap(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r.o for r in df.select(facets.jaccard(F.col("x"), F.col("y")).alias("o")).collect()] == [1 / 3, 0.0]


def test_distinct_terms_and_bridge(spark):
    from quire.sources.readers import RESULT

    terms = [{"label": "S", "lemma_normalized": "a", "normalized": "x"}, {"label": "S", "lemma_normalized": "a", "normalized": "y"}, {"label": "S", "normalized": "a"}, {"label": "SUBSTANCE_PART", "substance_lemma_normalized": "s", "part_lemma_normalized": "p"}, {"label": "SUBSTANCE_PART", "substance_lemma_normalized": "s", "part_lemma_normalized": "p", "normalized": "z"}, {"label": "T", "lemma_normalized": "a"}]
    df = spark.createDataFrame([("e", terms, [])], RESULT)
    got = df.select(checks.distinct_terms(F.col("terms")).alias("o")).first().o
    assert [(t.label, t.normalized) for t in got] == [("S", "x"), ("SUBSTANCE_PART", None), ("T", None)]
    vocabulary = spark.createDataFrame([("ριζα", "P1")], "form string, part_id string")
    found, rest = linking.supplement(spark.createDataFrame([(1, " Ῥίζα"), (2, "x")], "k int, t string"), "t", vocabulary, "form", "part_id")
    assert [(r.k, r.part_id) for r in found.collect()] == [(1, "P1")] and [r.k for r in rest.collect()] == [2]


def test_quality_statements(spark):
    from quire.operators import qualities

    cases = {"a": "Θερμὸς καὶ ξηραντικὸς κατὰ τὴν τρίτην που ἀπόστασιν· ψυχρὸς μετρίως.", "b": "ὑγρόν", "c": None, "d": "ξηραίνει σφοδρῶς καὶ μετρίως", "e": "ψυχρὸν κατὰ τὴν τετάρτην"}
    df = spark.createDataFrame(list(cases.items()), "k string, t string")
    got = sorted((r.k, r.axis, r.degree, r.intensity, r.hedge) for r in qualities.extract(df, "k", "t").collect())
    assert got == [("a", "COLD", None, "moderate", None), ("a", "DRY", 3, None, "που"), ("a", "HOT", 3, None, "που"), ("d", "DRY", None, "strong", None), ("e", "COLD", 4, None, None)]


def test_closure_of_any_depth(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 201)], "c int, p int")
    got = tables.closure(chain, "c", "p")
    assert got.count() == 20_100 and got.agg(F.max("depth")).first()[0] == 200
    assert got.distinct().count() == 20_100 and got.filter("node - ancestor <> depth").isEmpty()
    for loop in ([(1, 2), (2, 3), (3, 1)], [(1, 1)]):
        with pytest.raises(ValueError, match="its own ancestor"):
            tables.closure(spark.createDataFrame(loop, "c int, p int"), "c", "p")


def test_skip_counts_and_features(spark):
    df = spark.createDataFrame([(10, None), (9, ""), (2, " "), (30, ""), (4, ""), (1, "x y")], "k int, t string")
    got = {r.reason: (r.n, r.examples) for r in checks.skip_counts(df, checks.skip_reason(F.col("t")), "k").collect()}
    assert got == {"null_contents": (1, "10"), "blank_contents": (4, "2,4,9")}
    assert checks.has_all(df, "k", [1, 2, 2]).first()[0] and not checks.has_all(df, "k", [1, 77]).first()[0]
    from quire.sources.readers import RESULT

    terms = [{"label": "PROCESS", "applies_to": {"kind": "UNSPECIFIED"}}, {"label": "X", "variant_place_lemma_normalized": ""}]
    results = [("a", terms, None), ("b", [{"label": "PROCESS", "applies_to": {"kind": "TERM"}}, {"label": "SUBSTANCE_PART"}], [{"axis": "HOT"}]), ("c", None, [])]
    found = spark.createDataFrame(results, RESULT)
    features = checks.result_features(F.col("terms"), F.col("qualities"))
    assert list(features) == ["has_quality", "has_substance_part", "has_place", "has_linked_action"]
    assert rows(found.select("source_id", *(c.alias(n) for n, c in features.items()))) == [("a", False, False, False, False), ("b", True, True, False, True), ("c", False, False, False, False)]


def test_segments_by_configured_expression(spark):
    xpath = "//tei:div[@type='chapter'][not(descendant::tei:div[@type='chapter'])]"
    assert markup.selection(xpath) == ("div", "chapter") and markup.selection("//tei:div[not(descendant::tei:div)]") == ("div", None)
    for bad in ("//tei:div", "/TEI/text", "//tei:div[@type='a'][not(descendant::tei:div[@type='b'])]"):
        with pytest.raises(ValueError):
            markup.selection(bad)
    nested = TEI.format(a='<div type="section"><p>x</p></div>', b="<p>y</p>")
    docs = spark.createDataFrame([("d", nested), ("e", nested.replace('"chapter"', '"part"'))], "tei_doc_id string, content string")
    out = markup.segments(docs, xpath=xpath).collect()
    assert sorted((r.tei_doc_id, r.reading_text) for r in out if r.reading_text) == [("d", "x"), ("d", "y")]
    assert [(r.tei_doc_id, r.code) for r in out if r.code] == [("e", "zero_segments")]


def test_constants_families_and_headings(spark):
    editions = spark.createDataFrame([("KUHN", 4), ("CMG", 5)], "code string, edition_id int")
    df = spark.createDataFrame([(1,)], "k int")
    assert rows(linking.constant_lookup(df, editions, F.col("code") == "KUHN", "edition_id", "e")) == [(1, 4)]
    with pytest.raises(ValueError):
        linking.constant_lookup(df, editions, F.col("code") == "X", "edition_id", "e")
    lemmata = spark.createDataFrame([("L001", "ελαιον"), ("L002", "ελαιον ροδινον"), ("L003", "ροδον"), ("L004", "ροδον αγριον"), ("L005", "αγριον ελαιον")], "lemma_id string, headword_normalized string")
    assert rows(linking.assigned_parents(lemmata), "lemma_id") == [("L002", "L001", "family"), ("L004", "L003", "prefix"), ("L005", "L001", "family")]
    vocabulary = spark.createDataFrame([("ριζα", "part", "root"), ("φυλλον", "part", "leaf"), ("αγριος", "variety", "wild"), ("ξηρος", "state", "dry")], "form string, domain string, english string")
    heads = spark.createDataFrame([("e", "ξηρὸς ἄγριος ῥίζα, φύλλον")], "k string, t string")
    assert rows(linking.heading_terms(heads, "k", "t", vocabulary)) == [("e", "leaf,root,wild,dry")]


def test_small_functions(spark):
    from quire.functions import cells, citations
    from quire.sources import readers

    df = spark.createDataFrame([("6.1.1.12",), ("6.x",)], "r string")
    first, number = citations.entry_key(F.col("r"))
    assert [tuple(r) for r in df.select(first, number).collect()] == [("6.1.1", 12), ("6", None)]
    run = checks.import_run({"n": F.count("*")}, df, "run1", "full").first()
    assert run.id == "run1" and run.counts == '{"n":2}' and run.mode == "full"
    assert df.select(cells.category(F.lit(" Plant "))).first()[0] == "vegetable"
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, s string").createOrReplaceTempView("scanned")
    assert rows(readers.scan(spark, "scanned", ["k"], {"s": "a"})) == [(1,), (3,)] and readers.scan(spark, "scanned", limit=2).count() == 2


def test_streaming_sink_does_not_lose_rows(spark, tmp_path):
    from quire.streaming import events

    merge = events.upserting(str(tmp_path / "t"), ["k"], "v")
    batch = lambda *r: spark.createDataFrame(list(r), "k int, v int")
    merge(batch((1, 1), (1, 3), (2, 1)), 0)
    merge(batch((1, 2), (3, 1)), 1)
    assert rows(spark.read.parquet(str(tmp_path / "t/v=000000000001"))) == [(1, 3), (2, 1), (3, 1)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        merge(batch((9, 9)), 7)
