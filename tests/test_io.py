from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.operators import facets
from quire.plans import library
from quire.sources import readers, sinks
from quire.streaming import events


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'q"uote, and\nline'), ("b", None)], "k string, v string")
    sinks.csv(df, str(tmp_path / "c"), ["k"], single=True)
    back = readers.csv(spark, str(tmp_path / "c"), ["k", "v"])
    assert sorted(tuple(r) for r in back.collect()) == [("a", 'q"uote, and\nline'), ("b", "")]
    with pytest.raises(ValueError, match="lacks z"):
        readers.csv(spark, str(tmp_path / "c"), ["z"])


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source_a_entry_id": "x~1", "source_b_entry_id": "x~2"}\n\nnot json\n', encoding="utf-8")
    got = [(r.line_no, r.source_a_entry_id, r.error) for r in readers.json_lines(spark, str(tmp_path / "a.jsonl")).orderBy("line_no").collect()]
    assert got == [(1, "x~1", None), (3, None, "invalid_json")]


def test_results_and_ids(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/GAL_1.json").write_text(json.dumps({"source_id": "GAL_1", "terms": [{"label": "x"}], "qualities": []}, indent=1))
    (tmp_path / "r/GAL_2.json").write_text(json.dumps({"terms": []}))
    docs = readers.results(spark, str(tmp_path / "r"), "GAL")
    assert [r.source_id for r in docs.collect()] == ["GAL_1", "GAL_2"]
    (tmp_path / "ids").write_text("# comment\nGAL_2\n\nGAL_1\n")
    ids = readers.id_list(spark, str(tmp_path / "ids"))
    assert [r.id for r in ids.orderBy("seq").collect()] == ["GAL_2", "GAL_1"]
    assert readers.fetched(ids.select(F.col("id").alias("source_id")), docs, "source_id").count() == 2
    with pytest.raises(Exception, match="missing document"):
        readers.fetched(spark.createDataFrame([("z",)], "source_id string"), docs, "source_id").collect()


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "simples.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="SMT" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Lemma</t></si><si><r><t>ῥί</t></r><r><t>ζα</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>N</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>12</v></c></row><row r="3"><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    sheet = readers.workbook(spark, str(readers.find_workbook(str(tmp_path))), ["SMT"])["SMT"]
    assert [tuple(r) for r in sheet.orderBy("row").collect()] == [(1, "ῥίζα", "12"), (2, None, "5")]
    with pytest.raises(ValueError, match="lacks sheets"):
        readers.workbook(spark, str(path), ["Other"])


def test_vocabulary_and_config(spark, tmp_path):
    (tmp_path / "v.md").write_text("# x\n#### 1. Botanical Parts\n| English | Greek |\n| :--- | :--- |\n| **Seed** | σπέρμα (sperma), κόκκος (kokkos) |\n#### 2. States\n| **Dry** | ξηρός (xeros) |\n", encoding="utf-8")
    got = [tuple(r) for r in readers.vocabulary(spark, str(tmp_path / "v.md")).orderBy("form").collect()]
    assert got == [("Botanical Parts", "Seed", "κόκκος", "kokkos", "κοκκος"), ("States", "Dry", "ξηρός", "xeros", "ξηρος"), ("Botanical Parts", "Seed", "σπέρμα", "sperma", "σπερμα")]
    text = "# c\ntei_doc_id: gal_smt\nsource_code: GAL\nsegment_xpath: \".//tei:div\"\nedition:\n  label: Kühn # x\n"
    assert readers.checked_config(text)["edition.label"] == "Kühn"
    with pytest.raises(ValueError):
        readers.checked_config("tei_doc_id: a#b\nsource_code: x\nsegment_xpath: y")


def test_bundle_is_deterministic(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i}", None) for i in range(50)], "id int, seg string, note string")
    out = []
    for name, parts in (("a", 1), ("b", 7)):
        sinks.bundle({"entries": (df.repartition(parts), ["id"])}, str(tmp_path / name), {"version": "1"})
        out.append("".join(p.read_text() for p in sorted((tmp_path / name / "entries").glob("part-*"))))
    assert out[0] == out[1] and json.loads(out[0].splitlines()[3]) == {"id": 3, "seg": "s3", "note": None}
    assert "count.entries" in "".join(p.read_text() for p in (tmp_path / "a/meta").glob("part-*"))


def test_stored_prefix_and_report(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 2}", t) for i, t in enumerate(["Ῥίζα", "ἄνθος"])], "id int, source string, t string")
    sinks.stored_prefix(df, str(tmp_path / "p"), "t", "source")
    assert [r.id for r in facets.search(spark.read.parquet(str(tmp_path / "p")), "ριζ", ["id"]).collect()] == [0]
    assert "| s0 | 1 |" in sinks.report("QC", {"by source": df.groupBy("source").count().orderBy("source")})


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:00:00", i % 3, "click", 1.0) for i in range(30)], "event_id long, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"), df, 1)
    q = events.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 30
    path = str(tmp_path / "out")
    q = stream.writeStream.foreachBatch(events.upserting(path, ["user_id"], "event_id")).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(f"{path}/v={2:012d}")
    assert sorted((r.user_id, r.event_id) for r in last.collect()) == [(0, 27), (1, 28), (2, 29)]


def test_queries_match_sql(spark):
    """Every query with SQL, on the smallest driver tables."""
    import duckdb

    d = __spark_entry__.SMOKE_DIR
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    found = library.queries()
    for name, sql in library.oracle_sql().items():
        df, want = found[name](spark, d), con.sql(sql)
        assert sorted(df.columns) == sorted(want.columns), name
        got = sorted(tuple(map(str, r)) for r in df.select(*want.columns).collect())
        assert got == sorted(tuple(map(str, r)) for r in want.fetchall()), name


def test_entry(spark):
    assert set(library.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "source", "prefix"]
