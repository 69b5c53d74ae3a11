from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import cells, citations, text

CASES = [
    ("Ψυχρός", "ψυχρος"),
    ("τῇ", "τη"),
    ("ἄνθρωπος", "ανθρωπος"),
    ("Aëtius", "aetius"),
    (None, ""),
    ("", ""),
    ("hello", "hello"),
    ("ἁ", "α"),
    ("ὰ", "α"),
    ("ἅ", "α"),
    ("ῶ", "ω"),
    ("ς", "ς"),
    ("abc αβγ", "abc αβγ"),
    ("ά", "α"),
]


def oracle(t, version="1.1"):
    gone = (lambda c: 0x300 <= ord(c) <= 0x36F) if version == "1.1" else (lambda c: unicodedata.combining(c) and c != "ͅ")
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", (t or "").lower()) if not gone(c)))


def run(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, t {kind}")
    return [r.o for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def test_normalize_cases(spark):
    assert run(spark, [a for a, _ in CASES], text.normalize) == [b for _, b in CASES]


def test_normalize_versions(spark):
    words = ["τῇ", "δευτέρᾳ", "ᾠδή", "Ἀθῆναι", "é", "Å", "ǖ"]
    for version in ("1.0", "1.1"):
        assert run(spark, words, lambda c, v=version: text.normalize(c, v)) == [oracle(w, version) for w in words]
    with pytest.raises(ValueError):
        text.accent_map("2")


def test_normalize_matches_unicode_over_whole_blocks(spark):
    chars = [chr(c) for a, b in ((0x20, 0x180), (0x370, 0x400), (0x1E00, 0x2000)) for c in range(a, b) if c not in (0x130, 0x3A3) and unicodedata.category(chr(c)) != "Cn"]
    assert run(spark, chars, text.normalize) == [oracle(c) for c in chars]


def test_normalize_is_idempotent_and_composed(spark):
    rng = random.Random(1)
    pool = "ἄνθρωποςῥίζαΨΥΧΡΌéñüßabc τῇ"
    words = ["".join(rng.choice(pool) for _ in range(12)) for _ in range(60)]
    once = run(spark, words, text.normalize)
    assert run(spark, once, text.normalize) == once == [unicodedata.normalize("NFC", w) for w in once]


def tokens_of(t):
    out, i = [], 0
    while i < len(t):
        if unicodedata.category(t[i])[0] in "LN":
            j = i
            while j < len(t) and (unicodedata.category(t[j])[0] in "LN" or unicodedata.category(t[j]) == "Mn"):
                j += 1
            out.append((len(out), i, j, t[i:j]))
            i = j
        else:
            i += 1
    return out


TOKEN_CASES = ["λόγος", "λόγος καλός", "λόγος, καλός.", "", "   ,.;  ", "abc αβγ", "word1 123 αβγ", "[...]", "λόγος [...] καλός", "[...] α [...] β [...]", "ά́x", "́lead", "𝔸b c", "a\nb"]


def test_tokens(spark):
    df = spark.createDataFrame(list(enumerate(TOKEN_CASES)) + [(99, None)], "k int, t string")
    got = {}
    for r in text.tokens(df, "k", "t").collect():
        got.setdefault(r.k, []).append((r.token_index, r.start_offset, r.end_offset, r.token_text))
        assert r.token_normalized == oracle(r.token_text)
    assert {k: sorted(v) for k, v in got.items()} == {k: tokens_of(t) for k, t in enumerate(TOKEN_CASES) if tokens_of(t)}
    assert [s for _, s, _, _ in sorted(got[8])] == [0, 12]


def test_tokens_of_long_texts_and_repeated_keys(spark):
    long = ", ".join("ab" * (i % 7) + "c" for i in range(5000))
    df = spark.createDataFrame([(1, long), (1, "x y"), (1, "x y"), (None, "z")], "k int, t string")
    got = sorted((r.token_index, r.start_offset, r.end_offset, r.token_text) for r in text.tokens(df, "k", "t").collect())
    assert got == sorted([*tokens_of(long), *tokens_of("x y"), *tokens_of("x y"), *tokens_of("z")])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aé1 .,ῥ́\n", max_size=20), min_size=1, max_size=5))
def test_tokens_property(spark, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = sorted((r.k, r.token_index, r.start_offset, r.end_offset, r.token_text) for r in text.tokens(df, "k", "t").collect())
    assert got == sorted((k, *x) for k, t in enumerate(cases) for x in tokens_of(t))


def test_small_text_functions(spark):
    assert run(spark, ["a  b\n c", "", None], text.word_count) == [3, 0, 0]
    assert run(spark, [" a \r\n\r\n b", None], text.single_line) == ["a\\nb", ""]
    assert run(spark, ["a\\nb"], text.multi_line) == ["a\nb"]
    assert run(spark, ["x" * 181, "x" * 180], lambda c: text.clip(c, 180)) == ["x" * 177 + "...", "x" * 180]
    assert run(spark, [" a\t\n b "], text.squash) == ["a b"]
    assert run(spark, ["ab-\n cd 1-\n2"], text.dehyphenate) == ["abcd 1-\n2"]
    assert run(spark, ["ῥίζα, root φύλλον"], text.greek_tokens) == [["ῥίζα", "φύλλον"]]
    assert text.search_key("  Τῇ   ῥίζῃ ") == "τη ριζη" and text.search_key("τῇ ῥίζῃ", compat=True) == "τηριζη" and text.search_key(None) == ""
    assert len(text.search_key("a" * 600)) == 512


def test_hashes(spark):
    import hashlib

    assert run(spark, ["Ψυχρός"], text.normalized_hash) == [hashlib.sha256("ψυχρος".encode()).hexdigest()]
    assert run(spark, ["Ψυχρός"], text.raw_hash) == [hashlib.sha256("Ψυχρός".encode()).hexdigest()]


def test_cells(spark):
    assert run(spark, [" 12.9 ", "x", None, "", "1e99"], cells.to_int) == [12, None, None, None, None]
    assert run(spark, [12.0, 1.5, None, float("nan")], cells.to_intish, "double") == ["12", "1.5", "", ""]
    assert run(spark, ["L012", "l7", "X9", "", "L"], cells.id_order) == [12, 7, 10**9, 10**9, 10**9]
    assert run(spark, ["Plant", " mineral", "?", None], cells.category) == ["vegetable", "mineral", "", ""]
    assert run(spark, ["NULL", " (null) ", "nan", "x", None], cells.is_nullish) == [True, True, True, False, True]
    assert run(spark, ["Περὶ ἀψινθίου", "Προοίμιον", "περι ", "x"], cells.chapter_title_en) == ["On ἀψινθίου", "Prooimion", "", ""]


def test_build_ref(spark):
    rows = [("1", "2", "3", "", "", "", 1), ("1", "pr", "", "", "", "", 2), ("", "PR", None, None, None, None, 3), ("6", "0", "", "", "Προοίμιον", "", 4), (None, None, None, None, None, None, 5), ("1", "", "0", "", "x", "προοίμιον ", 6)]
    df = spark.createDataFrame(rows, "b string, c string, s string, ss string, cg string, sg string, r int")
    got = [x.o for x in df.select("r", cells.build_ref(False, F.col("b"), F.col("c"), F.col("s"), F.col("ss"), F.col("cg"), F.col("sg"), F.col("r")).alias("o")).orderBy("r").collect()]
    assert got == ["1.2.3", "1.prooimion", "prooimion", "6.prooimion", "row5", "1.prooimion"]
    legacy = df.select("r", cells.build_ref(True, F.col("b"), F.col("c"), F.col("s"), F.col("ss"), F.col("cg"), F.col("sg"), F.col("r")).alias("o")).orderBy("r")
    assert [x.o for x in legacy.collect()][:2] == ["1.2.3", "1.pr"]


def test_dedupe_and_dialects(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, row int")
    assert sorted(r.entry_id for r in cells.dedupe_ids(df, "id", ["row"]).collect()) == ["a~1", "a~2", "b"]
    old = spark.createDataFrame([("x", None)], "Contents string, entry_gr string")
    assert cells.dialects(old, {"greek": ["entry_gr", "Contents"], "en": ["entry_en"]}).first().asDict() == {"greek": "x", "en": None}
    with pytest.raises(Exception, match="not allowed"):
        df.select(cells.display_entry_id(F.lit("a#"), F.lit("b"))).collect()


def test_split_reference(spark):
    want = {"1.2:3.4.5": "1 2 3 4 5", "1.2:3.4": "1 2 3 - 4", "1.2:3": "1 2 3 - -", "1.2.3.4.5": "1 2 3 4 5", "1.2.3.4": "1 2 3 - 4", "1.2.3": "1 2 3 - -", "1.2": "1 2 - - -", "1": "1 - - - -", "1.2.3.4.5.6": "1 2 3 4.5 6", "1.2:3.4.5.6": "1 2 3 4.5 6"}
    df = spark.createDataFrame([(k,) for k in want], "r string")
    for row in df.select("r", *(c.alias(n) for n, c in citations.split_reference(F.col("r")).items())).collect():
        assert " ".join(x or "-" for x in row[1:]) == want[row.r]


def test_citations(spark):
    df = spark.range(1)
    path = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(None).cast("string").alias("head")) for n in ("6", "1", "1")])
    null = F.lit(None).cast("string")

    def edition(*p):
        return df.select(citations.edition_ref(*[null if x is None else F.lit(x) for x in p]).alias("o")).first().o

    assert df.select(citations.structure_ref(path).alias("o")).first().o == "6.1.1"
    assert edition("Kühn", "XI.123", "4", "XI.124", "2") == "Kühn XI.123.4–XI.124.2"
    assert edition("Wellmann", "1", "7", "1", "8") == "Wellmann 1.7–1.8"
    assert edition("Kühn", "XI.123", "4", None, None) == "Kühn XI.123.4" and edition("Kühn", None, None, None, None) == "Kühn"
    assert edition(None, "1", None, None, None) is None
    assert df.select(citations.combined_ref(F.lit("6.1.1"), F.lit("K")).alias("o")).first().o == "6.1.1 (K)"
    assert df.select(citations.combined_ref(F.lit("6.1.1"), null).alias("o")).first().o == "6.1.1"


def test_markers(spark):
    assert run(spark, ["1.2:3.4.5", "1.t.3", "12", "a1.2", " 1.2 ", "1.2."], citations.is_marker) == [True, True, False, False, True, False]
    assert run(spark, ["1.t.3", "1.2"], citations.is_title_marker) == [True, False]
