"""Re-anchoring and spans against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import anchoring, spans


def edits(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row = row, [i]
        for j, b in enumerate(y, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return row[-1]


def brute_matches(quote: str, body: str, errors: int) -> list:
    least = [min(edits(quote, body[s:e]) for s in range(e + 1)) for e in range(len(body) + 1)]
    ends = [e for e in range(1, len(body) + 1) if least[e] <= errors and least[e] <= least[e - 1] and (e == len(body) or least[e] <= least[e + 1])]
    return [(max(s for s in range(e + 1) if edits(quote, body[s:e]) == least[e]), e, least[e]) for e in ends]


def test_distances_and_matches_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        quote = "".join(rng.choices("abc", k=rng.randrange(1, 12)))
        body = "".join(rng.choices("abcd", k=rng.randrange(25)))
        assert anchoring.edit_distance(quote, body) == edits(quote, body)
        errors = rng.randrange(len(quote))
        assert anchoring.matches(quote, body, errors) == brute_matches(quote, body, errors)


def brute_anchor(body, quote, start, prefix, suffix, rate=0.25, least=0.6):
    if not body or not quote:
        return "needs_review", None, None, None
    if body[start : start + len(quote)] == quote:
        return "stable", start, start + len(quote), 1.0
    prefix, suffix = prefix or "", suffix or ""
    total = len(prefix) + len(quote) + len(suffix)
    scored = []
    for s, e, d in brute_matches(quote, body, math.floor(rate * len(quote))):
        wrong = d + min(edits(prefix, body[max(0, s - len(prefix)) : s]), len(prefix)) + min(edits(suffix, body[e : e + len(suffix)]), len(suffix))
        scored.append((1 - wrong / total, s, e))
    if not scored:
        return "needs_review", None, None, None
    best = max(x[0] for x in scored)
    at = [x for x in scored if x[0] == best]
    return ("reanchored", at[0][1], at[0][2], best) if best >= least and len(at) == 1 else ("needs_review", None, None, best)


ROW = "id int, text string, quote string, prefix_context string, suffix_context string, start_offset int"


def test_reanchored_equals_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(150):
        body = "".join(rng.choices("abc é𝛼 ", k=70))
        a = rng.randrange(10, 50)
        anchor = body[a : a + 10], body[a - 8 : a], body[a + 10 : a + 18], a
        now = list(body)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(now))
            now[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        if rng.random() < 0.4:  # the quote stands elsewhere too
            at = rng.randrange(len(now))
            now[at:at] = anchor[0]
        rows.append((len(rows), "".join(now), *anchor))
    odd = [(None, "quote", "a", "b", 0), ("", "quote", "a", "b", 0), ("some text", None, None, None, None), ("some text", "", "", "", 0), ("x" * 30, "xxx", None, None, 40), ("a quote here", "quote", None, None, 0), ("quote and quote", "quote", None, None, 3)]
    rows += [(len(rows) + i, *r) for i, r in enumerate(odd)]
    df = spark.createDataFrame(rows + rows[:3], ROW)
    column = anchoring.match_anchor(F.col("text"), F.col("quote"), F.col("start_offset"), F.col("prefix_context"), F.col("suffix_context"))
    got = sorted(map(str, (tuple(r) for r in df.select("id", column.alias("x")).select("id", "x.*").collect())))
    want = [(r[0], *brute_anchor(r[1], r[2], r[5] if r[5] is not None else 10**6, r[3], r[4])) for r in rows + rows[:3]]
    assert got == sorted(map(str, want))
    assert {w[1] for w in want} == {"stable", "reanchored", "needs_review"}


def test_context_settles_repeated_and_edited_quotes(spark):
    entries = spark.createDataFrame([(1, "hot and dry root; new words; cold and dry root of the iris"), (2, "take the bark of myrrh with honey"), (3, "gone")], "id int, body string")
    anchors = [(1, "dry root", "cold and ", " of the iris", 3), (1, "dry root", None, None, 0), (2, "the bark of myrhh", "take ", " with honey", 4), (3, "nowhere", "a", "b", 0), (9, "x", "a", "b", 0)]
    df = spark.createDataFrame(anchors, "entry int, quote string, prefix_context string, suffix_context string, start_offset int")
    found = {(r.entry, r.prefix_context): (r.anchor.outcome, r.anchor.start, r.anchor.end) for r in anchoring.reanchored(df, entries, "entry", "id", "body").collect()}
    assert found == {(1, "cold and "): ("reanchored", 38, 46), (1, None): ("needs_review", None, None), (2, "take "): ("reanchored", 5, 22), (3, "a"): ("needs_review", None, None), (9, "a"): ("needs_review", None, None)}


def test_long_texts_are_searched_whole(spark):
    rng = random.Random(4)
    body = " ".join(str(rng.randrange(10**6)) for _ in range(40_000)) + " the very last words of it"
    df = spark.createDataFrame([(1, body, "the very last wurds", "", " of it", 0)], ROW)
    r = df.select(anchoring.match_anchor(F.col("text"), F.col("quote"), F.col("start_offset"), F.col("prefix_context"), F.col("suffix_context")).alias("x")).first().x
    assert (r.outcome, body[r.start : r.end]) == ("reanchored", "the very last words")


@pytest.mark.parametrize("width", [1, 7, 256])
def test_overlapping_equals_brute_force(spark, width):
    rng = random.Random(width)
    span = lambda: (a := rng.randrange(100), a + rng.randrange(40))
    left = [(rng.randrange(3), i, *span()) for i in range(80)] + [(1, 900, None, 5), (None, 901, 0, 50), (0, 902, 5, 4)]
    right = [(rng.randrange(3), i, *span()) for i in range(80)] + [(1, 900, 0, None), (None, 901, 0, 50)]
    a = spark.createDataFrame(left, "k int, l int, a int, b int")
    b = spark.createDataFrame(right, "k int, r int, c int, d int")
    got = sorted((r.k, r.l, r.r) for r in spans.overlapping(a, b, "k", ("a", "b"), ("c", "d"), width).collect())
    whole = lambda r: None not in r and r[2] < r[3]
    assert got == sorted((x[0], x[1], y[1]) for x in left for y in right if whole(x) and whole(y) and x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_overlapping_is_an_equality_join(spark):
    a = spark.createDataFrame([(1, 0, 5)], "k int, a int, b int")
    b = spark.createDataFrame([(1, 3, 9)], "k int, c int, d int")
    plan = spans.overlapping(a, b, "k", ("a", "b"), ("c", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="both sides"):
        spans.overlapping(a, a, "k", ("a", "b"), ("a", "b"))


def test_tokens_decide(spark):
    docs = spark.createDataFrame([(1, "Ἄγνος, τὸ δένδρον καλόν"), (2, "")], "doc int, body string")
    tokens = text.tokens(docs, "doc", "body")
    anchors = spark.createDataFrame([(1, "a", 1, 3, 7, 17), (1, "b", 0, 1, 2, 9), (1, "c", 3, 5, 0, 1), (1, "d", 2, 2, 0, 0), (2, "e", 0, 1, 0, 0)], "doc int, id string, start_token int, end_token int, start_offset int, end_offset int")
    got = {r.id: (r.start_offset, r.end_offset, r.status) for r in spans.by_tokens(anchors, tokens, "doc").collect()}
    assert got == {"a": (7, 17, "agree"), "b": (0, 5, "moved"), "c": (0, 1, "lost"), "d": (0, 0, "lost"), "e": (0, 0, "lost")}
    cover = {r.id: (r.start_token, r.end_token, r.n_inside) for r in spans.covering_tokens(anchors, tokens, "doc", "id").collect()}
    assert cover == {"a": (1, 3, 2), "b": (0, 2, 1), "c": (0, 1, 0), "d": (None, None, 0), "e": (None, None, 0)}


def test_running_totals(spark):
    rows = [(1, [3, 1, 2]), (2, []), (3, None), (4, [5]), (5, list(range(50_000)))]
    df = spark.createDataFrame(rows, "id int, x array<int>").repartition(2)
    got = {r.id: r.y for r in df.select("id", text.running_totals(F.col("x")).alias("y")).collect()}
    total = lambda x: None if x is None else [sum(x[: i + 1]) for i in range(min(len(x), 10))]
    assert {i: y if y is None else y[:10] for i, y in got.items()} == {i: total(x) for i, x in rows}
    assert got[5][-1] == sum(range(50_000))


def test_segments_keep_columns(spark):
    from quire.operators import markup

    body = "<TEI><text><body><div xml:id='a'>one</div><div xml:id='b'>two</div></body></text></TEI>"
    docs = spark.createDataFrame([("d", body, 7), ("e", "<broken", None), ("f", body, 9)], "tei_doc_id string, content string, extra int")
    out = markup.segments(docs, keep=["extra"]).collect()
    assert sorted((r.tei_doc_id, r.extra, r.reading_text) for r in out if r.reading_text) == [("d", 7, "one"), ("d", 7, "two"), ("f", 9, "one"), ("f", 9, "two")]
    assert [(r.tei_doc_id, r.extra, r.severity) for r in out if r.severity == "error" and r.code.startswith("parse")] == [("e", None, "error")]
