"""Near-duplicates, collocations and vector codes against brute force, on small tables with nulls, empty and long
texts, ties, repeated rows, no rows, and columns whose names clash."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import collocations, minhash, vectorcodes
from quire.llm.common import written

DOCS = "doc_id long, text string, lang string"
CLASHING = ["key", "sig", "n", "label", "node", "a", "b", "bucket", "hashes", "rank", "phrase", "f", "h", "word", "codes", "error", "vector", "x", "component_id"]


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


# ---- 11 ----


def brute_components(rows: list, percent: int = 80, gram: int = 2) -> dict:
    sets = []
    for _, t in rows:
        ws = [w for w in re.split("[ \t-\r]+", lower(t or "")) if w]
        sets.append({tuple(ws)} if 0 < len(ws) < gram else {tuple(ws[i : i + gram]) for i in range(len(ws) - gram + 1)})
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[root(i)], rows[i][0] == least[root(i)]) for i in range(len(rows)))


def near_texts(seed: int) -> list:
    """Chains and groups of edited copies with similarities on both sides of the threshold, and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("Ab cd eF über x".split()) + str(rng.randrange(300))
    out = []
    for _ in range(6):
        text = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(2, 12)):  # a chain: each an edit of the one before
            out.append(" ".join(text))
            for _ in range(rng.randrange(1, max(2, len(text) // 14))):
                text[rng.randrange(len(text))] = word()
        base = [word() for _ in range(60)]
        for _ in range(12):  # a group around one text
            out.append("\t ".join(w if rng.random() < 0.95 else word() for w in base).upper())
    return out + [None, None, "", " \n\x0b", "one", "One", "one two", "ONE  two", "loop " * 50, "loop loop", " ".join(word() for _ in range(30_000)), out[0], out[0]]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = list(enumerate(near_texts(seed)))
    random.Random(seed).shuffle(rows)
    rows += [rows[5], rows[5], (None, rows[7][1]), (None, "alone without an id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    got = Counter((r.doc_id, r.n_shingles, r.component_id, bool(r.kept)) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_components(rows)
    assert len({r[2] for r in got}) < len(rows) - 40  # the groups are found


def test_near_duplicates_of_no_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
    assert minhash.near_duplicates(spark.createDataFrame([(1, None, "en")], DOCS)).collect() == [(1, 0, 1, True)]


def test_what_stars_leave_is_compared_in_full(spark, monkeypatch):
    """Without star rounds that connect anything, the rest alone finds every link, in chunks and pieces."""
    monkeypatch.setattr(minhash, "FEW", 3)
    monkeypatch.setattr(minhash, "MANY", 5)
    none = lambda members: members.select(F.col("sig").alias("a"), F.col("sig").alias("b")).limit(0)
    monkeypatch.setattr(minhash, "star_candidates", none)
    rows = list(enumerate(near_texts(3)))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, bool(r.kept)) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows)


def test_a_group_of_near_copies_costs_its_members(spark):
    """Of 400 near copies, star rounds compare some pairs a class, not 80,000 pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(10**6)}" for w in base)) for i in range(400)]
    docs = minhash.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    signed = minhash.signatures(docs, *minhash.banding(), 2)
    alike = written(signed.select("sig", "key", F.col("doc_id").alias("least"), "n", "marks", "buckets"), "alike")
    members = written(minhash.shared_buckets(alike), "members")
    assert minhash.star_candidates(members).count() < 20 * 400
    labels = minhash.link_classes(docs, alike, 80, 2, 200)
    brute = Counter()
    for (_, _, component, _), n in brute_components(rows).items():
        brute[component] += n
    assert labels.groupBy("label").count().agg(F.max("count")).first()[0] == max(brute.values()) > 300


@pytest.mark.parametrize("seed", range(3))
def test_stars_find_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(50)]
    got = {r.node: r.label for r in minhash.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_banding_and_agreement():
    bands, per = minhash.banding()
    assert bands * per <= 200 and (1 - 0.8**per) ** bands < 1e-6
    t = minhash.least_agreement() / 200
    assert 0.6 < t < 0.65
    assert sum(math.comb(200, k) * 0.8**k * 0.2 ** (200 - k) for k in range(minhash.least_agreement())) < 1e-8


# ---- 12 ----


def brute_phrases(rows: list, longest: int, least: int, cover: int, top: int | None) -> list:
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for size in range(1, longest + 1):
                for i in range(len(ws) - size + 1):
                    f[lang, tuple(ws[i : i + size])] += 1
    candidates = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(g == lang and len(q) > len(p) and inside(q) and 100 * v >= cover * a for (g, q), v in candidates.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def phrase_texts(seed: int) -> list:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["Über", "naïve", "x", "|", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(150):
        words = rng.choices(vocabulary, weights, k=rng.randrange(1, 60))
        if i % 3 == 0:
            words[2:2] = ["New", "york", "city"]
        rows.append(("".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words), ["en", "fr", None, "und"][i % 4]))
    return rows + [(None, "en"), ("", "fr"), (" \t", None), ("...", "en"), ("same same same same same same same same same same same same", "en"), rows[0], rows[0], (" ".join(rng.choices(vocabulary, weights, k=20_000)), "fr")]


@pytest.mark.parametrize(("longest", "least", "top"), [(3, 10, 2000), (3, 10, 15), (4, 7, None), (2, 10, 2000)])
def test_phrases_equal_brute_force(spark, monkeypatch, longest, least, top):
    monkeypatch.setattr(collocations, "RUN_BYTES", 3000)  # many runs, so counts of prefixes meet from several
    monkeypatch.setattr(collocations, "FOLD_ROWS", 50)
    rows = phrase_texts(longest)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4).select("*", *[F.lit("x").alias(c) for c in CLASHING])
    got = sorted(tuple(r) for r in collocations.mine(docs, longest, least, 50, top).collect())
    want = brute_phrases(rows, longest, least, 50, top)
    assert got == want and want


def test_phrases_of_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None), (2, " ", "en")], DOCS)).collect() == []


def test_words_that_share_a_hash_start_again(spark, monkeypatch):
    real, seeds = collocations.span_hashes, []

    def colliding(data, starts, stops, seed=0):
        out = real(data, starts, stops, seed)
        return out & np.uint64(3) if seed == 0 else out

    monkeypatch.setattr(collocations, "span_hashes", colliding)
    counts = collocations.word_counts

    def noted(rows, seed):
        seeds.append(seed)
        hashed = counts(rows, seed)
        return hashed.withColumn("h", F.col("h") % 3) if seed == 0 else hashed

    monkeypatch.setattr(collocations, "word_counts", noted)
    rows = phrase_texts(9)
    got = sorted(tuple(r) for r in collocations.mine(spark.createDataFrame(rows, "text string, lang string")).collect())
    assert seeds == [0, 1] and got == brute_phrases(rows, 3, 10, 50, 2000)


def test_growth_is_depth_first():
    rows = np.array([[1, 2], [1, 3], [2, 0], [2, 2]], np.uint64)
    assert list(collocations.grown(rows, np.array([3, 4, 6, 2]), 3)) == [((1,), 7), ((1, 2), 3), ((1, 3), 4), ((2,), 8)]


# ---- 13 ----


def brute_codes(rows: list, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[list, list]:
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            held = defaultdict(list)
            for c, code in zip(cut, codes, strict=True):
                held[code[p]].append(c[p])
            for e, xs in held.items():
                books[p][e] = [sum(x) // len(x) for x in zip(*xs, strict=True)]
    codes = assign()
    out = [(i, label, code, sum(far(c[p], books[p][code[p]]) for p in range(parts))) for (i, label, _), c, code in zip(kept, cut, codes, strict=True)]
    return out, books


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(seed: int, n: int) -> list:
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.25]) for _ in range(8)], rng.choice([1, 2, None])) for i in rng.sample(range(10 * n), n)]
    odd = [(5, None, 1), (6, [], 1), (7, [0.1] * 7 + [None], 1), (8, [0.1] * 7 + [math.nan], 2), (9, [0.1] * 7 + [math.inf], 2)]
    return rows + odd + [rows[0], rows[0], (None, rows[1][1], None), (rows[2][0], rows[3][1], 1)]


@pytest.mark.parametrize(("n", "entries"), [(60, 8), (20, 256), (700, 16)])
def test_codes_equal_brute_force(spark, monkeypatch, n, entries):
    monkeypatch.setattr(vectorcodes, "SLICE", 37)
    rows = vectors(n, n)
    df = spark.createDataFrame(rows, VECTORS).repartition(5).select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in ("label",)])
    coded, books = vectorcodes.compress(df, entries=entries)
    want, wanted_books = brute_codes(rows, entries=entries)
    assert books.tolist() == wanted_books
    got = vectorcodes.label_errors(coded).collect()
    assert Counter((r.vec_id, r.label, tuple(r.codes), r.error) for r in got) == Counter((i, label, tuple(c), e) for i, label, c, e in want)
    by_label = Counter()
    for _, label, _, e in want:
        by_label[label] += e
    assert all(r.label_error == by_label[r.label] for r in got)
    back = vectorcodes.decoded(coded, books).first()
    assert back.decoded == [x / 1024 for p, c in enumerate(back.codes) for x in wanted_books[p][c]]


def test_codes_of_large_components_and_of_none(spark):
    rows = [(i, [float((i * 7919 + k) % 1000 * 100) for k in range(4)], None) for i in range(30)]
    coded, books = vectorcodes.compress(spark.createDataFrame(rows, VECTORS), entries=4)
    want, wanted_books = brute_codes(rows, entries=4)
    assert books.tolist() == wanted_books and sorted(r.error for r in coded.collect()) == sorted(w[3] for w in want)
    for none in ([], [(1, None, 1), (2, [math.nan] * 4, 1)]):
        coded, books = vectorcodes.compress(spark.createDataFrame(none, VECTORS))
        assert vectorcodes.label_errors(coded).collect() == [] and books.size == 0


@pytest.mark.parametrize("rows", [[(1, [1.0] * 6, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], [(1, [1e300] * 4, 1)]])
def test_vectors_that_cannot_be_coded_raise(spark, rows):
    with pytest.raises(Exception, match="components"):
        vectorcodes.compress(spark.createDataFrame(rows, VECTORS))[0].collect()
