"""Mentions and reused passages against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from quire.operators import mentions, reuse


def brute_mentions(texts, aliases):
    out = Counter()
    for key, tokens in texts:
        for lemma, alias in aliases:
            words = alias.split(" ") if alias else []
            for i in range(len(tokens or []) - len(words) + 1):
                if words and tokens[i : i + len(words)] == words:
                    out[key, i, lemma, len(words)] += 1
    return out


@pytest.mark.parametrize("most", [None, 0])
def test_mentions_equal_brute_force(spark, most):
    rng = random.Random(3)
    texts = [(i, rng.choices("a b ab ü ab a".split(), k=rng.randrange(30))) for i in range(60)] + [(60, None), (61, []), (None, ["a", "b"]), (0, ["ab"])]
    aliases = [("L1", "a"), ("L2", "a b"), ("L3", "a b"), ("L1", "a"), ("L4", "ab ü a"), ("L5", ""), ("L6", None), ("L7", "b a b a"), (None, "ü"), ("L8", "aba"), ("L9", " a"), ("L9", "a  b")]
    a = spark.createDataFrame(texts, "id int, tokens array<string>").repartition(3)
    b = spark.createDataFrame(aliases, "lemma_id string, alias_normalized string")
    got = Counter(tuple(r) for r in mentions.mentions(a, b, "id", "tokens", most).select("id", "token_index", "lemma_id", "n_tokens").collect())
    assert got == brute_mentions(texts, aliases) and got
    assert mentions.mentions(a, b.limit(0), "id", "tokens", most).collect() == []
    assert mentions.mentions(a.limit(0), b, "id", "tokens", most).collect() == []


def test_few_aliases_take_no_shuffle(spark):
    a = spark.createDataFrame([(1, ["a"])], "id int, tokens array<string>")
    b = spark.createDataFrame([("L", "a")], "lemma_id string, alias_normalized string")
    plan = mentions.mentions(a, b, "id", "tokens")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_winnowing_keeps_one_of_each_window():
    rng = np.random.default_rng(1)
    for n in range(40):
        h = rng.integers(0, 6, n).astype(np.uint64)
        kept = set(reuse.winnowed(h, 5).tolist())
        want = {max(i for i in range(s, s + 5) if h[i] == min(h[s : s + 5])) for s in range(n - 4)}
        assert kept == want


def brute_runs(items, texts, least):
    out = set()
    for a, x in items:
        x = x or []
        for b, y in texts:
            y = y or []
            if 0 < len(x) < least:
                out |= {(a, b, 0, j, len(x)) for j in range(len(y) - len(x) + 1) if y[j : j + len(x)] == x}
                continue
            for i in range(len(x)):
                for j in range(len(y)):
                    if x[i] == y[j] and (i == 0 or j == 0 or x[i - 1] != y[j - 1]):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= least:
                            out.add((a, b, i, j, n))
    return out


@pytest.mark.parametrize(("gram", "window", "words"), [(4, 5, 30), (2, 3, 3), (3, 1, 4), (1, 4, 2)])
def test_runs_equal_brute_force(spark, gram, window, words):
    rng = random.Random(words)
    word = lambda: f"w{rng.randrange(words)}"
    items = [(i, [word() for _ in range(rng.randrange(1, 40))]) for i in range(25)] + [(90, None), (91, []), (92, ["w1"])]
    texts = []
    for i in range(30):
        tokens = [word() for _ in range(rng.randrange(40))]
        for _ in range(2):  # passages that begin anywhere, some edited
            part = list(rng.choice(items[:25])[1])[rng.randrange(5) :]
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "edited"
            tokens[3:3] = part
        texts.append((i, tokens))
    texts += [(90, None), (91, [])]
    a, b = spark.createDataFrame(items, "item int, x array<string>"), spark.createDataFrame(texts, "doc int, y array<string>")
    got = Counter(tuple(r) for r in reuse.runs(a, b, "item", "doc", "x", "y", gram, window).collect())
    assert set(got.values()) <= {1} and set(got) == brute_runs(items, texts, gram + window - 1) and got


def test_a_long_run_is_few_seeds(spark):
    """A passage of 2,000 tokens in every text joins a few seeds a text, not one for each window."""
    rng = random.Random(8)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [(i, [f"a{i}"] * 3 + passage + [f"b{i}"] * 3) for i in range(20)]
    a = spark.createDataFrame([(0, passage)], "item int, x array<string>")
    b = spark.createDataFrame(texts, "doc int, y array<string>")
    got = reuse.runs(a, b, "item", "doc", "x", "y").collect()
    assert sorted((r.doc, r.item_start, r.text_start, r.n_tokens) for r in got) == [(i, 0, 3, 2000) for i in range(20)]


def test_passages_chain_runs(spark):
    rows = [(1, 1, 0, 10, 8), (1, 1, 10, 19, 9), (1, 1, 40, 28, 8), (1, 2, 0, 0, 8), (1, 1, 0, 200, 8), (1, 1, 30, 208, 8)]
    df = spark.createDataFrame(rows, "item int, doc int, item_start int, text_start int, n_tokens int")
    got = sorted(tuple(r) for r in reuse.passages(df, "item", "doc").collect())
    assert got == [(1, 1, 0, 8, 200, 208, 8, 1), (1, 1, 0, 19, 10, 28, 17, 2), (1, 1, 30, 38, 208, 216, 8, 1), (1, 1, 40, 48, 28, 36, 8, 1), (1, 2, 0, 8, 0, 8, 8, 1)]


def test_mentions(spark):
    texts = spark.createDataFrame([("e", "a red cat and a red hat".split())], "e string, tokens array<string>")
    aliases = spark.createDataFrame([("L1", "red cat"), ("L2", "a"), ("L3", "red fox")], "lemma_id string, alias_normalized string")
    got = mentions.mentions(texts, aliases, "e", "tokens").collect()
    assert sorted((r.e, r.token_index, r.lemma_id, r.n_tokens) for r in got) == [("e", 0, "L2", 1), ("e", 1, "L1", 2), ("e", 4, "L2", 1)]
