"""License scan by a positional index of rare words.

Of each template's words the rarest, by document frequency over all documents, are indexed as word ->
postings (template, position). Each text's licence words are looked up, rarest first; their places minus
the posted positions say where the template would start, and starts that agree, give or take a few words
that were put in or left out, make an alignment. It is verified on the text: all mandatory key phrases must
stand in the aligned stretch, and the share of template words in place is the score. Work follows the
postings of a text's words, not the number of templates.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, texts

#: Phrases whose every place is counted, with the label of each.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The notices that public licences ask files to carry, or the licence itself where it is short, as words;
# label, text, mandatory key phrases.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "sublicense and or sell"]),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ["eclipse public license 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["unencumbered software released into the public domain"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("boost-1.0", "distributed under the boost software license version 1 0", ["boost software license version 1 0"]),
]
# Label, thing licensed, name, version of licences whose notices are alike but for these.
FOUNDATION = [
    ("gpl-2.0", "program", "gnu general public license", "2"),
    ("gpl-3.0", "program", "gnu general public license", "3"),
    ("lgpl-2.1", "library", "gnu lesser general public license", "2 1"),
    ("lgpl-3.0", "library", "gnu lesser general public license", "3"),
    ("agpl-3.0", "program", "gnu affero general public license", "3"),
]
# Licences under the names by which a sentence may name them.
NAMES = [
    ("mit", "mit license"),
    ("bsd-2-clause", "bsd 2 clause license"),
    ("bsd-3-clause", "bsd 3 clause license"),
    ("apache-2.0", "apache license version 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("epl-2.0", "eclipse public license version 2 0"),
    ("cc0-1.0", "cc0 1 0"),
]
CC_KINDS, CC_VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("3 0", "4 0")


def foundation_notice(thing: str, name: str, version: str) -> str:
    return f"this {thing} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation either version {version} of the license or at your option any later version"


def all_templates() -> list[tuple[str, str, list[str]]]:
    """(label, words, mandatory key phrases): notices, and for each licence the sentence that names it."""
    out = list(NOTICES)
    names = list(NAMES)
    for label, thing, name, version in FOUNDATION:
        out.append((label, foundation_notice(thing, name, version), [name, f"version {version} of the license"]))
        names.append((label, f"{name} version {version}"))
    for kind in CC_KINDS:
        names += [(f"cc-{kind} {v}".replace(f" {v}", f"-{v.replace(' ', '.')}").replace(" ", "-"), f"cc {kind} {v}") for v in CC_VERSIONS]
    return out + [(label, f"licensed under the {name}", [name]) for label, name in names]


TEMPLATES = all_templates()

#: All bytes below 0x80 but digits and letters part words; A-Z become a-z. Bytes from 0x80 on belong to words.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, as UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


class Index:
    """Positional postings of the templates' rare words, and what a text is matched with."""

    def __init__(self, templates=TEMPLATES, base=BASE, frequency: dict[bytes, int] | None = None, n_docs: int = 0, rare: int = 8, least: float = 0.6, slip: int = 6):
        self.least, self.slip = least, slip
        self.templates = [(label, words_of(text), [words_of(k) for k in keys]) for label, text, keys in templates]
        self.base = [(words_of(phrase), label) for phrase, label in base.items()]
        self.lexicon = frozenset(w for _, words, _ in self.templates for w in words)
        frequency = frequency or {}
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in self.lexicon}
        #: word -> (template, position); of each template the rarest half of its words, at most ``rare``
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, words, _) in enumerate(self.templates):
            distinct = sorted(set(words), key=lambda w: (-self.idf[w], w))
            chosen = set(distinct[: max(2, min(rare, len(distinct) // 2))])
            for p, word in enumerate(words):
                if word in chosen:
                    self.postings[word].append((t, p))
        #: each key phrase by its rarest word and where that stands in it
        self.key_at = {tuple(k): min(range(len(k)), key=lambda i: (-self.idf.get(k[i], 0.0), i)) for _, _, keys in self.templates for k in keys}
        self.known = frozenset(self.postings) | {k[i] for k, i in self.key_at.items()} | {phrase[-1] for phrase, _ in self.base}

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], dict[str, float]]:
        """Starts of all base places, the base labels, and the score of each label whose template verifies."""
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            if word in self.known:
                at[word].append(i)
        starts, labels = [], set()
        for phrase, label in self.base:
            found = [s for i in at.get(phrase[-1], ()) if (s := i - len(phrase) + 1) >= 0 and words[s : i + 1] == phrase]
            starts += found
            labels |= {label} if found else set()
        return starts, labels, self.match(words, at)

    def match(self, words: list[bytes], at: dict[bytes, list[int]]) -> dict[str, float]:
        """The text's licence words, rarest first, are looked up; postings that agree on where a template would start,
        give or take ``slip`` words, make an alignment, which is then verified on the words themselves."""
        votes: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for word in sorted(at.keys() & self.postings.keys(), key=lambda w: (-self.idf[w], w)):
            for t, p in self.postings[word]:
                mine = votes[t]
                for i in at[word]:
                    mine[i - p].add(p)
        places: dict[tuple, list[int]] = {}
        best: dict[str, float] = {}
        for t, mine in votes.items():
            label, template, keys = self.templates[t]
            if len(set().union(*mine.values())) < 2:
                continue
            for key in map(tuple, keys):
                if key not in places:
                    k = self.key_at[key]
                    places[key] = [s for i in at.get(key[k], ()) if (s := i - k) >= 0 and tuple(words[s : s + len(key)]) == key]
            if not all(places[tuple(key)] for key in keys):
                continue
            shifts = sorted(mine)
            for n, low in enumerate(shifts):
                near = shifts[n : bisect_right(shifts, low + self.slip, n)]
                if len(set().union(*(mine[d] for d in near))) < 2:
                    continue
                end = near[-1] + len(template)
                if all((j := bisect_left(places[tuple(key)], max(low, 0))) < len(places[tuple(key)]) and places[tuple(key)][j] + len(key) <= end for key in keys):
                    share = sum(any(0 <= d + p < len(words) and words[d + p] == w for d in near) for p, w in enumerate(template)) / len(template)
                    if share >= self.least:
                        best[label] = max(share, best.get(label, 0.0))
        return best


def document_frequency(docs: DataFrame, lexicon: frozenset, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, and the number of documents. Counted per task, then
    summed: a row for each word and task."""
    lexicon = frozenset(lexicon)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in slices(batches, "text"):
            seen[b""] += batch.num_rows
            for text in batch.column(1).to_pylist():
                seen.update(lexicon.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = texts(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word.encode(): r.n for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, rare: int = 8, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches (label
    and score of each verified template).

    Of each template the rarest half of its words, at most ``rare``, is indexed; starts within a few words with
    two posted places or more are verified and need ``least`` of the template's words in place. The score is
    the best template's share, 0 without one. A null or empty text has no words, empty labels, null places and
    score 0; repeated rows are scanned each; an empty table gives no rows; other columns are not read.
    The lexicon is bounded by the templates, so the index goes to every task.
    """
    frequency, n_docs = document_frequency(docs, Index(templates, base).lexicon, id_col, text_col)
    state = (templates, base, frequency, n_docs, rare, least)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = Index(*state)
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                starts, labels, found = index.scan(words)
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), max(found.values(), default=0.0), [{"label": k, "score": v} for k, v in sorted(found.items())])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,score:double>>")
