"""BPE encoding and decoding by a trie over distinct words.

In byte-pair encoding the last token of a word's prefix does not depend on what follows, and a
sequence of tokens is the encoding of its text exactly if each neighbouring pair is. So the distinct
words of a batch go into a trie, which is walked depth first; each node gets its last token once, from
the nodes above, whatever words share it. A word's ids follow by stepping back from its end.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SLICE_BYTES, slices, texts
from quire.llm.packing import byte_characters

#: Words whose encodings a process keeps, twice: beyond that the older half goes. Only speed depends on it.
KEPT_WORDS = 150_000
#: Pairs of tokens of which a process knows whether they stand side by side; beyond that all are forgotten.
KEPT_PAIRS = 500_000
_LOADED: dict = {}


def pack(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Merges:
    """Vocabulary and merges, and which pairs of tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.token = {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = rank
            self.parts.setdefault(made, (left, right))
            self.born.setdefault(made, rank)
        self.longest = max(map(len, vocab))
        #: left << 20 | right -> whether they stand side by side
        self.side: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def plain(self, symbols: list[int]) -> list[int]:
        """The textbook loop: merge the pair of the lowest rank, leftmost first, until none is left."""
        out = list(symbols)
        while len(out) > 1:
            rank, at = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(out, out[1:], strict=False)))
            if rank == 1 << 60:
                break
            pair, made = (out[at], out[at + 1]), self.vocab[self.token[out[at]] + self.token[out[at + 1]]]
            merged, i = [], 0
            while i < len(out):
                if i + 1 < len(out) and (out[i], out[i + 1]) == pair:
                    merged.append(made)
                    i += 2
                else:
                    merged.append(out[i])
                    i += 1
            out = merged
        return out

    def stands(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: undo their merges from the latest on, and no pair across the
        border may merge before the merges that are still to come on either side."""
        known = self.side.get(left << 20 | right)
        if known is None:
            known = self.side[left << 20 | right] = self._stands(left, right)
        return known

    def _stands(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < limit:
                return False
            # of the merges beside the border the latest is undone. Equal ranks are one merge on both
            # sides, done on the left first. A pair across the border must come before the left side's
            # next merge, which takes its first token; of the right side's it is further left.
            x, y = self.born.get(a, -1), self.born.get(b, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                a, limit = self.parts[a][1], x
            else:
                b, limit = self.parts[b][0], y + 1

    def makes_itself(self, token: int) -> bool:
        """Whether the text of a token is encoded as that token."""
        known = self.whole.get(token)
        if known is None:
            text, end = self.token[token], self.suffix
            tail = bool(end) and text.endswith(end) and len(text) > len(end)
            body = text[: -len(end)] if tail else text
            symbols = [*body[:-1], body[-1] + end] if tail else list(body)
            known = self.whole[token] = all(s in self.vocab for s in symbols) and self.plain([self.vocab[s] for s in symbols]) == [token]
        return known


class Trie:
    """Distinct words as paths of symbols; every node has the last token of the encoding of its prefix."""

    def __init__(self, merges: Merges):
        if len(merges.vocab) > 1 << 20:
            raise ValueError("vocabularies of more than 2**20 tokens are not supported")
        self.merges = merges
        lengths = range(1, merges.longest + 1)
        #: Only one suffix fits, so the likely ones come first: the last token with one character more, then short ones.
        self.orders = [(g, *(n for n in lengths if n != g)) for g in range(merges.longest + 1)]

    def encode(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of each word, given in byte characters. Sorted words are a trie's paths in depth-first
        order: what a word shares with the one before it is the path down to the node to go on from.

        A node's last token is the one suffix of its prefix in the vocabulary that stands beside the last
        token of what is before it. A word's last symbol carries the end mark, so its end is a node apart."""
        m = self.merges
        get, side, stands, longest, suffix = m.vocab.get, m.side, m.stands, m.longest, m.suffix
        path: list[int] = []  # the last token at each depth of the inner nodes
        size: list[int] = []  # its length in characters
        before = ""
        for word in sorted(words):
            length = len(word)
            shared, most = 0, min(len(before), length - 1, len(path))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared:], size[shared:]
            marked = word + suffix
            for depth in range(shared + 1, length + 1):
                text, stop = (word, depth) if depth < length else (marked, length + len(suffix))
                for n in self.orders[min(size[-1] + 1, longest) if size else 1]:
                    if n > depth:
                        continue
                    start = depth - n
                    token = get(text[start:stop])
                    if token is None:
                        continue
                    if start:
                        left = path[start - 1]
                        fine = side.get(left << 20 | token)
                        if fine is None:
                            fine = stands(left, token)
                    else:
                        fine = m.makes_itself(token)
                    if fine:
                        path.append(token)
                        size.append(n)
                        break
                else:
                    raise ValueError(f"no token ends {text[:stop]!r}")
            ids, at = [], length
            while at > 0:
                ids.append(path[at - 1])
                at -= size[at - 1]
            ids.reverse()
            path.pop()  # the end's node is no inner node
            size.pop()
            yield word, ids
            before = word


def _letters() -> tuple[str, str]:
    """Character classes of letters and numbers in the ranges that the fast path takes."""
    span = [chr(c) for a, b in FAST for c in range(a, b + 1)]
    return "".join(re.escape(c) for c in span if unicodedata.category(c)[0] == "L"), "".join(re.escape(c) for c in span if unicodedata.category(c)[0] == "N")


#: Latin text and common punctuation: no combining marks, so NFC keeps it, and no U+0130, whose lower case has one.
FAST = [(0x00, 0x1B), (0x20, 0x12F), (0x131, 0x17F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]


class Codec:
    """Encodes and decodes as the ``tokenizers`` library does with a file of a word-end BPE.

    Its normalizer and word split are applied by a regular expression where a text has Latin letters and
    common signs only, and by the library elsewhere; the merges are always the trie's.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.trie = Trie(self.merges)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = dict(self.merges.token) | {i: t for t, i in self.added.items()}
        self._library = None
        letters, numbers = _letters()
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+")
        self.rare = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" if chr(a) not in "\\]^-" else re.escape(chr(a)) + "-" + chr(b) for a, b in FAST) + "]")
        self.special = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.byte = {b: c for c, b in byte_characters().items()}
        size = max(self.token, default=-1) + 1
        self.text_of = pa.array([self.token.get(i) for i in range(size)], pa.string())
        self.decimal_of = pa.array([str(i) for i in range(size)], pa.string())
        #: word -> its ids as little-endian bytes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @property
    def library(self):
        """Only for texts with other than Latin letters, so most processes never load it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, text: str) -> list[str]:
        """The words, as the pre-tokenizer gives them before bytes are mapped; added tokens stand for themselves."""
        if self.special and "<" in text and self.special.search(text):
            out, at = [], 0
            for found in self.special.finditer(text):
                out += self.plain_words(text[at : found.start()])
                out.append("\0" + found.group())
                at = found.end()
            return out + self.plain_words(text[at:])
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if not self.rare.search(text):
            return self.split.findall(text.lower())
        back = byte_characters()
        text = self.library.normalizer.normalize_str(text)
        return [bytes(back[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, words: set[str]) -> None:
        if len(self.known) > KEPT_WORDS:
            self.older, self.known = self.known, {}
        fresh = words - self.known.keys()
        again = fresh & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        fresh -= again
        if len(self.merges.side) > KEPT_PAIRS:
            self.merges.side.clear()
        shown: dict[str, str] = {}
        for word in fresh:
            if word[0] == "\0" and word[1:] in self.added:
                i = self.added[word[1:]]
                self.known[word] = pack(i)
            elif word.isascii() and word.isprintable():  # such characters stand for themselves
                shown[word] = word
            else:
                shown["".join(map(self.byte.__getitem__, word.encode()))] = word
        for mapped, ids in self.trie.encode(list(shown)):
            self.known[shown[mapped]] = pack(*ids)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The text of each run of ids, which ends where ``ends`` (from 0 on) says: tokens joined by a space, as the
        file names no decoder. Ids of no token are passed over."""
        fine = (ids >= 0) & (ids < len(self.text_of))
        fine[fine] = self.text_of.is_valid().to_numpy(zero_copy_only=False)[ids[fine]]
        if not fine.all():
            ends, ids = np.concatenate(([0], np.cumsum(fine)))[ends], ids[fine]
        return joined(self.text_of, ids, ends)


def joined(names: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The names of each run of ids, joined by a space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), names.take(pa.array(ids))), " ")


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encoded(c: Codec, texts_: list) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in one array, and where each text's end (from 0 on); a null text has none."""
    split = [c.words(t) if t else [] for t in texts_]
    c.learn(set().union(*split))
    raw = [b"".join(map(c.known.__getitem__, words)) for words in split]
    return np.frombuffer(b"".join(raw), "<i4"), np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw]))).astype(np.int64)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids (array of ints) and ids_text (the same, in decimal, joined by a space).

    A null text is empty and has no ids; repeated rows are encoded each; an empty table gives no rows; other
    columns are not read. No shuffle: a task gathers the distinct words of a run of rows, encodes those it
    does not know through the trie, and looks all words up.
    """

    def run(batches: Iterator) -> Iterator:
        c = codec(tokenizer_path)
        for batch in slices(batches, "text", 2 * SLICE_BYTES):
            ids, ends = encoded(c, batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), lists, joined(c.decimal_of, ids, ends)], names=["doc_id", "n_tokens", "ids", "ids_text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, ids_text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_text and decoded, as ``encode`` and then ``decode`` give them, in one pass: the ids
    need no way through the JVM, and a task has one Python process. Nulls, repeated rows and empty tables as
    there."""

    def run(batches: Iterator) -> Iterator:
        c = codec(tokenizer_path)
        for batch in slices(batches, "text", 2 * SLICE_BYTES):
            ids, ends = encoded(c, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), joined(c.decimal_of, ids, ends), c.decode(ids, ends)], names=["doc_id", "n_tokens", "ids_text", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_text string, decoded string")


def decode(rows: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``rows`` but the ids, and decoded. Null lists and empty ones decode to an empty text; a null id in
    a list and an id of no token are passed over; repeated rows are decoded each; an empty table gives no rows."""
    rest = [c for c in rows.columns if c != ids_col]
    own = [f"__q{i}" for i in range(len(rest))]

    def run(batches: Iterator) -> Iterator:
        c = codec(tokenizer_path)
        for batch in batches:
            n = batch.num_columns - 1
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(n)
                ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], c.decode(ids, ends)], names=[*own, "decoded"])

    schema = ", ".join([*(f"{o} {rows.schema[c].dataType.simpleString()}" for o, c in zip(own, rest, strict=True)), "decoded string"])
    return rows.select(*rest, F.col(ids_col).cast("array<int>")).toDF(*own, "ids").mapInArrow(run, schema).toDF(*rest, "decoded")
