"""Token counts under a unigram model, by dynamic programming shared in a trie.

Pre-tokens are runs without white space behind the word mark. The distinct ones of a run of rows go
into a trie; a node's forward score, the best of all segmentations of its prefix into pieces, is taken
once from the nodes above it, and a word's end stores its count of pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame

from quire.llm.common import slices, texts

MARK = "▁"
KEPT_WORDS = 500_000
_LOADED: dict = {}


def zipf_scores(path: str) -> dict[str, float]:
    """Piece -> log probability. The file orders its pieces by merges and has no unigram scores, so a piece of
    rank r gets 1 / (r + 1) by Zipf's law, up to a constant, and a byte piece the lowest score."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(normal, 1)}
    total = math.log(sum(map(math.exp, scores.values())))
    return {piece: s - total for piece, s in scores.items()}


class Counter:
    """Best segmentations of words, shared by prefix. Among equal scores the one of fewest pieces counts; a
    character that is no piece is as many byte pieces as its UTF-8 has, each below the lowest score."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 1.0
        self.known: dict[bytes, int] = {}

    def count(self, words: list[str]) -> Iterator[tuple[str, int]]:
        """(word, pieces) of each word; sorted words are the trie's paths in depth-first order."""
        get, longest = self.scores.get, self.longest
        score, pieces = [0.0], [0]
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], pieces[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode())
                best, fewest = score[end - 1] + size * self.byte, pieces[end - 1] + size
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None:
                        s += score[start]
                        if s > best + 1e-9 or s > best - 1e-9 and pieces[start] + 1 < fewest:
                            best, fewest = s, pieces[start] + 1
                score.append(best)
                pieces.append(fewest)
            yield word, pieces[-1]
            before = word

    def learn(self, words: set[bytes]) -> None:
        fresh = words - self.known.keys()
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known.clear()
            fresh = words
        for word, n in self.count([MARK + w.decode() for w in fresh]):
            self.known[word[1:].encode()] = n


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED[path] = Counter(zipf_scores(path))
    return _LOADED[path]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens.

    Null and empty texts have 0 of both; repeated rows are counted each; an empty table gives no rows; other
    columns are not read. No shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c = counter(model_path)
        for batch in slices(batches, "text"):
            split = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            c.learn(set().union(*split))
            known = c.known.__getitem__
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array([sum(map(known, w)) for w in split], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
