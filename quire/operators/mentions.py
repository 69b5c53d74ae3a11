"""Where the aliases of a vocabulary stand in token arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Aliases of at most so many bytes become an automaton in every Python worker.
AUTOMATON_BYTES = 8 << 20
_BUILT: dict = {}


def _automaton(shared):
    """All aliases in one automaton, built once a worker: a text is read once, whatever their number."""
    import ahocorasick

    if shared.value[0] not in _BUILT:
        found = ahocorasick.Automaton()
        for k, alias in enumerate(shared.value[1]):
            found.add_word(f" {alias} ", (k, alias.count(" ") + 1))
        if len(found):
            found.make_automaton()
        _BUILT.clear()
        _BUILT[shared.value[0]] = found
    return _BUILT[shared.value[0]]


def mentions(texts: DataFrame, aliases: DataFrame, key: str, tokens: str, most: int | None = None) -> DataFrame:
    """(key, token_index, lemma_id, n_tokens) wherever an alias stands in the array ``tokens`` of ``texts``, aliases
    (lemma_id, alias_normalized) of one or more words parted by single spaces, overlaps included.

    Aliases are measured first. Up to ``most`` bytes an Aho-Corasick automaton of them runs over each text, so texts
    are neither shuffled nor sorted; more of them meet the runs of tokens of their lengths in a join. Null and empty
    aliases stand nowhere; a repeated alias is found as often; tokens hold no spaces.
    """
    aliases = aliases.select("lemma_id", "alias_normalized").filter("alias_normalized <> ''")
    size = aliases.agg(F.sum(F.octet_length("alias_normalized"))).first()[0] or 0
    if size > (AUTOMATON_BYTES if most is None else most):
        return _joined(texts, aliases, key, tokens)
    spark = texts.sparkSession
    words = [r[0] for r in aliases.select("alias_normalized").distinct().collect()]
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, words))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = _automaton(shared)
        for batch in batches:
            rows, index, alias, length = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist() if len(automaton) else []):
                if not text:
                    continue
                text, seen, at = f" {text} ", 0, 0
                for end, (k, n) in automaton.iter(text):
                    seen += text.count(" ", at, end + 1)
                    at = end + 1
                    rows.append(i)
                    index.append(seen - 1 - n)
                    alias.append(shared.value[1][k])
                    length.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(index, pa.int32()), pa.array(alias, pa.string()), pa.array(length, pa.int32())], names=[key, "token_index", "alias_normalized", "n_tokens"])

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(key, F.array_join(tokens, " ")).mapInArrow(run, f"`{key}` {kind}, token_index int, alias_normalized string, n_tokens int")
    # as many rows as the vocabulary, of checked size
    return found.join(F.broadcast(aliases), "alias_normalized").select(key, "token_index", "lemma_id", "n_tokens")


def _joined(texts: DataFrame, aliases: DataFrame, key: str, tokens: str) -> DataFrame:
    """By equality of every run of tokens of a length that aliases have."""
    lengths = sorted(r[0] for r in aliases.select(F.size(F.split("alias_normalized", " "))).distinct().collect())
    n = F.explode(F.array(*[F.lit(k) for k in lengths])).alias("n_tokens")
    rows = texts.select(key, tokens, n).filter(F.size(tokens) >= F.col("n_tokens"))
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - F.col("n_tokens") + 1), lambda i: F.array_join(F.slice(tokens, i, F.col("n_tokens")), " "))
    rows = rows.select(key, "n_tokens", F.posexplode(runs).alias("token_index", "alias_normalized"))
    return rows.join(aliases, "alias_normalized").select(key, "token_index", "lemma_id", "n_tokens")
