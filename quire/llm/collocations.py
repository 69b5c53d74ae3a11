"""Phrase collocations by contiguous pattern growth (PrefixSpan on runs of words).

A first pass counts words. A second projects the occurrences of every frequent word: what stands behind it in its
piece, as long as words are frequent, counted once per run of texts. All occurrences of a prefix meet in one task,
which sorts them and grows patterns to the right depth-first: a pattern's occurrences are a range of pointers into
the sorted rows, and ranges below the least support go no further. The few prefixes that hold a large share of all
words are dealt by their second word as well, and a task folds what it holds into distinct rows.

Inside, a word is a 64-bit hash, which the word table turns back; two words of one hash start the run again with
other hashes, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import dropped, partitions, slices, written
from quire.llm.hashing import mix, span_hashes, text_buffer

LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Texts are read in runs of about so many bytes; a projected row is kept once a run.
RUN_BYTES = 4_000_000
#: The filter of frequent words has so many bits, whatever the corpus: 4 MB. A wrong hit costs a row and no result.
FILTER_BITS = 1 << 25
#: A word of more than 1 / (HEAVY * partitions) of all words is dealt by the next word as well.
HEAVY = 4
#: A task folds a prefix's rows into distinct ones whenever it holds so many.
FOLD_ROWS = 1 << 20

_PIECE, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_SPACE[[0x20, 0x09]] = True


class Pieces:
    """The words of lower-cased texts: hash, byte span, number of the piece and of the text."""

    def __init__(self, column, seed: int):
        data, ends = text_buffer(column)  # every text ends in a line feed, which ends a piece
        upper = (data >= 65) & (data <= 90)
        data[upper] += 32
        cut = _PIECE[data]
        word = np.concatenate(([False], ~(cut | _SPACE[data]))).view(np.int8)
        step = np.diff(word)
        self.bytes, self.starts, self.stops = data, np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.piece = np.cumsum(cut)[self.starts] if len(data) else np.zeros(0, np.int64)
        self.text = np.searchsorted(ends, self.starts, side="right")
        # 0 stands for no word
        self.hashes = np.maximum(span_hashes(data, self.starts, self.stops, seed), np.uint64(1))

    def strings(self, at: np.ndarray):
        """The words at the given places, as an Arrow column."""
        import pyarrow as pa

        size = self.stops[at] - self.starts[at]
        offsets = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.starts[at] - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.bytes[source])).cast(pa.string())


def _languages(column) -> tuple[np.ndarray, object]:
    """A code for each row, and the languages that the codes stand for."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns differ from the one before."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(out)


def word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, f) of rows (lang, text), counted in each run of texts first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text", RUN_BYTES):
            pieces = Pieces(batch.column(1), seed)
            codes, names = _languages(batch.column(0))
            lang = codes[pieces.text]
            order = np.lexsort((pieces.hashes, lang))
            begins = _fresh(lang[order], pieces.hashes[order])
            if len(begins):
                first, count = order[begins], np.diff(np.append(begins, len(order)))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[first])), pa.array(pieces.hashes[first].view(np.int64)), pieces.strings(first), pa.array(count)], names=["lang", "h", "word", "f"])

    counted = rows.mapInArrow(run, "lang string, h long, word string, f long")
    return counted.groupBy("lang", "h", "word").agg(F.sum("f").alias("f"))


def _filter(frequent: DataFrame) -> np.ndarray:
    """A bit for each hash of a frequent word, by its lowest bits; combined in Spark, of fixed size."""
    slot = F.col("h").bitwiseAND(FILTER_BITS // 64 - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("h", 40).bitwiseAND(63).cast("int"))
    found = frequent.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def _likely(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return bits[(h & np.uint64(FILTER_BITS // 64 - 1)).astype(np.int64)] >> (h >> np.uint64(40) & np.uint64(63)) & np.uint64(1) == 1


def _folded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with their counts summed."""
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    begins = _fresh(*rows.T)
    return rows[begins], np.add.reduceat(counts, begins)


def grown(rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """The frequent continuations of a prefix and their counts, from what follows its occurrences: distinct sorted
    rows, 0 behind their ends. Depth-first: a continuation's occurrences are a range of the rows."""

    def extend(low: int, high: int, path: tuple) -> Iterator:
        column = rows[low:high, len(path)]
        begins = _fresh(column)
        support = np.add.reduceat(counts[low:high], begins)
        for k in np.flatnonzero((support >= least) & (column[begins] != 0)):
            begin, end = begins[k], begins[k + 1] if k + 1 < len(begins) else high - low
            longer = (*path, int(column[begin]))
            yield longer, int(support[k])
            if len(longer) < rows.shape[1]:
                yield from extend(low + begin, low + end, longer)

    if len(rows):
        yield from extend(0, len(rows), ())


def phrase_counts(rows: DataFrame, words: DataFrame, longest: int, least: int, seed: int) -> DataFrame:
    """(lang, hashes, f) of the phrases of 2 to ``longest`` words that stand ``least`` times or more in pieces."""
    spark = rows.sparkSession
    parts = partitions(spark, rows)
    frequent = words.filter(F.col("f") >= least)
    total = words.agg(F.sum("f")).first()[0] or 0
    bits = spark.sparkContext.broadcast(_filter(frequent))
    # at most HEAVY * parts of them, as their shares sum to one
    heavy = np.array([r[0] for r in words.filter(F.col("f") * (HEAVY * parts) > total).select("h").collect()], np.int64).view(np.uint64)
    record = np.dtype([("words", "<u8", (longest - 1,)), ("f", "<u4")])

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text", RUN_BYTES):
            pieces = Pieces(batch.column(1), seed)
            codes, names = _languages(batch.column(0))
            h, n = pieces.hashes, len(pieces.hashes)
            known = _likely(bits.value, h)
            alive, after = known, []
            for k in range(1, longest):
                more = np.zeros(n, bool)
                if k < n:
                    more[:-k] = alive[:-k] & known[k:] & (pieces.piece[:-k] == pieces.piece[k:])
                word = np.zeros(n, np.uint64)
                word[more] = h[np.flatnonzero(more) + k]
                after.append(word)
                alive = more
            at = np.flatnonzero(after[0])
            if not len(at):
                continue
            lang, first, after = codes[pieces.text[at]], h[at], [a[at] for a in after]
            salt = np.where(np.isin(first, heavy), mix(after[0]) % np.uint64(parts), np.uint64(0)).astype(np.int32)
            order = np.lexsort((*after[::-1], salt, first, lang))
            lang, first, salt, after = lang[order], first[order], salt[order], [a[order] for a in after]
            begins = _fresh(lang, first, salt, *after)
            out = np.empty(len(begins), record)
            for k, a in enumerate(after):
                out["words"][:, k] = a[begins]
            out["f"] = np.diff(np.append(begins, len(order)))
            lang, first, salt = lang[begins], first[begins], salt[begins]
            groups = _fresh(lang, first, salt)
            ends = np.append(groups, len(out)).astype(np.int32) * np.int32(record.itemsize)
            data = pa.Array.from_buffers(pa.binary(), len(groups), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[groups])), pa.array(first[groups].view(np.int64)), pa.array(salt[groups]), data], names=["lang", "prefix", "salt", "rows"])

    projected = rows.mapInArrow(project, "lang string, prefix long, salt int, rows binary")
    dealt = projected.repartition(parts, "lang", "prefix", "salt").sortWithinPartitions("lang", "prefix", "salt")

    def grow(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.list_(pa.int64()), pa.int64()))], names=["lang", "hashes", "f"])
            out.clear()
            return batch

        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for (lang, prefix, _), found, counts in _prefixes(batches, record):
            if counts.sum() >= least:
                out += [(lang, [prefix, *map(signed, path)], f) for path, f in grown(*_folded(found, counts), least)]
            if len(out) > 5000:
                yield flush()
        if out:
            yield flush()

    return dealt.mapInArrow(grow, "lang string, hashes array<long>, f long")


def _prefixes(batches: Iterator, record: np.dtype) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """All rows of one (lang, prefix, salt) after the other, from batches sorted by them."""
    key, held, size = None, [], 0

    def all_rows():
        return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        codes, names = _languages(batch.column(0))
        prefix, salt = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        data = batch.column(3)
        offsets = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4).astype(np.int64)
        raw = memoryview(data.buffers()[2])
        groups = _fresh(codes, prefix, salt)
        for begin, end in zip(groups, np.append(groups[1:], batch.num_rows), strict=True):
            this = names[int(codes[begin])].as_py(), int(prefix[begin]), int(salt[begin])
            if this != key:
                if held:
                    yield key, *all_rows()
                key, held, size = this, [], 0
            found = np.frombuffer(raw[offsets[begin] : offsets[end]], record)
            held.append((found["words"].copy(), found["f"].astype(np.int64)))
            size += len(found)
            if size > FOLD_ROWS and len(held) > 1:
                held = [_folded(*all_rows())]
                size = len(held[0][0]) // 2  # at least as many rows come in before it folds again
    if held:
        yield key, *all_rows()


def _highest(scored: DataFrame, top: int) -> DataFrame:
    """The rows that can be among a language's first ``top``: those down to the score step in which the last of them
    lies. Steps are counted first, at most 1,001 a language."""
    step = F.call_function("div", F.col("score"), F.lit(1000))
    above = Window.partitionBy("lang").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    steps = scored.groupBy("lang", step.alias("step")).agg(F.count("*").alias("m"))
    steps = steps.withColumn("above", F.coalesce(F.sum("m").over(above), F.lit(0))).filter(F.col("above") < top)
    lowest = steps.groupBy("lang").agg(F.min("step").alias("lowest"))
    return scored.join(lowest, "lang").filter(step >= F.col("lowest")).drop("lowest")


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the ``top`` phrases of 2 to ``longest`` words, all of
    them where ``top`` is None.

    A-Z are lower-cased, texts cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs.
    n counts the language's words, a the phrase's occurrences (``least`` or more), overlaps included. Each cut of a
    phrase into l and r occurrences gives floor(1000000 * a * a / (l * r)); the lowest counts, of equal ones the
    first. A phrase within a longer one of at least ``cover`` percent of its occurrences goes. Order: score, a, then
    the phrase in byte order. A null language is ``und``, a null text empty; repeated rows each count; an empty
    table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for seed in range(8):
        words = written(word_counts(rows, seed), "words")
        if not words.groupBy("lang", "h").agg(F.count("*").alias("m")).filter("m > 1").take(1):
            break
        dropped(words)
    else:
        raise RuntimeError("words share hashes with every seed")
    phrases = written(phrase_counts(rows, words, longest, least, seed), "phrases")
    frequent = words.filter(F.col("f") >= least)
    counts = phrases.union(frequent.select("lang", F.array("h"), "f"))

    cuts = phrases.select("lang", "hashes", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("hashes") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("hashes", F.lit(1), F.col("k"))).withColumn("right", F.slice("hashes", F.col("k") + 1, F.size("hashes")))
    of = lambda side, name: counts.select("lang", F.col("hashes").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    big = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  # products stay below 38 digits
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), big("l") * big("r"))
    scored = cuts.groupBy("lang", "hashes", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("hashes") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("hashes") - m + 1), lambda i: F.slice("hashes", i, m))))
    covers = phrases.filter(F.size("hashes") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("hashes"), "f")
    covers = covers.groupBy("lang", "hashes").agg(F.max("f").alias("longer"))
    kept = scored.join(covers, ["lang", "hashes"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    kept = written(kept.select("lang", "hashes", "a", "x.l", "x.r", "x.score"), "scored")
    if top is not None:
        kept = _highest(kept, top)

    spelled = kept.select("lang", "hashes", F.posexplode("hashes").alias("i", "h")).join(frequent.select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "hashes").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("ws"))
    spelled = spelled.select("lang", "hashes", F.array_join(F.transform("ws", lambda w: w["word"]), " ").alias("phrase"))
    out = kept.join(spelled, ["lang", "hashes"]).join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = out.withColumn("rank", F.row_number().over(order))
    if top is not None:
        out = out.filter(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
