"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is a character n-gram (of the text with A-Z folded) that stands at least once, twice or three
times in a document. Its value is the log ratio of its smoothed document frequency among toxic and other
training documents; n-grams that the classes share alike are left out by a chi-square test, and logistic
regression learns a weight on top of the rest. The classifier is fitted on a bounded sample of labelled
rows; whole texts of all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, slices, texts, written
from quire.llm.hashing import text_buffer

BITS = 21
ORDERS = (4, 6)
#: A feature for so many occurrences of an n-gram or more.
LEVELS = 3
#: At most so many training documents of either class.
SAMPLE = 2500
#: Features need so many training documents, and such a chi-square of class and presence (99.99997 % at 25).
SEEN, CHI_SQUARE = 5, 25.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LEVEL_STEP = 0x5BD1E995


def level_slot(slot: np.ndarray, level: int, bits: int = BITS) -> np.ndarray:
    """The slot of "at least ``level`` times" of an n-gram."""
    return ((slot.astype(np.int64) + (level - 1) * _LEVEL_STEP) & ((1 << bits) - 1)).astype(np.int32)


def grams(column, orders=ORDERS, bits=BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order the slot of each n-gram of characters of all texts and the number of its text, repeats and all.

    N-grams do not reach over the end of a text, which counts as a line feed before and after it."""
    data, ends = text_buffer(column)
    data = _LOWER[np.concatenate((np.full(1, 0x0A, np.uint8), data, np.zeros(3, np.uint8)))]
    lead = np.flatnonzero((data[:-3] & 0xC0) != 0x80)  # the first byte of each character
    size = np.diff(np.concatenate((lead, [len(data) - 3])))
    char = data[lead].astype(np.uint64)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        char[more] |= data[lead[more] + k].astype(np.uint64) << np.uint64(8 * k)
    char = (char + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    char ^= char >> np.uint64(29)
    first = np.searchsorted(lead, np.concatenate(([1], ends + 1)))  # of each text, behind the line feed before it
    for order in orders:
        code = np.zeros(max(len(char) - order + 1, 0), np.uint64)
        for k in range(order):
            code *= np.uint64(0xD6E8FEB86659FD93)
            code += char[k : k + len(code)]
        code ^= code >> np.uint64(32)
        code *= np.uint64(0x9E3779B97F4A7C15)
        code >>= np.uint64(64 - bits)
        counts = np.maximum(np.diff(first) - order + 2, 0)
        owner = np.repeat(np.arange(len(ends), dtype=np.int32), counts)
        at = np.arange(len(owner)) + np.repeat(first[:-1] - 1 - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(ends) else np.zeros(0, np.int64)
        yield code[at].astype(np.int32), owner


def leveled(slot: np.ndarray, owner: np.ndarray, n: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, in one array, and where each text's begin (one more than texts)."""
    both = np.sort(owner.astype(np.int64) << bits | slot)
    start = np.concatenate((np.ones(min(len(both), 1), bool), both[1:] != both[:-1]))
    count = np.arange(len(both)) - np.maximum.accumulate(np.where(start, np.arange(len(both)), 0))
    found = [both[count == 0]]
    for level in range(2, LEVELS + 1):
        more = both[count == level - 1]
        found.append(more >> bits << bits | level_slot(more & ((1 << bits) - 1), level, bits))
    both = np.unique(np.concatenate(found))
    return (both & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(both, np.arange(n + 1, dtype=np.int64) << bits)


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """All features of each text, as ``leveled`` gives them."""
    slot, owner = (np.concatenate(x) for x in zip(*grams(column), strict=True))
    return leveled(slot, owner, len(column))


@dataclass
class Model:
    """The slots that have a weight, sorted, their weights, and the bias."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The weight of every slot, and whether an n-gram has a weight at any level; made once a process."""
        if "_tables" not in self.__dict__:
            dense = np.zeros(1 << BITS, np.float32)
            dense[self.slots] = self.weights
            every = np.arange(1 << BITS, dtype=np.int32)
            live = dense != 0
            for level in range(2, LEVELS + 1):
                live |= dense[level_slot(every, level)] != 0
            self.__dict__["_tables"] = dense, live
        return self.__dict__["_tables"]

    def __getstate__(self) -> dict:
        return {"slots": self.slots, "weights": self.weights, "bias": self.bias}

    def score(self, column) -> np.ndarray:
        """Only n-grams with a weight are gathered; most have none."""
        dense, live = self.tables()
        slots, owners = [], []
        for slot, owner in grams(column):
            at = np.flatnonzero(live[slot])
            slots.append(slot[at])
            owners.append(owner[at])
        slot, begins = leveled(np.concatenate(slots), np.concatenate(owners), len(column))
        sums = np.concatenate(([0], np.cumsum(dense[slot], dtype=np.float64)))
        return 1 / (1 + np.exp(-np.clip(sums[begins[1:]] - sums[begins[:-1]] + self.bias, -30, 30)))


def chosen_features(slot: np.ndarray, pos: np.ndarray, all_: np.ndarray, positive: int, n: int, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(slots, log-count ratios) of the features to learn from, by slot. ``pos`` and ``all_`` are in how many toxic and
    in how many training documents each stands."""
    order = np.argsort(slot)
    slot, pos, all_ = slot[order], pos[order].astype(float), all_[order].astype(float)
    ratio = np.log((alpha + pos) / (positive + 2 * alpha)) - np.log((alpha + all_ - pos) / (n - positive + 2 * alpha))
    prior = positive / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = (pos - all_ * prior) ** 2 / (all_ * prior * (1 - prior) * (1 - all_ / n))
    use = (all_ >= SEEN) & (np.abs(ratio) > 0.5) & (np.nan_to_num(chi, nan=0.0, posinf=np.inf) >= CHI_SQUARE)
    return slot[use], ratio[use]


def fit(docs: list[np.ndarray], label: np.ndarray, slots: np.ndarray, ratio: np.ndarray, rounds: int = 300, penalty: float = 2e-2) -> Model:
    """Logistic regression over the given features (of each document, those of ``slots`` that it has) with an L2
    penalty, by Nesterov steps. Classes weigh alike. Without both classes every score is the same: 0.5
    without any label, else near the only label."""
    n, positive = len(label), int(label.sum())
    if not n or positive in (0, n):
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0 if not n else (3.0 if positive else -3.0))
    column = np.searchsorted(slots, np.concatenate(docs)) if len(slots) else np.zeros(0, np.int64)
    lengths = np.array([len(d) for d in docs])
    ends = np.cumsum(lengths)
    share = np.where(label > 0, 0.5 / positive, 0.5 / (n - positive))

    def sums(values: np.ndarray) -> np.ndarray:
        """Of each document, the sum over its features."""
        c = np.concatenate(([0], np.cumsum(values[column])))
        return c[ends] - c[ends - lengths]

    step = 1 / (0.25 * float((share * (sums(ratio**2) + 1)).sum()) + penalty)
    w, old, bias, old_bias = np.zeros(len(slots)), np.zeros(len(slots)), 0.0, 0.0
    for t in range(rounds):
        pull = t / (t + 3)
        ahead, ahead_bias = w + pull * (w - old), bias + pull * (bias - old_bias)
        error = share * (1 / (1 + np.exp(-np.clip(sums(ahead * ratio) + ahead_bias, -30, 30))) - label)
        gradient = np.bincount(column, np.repeat(error, lengths), len(slots))
        old, old_bias = w, bias
        w, bias = ahead - step * (gradient * ratio + penalty * ahead), ahead_bias - step * float(error.sum())
    return Model(slots.astype(np.int32), (w * ratio).astype(np.float32), float(bias))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(y, text) of at most ``sample`` documents of either class, those with the smallest hashes of their ids."""
    of = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    of = of.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    of = of.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")  # labels of documents that are gone use up no place
    order = [F.xxhash64("id"), F.col("id")]
    chosen = of.filter("y > 0").orderBy(*order).limit(sample).union(of.filter("y <= 0").orderBy(*order).limit(sample))
    found = texts(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))  # two samples at most
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``sample`` documents of either class that ``docs`` has.

    Rows whose crc32(id) modulo 3 is 1 and rows with a null id or label are left out; a document labelled
    more than once counts as toxic if any label says so; of rows with one id and several texts the smallest
    text counts. Tasks count in how many documents each feature stands; only features that pass the test go
    on, so that the task that fits holds few numbers a document, however long the texts are."""
    rows = written(sampled(docs, labels, sample, id_col, text_col, label_col), "sample")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, hits = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in slices(batches, "text"):
            slot, begins = features(batch.column(1))
            toxic = np.repeat(batch.column(0).to_numpy(), np.diff(begins))
            total += np.bincount(slot, minlength=1 << BITS).astype(np.int32)
            hits += np.bincount(slot[toxic > 0], minlength=1 << BITS).astype(np.int32)
        for at in np.array_split(np.flatnonzero(total), 16):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(hits[at].astype(np.int64)), pa.array(total[at].astype(np.int64))], names=["slot", "pos", "n"])

    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    counts = rows.mapInArrow(count, "slot int, pos long, n long").groupBy("slot").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).filter(F.col("n") >= SEEN)
    slots, ratio = np.zeros(0, np.int32), np.zeros(0)
    if 0 < size.pos < size.n:
        # what the two classes share alike goes before it reaches the driver
        share = size.pos / size.n
        far = F.pow(F.col("pos") - F.col("n") * share, 2) >= F.col("n") * share * (1 - share) * (1 - F.col("n") / size.n) * (CHI_SQUARE - 1e-6)
        got = counts.filter(far).toArrow()
        slots, ratio = chosen_features(*(got[c].to_numpy() for c in ("slot", "pos", "n")), size.pos, size.n)

    def select(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            slot, begins = features(batch.column(1))
            use = np.isin(slot, slots)
            kept = [slot[a:b][use[a:b]].tobytes() for a, b in zip(begins, begins[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], names=["y", "slots"])

    def learn(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = [(y, x) for batch in batches for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        found.sort()  # the same sums in every run
        model = fit([np.frombuffer(x, np.int32) for _, x in found], np.array([y for y, _ in found], np.float64), slots, ratio)
        yield pa.RecordBatch.from_arrays([pa.array([model.slots.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([float(model.bias)])], names=["slots", "weights", "bias"])

    # the sample is bounded, and so is what is left of each document, so one task learns from it
    got = rows.mapInArrow(select, "y int, slots binary").repartition(1).mapInArrow(learn, "slots binary, weights binary, bias double").first()
    dropped(rows)
    return Model(np.frombuffer(got.slots, np.int32), np.frombuffer(got.weights, np.float32), got.bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score, between 0 and 1. Null and empty texts have the score of a text
    without words; repeated rows score alike. The model is an array of fixed size, and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"__q{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            n = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(shared.value.score(batch.column(n)))], names=[*own, "score"])

    schema = ", ".join([*(f"{o} {f.dataType.simpleString()}" for o, f in zip(own, docs.schema, strict=True)), "score double"])
    rows = docs.toDF(*own).select("*", F.col(own[docs.columns.index(text_col)]).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).toDF(*docs.columns, name)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null id is not held out. An empty table gives no rows."""
    model = train(docs, labels, sample, id_col, text_col)
    slim = score(texts(docs, id_col, text_col), model, name="score")
    return slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns and no others."""
    scored = score(docs, train(docs, labels, SAMPLE, id_col, text_col), text_col, "__toxicity")
    return scored.filter(F.col("__toxicity") < threshold).select(*docs.columns)
