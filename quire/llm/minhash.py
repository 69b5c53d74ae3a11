"""MinHash near-duplicates: universal hash minima, banding, signature verification, large-star and small-star.

Documents with the same shingle set are one text class, which has a signature of many minima. Classes that share a
band's minima are a bucket; buckets with the same members are one. A group of near copies costs its members and not
their pairs: first every class of a bucket is compared with two of them, the bucket's centres, and then what that leaves
unconnected in a bucket is compared in full, the few against all. Every candidate passes its signatures first and then
its full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import dropped, partitions, slices, written
from quire.llm.hashing import mix
from quire.llm.nearjoin import gram_sets, keyed

PERCENT, GRAM, HASHES = 80, 2, 200
#: So many of a bucket's less common classes are held by a task, which streams so many others past them.
FEW, MANY = 256, 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def banding(percent: int = PERCENT, hashes: int = HASHES, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows): the most rows a band, for the fewest chance candidates, with which a pair at the threshold shares
    no band with probability ``miss`` or less."""
    t = percent / 100
    fit = [r for r in range(1, hashes + 1) if t == 1 or (hashes // r) * math.log(1 - t**r) <= math.log(miss)]
    if not fit:
        raise ValueError("too few hashes for the threshold")
    return hashes // fit[-1], fit[-1]


def least_agreement(percent: int = PERCENT, hashes: int = HASHES) -> int:
    """Signatures that agree in fewer places are not at the threshold: six standard deviations below the mean there,
    a chance of 1e-9."""
    t = percent / 100
    return max(0, math.floor(hashes * t - 6 * math.sqrt(hashes * t * (1 - t))))


def signatures(rows: DataFrame, bands: int, per: int, gram: int) -> DataFrame:
    """Of (doc_id, text, key): (doc_id, key, sig, n, marks, buckets). sig is a 128-bit hash of the shingle set, null
    without words, n its size, marks the lowest 16 bits of each minimum, buckets a hash of each band's minima."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hashes = bands * per
        draw = mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        factor, shift = draw[:hashes] | np.uint64(1), draw[hashes:]
        for batch in slices(batches, "text"):
            flat, begins = gram_sets(batch.column(1), gram)
            n = np.diff(begins)
            some = np.flatnonzero(n)
            sig = np.zeros((batch.num_rows, 2), np.uint64)
            least = np.zeros((batch.num_rows, hashes), np.uint64)
            if len(some):
                starts = begins[some]
                sig[some, 0] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                sig[some, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x14057B7EF767814F)), starts)
                for k in range(hashes):
                    least[some, k] = np.minimum.reduceat(flat * factor[k] + shift[k], starts)
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            for b in range(bands):
                keys[:, b] = b + 1
                for r in range(per):
                    keys[:, b] = mix(keys[:, b] * np.uint64(31) + least[:, b * per + r])
            marks, raw = (least >> np.uint64(24)).astype(np.uint16), sig.tobytes()
            sigs = pa.array([raw[16 * i : 16 * i + 16] if n[i] else None for i in range(batch.num_rows)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sigs, pa.array(n), pa.array([m.tobytes() for m in marks], pa.binary()), lists], names=["doc_id", "key", "sig", "n", "marks", "buckets"])

    return rows.mapInArrow(run, f"doc_id {kind}, key long, sig binary, n long, marks binary, buckets array<long>")


def shared_buckets(alike: DataFrame) -> DataFrame:
    """(bucket, sig) of the buckets of two classes or more; of buckets with the same members one."""
    slim = alike.select("sig", F.explode("buckets").alias("bucket"))
    members = F.count("*").alias("m"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y")
    one = slim.groupBy("bucket").agg(*members).filter("m > 1").groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket"))
    return slim.join(one.select("bucket"), "bucket")


def _matrix(column, width: int) -> np.ndarray:
    """A column of binaries of equal length as rows of 16-bit values."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint16).reshape(-1, width)


def _fitting(x: DataFrame, y: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of both sides."""
    side = lambda df, s: df.select(*[F.col(c).alias(s if c == "sig" else f"{c}_{s}") for c in df.columns])
    return pairs.join(side(x, "a"), "a").join(side(y, "b"), "b")


def likely(pairs: DataFrame, alike: DataFrame, percent: int, agree: int, hashes: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the threshold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(2), hashes) == _matrix(batch.column(3), hashes)).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= agree))

    both = _fitting(alike.select("sig", "n", "marks"), alike.select("sig", "n", "marks"), pairs)
    sized = both.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.select("a", "b", "marks_a", "marks_b").mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return _fitting(sets, sets, pairs).select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a binary, b binary")


def shingle_sets(members: DataFrame, alike: DataFrame, docs: DataFrame, gram: int) -> DataFrame:
    """(sig, grams) of the classes in buckets, from the text of one document of each."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, "text"):
            flat, begins = gram_sets(batch.column(1), gram)
            grams = pa.array([flat[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["sig", "grams"])

    wanted = alike.join(members.select("sig").distinct(), "sig", "left_semi").select(F.col("key").alias("__key"), F.col("least").alias("__id"), "sig")
    texts = docs.join(wanted, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return texts.dropDuplicates(["sig"]).select("sig", "text").mapInArrow(run, "sig binary, grams binary")


def star_candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each class of a bucket with the bucket's two centres, those with the smallest hash of two draws, so
    that a group has the same ones in most of its buckets and one odd class does not stand for all."""
    centres = [F.min(F.struct(F.xxhash64(F.lit(draw), "sig").alias("h"), "sig")).alias(f"c{draw}") for draw in (0, 1)]
    found = members.join(written(members.groupBy("bucket").agg(*centres), "centres"), "bucket")
    pairs = found.select("sig", F.explode(F.array_distinct(F.array("c0.sig", "c1.sig"))).alias("c")).filter("sig <> c")
    return pairs.select(F.least("sig", "c").alias("a"), F.greatest("sig", "c").alias("b")).distinct()


def overlaps(few: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets of distinct hashes, as a product of matrices of 0 and 1, so many columns at a
    time; columns are the hashes of ``few`` that ``others`` have too."""
    flat = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    (x, i), (y, j) = flat(few), flat(others)
    known = np.unique(x)
    at = np.searchsorted(known, y)
    met = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == y)
    used, at = np.unique(at[met], return_inverse=True)
    j, place = j[met], np.full(len(known), -1)
    place[used] = np.arange(len(used))
    k = place[np.searchsorted(known, x)]
    out = np.zeros((len(few), len(others)), np.int64)
    for low in range(0, len(used), 4096):
        left, right = (k >= low) & (k < low + 4096), (at >= low) & (at < low + 4096)
        a, b = np.zeros((len(few), 4096), np.float32), np.zeros((len(others), 4096), np.float32)
        a[i[left], k[left] - low] = 1
        b[j[right], at[right] - low] = 1
        out += (a @ b.T).astype(np.int64)
    return out


class _Classes:
    """Rows of a unit: their hashes, components, sizes, signatures, buckets and sets."""

    def __init__(self, part, hashes: int):
        self.sig, self.label = part.column(4).to_pylist(), np.array(part.column(5).to_pylist(), object)
        self.n, self.marks = part.column(6).to_numpy(), _matrix(part.column(7), hashes)
        self.buckets = part.column(8).flatten().to_numpy().reshape(len(self.sig), -1)
        self.grams = [np.frombuffer(g.as_buffer(), np.uint64) for g in part.column(9)]

    def links(self, others: _Classes, bucket: int, percent: int, agree: int, met: set) -> list[tuple]:
        """Of each class the first link to each other component, but those that are in ``met``."""
        last = np.iinfo(np.int64).max
        likely = np.zeros((len(self.sig), len(others.sig)), bool)
        for i, n in enumerate(self.n):
            fit = np.flatnonzero((np.minimum(others.n, n) * 100 >= np.maximum(others.n, n) * percent) & (others.label != self.label[i]))
            fit = fit[(others.marks[fit] == self.marks[i]).sum(1) >= agree]
            least = np.where(others.buckets[fit] == self.buckets[i], self.buckets[i], last).min(1, initial=last)
            likely[i, fit[least == bucket]] = True
        x, y = np.flatnonzero(likely.any(1)), np.flatnonzero(likely.any(0))
        if not len(x):
            return []
        both = overlaps([self.grams[k] for k in x], [others.grams[k] for k in y])
        linked = likely[np.ix_(x, y)] & (100 * both >= percent * (self.n[x, None] + others.n[None, y] - both))
        out = []
        for i, k in zip(*np.nonzero(linked), strict=True):
            pair = self.sig[x[i]], others.label[y[k]]
            if pair not in met:
                met.add(pair)
                out.append((pair[0], others.sig[y[k]]))
        return out


def remaining_links(members: DataFrame, labels: DataFrame, alike: DataFrame, sets: DataFrame, percent: int, agree: int, hashes: int) -> DataFrame:
    """Links (a, b) between classes of a bucket that are not connected: the classes outside the bucket's commonest
    component, in chunks, against all, in pieces. A pair is compared in the least bucket that it shares, by sizes,
    signatures and then full sets in the task, and of a class's links to one component the first is returned: rows
    follow the classes, however many pairs are just below the threshold."""
    rows = members.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    rows = written(rows.select("bucket", "sig", F.coalesce("label", "sig").alias("label")), "labelled")
    sizes = rows.groupBy("bucket", "label").agg(F.count("*").alias("k")).groupBy("bucket")
    sizes = sizes.agg(F.max(F.struct("k", "label")).alias("big"), F.sum("k").alias("m"), F.count("*").alias("labels")).filter("labels > 1")
    sizes = written(sizes.select("bucket", F.col("big.label").alias("big"), "m", (F.col("m") - F.col("big.k")).alias("s")), "buckets")
    rows = rows.join(sizes, "bucket").join(alike.select("sig", "n", "marks", "buckets"), "sig").join(sets, "sig")
    chunks, pieces = F.ceil(F.col("s") / FEW).cast("int"), F.ceil(F.col("m") / MANY).cast("int")
    mine = lambda k: F.pmod(F.xxhash64("sig"), k).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    rest = ["sig", "label", "n", "marks", "buckets", "grams"]
    few = rows.filter(F.col("label") != F.col("big")).select("bucket", mine(chunks).alias("chunk"), every(pieces).alias("piece"), F.lit(0).alias("side"), *rest)
    others = rows.select("bucket", every(chunks).alias("chunk"), mine(pieces).alias("piece"), F.lit(1).alias("side"), *rest)
    unit, parts = ["bucket", "chunk", "piece"], partitions(rows.sparkSession)
    work = few.union(others).repartition(parts, *unit).sortWithinPartitions(*unit, "side")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, held, met = None, [], set()
        for batch in batches:
            if not batch.num_rows:
                continue
            units = np.stack([batch.column(k).to_numpy() for k in range(4)])
            begins = np.concatenate(([0], np.flatnonzero((units[:, 1:] != units[:, :-1]).any(0)) + 1))
            out = []
            for begin, end in zip(begins, np.append(begins[1:], batch.num_rows), strict=True):
                this = tuple(units[:3, begin])
                if this != key:
                    key, held, met = this, [], set()
                if units[3, begin] == 0:  # the few of a unit come first, perhaps in several batches
                    held.append(_Classes(batch.slice(begin, end - begin), hashes))
                    continue
                for at in range(begin, end, MANY):
                    others = _Classes(batch.slice(at, min(MANY, end - at)), hashes)
                    for few in held:
                        out += few.links(others, this[0], percent, agree, met)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return work.mapInArrow(run, "a binary, b binary")


def stars(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Connected components of ``edges`` (a, b) by alternating large-star and small-star: (node, label), the label the
    smallest node. Nodes without an edge are not returned. Both sides of every join are tables, so a hub is split."""
    mark = [F.count("*"), F.bit_xor(F.xxhash64("a", "b"))]
    live = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = live.agg(*mark).first()
    for _ in range(most_rounds):
        # large-star: every larger neighbour of a node to the node's smallest
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        # small-star: every smaller neighbour of a node, and the node, to the smallest
        small = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(joined.union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for table in (live, least, large, small):
            dropped(table)
        before, state, live = state, new.agg(*mark).first(), new
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return live.select(F.col("a").alias("node"), F.col("b").alias("label")).union(live.select("b", "b").distinct())


def link_classes(docs: DataFrame, alike: DataFrame, percent: int, gram: int, hashes: int) -> DataFrame:
    """(node, label) of the classes (sig, key, least, n, marks, buckets) that are linked to another."""
    agree = least_agreement(percent, hashes)
    members = written(shared_buckets(alike), "members")
    sets = written(shingle_sets(members, alike, docs, gram), "sets")
    pairs = written(likely(written(star_candidates(members), "pairs"), alike, percent, agree, hashes), "likely")
    links = written(confirmed(pairs, sets, percent), "links")
    labels = written(stars(links), "components")
    links = written(remaining_links(members, labels, alike, sets, percent, agree, hashes), "links")
    if links.take(1):
        # a component is as good as its links
        labels = written(stars(links.union(labels.filter("node <> label"))), "components")
    dropped(sets)
    return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT, gram: int = GRAM, hashes: int = HASHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; words are runs without ASCII white space. A document's set holds its distinct shingles of
    ``gram`` words; with fewer words the whole sequence is one. Documents are linked where ``percent`` of the union of
    their sets is shared or more. component_id is the smallest id that links reach, the document's own included, and
    kept says whether that is its own. Null and blank texts have no shingles and are linked with nothing. Null ids
    count as the largest: a component of them alone has a null id and all are kept. Repeated rows are equal sets with
    one id, all kept or none. Other columns are not read; an empty table gives no rows. A pair at the threshold is
    missed with probability 1e-6 at most.
    """
    bands, per = banding(percent, hashes)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER).alias("text"))
    rows = keyed(slim, "doc_id", "text")
    signed = written(signatures(rows, bands, per, gram), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x")
    alike = signed.filter("sig is not null").groupBy("sig").agg(first, F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("buckets").alias("buckets"))
    alike = written(alike.select("sig", F.col("x.key").alias("key"), F.col("x.doc_id").alias("least"), "n", "marks", "buckets"), "alike")
    labels = link_classes(rows, alike, percent, gram, bands * per)
    named = alike.select("sig", "least").join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    named = written(named.select("sig", "least", F.coalesce("label", "sig").alias("label")), "named")
    least = written(named.groupBy("label").agg(F.min("least").alias("component_id")), "least")
    named = written(named.join(least, "label").select("sig", "component_id"), "classes")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(named, "sig", "left")
    component = F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
