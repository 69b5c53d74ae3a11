"""Jaccard join of documents on sets of word n-grams, by MinHash banding.

Bands and rows are chosen for a target recall at the threshold. Documents with the same n-gram set are
one text class; classes shuffle on their band hashes, and those that share one are compared on their
full n-gram sets. A pair is compared once, at the first band it shares. Band groups larger than
``CHUNK`` are dealt as pairs of chunks, so no task ever holds a large group, and what leaves a task is
per class the number of its links and one edge, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, dropped, partitions, slices, written
from quire.llm.hashing import Words, mix, windows, within

THRESHOLD, GRAM = 0.8, 5
CHUNK = 256


def banding(threshold: float = THRESHOLD, recall: float = 0.9995, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, for the fewest chance candidates, with which a pair at the
    threshold shares a band with probability ``recall`` or more and no more than ``hashes`` are needed."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("too few hashes for the recall")
    return best


def gram_sets(column, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, in one array, and where each text's begin. A text of
    fewer words than ``gram`` has one, all of them; a text without words has none."""
    words = Words(column)
    h = words.hashes()
    at, owner = within(words.first, gram)
    grams = windows(h, gram)[at] if len(at) else np.zeros(0, np.uint64)
    begins = np.searchsorted(owner, np.arange(len(words.n_words) + 1))
    out = []
    for i, n in enumerate(words.n_words.tolist()):
        if n >= gram:
            out.append(np.unique(grams[begins[i] : begins[i + 1]]))
        elif n:
            value = np.full(1, n, np.uint64)
            for k in range(words.first[i], words.first[i + 1]):
                value = mix(value * np.uint64(31) + h[k : k + 1])
            out.append(value)
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def signed(rows: DataFrame, bands: int, per: int, gram: int) -> DataFrame:
    """(doc_id, key, sig, n, bands): a 128-bit hash of the n-gram set, its size, and the band hashes; sig is
    null without words."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        factors = mix(np.arange(1, bands * per + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for batch in slices(batches, "text"):
            flat, begins = gram_sets(batch.column(1), gram)
            n = np.diff(begins)
            some = np.flatnonzero(n)
            sig = np.zeros((batch.num_rows, 2), np.uint64)
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            if len(some):
                starts = begins[some]
                sig[some, 0] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                sig[some, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x14057B7EF767814F)), starts)
                for b in range(bands):
                    key = np.full(len(some), b + 1, np.uint64)
                    for r in range(per):
                        key = mix(key * np.uint64(31) + np.minimum.reduceat(flat * factors[b * per + r], starts))
                    keys[some, b] = key
            raw = sig.tobytes()
            sigs = pa.array([raw[16 * i : 16 * i + 16] if n[i] else None for i in range(batch.num_rows)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sigs, pa.array(n), lists], names=["doc_id", "key", "sig", "n", "bands"])

    return rows.mapInArrow(run, f"doc_id {kind}, key long, sig binary, n long, bands array<long>")


def _units(batches: Iterator) -> Iterator[dict]:
    """Rows grouped by their first columns band, i, j, which arrive together: one dict of lists a unit."""
    unit, held = None, None
    for batch in batches:
        columns = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
        ids = list(zip(columns["band"], columns["bucket"], columns["i"], columns["j"], strict=True))
        at = 0
        while at < len(ids):
            to = at + 1
            while to < len(ids) and ids[to] == ids[at]:
                to += 1
            if ids[at] != unit:
                if held is not None:
                    yield held
                unit, held = ids[at], {name: [] for name in columns}
            for name, values in columns.items():
                held[name] += values[at:to]
            at = to
    if held is not None:
        yield held


def _owned(unit: dict, threshold: float) -> np.ndarray:
    """Which pairs (row < column) are compared in this unit: they share no earlier band, lie on both sides
    of a pair of chunks, and sizes allow the threshold."""
    bands = np.array(unit["bands"], np.int64)
    band, side, n = unit["band"][0], np.array(unit["side"]), np.array(unit["n"], float)
    own = np.triu(np.ones((len(n), len(n)), bool), 1)
    if unit["i"][0] != unit["j"][0]:
        own &= side[:, None] != side[None, :]
    own &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    for b in range(band):
        if not own.any():
            break
        own &= bands[:, b][:, None] != bands[None, :, b]
    return own


def _shared(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs in ``own``."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    pairs = np.argwhere(own)
    if len(pairs) <= 4 * m:
        for a, b in pairs:
            out[a, b] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(fresh) - 1
    often = np.bincount(column) > 1  # n-grams of one set alone count for no pair
    place = np.cumsum(often) - 1
    use = often[column]
    owner, column = owner[use], place[column[use]]
    for at in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, (at, at + 4096))
        dense = np.zeros((m, 4096), np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        out += (dense @ dense.T).astype(np.int64)
    return out


def similar(classes: DataFrame, docs: DataFrame, bands: int, threshold: float, gram: int, pairs: bool = False) -> DataFrame:
    """From text classes (sig, key, n, copies, bands): rows (sig, parent, n_links) of the classes with links,
    one for each unit of work, or with ``pairs`` every linked pair (sig, parent, jaccard)."""
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    slim = classes.select("sig", F.posexplode("bands").alias("band", "bucket"))
    groups = slim.groupBy("band", "bucket").agg(F.count("*").alias("m")).filter("m > 1")
    # most classes share no band: what the comparison needs of the others is joined once they are gone
    members = slim.join(groups, ["band", "bucket"]).join(classes.select("sig", "n", "bands"), "sig").withColumn("g", F.ceil(F.col("m") / CHUNK).cast("int"))
    members = members.withColumn("c", F.pmod(F.xxhash64("sig", "band"), F.col("g")).cast("int"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    units = members.select("band", "bucket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).cast("int").alias("side"), "sig", "n", "bands")
    unit = ["band", "bucket", "i", "j"]

    def choose(batches: Iterator) -> Iterator:
        """The members of each unit that have a pair to compare there."""
        import pyarrow as pa

        out: list[tuple] = []
        for u in _units(batches):
            own = _owned(u, threshold)
            for k in np.flatnonzero(own.any(0) | own.any(1)):
                out.append((u["band"][k], u["bucket"][k], u["i"][k], u["j"][k], u["side"][k], u["sig"][k]))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    import pyarrow as pa

    names = [*unit, "side", "sig"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    order = lambda df: df.repartition(parts, *unit).sortWithinPartitions(*unit)
    chosen = written(order(units).mapInArrow(choose, "band int, bucket long, i int, j int, side int, sig binary"), "chosen")

    def build(batches: Iterator) -> Iterator:
        for batch in slices(batches, "text"):
            flat, begins = gram_sets(batch.column(1), gram)
            grams = pa.array([flat[a:b].tobytes() for a, b in zip(begins, begins[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], names=["sig", "grams"])

    wanted = classes.join(chosen.select("sig").distinct(), "sig", "left_semi")
    # a document is known by its id and a hash of both: the hash alone could meet another's
    one = wanted.select(F.col("key").alias("__key"), F.col("least").alias("__id"), "sig")
    texts = docs.join(one, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))).dropDuplicates(["sig"]).select("sig", "text")
    sets = written(wanted.join(texts.mapInArrow(build, "sig binary, grams binary"), "sig").select("sig", "n", "copies", "bands", "grams"), "grams")

    def verify(batches: Iterator) -> Iterator:
        out: list[tuple] = []
        for u in _units(batches):
            own = _owned(u, threshold)
            n = np.array(u["n"], float)
            inter = _shared([np.frombuffer(x, np.uint64) for x in u["grams"]], own)
            inter = np.where(own, inter, 0)
            jaccard = inter / np.maximum(n[:, None] + n[None, :] - inter, 1)
            link = own & (jaccard >= threshold - 1e-9)
            if not link.any():
                continue
            sig = u["sig"]
            if pairs:
                out += [(sig[a], sig[b], float(jaccard[a, b])) for a, b in np.argwhere(link)]
            else:
                link |= link.T
                label = np.arange(len(n))
                while True:
                    low = np.minimum(label, np.where(link, label[None, :], len(n)).min(1))
                    if (low == label).all():
                        break
                    label = low
                copies = np.array(u["copies"], np.int64)
                out += [(sig[k], sig[label[k]], float((link[k] * copies).sum())) for k in np.flatnonzero(link.any(1))]
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), found, strict=True)], names=["sig", "parent", "value"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), found, strict=True)], names=["sig", "parent", "value"])

    found = [pa.binary(), pa.binary(), pa.float64()]
    work = order(chosen.join(sets, "sig").select(*unit, "side", "sig", "n", "copies", "bands", "grams"))
    out = written(work.mapInArrow(verify, "sig binary, parent binary, value double"), "links")
    dropped(chosen)
    dropped(sets)
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, key (a hash of id and text), class_id, n_links, n_copies.

    Documents are linked if the Jaccard similarity of their sets of ``gram``-word shingles is at least
    ``threshold``; words are runs without white space. class_id is the smallest id of a document's
    connected component, n_links the number of other rows it is linked to, copies included, n_copies the
    number of rows with the same set. A text of fewer words than ``gram`` is one shingle; null, empty
    and blank texts have no links and are classes of their own. A null id stays null; a class of null
    ids alone has a null class_id. Repeated rows are copies of each other. An empty table gives no rows.
    """
    bands, per = banding(threshold, recall)
    rows = keyed(docs, id_col, text_col)
    sign = written(signed(rows, bands, per, gram), "signed")
    alike = written(
        sign.filter("sig is not null")
        .groupBy("sig")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
        .select("sig", F.col("m.key").alias("key"), "n", "copies", "bands", F.col("m.doc_id").alias("least")),
        "alike",
    )
    links = similar(alike, rows, bands, threshold, gram)
    counted = links.groupBy("sig").agg(F.sum("value").cast("long").alias("links"))
    label = components(links.select(F.col("sig").alias("a"), F.col("parent").alias("b")))
    named = alike.select("sig", "copies", "least").join(label.withColumnRenamed("node", "sig"), "sig", "left").join(counted, "sig", "left")
    named = named.select("sig", "copies", "least", F.coalesce("label", "sig").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    # both sides of the join are tables, so that the rows of a large class can be split
    named = written(named, "named")
    least = written(named.groupBy("label").agg(F.min("least").alias("class_id")), "least")
    named = written(named.join(least, "label").select("sig", "label", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies")), "classes")
    out = sign.select("doc_id", "key", "sig").join(named, "sig", "left")
    alone = F.col("label").isNull()
    return out.select("doc_id", "key", "label", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one of each class stays: that with the smallest id (a null id first; of
    equal ids one). Rows without words all stay. Columns as in ``docs``."""
    found = classes(docs, threshold, gram, id_col=id_col, text_col=text_col)
    stay = found.filter("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("m")).select(F.col("m.key").alias("__stay"), F.col("m.doc_id").alias("__stay_id"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn("__key", F.xxhash64(F.col(id_col), text))
    blank = ~text.rlike("[^ \\t\\n\\x0B\\f\\r]")
    kept = rows.filter(~blank).join(stay, (F.col("__key") == F.col("__stay")) & F.col(id_col).eqNullSafe(F.col("__stay_id")), "left_semi").dropDuplicates(["__key", id_col])
    return kept.select(*docs.columns).unionByName(docs.filter(blank))
