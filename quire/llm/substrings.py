"""Removal of repeated passages, by difference-cover anchors.

A window is ``size`` consecutive words of one document. Each word that lies in a window whose words
also start earlier (smaller id, or earlier in the same document) goes. The positions with p modulo
``PERIOD`` in ``COVER`` are a difference cover: whatever the distance of two equal windows, there is
an offset below the period at which both have a cover position. So hashing only the shorter windows
of ``size - PERIOD + 1`` words at cover positions finds an anchor in every repeated window; around
anchors that occur twice the match is extended to full windows, which are compared by 96-bit hashes.

Rows move in blocks: a task gathers what goes to one partition into a few binary arrays. What repeats
within a task is settled there and goes straight to its documents; one place of it goes to the partition
of its hash, so a passage in a third of all documents reaches that partition once per block of FLUSH
entries, not once per document. The number of partitions follows the size of the input's files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import partitions, slices
from quire.llm.hashing import Words, windows, within

SIZE = 20
#: A perfect difference set: every distance modulo the period is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: A task sends its blocks off after so many entries.
FLUSH = 1 << 19
BLOCK = "part int, rows binary, docs binary"


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _unpack(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    """The columns of several blocks, each joined."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]


def _batch(part, rows, docs):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(rows, pa.binary()), pa.array(docs, pa.binary())], names=["part", "rows", "docs"])


def _groups(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, its rows) for each partition that has any."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for mine in np.split(order, cut):
        if len(mine):
            yield int(part[mine[0]]), mine


def _gathered(blocks: DataFrame, n: int, settle, schema: str) -> DataFrame:
    """Deal blocks to their partitions and run ``settle(rows, docs)`` on each partition's."""

    def run(batches: Iterator) -> Iterator:
        rows, docs = [], []
        for batch in batches:
            rows += batch.column(1).to_pylist()
            docs += batch.column(2).to_pylist()
        if rows:
            yield from settle(rows, docs)

    return blocks.repartitionById(n, F.col("part")).mapInArrow(run, schema)


def _settled(blocks: DataFrame, n: int, settle) -> DataFrame:
    """Deal blocks to their partitions, run ``settle(rows, docs)`` on each partition's, and pass on to their documents
    the entries of blocks that were settled before (partition -1), which are dealt evenly."""

    def run(batches: Iterator) -> Iterator:
        rows, docs, done = [], [], []
        for batch in batches:
            for p, r, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p >= 0:
                    rows.append(r)
                    docs.append(d)
                    continue
                done.append(r)
                if sum(map(len, done)) > 12 * FLUSH:
                    yield from _to_documents(*_unpack(done, "<i8", "<i4"), n)
                    done = []
        if done:
            yield from _to_documents(*_unpack(done, "<i8", "<i4"), n)
        if rows:
            yield from settle(rows, docs)

    part = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.pmod(F.xxhash64("rows"), F.lit(n)).cast("int"))
    return blocks.repartitionById(n, part).mapInArrow(run, BLOCK)


def _places(name: str, blocks: DataFrame, n: int) -> DataFrame:
    """(key, name): per document all its places, from blocks of (document key, place)."""

    def settle(rows: list[bytes], _) -> Iterator:
        import pyarrow as pa

        key, place = _unpack(rows, "<i8", "<i4")
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.concatenate((begins[1:], [len(key)]))
        for at in range(0, len(begins), 4096):
            some = slice(at, at + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(key[begins[some]]), pa.array([place[a:b].tobytes() for a, b in zip(begins[some], ends[some], strict=True)], pa.binary())], names=["key", name])

    return _gathered(blocks, n, settle, f"key long, {name} binary")


def _to_documents(key: np.ndarray, place: np.ndarray, n: int) -> Iterator:
    """Blocks of (document key, place), one for each partition."""
    part = (key.view(np.uint64) % np.uint64(n)).astype(np.int32)
    for p, mine in _groups(part):
        yield _batch([p], [_pack(key[mine], place[mine])], [b""])


def repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, starts): per document, under xxhash64 of its id and text, the windows that also start earlier.

    ``docs`` has doc_id (a long), text and key."""
    if size < PERIOD:
        raise ValueError(f"a window has {PERIOD} words or more")
    n = partitions(docs.sparkSession, docs)
    span = size - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches: Iterator) -> Iterator:
        """Blocks of (hash, key, place, seen twice), one place of each hash; all places of those that the block itself
        has twice go to their documents, in blocks of partition -1."""
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator:
            h, key, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            same = h[order][1:] == h[order][:-1]
            first, twice = np.ones(len(h), bool), np.zeros(len(h), bool)
            first[order[1:][same]] = False
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            again = np.flatnonzero(twice)
            if len(again):
                yield _batch([-1], [_pack(key[again], place[again])], [b""])
            once = np.flatnonzero(first)  # as read: a document's key repeats, which compresses
            part = ((h[once] >> np.uint64(32)) % np.uint64(n)).astype(np.int32)
            for p, mine in _groups(part):
                mine = once[mine]
                yield _batch([p], [_pack(h[mine].astype("<u4"), key[mine], place[mine], twice[mine].astype("u1"))], [b""])

        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            at, owner = within(words.first, span)
            place = at - words.first[owner]
            good = in_cover[place % PERIOD] & (words.n_words[owner] >= size)
            at, owner, place = at[good], owner[good], place[good]
            if len(at):
                held.append((windows(words.hashes(), span)[at], keys[owner], place.astype("<i4")))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def shared(rows: list[bytes], _) -> Iterator:
        """Anchors that occur in several blocks; those that were seen twice in one are with their documents."""
        h, key, place, twice = _unpack(rows, "<u4", "<i8", "<i4", "u1")
        order = np.argsort(h, kind="stable")
        same = np.concatenate(([False], h[order][1:] == h[order][:-1], [False]))
        found = order[(same[1:] | same[:-1]) & (twice[order] == 0)]
        yield from _to_documents(key[found], place[found], n)

    anchored = _places("places", _settled(docs.select("doc_id", "text", "key").mapInArrow(anchors, BLOCK), n, shared), n)

    def extend(batches: Iterator) -> Iterator:
        """Blocks of (hash, check, document's number in the block, start) with the block's documents (id, key);
        windows that a task itself has earlier are settled, and come with partition -1."""
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator:
            h, c, ids, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((start, key, ids, c, h))
            h, c, ids, key, start = (x[order] for x in (h, c, ids, key, start))
            late = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & ((ids[1:] != ids[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1]))))
            # a repeated row's window equals the one before it: late if that one is
            same = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1]) & ~late[1:]))
            if same.any():
                base = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
                late |= late[base]
            settled, open_ = np.flatnonzero(late), np.flatnonzero(~late & ~same)
            if len(settled):
                yield _batch([-1], [_pack(key[settled], start[settled])], [b""])
            part = ((h[open_] >> np.uint64(20)) % np.uint64(n)).astype(np.int32)
            for p, mine in _groups(part):
                mine = np.sort(open_[mine])
                mine = mine[np.lexsort((start[mine], key[mine], ids[mine]))]  # by place, which compresses
                docs_, number = np.unique(np.rec.fromarrays((ids[mine], key[mine])), return_inverse=True)
                yield _batch([p], [_pack(h[mine], c[mine], number.astype("<u4"), start[mine])], [_pack(docs_.f0, docs_.f1)])

        for batch in slices(batches, "text"):
            words = Words(batch.column(1))
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            blobs = batch.column(3).to_pylist()
            places = np.frombuffer(b"".join(blobs), "<i4").astype(np.int64) + np.repeat(words.first[:-1], [len(x) // 4 for x in blobs])
            at, owner = within(words.first, size)
            # a window is a candidate if an anchor starts at one of its first PERIOD words
            marks = np.zeros(int(words.first[-1]) + 1, np.int32)
            marks[places + 1] = 1
            marks = np.cumsum(marks)
            good = marks[at + PERIOD] > marks[at]
            at, owner = at[good], owner[good]
            if len(at):
                h = words.hashes()
                held.append((windows(h, size)[at], windows(h, size, 1)[at].astype("<u4"), ids[owner], keys[owner], (at - words.first[owner]).astype("<i4")))
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def later(rows: list[bytes], more: list[bytes]) -> Iterator:
        """All but the first window of each hash."""
        sizes = [len(x) // 16 for x in more]
        h, c, number, start = _unpack(rows, "<u8", "<u4", "<u4", "<i4")
        ids, key = _unpack(more, "<i8", "<i8")
        base = np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), [len(x) // 20 for x in rows]).astype(np.int64)
        number = base + number
        ids, key = ids[number], key[number]
        order = np.lexsort((start, key, ids, c, h))
        h, c, ids, key, start = (x[order] for x in (h, c, ids, key, start))
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        late = (ids != ids[lead]) | (key != key[lead]) | (start != start[lead])
        yield from _to_documents(key[late], start[late], n)

    candidates = docs.join(anchored, "key").select("doc_id", "text", "key", "places").mapInArrow(extend, BLOCK)

    return _places("starts", _settled(candidates, n, later), n)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id as a long (null: the smallest), text (null: empty) and the document's key."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return slim.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def strip(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """All columns of ``docs``, then n_words, n_removed and kept (the words that stay, joined by one space).

    Ids are integers; a null id comes before all others. A null text has no words. Rows with the same id
    but other texts are told apart by a hash of the text; rows that repeat id and text are one document,
    which does not repeat itself, and get the same result. Texts of fewer than ``size`` words stay whole.
    An empty table gives no rows. The new columns carry ``prefix``, so that names need not clash.
    """
    own = [f"__q{i}" for i in range(len(docs.columns))]
    names = [prefix + x for x in ("n_words", "n_removed", "kept")]
    key_docs = keyed(docs, id_col, text_col)
    found = repeats(key_docs, size)
    position = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    i, t = own[position[id_col]], own[position[text_col]]
    whole = docs.toDF(*own)
    extra = [c for c in own if c != t]
    if extra == [i]:  # the same rows as above, so their exchange is used again
        base = key_docs
    else:
        base = whole.select(*extra, F.coalesce(F.col(t).cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64(F.coalesce(F.col(i).cast("long"), F.lit(-(1 << 63))), "text"))
    rows = base.join(found, "key", "left")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from itertools import compress

        for batch in slices(batches, "text"):
            n = batch.num_columns - 2
            counts, removed, kept = [], [], []
            for text, starts in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                words = text.encode().split()
                gone = 0
                counts.append(len(words))
                if starts:
                    change = np.zeros(len(words) + 1, np.int32)
                    at = np.frombuffer(starts, "<i4")
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size, -1)
                    stay = np.cumsum(change)[:-1] == 0
                    gone = len(words) - int(stay.sum())
                    words = list(compress(words, stay.tolist()))
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*columns, "text", *("a", "b", "c")])

    if extra == [i]:
        columns = [i]
        rows = rows.select(F.nullif("doc_id", F.lit(-(1 << 63))).cast(docs.schema[id_col].dataType).alias(i), "text", "starts")
    else:
        columns = extra
        rows = rows.select(*extra, "text", "starts")
    kinds = dict(zip(own, (f.dataType.simpleString() for f in docs.schema), strict=True))
    done = rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in columns), "text string, a long, b long, c string"]))
    return done.select(*(F.col("text" if c == t else c) for c in own), "a", "b", "c").toDF(*docs.columns, *names)
