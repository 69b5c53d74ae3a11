"""Quality rules with n-gram perplexity bands.

The language model is a modified Kneser-Ney model over the bytes of the texts, one per language,
counted by Spark over all documents: n-grams of LONG bytes, which is about a word with its space.
N-grams of the highest order are counted per task and summed; everything below follows from the
distinct n-grams with joins and sums. The finished model is a table with a row for each distinct
n-gram, so it grows with the corpus. Tasks hold PART rows of it at a time, as sorted arrays of
invertible hashes: no two n-grams share one. A larger model is scored part by part, and the sums
are added. A document is rejected if the log of its perplexity, by the whole n-grams or
by their last ORDER bytes, leaves the band of its language, which is taken from quantiles over
all documents of that language that pass the base rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import dropped, slices, written
from quire.llm.hashing import text_buffer

ORDER = 4
LONG = 6
#: N-grams of the model that a task holds at a time, 16 bytes each and up to 8 in the index.
PART = 1 << 22
#: Rows of a part that the driver fetches at a time.
PIECE = 1 << 19
#: Up to so many languages a table of one row each is broadcast; beyond, it is shuffled.
MANY_LANGUAGES = 10_000
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; zeros for null."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes], size: int = 3) -> int:
    """Words in windows of ``size`` words found twice or more in the text, the first place included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    code = ids[:n]
    for k in range(1, size):  # exact: renumbered whenever the product could overflow
        if (int(code.max()) + 1) * len(number) >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(number) + ids[k : k + n]
    order = np.sort(code)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.searchsorted(twice, code)
    at[at == len(twice)] = 0
    hit = twice[at] == code
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + n] |= hit
    return int(covered.sum())


def padded(column, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with order - 1 line feeds before, between and after, so that no n-gram has bytes of two
    texts, and the end of each text with its line feeds."""
    data, ends = text_buffer(column, order - 1)
    return np.concatenate((np.full(order - 1, 0x0A, np.uint8), data)), ends


def codes(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as a number of ``order`` bytes."""
    n = len(data) - order + 1
    kind = np.uint32 if order <= 4 else np.uint64
    out = np.zeros(max(n, 0), kind)
    for k in range(order):
        out <<= kind(8)
        out |= data[k : k + n]
    return out


def count_ngrams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, code, n): how often each n-gram of the highest order stands in all texts of a language.

    Each text stands between line feeds, so the counts do not depend on how texts are dealt; a task merges
    its counts as it goes and gives each n-gram once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}

        def merge(lang: str) -> None:
            found, n = np.unique(np.concatenate(fresh.pop(lang)), return_counts=True)
            if lang in held:
                both, back = np.unique(np.concatenate((held[lang][0], found)), return_inverse=True)
                found, n = both, np.bincount(back, np.concatenate((held[lang][1], n))).astype(np.int64)
            held[lang] = found, n.astype(np.int64)

        for batch in slices(batches, "text"):
            langs = pc.fill_null(batch.column(0), "")
            for lang in pc.unique(langs).to_pylist():
                fresh.setdefault(lang, []).append(codes(padded(batch.column(1).filter(pc.equal(langs, lang)), order)[0], order))
                if sum(map(len, fresh[lang])) > 4 << 20:
                    merge(lang)
        for lang in list(fresh):
            merge(lang)
        for lang, (found, n) in held.items():
            for at in range(0, len(found), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(found[part])), pa.array(found[part].astype(np.int64)), pa.array(n[part])], names=["lang", "code", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _hash(lang: Column, code: Column, order: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(lang, code), 1)


def _discounts(grams: DataFrame) -> DataFrame:
    """Per language the three discounts of modified Kneser-Ney from the counts of counts; where a count of
    counts is 0 the discount is that of absolute discounting by a half."""
    n = [F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = lambda k: F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(0.5)).alias(f"d{k}")
    return grams.groupBy("lang").agg(*n).select("lang", d(1), d(2), d(3))


def _smoothed(counts: DataFrame, top: int) -> tuple[dict[int, DataFrame], dict[int, DataFrame], list[DataFrame]]:
    """Per order (lang, tail, below, short): the interpolated probability of each n-gram and that of its last ORDER
    bytes; per order of a context (lang, ctx, bow); the tables that both are read from. Lower orders count
    distinct left neighbours."""
    grams = {top: counts}
    for order in range(top - 1, 0, -1):
        tails = grams[order + 1].select("lang", F.expr(f"code & {(1 << 8 * order) - 1}").alias("code"))
        grams[order] = written(tails.groupBy("lang", "code").agg(F.count("*").alias("n")), f"grams{order}")  # read three times
    few = counts.select("lang").distinct().limit(MANY_LANGUAGES + 1).count() <= MANY_LANGUAGES
    small = F.broadcast if few else (lambda df: df)  # a row a language
    found, contexts = {}, {}
    for order in range(1, top + 1):
        g = grams[order].join(small(_discounts(grams[order])), "lang").withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        g = g.select("lang", "code", "n", "d", F.expr("code >> 8").alias("ctx"), F.expr(f"code & {(1 << 8 * (order - 1)) - 1}").alias("tail"))
        ctx = g.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("mass")).withColumn("bow", F.col("mass") / F.col("total"))
        contexts[order - 1] = ctx.select("lang", "ctx", "bow")
        g = g.join(ctx, ["lang", "ctx"])
        rest = F.lit(1 / 256)
        if order > 1:  # the tail of every n-gram is counted, so it is there
            g, rest = g.join(found[order - 1], ["lang", "tail"]), F.col("below")
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("bow") * rest
        lower = g.select("lang", F.col("code").alias("tail"), p.alias("below"), (p if order <= ORDER else F.col("short")).alias("short"))
        found[order] = written(lower, f"kn{order}") if order < top else lower
    return found, contexts, [*grams.values(), *(found[k] for k in range(1, top))]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(order, slot, logp, logb) for n-grams of ORDER bytes: log probabilities of all n-grams and log back-off weights
    of all contexts, by their full hashes."""
    found, contexts, _ = _smoothed(counts, ORDER)
    none = F.lit(None).cast("double")
    parts = [c.select(F.lit(k).alias("order"), _hash(F.col("lang"), F.col("ctx"), k).alias("slot"), none.alias("p"), "bow") for k, c in contexts.items()]
    parts += [g.select(F.lit(k).alias("order"), _hash(F.col("lang"), F.col("tail"), k).alias("slot"), F.col("below").alias("p"), none.alias("bow")) for k, g in found.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("order", "slot").agg(F.log(F.max("p")).cast("float").alias("logp"), F.log(F.max("bow")).cast("float").alias("logb"))


@dataclass
class Model:
    """Per order the sorted hashes and, aligned with them, log probabilities and log back-off weights: the model of
    ORDER bytes in one process, for a small corpus and for texts that were not counted."""

    orders: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def find(self, order: int, slot: np.ndarray) -> np.ndarray:
        """Places in the sorted array, -1 where there is none."""
        keys = self.orders[order][0]
        if not len(keys):
            return np.full(len(slot), -1)
        at = np.minimum(np.searchsorted(keys, slot), len(keys) - 1)
        return np.where(keys[at] == slot, at, -1)

    def log_probability(self, lang: str, data: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """Of each byte after the first ORDER - 1 given those before it; in blocks, so temporaries stay small."""
        n = max(len(data) - ORDER + 1, 0)
        parts = [self._log_probability(lang, codes(data[at : min(at + block, n) + ORDER - 1]).astype(np.int64)) for at in range(0, n, block)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def _log_probability(self, lang: str, full: np.ndarray) -> np.ndarray:
        out = np.zeros(len(full), np.float32)
        open_ = np.arange(len(full))
        for order in range(ORDER, 0, -1):
            code = full[open_] & ((1 << 8 * order) - 1)
            at = self.find(order, hash_codes(lang, code, order))
            hit = at >= 0
            if not len(self.orders[order][1]):
                continue
            logp = self.orders[order][1][at]
            hit &= np.isfinite(logp)
            out[open_[hit]] += logp[hit]
            open_ = open_[~hit]
            if not len(open_):
                return out
            ctx = (full[open_] & ((1 << 8 * order) - 1)) >> 8
            at = self.find(order - 1, hash_codes(lang, ctx, order - 1))
            if len(self.orders[order - 1][2]):
                logb = np.where(at >= 0, self.orders[order - 1][2][at], 0)
                out[open_] += np.where(np.isfinite(logb), logb, 0)
        out[open_] += math.log(1 / 256)
        return out


_PRIME = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]


def hash_codes(lang: str, code: np.ndarray, order: int) -> np.ndarray:
    """The slot of each n-gram: Spark's xxhash64(lang, code) without its last bit, in numpy."""
    import xxhash

    u = np.uint64
    p1, p2, p3, p4, p5 = map(u, _PRIME)
    seed = u(xxhash.xxh64_intdigest(lang.encode(), seed=42))
    rot = lambda x, k: (x << u(k)) | (x >> u(64 - k))
    with np.errstate(over="ignore"):
        h = seed + p5 + u(8)
        k1 = rot(code.astype(u) * p2, 31) * p1
        h = rot(h ^ k1, 27) * p1 + p4
        h ^= h >> u(33)
        h *= p2
        h ^= h >> u(29)
        h *= p3
        h ^= h >> u(32)
    return (h >> u(1)).astype(np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count, smooth, and gather the arrays of all n-grams of ORDER bytes: for a small corpus."""
    rows = written(kneser_ney(written(count_ngrams(docs, text_col, lang_col), "ngrams")), "model")
    out = {}
    for k in range(ORDER + 1):  # one order at a time
        arrays = rows.filter(F.col("order") == k).select("slot", "logp", "logb").orderBy("slot").toArrow()
        out[k] = tuple(np.array(c, kind) for c, kind in zip(arrays.columns, (np.int64, np.float32, np.float32), strict=True))
    return Model(out)


class Part:
    """A part of the model: per language the hashes of distinct n-grams, sorted, and aligned with them the log
    probabilities of all their bytes and of the last ORDER. The hash is a bijection, so no two n-grams share one;
    an index by its first bits, made once a process, says where to look."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.arrays: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.index: dict[str, tuple[np.ndarray, np.uint64]] = {}
        for lang in list(grams):
            keys, logs = grams.pop(lang)
            h = scrambled(keys)
            order = np.argsort(h)
            self.arrays[lang] = h[order], logs[order]

    def __getstate__(self) -> dict:
        return {"arrays": self.arrays, "index": {}}

    def _begins(self, lang: str) -> tuple[np.ndarray, np.uint64]:
        """Where the hashes of each bucket begin, and how far a hash is shifted to give its bucket."""
        if lang not in self.index:
            hashes = self.arrays[lang][0]
            bits = max(4, len(hashes).bit_length())
            counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            self.index[lang] = np.concatenate(([0], np.cumsum(counts))).astype(np.int32), np.uint64(64 - bits)
        return self.index[lang]

    def logs(self, lang: str, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram the two log probabilities, and whether it is in this part; zeros if not."""
        out, hit = np.zeros((len(code), 2), np.float32), np.zeros(len(code), bool)
        if lang not in self.arrays or not len(self.arrays[lang][0]):
            return out, hit
        hashes, values = self.arrays[lang]
        begins, shift = self._begins(lang)
        h = scrambled(code)
        bucket = (h >> shift).astype(np.int64)
        at, stop, left = begins[bucket], begins[bucket + 1], None
        while True:  # a bucket has one hash on average
            go = at < stop
            at, stop, left = at[go], stop[go], np.flatnonzero(go) if left is None else left[go]
            if not len(left):
                return out, hit
            same = hashes[at] == h[left]
            hit[left[same]] = True
            out[left[same]] = values[at[same]]
            at, stop, left = at[~same] + 1, stop[~same], left[~same]


def scrambled(code: np.ndarray) -> np.ndarray:
    """An invertible hash: an odd factor modulo 2**64."""
    return code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(part, lang, code, long, short): the two log probabilities of every distinct n-gram of LONG bytes in ``docs``, dealt
    into as many parts of about PART rows as there have to be."""
    counts = written(count_ngrams(docs, text_col, lang_col, LONG), "ngrams")
    n = -(-counts.count() // PART) or 1
    found, _, tables = _smoothed(counts, LONG)
    top = found[LONG].withColumnRenamed("tail", "code")
    part = F.pmod(F.xxhash64("lang", "code"), F.lit(n)).cast("int").alias("part")
    model = written(top.select(part, "lang", "code", F.log("below").cast("float").alias("long"), F.log("short").cast("float").alias("short")), "model")
    for table in tables:
        dropped(table)
    return model


def gathered(model: DataFrame, part: int, n_rows: int) -> Part:
    """One part of ``n_rows`` rows, fetched in pieces of about PIECE, so that the driver holds little beside it."""
    import pyarrow as pa

    found: dict[str, list] = {}
    rows = model.filter(F.col("part") == part).drop("part")
    pieces = -(-n_rows // PIECE)
    for k in range(pieces):
        got = rows.filter(F.pmod(F.xxhash64("code", "lang"), F.lit(pieces)) == k).toArrow()
        if not got.num_rows:
            continue
        langs = got["lang"].combine_chunks().dictionary_encode()
        if isinstance(langs, pa.ChunkedArray):
            langs = langs.combine_chunks()
        names, number = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        code, logs = got["code"].to_numpy().astype(np.uint64), np.stack((got["long"].to_numpy(), got["short"].to_numpy()), 1)
        order = np.argsort(number, kind="stable")
        ends = np.cumsum(np.bincount(number, minlength=len(names)))
        for name, a, b in zip(names, np.concatenate(([0], ends[:-1])), ends, strict=True):
            found.setdefault(name, []).append((code[order[a:b]], logs[order[a:b]]))
    return Part({lang: (np.concatenate([c for c, _ in x]), np.concatenate([v for _, v in x])) for lang, x in found.items()})


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, short_perplexity double"
SUMS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double, short_perplexity double, found long, grams long"


def sums(docs: DataFrame, part: Part, text_col: str, lang_col: str, prefix: str) -> DataFrame:
    """All columns of ``docs``, the base counts, the sums of the two log probabilities (negative, over the bytes) as far
    as the n-grams are in ``part``, how many are, and how many there are. Null for empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(part)
    names = [prefix + x.split()[0] for x in SUMS.split(", ")]
    own = [f"__q{i}" for i in range(len(docs.columns))]  # clashing names cannot meet

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in slices(batches, "text"):
            n = batch.num_columns - 2
            texts, langs = batch.column(n), pc.fill_null(batch.column(n + 1), "")
            counts = np.array([base_counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, 5)
            logs, seen = np.full((batch.num_rows, 2), np.nan), np.zeros((batch.num_rows, 2), np.int64)
            size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for lang in pc.unique(langs).to_pylist():
                mine = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False) & (size > 0))
                if len(mine):
                    data, ends = padded(texts.take(pa.array(mine)), LONG)
                    begins, stops = np.concatenate(([0], ends[:-1])), ends - (LONG - 1)
                    total, hits = np.zeros((len(mine), 2)), np.zeros(len(mine), np.int64)
                    code = codes(data, LONG)
                    at = 0
                    while at < len(mine):  # runs of texts, a long one in blocks: temporaries stay small
                        to = max(at + 1, int(np.searchsorted(ends, begins[at] + (1 << 18), side="right")))
                        for a in range(begins[at], stops[to - 1], 1 << 18):
                            b = min(a + (1 << 18), stops[to - 1])
                            got, hit = shared.value.logs(lang, code[a:b])
                            up = np.concatenate((np.zeros((1, 2)), np.cumsum(got, axis=0, dtype=np.float64)))
                            many = np.concatenate(([0], np.cumsum(hit)))
                            x, y = np.clip(begins[at:to], a, b) - a, np.clip(stops[at:to], a, b) - a
                            total[at:to] += up[x] - up[y]
                            hits[at:to] += many[y] - many[x]
                        at = to
                    logs[mine], seen[mine] = total / (stops - begins)[:, None], np.stack((hits, stops - begins), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(counts[:, i]) for i in range(5)), *(pa.array(logs[:, i], mask=np.isnan(logs[:, i])) for i in (0, 1)), *(pa.array(seen[:, i]) for i in (0, 1))], names=own + names)

    schema = ", ".join([*(f"{o} {f.dataType.simpleString()}" for o, f in zip(own, docs.schema, strict=True)), *(f"{x} {y.split()[1]}" for x, y in zip(names, SUMS.split(", "), strict=True))])
    given = docs.toDF(*own)
    position = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    rows = given.select("*", F.col(own[position[text_col]]).cast("string").alias("text"), F.col(own[position[lang_col]]).cast("string").alias("lang"))
    return rows.mapInArrow(run, schema).toDF(*docs.columns, *names)


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", lang_col: str = "lang", prefix: str = "") -> DataFrame:
    """All columns of ``docs``, then the base counts and the log perplexities per byte (null for empty texts), named
    with ``prefix``. A part of the model is broadcast at a time; with more than one, the sums of the later parts
    are added by text and language. An n-gram that is in no part is an error."""
    names = [prefix + x.split()[0] for x in STATS.split(", ")]
    size = dict(model.groupBy("part").count().collect())  # a row for each PART n-grams
    n = max(size, default=0) + 1
    rows = sums(docs, gathered(model, 0, size.get(0, 0)), text_col, lang_col, prefix)
    logs, found, grams = names[-2:], f"{prefix}found", f"{prefix}grams"
    if n > 1:
        key = lambda text, lang: [F.coalesce(F.md5(F.col(text).cast("string")), F.lit("")).alias("__key"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("__key_lang")]
        more = None
        for k in range(1, n):
            got = sums(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), gathered(model, k, size.get(k, 0)), "text", "lang", "__")
            got = got.filter("__grams > 0").select(*key("text", "lang"), "__log_perplexity", "__short_perplexity", "__found")
            got = written(got.groupBy("__key", "__key_lang").agg(*(F.first(c).alias(c) for c in got.columns[2:])), "sums")
            more = got if more is None else more.union(got)
        more = more.groupBy("__key", "__key_lang").agg(*(F.sum(c).alias(c) for c in more.columns[2:]))
        rows = rows.select("*", *key(text_col, lang_col)).join(more, ["__key", "__key_lang"], "left")
        add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
        extra = {logs[0]: add(logs[0], "__log_perplexity"), logs[1]: add(logs[1], "__short_perplexity"), found: add(found, "__found")}
        rows = rows.select(*docs.columns, *(extra.get(c, F.col(c)) for c in [*names, found, grams]))
    whole = F.when(F.col(found) == F.col(grams), F.col(logs[0])).otherwise(F.raise_error(F.lit("a text has n-grams that were not counted")).cast("double"))
    return rows.select(*docs.columns, *names[:-2], F.when(F.col(logs[0]).isNotNull(), whole).alias(logs[0]), logs[1])


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def bands(scores: DataFrame, spread: float = 4.0, of: str = "log_perplexity", low_share: float = 0.25) -> DataFrame:
    """(__band_lang, __low, __high): per language the median of the column ``of``, minus and plus ``spread`` robust
    standard deviations of its own side (from the quartile there, below from the quantile ``low_share``); over all documents that pass the base rules.
    A side whose quartile is the median takes the other side's deviation. A language without spread, or without
    such documents, has no band, and keeps what passes the base rules."""
    good = scores.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")) & F.col(of).isNotNull())
    # exact quartiles of values in steps of a ten-thousandth: a row per language and step, however many documents
    steps = good.groupBy(F.coalesce("lang", F.lit("")).alias("__band_lang"), F.round(F.col(of) * 10_000).cast("long").alias("x")).agg(F.count("*").alias("n"))
    lang = Window.partitionBy("__band_lang")
    steps = steps.withColumn("upto", F.sum("n").over(lang.orderBy("x"))).withColumn("all", F.sum("n").over(lang))
    q = [F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("x"))).alias(f"q{i}") for i, share in enumerate((low_share, 0.5, 0.75))]
    rows = steps.groupBy("__band_lang").agg(*q).withColumn("below", F.expr(f"nullif(q1 - q0, 0) / {-NormalDist().inv_cdf(low_share)}")).withColumn("above", F.expr("nullif(q2 - q1, 0) / 0.6745"))
    wide = lambda side, other: spread * F.coalesce(side, other) / 10_000
    return rows.select("__band_lang", (F.col("q1") / 10_000 - wide("below", "above")).alias("__low"), (F.col("q1") / 10_000 + wide("above", "below")).alias("__high"))


def both_bands(scores: DataFrame) -> DataFrame:
    """``bands`` of the log perplexity, and as __short_low and __short_high those of its short form. Texts that share
    passages are easily predicted: where they are a tenth of a language, they are inside."""
    short = bands(scores, of="short_perplexity", low_share=0.1).toDF("__band_lang", "__short_low", "__short_high")
    return bands(scores, low_share=0.1).join(short, "__band_lang")


def _inside(limits: DataFrame, prefix: str = "") -> Column:
    """Inside all bands that ``limits`` has; what has no band is."""
    inside = F.coalesce(F.col(f"{prefix}log_perplexity").between(F.col("__low"), F.col("__high")), F.lit(True))
    if "__short_low" in limits.columns:
        inside &= F.coalesce(F.col(f"{prefix}short_perplexity").between(F.col("__short_low"), F.col("__short_high")), F.lit(True))
    return inside


def judged(scores: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    rows = scores.join(limits, F.coalesce(scores["lang"], F.lit("")) == limits["__band_lang"], "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & _inside(limits)).drop(*limits.columns)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    log_perplexity. A null text has no words and fails the base rules; a null language is the language ''.
    Repeated rows are judged each and alike; an empty table gives no rows; other columns are not read."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    scores = written(score(slim, learn(slim)).drop("text"), "scores")
    return judged(scores, written(both_bands(scores), "bands")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns and no others. Texts are scored twice, for the
    bands and for the verdicts, rather than shuffled; nulls and empty tables as in ``assess``."""
    slim = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = learn(slim)
    scores = written(score(slim, model).drop("text"), "scores")
    limits = written(both_bands(scores), "bands")
    dropped(scores)
    scored = score(docs, model, text_col, lang_col, "__s_")
    failed = base_failed(F.col("__s_n_words"), F.col("__s_n_repeat_words"))
    rows = scored.join(limits, F.coalesce(F.col(lang_col), F.lit("")) == F.col("__band_lang"), "left")
    return rows.filter(~failed & _inside(limits, "__s_")).select(*docs.columns)
