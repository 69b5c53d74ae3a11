"""Text functions as column expressions: normalization, tokens, hashes, white space."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORMALIZATION_VERSION = "1.1"
TOKENIZER_VERSION = "1.0"
PREFIX_CHARS = 512
#: Tokens of Greek script only.
GREEK_RUN = "[Ͱ-Ͽἀ-῿]+"
_SEGMENT = r"([^\p{L}\p{N}]*)([\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*)"


def _dropped(version: str, mark: str) -> bool:
    """1.1 drops U+0300 to U+036F; 1.0 drops every combining mark but the iota subscript."""
    if version == "1.1":
        return 0x300 <= ord(mark) <= 0x36F
    return unicodedata.combining(mark) != 0 and mark != "ͅ"


@lru_cache
def accent_map(version: str = NORMALIZATION_VERSION) -> tuple[str, str]:
    """Arguments of ``translate``: characters that change, then marks that go, and what the former become.
    Built by decomposing each character up to U+2FFF, dropping marks and composing again."""
    if version not in ("1.0", "1.1"):
        raise ValueError(f"no normalization version {version}")
    source, target, gone = [], [], []
    for c in map(chr, [*range(0x20, 0x3000), *range(0xFE20, 0xFE30)]):
        if unicodedata.combining(c) or 0x300 <= ord(c) <= 0x36F:
            if _dropped(version, c):
                gone.append(c)
            continue
        kept = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if not _dropped(version, x)))
        if kept != c and len(kept) == 1:
            source.append(c)
            target.append(kept)
    return "".join(source) + "".join(gone), "".join(target)


def normalize(text: Column, version: str = NORMALIZATION_VERSION, strip: bool = False) -> Column:
    """Lower case without accents; null is empty. Built-in functions only, so it stays in generated code."""
    text = F.coalesce(text, F.lit(""))
    return F.translate(F.lower(F.trim(text) if strip else text), *accent_map(version))


def prefix_key(text: Column) -> Column:
    """What a table stores for prefix search: the first 512 characters of the normalized text."""
    return F.left(normalize(text), F.lit(PREFIX_CHARS))


def raw_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized_hash(text: Column) -> Column:
    return F.sha2(normalize(text), 256)


def greek_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(GREEK_RUN), F.lit(0))


def segments(text: Column) -> Column:
    """Each token with what stands between it and the one before."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SEGMENT), F.lit(0))


def token_texts(text: Column) -> Column:
    """Runs of letters and numbers with their marks."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SEGMENT), F.lit(2))


def running_totals(values: Column) -> Column:
    """The array of ints ``values`` summed up to and with each place: one pass over the numbers of an Arrow batch, so
    it is linear in a row's length and shuffles nothing. A null array stays null."""

    @F.arrow_udf("array<int>")
    def totals(lists: pa.Array) -> pa.Array:
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        sums = np.concatenate(([0], np.cumsum(flat)))
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        within = sums[1:] - np.repeat(sums[begins], ends - begins)
        offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(within.astype(np.int32)), mask=lists.is_null() if lists.null_count else None)

    return totals(values)


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token_index, start_offset, end_offset, token_text, token_normalized), offsets half-open in code points."""
    ends = running_totals(F.transform(segments(F.col(text)), lambda s: F.char_length(s)))
    rows = df.select(key, ends.alias("__end"), token_texts(F.col(text)).alias("__t"))
    rows = rows.select(key, F.posexplode(F.arrays_zip(F.col("__t").alias("t"), F.col("__end").alias("e"))).alias("token_index", "x"))
    rows = rows.select(key, "token_index", F.col("x.t").alias("token_text"), F.col("x.e").alias("end_offset"))
    return rows.select(key, "token_index", (F.col("end_offset") - F.char_length("token_text")).alias("start_offset"), "end_offset", "token_text", normalize(F.col("token_text")).alias("token_normalized"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def squash(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]+", " "))


def single_line(text: Column) -> Column:
    """Trimmed non-empty lines joined by a literal backslash and n."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"[\r\n]")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(" \t"))), lambda x: x != ""), "\\n")


def multi_line(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def clip(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def search_key(query: str | None, compat: bool = False) -> str:
    """A query as it meets the stored prefix. White space becomes one space; with ``compat`` it goes, as texts
    stored without spaces need."""
    source, target = accent_map()
    table = {ord(c): (target[i] if i < len(target) else None) for i, c in enumerate(source)}
    words = (query or "").lower().translate(table).split()
    return ("" if compat else " ").join(words)[:PREFIX_CHARS]


def dehyphenate(text: Column) -> Column:
    """Words that a line end cuts are joined again."""
    return F.regexp_replace(text, r"(?<=\p{L})-\s*\n\s*(?=\p{L})", "")
