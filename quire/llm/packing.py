"""Packing by power-of-two decomposition.

A document's ids, with the end-of-text id, are cut into pieces of binary lengths: as many of the
longest as fit, then the set bits of the rest from the highest down. Every piece is a sequence of
its own, so none crosses documents and none is padded; training draws batches from one length's
bucket at a time. No shuffle is needed: a document's pieces depend on that document alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, texts

_LOADED: dict = {}


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by rule: bytes that print stand for
    themselves, the others take the characters from U+0100 on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file, run by tiktoken, which gives the same ids several times
    faster. Ids follow the merge order in such files, so they serve as ranks."""
    if path not in _LOADED:
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_characters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _LOADED[path]


def token_ids(path: str, text: str):
    """The ids of a text. tiktoken's pattern fails on white space of about a million characters, which it follows
    backwards; such a text goes to ``tokenizers`` itself, at its speed."""
    import numpy as np

    try:
        return encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        from tokenizers import Tokenizer

        if (path, "library") not in _LOADED:
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            _LOADED[path, "library"] = library
        return np.array(_LOADED[path, "library"].encode(text, add_special_tokens=False).ids, np.uint32)


def piece_lengths(n: int, longest: int) -> list[int]:
    """Binary lengths that sum to n, longest first."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer_path: str, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    ``longest`` is a power of two. A null text counts as empty: its document is the end id alone, one
    piece of length 1. Repeated rows are packed each for itself, null ids stay null, an empty table
    gives no rows, and other columns are not read. ``sequence_id`` is unique to a piece and offset is 0.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            owner, starts, lengths, totals, blobs = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(token_ids(tokenizer_path, text or ""), np.uint32(end_id)).astype("<u4")
                raw, at = ids.tobytes(), 0
                for n in piece_lengths(len(ids), longest):
                    owner.append(i)
                    starts.append(at)
                    lengths.append(n)
                    totals.append(len(ids))
                    blobs.append(raw[4 * at : 4 * (at + n)])
                    at += n
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(long(owner)), long(starts), long(lengths), pa.array(blobs, pa.binary()), long(totals), long(np.arange(number, number + len(owner))), long(np.zeros(len(owner), np.int64))],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
            number += len(owner)

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder per length, so a reader takes batches of equal lengths."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
