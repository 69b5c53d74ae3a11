"""A total order of JSON values of mixed types, as binary keys that compare byte by byte."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed order of types: null, booleans, integers, floats, strings, arrays, objects. 0 ends arrays and objects.
END, NULL, BOOLEAN, INTEGER, FLOAT, STRING, ARRAY, OBJECT = range(8)


def _text(value: str) -> bytes:
    """UTF-8 orders as code points do; a zero byte is escaped, as two of them end the text."""
    return value.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\0"


def _integer(value: int) -> bytes:
    """Sign, number of bytes and bytes of any size; all turned round for negative ones."""
    size = (abs(value).bit_length() + 7) // 8
    plain = size.to_bytes(4, "big") + abs(value).to_bytes(size, "big")
    return b"\1" + plain if value >= 0 else b"\0" + bytes(255 - b for b in plain)


def _float(value: float) -> bytes:
    """The bits of a double with the sign turned round, all bits for negative ones; -0.0 is 0.0, NaN comes last."""
    bits = struct.unpack(">Q", struct.pack(">d", value if value == value else float("nan")))[0] if value else 0
    return struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 and value == value else 1 << 63))


def sort_bytes(value) -> bytes:
    """The key of a parsed value. Every key says where it ends, so keys of arrays are those of their elements in a row,
    and a shorter array comes before what it begins; an object is the sequence of its pairs in the order of names."""
    if value is None:
        return bytes([NULL])
    if isinstance(value, bool):
        return bytes([BOOLEAN, value])
    if isinstance(value, int):
        return bytes([INTEGER]) + _integer(value)
    if isinstance(value, float):
        return bytes([FLOAT]) + _float(value)
    if isinstance(value, str):
        return bytes([STRING]) + _text(value)
    if isinstance(value, list):
        return bytes([ARRAY]) + b"".join(map(sort_bytes, value)) + bytes([END])
    return bytes([OBJECT]) + b"".join(b"\1" + _text(k) + sort_bytes(v) for k, v in sorted(value.items())) + bytes([END])


def _key(text: str | None) -> bytes | None:
    try:
        return None if text is None else sort_bytes(json.loads(text))
    except ValueError:
        return None


def json_key(text: Column | str) -> Column:
    """The key of a JSON text: ``orderBy(json_key("x"))`` sorts mixed values by type, then value. Null where there is
    no text or it does not parse. A variant is given as ``to_json``. Numbers with a point or exponent are floats."""

    @F.pandas_udf("binary")
    def key(x: pd.Series) -> pd.Series:
        return x.map(_key)

    return key(text)
