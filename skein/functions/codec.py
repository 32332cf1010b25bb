"""The compact reference codec: variable-length integers and base 62, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def varint(value: int) -> bytes:
    """Seven bits a byte, least first; the high bit says that more follow."""
    if value < 0:
        raise ValueError("only numbers from 0 on")
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def read_varints(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            value = shift = 0
    if shift:
        raise ValueError("the last number is cut off")
    return out


def base62(data: bytes) -> str:
    """A leading 1 byte keeps zeros at the front."""
    n, out = int.from_bytes(b"\1" + data, "big"), []
    while n:
        n, r = divmod(n, 62)
        out.append(ALPHABET[r])
    return "".join(reversed(out))


def from_base62(text: str) -> bytes:
    n = 0
    for c in text:
        n = n * 62 + ALPHABET.index(c)
    return n.to_bytes((n.bit_length() + 7) // 8, "big")[1:]


@F.pandas_udf(T.StringType())
def encode_reference(columns: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """A struct of whole numbers -> one base-62 word; a row with a null has none."""
    for frame in columns:
        yield pd.Series([None if any(pd.isna(v) for v in row) else base62(b"".join(varint(int(v)) for v in row)) for row in frame.itertuples(index=False)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def decode_reference(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in words:
        yield series.map(lambda w: None if w is None else read_varints(from_base62(w)))
