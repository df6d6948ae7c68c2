"""Corpus-wide questions about keys, asked in packed form.

Several operators need a fact about every word window or n-gram of the corpus
(does it occur elsewhere, how often, who has it first). One shuffled row per
window would move many times the input. Instead documents are dealt to parts by
a hash of their id; a part asks about each of its *distinct* keys once, in one
binary row per (part, bucket), where a key's hash picks the bucket; a bucket
task answers with one value per key in the order asked. So

* a key that occurs in a third of all rows costs one entry per part, and all
  buckets stay even: nothing has to be salted, dropped or capped;
* questions are sorted key sets, so they cost two to six bytes a key, and an
  answer needs no keys at all;
* a part's question does not depend on the order of its rows, so tasks that are
  run again after the loss of an executor ask and read the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallscope.llm.arrays import U64

PART = "__part"
ASK = "__part int, __bucket int, __keys binary, __values binary"


def text_parts(docs: DataFrame, text_col: str, part_bytes: int) -> int:
    """Number of parts of about ``part_bytes`` of text (one narrow aggregate)."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)) + F.lit(16))).first()[0]
    return max(1, -(-int(total or 0) // part_bytes))


def with_part(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    return docs.withColumn(PART, F.pmod(F.xxhash64(F.col(id_col)), F.lit(parts)).cast("int"))


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes of the least width that holds them all
    (the shuffle's compression removes constant planes)."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    body = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(body).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((body.shape[1], 8), np.uint8)
    out[:, :width] = body.T
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """A sorted array of distinct unsigned integers: first value, then gaps."""
    if len(keys) == 0:
        return b""
    return int(keys[0]).to_bytes(8, "little") + planes(np.diff(keys))


def unpack_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    first = np.frombuffer(blob, "<u8", 1)
    return np.cumsum(np.concatenate([first, unplanes(blob[8:])]), dtype=U64)


def bucket_bounds(buckets_of_sorted: np.ndarray, buckets: int) -> np.ndarray:
    """Ends of each bucket's range in an array sorted by bucket."""
    return np.searchsorted(buckets_of_sorted, np.arange(buckets + 1))


def blobs(column) -> list[bytes]:
    return [x if x is not None else b"" for x in column.to_pylist()]
