"""Order MinHash fingerprints of whole texts.

A text is a sequence of overlapping k-mers of code points, each with its number
among the equal ones before it, so repeats count. For each of the sketch's
random orders the ``tuple_size`` least (k-mer, number) pairs are selected, put back
into the order in which they stand in the text, and hashed as a tuple. Two texts
agree in a slot only if they share the selected k-mers *and* their order, so the
share of equal slots follows the edit distance rather than mere set overlap.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.llm.arrays import U64, mix, trim, windows
from recallscope.llm.exchange import text_parts

K = 8
SLOTS = 64
TUPLE = 2
PART_BYTES = 12 << 20
PART = "__part"
TAIL = "__tail"


class Sketcher:
    def __init__(self, k: int = K, slots: int = SLOTS, tuple_size: int = TUPLE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.k, self.slots, self.size = k, slots, tuple_size
        self.factor = rng.integers(0, 1 << 31, slots, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, slots, dtype=np.uint64).astype(np.uint32)[:, None]

    def sketch(self, text: str) -> np.ndarray:
        """The slots (16 bits each) of one text; all zero for the empty one."""
        if not text:
            return np.zeros(self.slots, np.uint16)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        k = min(self.k, len(points))
        kmer, _ = windows(points + U64(1), np.zeros(len(points), np.int8), k)
        # occurrence numbers: equal k-mers side by side, in text order. The low bits of the hash make room for the
        # position, so that one plain sort does it; a k-mer's value stays its whole hash, whatever the length of
        # the text, and where two k-mers differ in those low bits only, the slower stable sort is used
        bits = U64(max(1, len(kmer).bit_length()))
        packed = np.sort(kmer >> bits << bits | np.arange(len(kmer), dtype=U64))
        place = (packed & ((U64(1) << bits) - U64(1))).astype(np.int64)
        ranked, packed = kmer[place], packed >> bits
        if ((packed[1:] == packed[:-1]) & (ranked[1:] != ranked[:-1])).any():
            place = np.argsort(kmer, kind="stable")
            ranked = kmer[place]
        kmer = ranked
        rank = np.arange(len(kmer))
        new = np.concatenate([[True], kmer[1:] != kmer[:-1]])
        number = rank - np.maximum.accumulate(np.where(new, rank, 0))
        item = (mix(kmer + number.astype(U64) * U64(0xD6E8FEB86659FD93)) >> U64(32)).astype(np.uint32)

        size = min(self.size, len(item))
        best, values = None, None
        step = max(size, 1 << 14)  # a long text in pieces: the least of the leasts
        for low in range(0, len(item), step):
            order = (item[None, low : low + step] ^ self.shift) * self.factor
            picked, least = [], []
            for _ in range(min(size, order.shape[1])):
                at = order.argmin(axis=1)
                least.append(order[np.arange(self.slots), at])
                picked.append(at + low)
                order[np.arange(self.slots), at] = np.iinfo(np.uint32).max
            picked, least = np.stack(picked, 1), np.stack(least, 1)
            if best is None:
                best, values = picked, least
            else:
                best, values = np.concatenate([best, picked], 1), np.concatenate([values, least], 1)
                first = np.argsort(values, axis=1, kind="stable")[:, :size]
                best, values = np.take_along_axis(best, first, 1), np.take_along_axis(values, first, 1)
        best = np.take_along_axis(best, np.argsort(place[best], axis=1), 1)
        out = np.full(self.slots, size, U64)
        for j in range(size):
            out = mix(out * U64(0x9E3779B97F4A7C15) + kmer[best[:, j]])
        return (out >> U64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text (hex, four digits a slot).
    One narrow pass; a null text counts as empty, and the empty text's fingerprint is
    all zeros; a column called like the result is replaced."""
    docs = docs.drop(*[c for c in (name,) if c in docs.columns and c != text_col])

    def run(batches):
        sketcher = Sketcher()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.append_column(name, pa.array([shown(sketcher.sketch(t.as_py() or "")) for t in texts], pa.string()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4,
                      part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprints of each text, of the text with its last ``n_chars // share`` code
    points replaced by the first as many of the next text (ids ascending, the first
    after the last), and the likeness of the text's fingerprint to both.

    Rows are dealt to ranges of ids (cut at approximate quantiles, which are ids of
    the table); the rows of a range's first id are also given to the range before, so
    every task knows the successor of its last row and one shuffle of the texts
    suffices. Null texts count as empty; null ids come last; rows that repeat an id
    are ordered by text; a single row is its own successor; an empty table gives an
    empty result. Extra columns are left out.
    """
    docs = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    parts = text_parts(docs, "__text", part_bytes)
    quantiles = [i / parts for i in range(1, parts)]
    cuts = docs.agg(F.min(id_col), F.percentile_approx(id_col, quantiles, 100 * parts + 1000) if quantiles else F.lit(None)).first()
    cuts = np.array(sorted({cuts[0], *(cuts[1] or [])} - {None}), np.int64)
    if not len(cuts):
        cuts = np.array([np.iinfo(np.int64).max])

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()
            part = np.maximum(np.searchsorted(cuts, ids, "right") - 1, 0)
            first = np.flatnonzero(cuts[part] == ids)
            for rows, to, tail in ((None, part, False), (first, (part[first] - 1) % len(cuts), True)):
                kept = batch if rows is None else batch.take(pa.array(rows))
                yield kept.append_column(PART, pa.array(to, pa.int32())).append_column(
                    TAIL, pa.array(np.full(len(to), tail)))

    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (
        ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
        ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())))])

    def compare(table):
        order = sorted(range(table.num_rows), key=_Order(table, id_col))
        tails = table.column(TAIL).to_pylist()
        texts, sketcher = table.column("__text"), Sketcher()
        own = [i for i in order if not tails[i]]
        following = [*own[1:], next((i for i in order if tails[i]), own[0] if own else None)]
        rows, sketch = [], None
        for i, j in zip(own, following):
            text, after = texts[i].as_py(), texts[j].as_py()
            cut = len(text) // share
            edited = text[: len(text) - cut] + after[:cut]
            sketch = sketcher.sketch(text) if sketch is None else sketch
            changed = sketch if edited == text else sketcher.sketch(edited)
            behind = sketch if after == text else sketcher.sketch(after)
            rows.append((len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(sketch), shown(changed),
                         likeness(sketch, changed), likeness(sketch, behind)))
            sketch = behind
        trim()
        columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(
            (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]
        return pa.table([table.column(id_col).take(pa.array(own, pa.int64())), *columns], names=[f.name for f in schema.fields])

    dealt = docs.mapInArrow(deal, T.StructType([*docs.schema.fields, T.StructField(PART, T.IntegerType()),
                                                T.StructField(TAIL, T.BooleanType())]))
    return dealt.groupBy(PART).applyInArrow(compare, schema)


class _Order:
    """Sort key of a row: id (null last), then text."""

    def __init__(self, table: pa.Table, id_col: str):
        self.ids, self.texts = table.column(id_col).to_pylist(), table.column("__text")

    def __call__(self, i: int):
        return self.ids[i] is None, self.ids[i] or 0, self.texts[i].as_py()
