"""Substring de-duplication by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``window // 2``
words; every rolling window of that length probes the index of all blocks. A
repeat of ``window`` words always holds a whole block of either text, so a text
without a hit around a position has no repeat there. Hits are then extended:
every ``window``-word window that touches a hit is compared, as a whole, with
all other such windows of the corpus, and chains of repeated windows are the
maximal exact repeats. All occurrences but those of the smallest id go.

Plan: documents are shuffled once by a hash of their id (the exchange is
reused); block probes and window comparisons travel as packed key sets
(``exchange``). Blocks are indexed by 32 bits beside their bucket, where a false
hit only makes a window be compared in vain; whole windows are compared by 64
bits and an independently hashed bucket.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recallscope.llm.arrays import U64, Words, lookup, runs, trim, utf8
from recallscope.llm.exchange import (ASK, PART, bucket_bounds, blobs, pack_keys, planes, text_parts, unpack_keys,
                                      unplanes, with_part)

PART_BYTES = 4 << 20  # text of one part; a task holds about 25 times as much in arrays
LAST_ID = np.iinfo(np.int64).max
ADDED = ("n_words", "n_removed", "removed_spans", "kept_sha256", "kept_text")


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    return table.column(id_col).cast(pa.int64()).fill_null(LAST_ID).to_numpy()


class _Part:
    """The texts of one part, in ascending order of id."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, window: int, buckets: int):
        self.ids = _ids(table, id_col)
        order = np.argsort(self.ids, kind="stable")
        self.table, self.ids = table.take(pa.array(order)), self.ids[order]
        self.words = Words(*utf8(self.table.column(text_col)))
        self.window, self.block, self.buckets = window, window // 2, buckets

    def block_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket << 32 | hash) of the rolling block-long window at each word; inside one text?"""
        h, inside = self.words.windows(self.block)
        return ((h >> U64(32)) % U64(self.buckets)) << U64(32) | (h & U64(0xFFFFFFFF)), inside

    def probes(self):
        """Distinct keys; whether one is a reference block here; whether one occurs twice here."""
        keys, inside = self.block_keys()
        at = np.arange(len(keys)) - self.words.first[self.words.text[: len(keys)]]
        tagged = np.sort((keys << U64(1) | (at % self.block == 0).astype(U64))[inside])
        keys = tagged >> U64(1)
        start = runs(keys)
        stop = np.append(start[1:], len(keys))
        return keys[start], (tagged[stop - 1] & U64(1)).astype(bool) if len(start) else np.zeros(0, bool), stop - start > 1

    def candidates(self, answers: dict[int, bytes]):
        """Starts, key and bucket of the whole windows that touch a hit."""
        keys, _, _ = self.probes()
        bounds = bucket_bounds(keys >> U64(32), self.buckets)
        hit = np.zeros(len(keys), bool)
        for b, answer in answers.items():
            hit[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(answer, np.uint8))[: bounds[b + 1] - bounds[b]]
        own, inside = self.block_keys()
        _, found = lookup(own, keys[hit])
        total = np.concatenate([[0], np.cumsum(found & inside)])
        whole, fits = self.words.windows(self.window)
        last = np.minimum(np.arange(len(whole)) + self.window - self.block + 1, len(total) - 1)
        starts = np.flatnonzero(fits & (total[last] > total[: len(whole)]))
        second, _ = self.words.windows(self.window, 1)
        return starts, whole[starts], (second[starts] % U64(self.buckets)).astype(np.int64)

    def owners(self, starts, keys, bucket):
        """The candidates' order by (bucket, key), the runs in it, and the smallest id of each run."""
        order = np.lexsort((keys, bucket))  # stable: ids ascend within a run
        k, b = keys[order], bucket[order]
        if len(order) == 0:
            return order, np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1])]))
        return order, start, self.ids[self.words.text[starts[order[start]]]]


def _answer_probes(table: pa.Table) -> pa.Table:
    """Is a key a reference block somewhere, and does it occur at least twice?"""
    keys = [unpack_keys(x) for x in blobs(table.column("__keys"))]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in blobs(table.column("__values"))]
    sizes = [len(k) for k in keys]
    block = np.concatenate([f[:n] for f, n in zip(flags, sizes)])
    twice = np.concatenate([f[n : 2 * n] for f, n in zip(flags, sizes)])
    everything = np.concatenate(keys)
    order = np.argsort(everything)
    start = runs(everything[order])
    hit = np.logical_or.reduceat(block[order], start) & (
        np.logical_or.reduceat(twice[order], start) | (np.diff(np.append(start, len(order))) > 1))
    out = np.empty(len(order), bool)
    out[order] = np.repeat(hit, np.diff(np.append(start, len(order))))
    return _answers(table, [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])])


def _answer_owners(table: pa.Table) -> pa.Table:
    """Does another part hold the window in a text with a smaller id?"""
    keys = [unpack_keys(x) for x in blobs(table.column("__keys"))]
    owner = np.concatenate([np.frombuffer(x, "<i8", 1) + unplanes(x[8:]).astype(np.int64)
                            for x in blobs(table.column("__values"))])
    sizes = [len(k) for k in keys]
    everything = np.concatenate(keys)
    order = np.argsort(everything)
    start = runs(everything[order])
    least = np.minimum.reduceat(owner[order], start)
    out = np.empty(len(order), bool)
    out[order] = np.repeat(least, np.diff(np.append(start, len(order)))) < owner[order]
    return _answers(table, [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])])


def _answers(table: pa.Table, values: list[bytes]) -> pa.Table:
    return pa.table({"__part": table.column("__part").cast(pa.int32()),
                     "__bucket": table.column("__bucket").cast(pa.int32()),
                     "__keys": pa.nulls(table.num_rows, pa.binary()), "__values": pa.array(values, pa.binary())})


def _questions(part: int, rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    return pa.table({"__part": pa.array([part] * len(rows), pa.int32()),
                     "__bucket": pa.array([r[0] for r in rows], pa.int32()),
                     "__keys": pa.array([r[1] for r in rows], pa.binary()),
                     "__values": pa.array([r[2] for r in rows], pa.binary())})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                    part_bytes: int = PART_BYTES, texts: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_removed``, ``removed_spans`` (word
    ranges, end exclusive), ``kept_sha256`` (of the kept words joined by one
    space) and, with ``texts``, ``kept_text`` (the text with the spans cut out
    and everything else unchanged).

    A word is removed if it lies in a ``window``-word window of its text that
    also starts in a text of a smaller id; windows are judged on the input.
    Null texts count as empty and stay null in ``kept_text``; a null id counts
    as larger than all others; rows that repeat an id never remove words of each
    other. Texts shorter than a window lose nothing. An empty table gives an
    empty result. Other columns pass through; input columns named like an added
    column are replaced.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    docs = docs.drop(*[c for c in (*ADDED, PART) if c in docs.columns])
    parts = text_parts(docs, text_col, part_bytes)
    buckets = -(-parts // 2)  # a bucket holds fewer bytes a key than a part
    dealt = with_part(docs, id_col, parts)
    make = lambda t: _Part(t, id_col, text_col, window, buckets)

    def ask_blocks(key, table):
        keys, block, twice = make(table).probes()
        trim()
        bounds = bucket_bounds(keys >> U64(32), buckets)
        return _questions(key[0].as_py(), [
            (b, pack_keys(keys[i:j] & U64(0xFFFFFFFF)), np.packbits(np.concatenate([block[i:j], twice[i:j]])).tobytes())
            for b, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])) if j > i])

    def ask_owners(key, table, answers):
        if table.num_rows == 0:
            return _questions(0, [])
        p = make(table)
        starts, keys, bucket = p.candidates(_by_bucket(answers))
        trim()
        order, start, owner = p.owners(starts, keys, bucket)
        k, b = keys[order[start]], bucket[order[start]]
        bounds = bucket_bounds(b, buckets)
        rows = []
        for x, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])):
            if j > i:
                low = int(owner[i:j].min())
                rows.append((x, pack_keys(k[i:j]), low.to_bytes(8, "little", signed=True)
                             + planes((owner[i:j] - low).astype(U64))))
        return _questions(key[0].as_py(), rows)

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
             T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.LongType()))),
             T.StructField("kept_sha256", T.StringType())]
    if texts:
        added.append(T.StructField("kept_text", T.StringType()))
    schema = T.StructType([*docs.schema.fields, *added])

    def finish(key, table, answers):
        if table.num_rows == 0:
            return pa.table({f.name: pa.nulls(0) for f in schema.fields})
        p = make(table)
        steps = answers.column("__bucket").to_numpy()
        of = lambda keep: _by_bucket(answers.filter(pa.array(keep)), buckets)
        starts, keys, bucket = p.candidates(of(steps < buckets))
        order, start, owner = p.owners(starts, keys, bucket)
        bounds = bucket_bounds(bucket[order[start]], buckets)
        elsewhere = np.zeros(len(start), bool)
        for b, answer in of(steps >= buckets).items():
            elsewhere[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(answer, np.uint8))[: bounds[b + 1] - bounds[b]]
        size = np.diff(np.append(start, len(order)))
        w = p.words
        gone = starts[order[np.repeat(elsewhere, size) | (np.repeat(owner, size) < p.ids[w.text[starts[order]]])]]
        cover = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
        trim()
        return _finish(p, np.cumsum(cover[:-1]) > 0, text_col, texts, schema)

    deal = dealt.groupBy(PART)
    probes = deal.applyInArrow(ask_blocks, ASK).groupBy("__bucket").applyInArrow(_answer_probes, ASK)
    owners = (deal.cogroup(probes.groupBy("__part")).applyInArrow(ask_owners, ASK)
              .groupBy("__bucket").applyInArrow(_answer_owners, ASK))
    both = probes.unionByName(owners.withColumn("__bucket", owners["__bucket"] + buckets))
    return deal.cogroup(both.groupBy("__part")).applyInArrow(finish, schema)


def _by_bucket(answers: pa.Table, modulo: int | None = None) -> dict[int, bytes]:
    return {b % modulo if modulo else b: v for b, v in zip(answers.column("__bucket").to_pylist(), blobs(answers.column("__values")))}


def _finish(p: _Part, removed: np.ndarray, text_col: str, texts: bool, schema: T.StructType) -> pa.Table:
    w, data = p.words, p.words.data.tobytes()
    n_removed = np.add.reduceat(np.append(removed, False).astype(np.int64), np.minimum(w.first[:-1], len(removed)))
    n_removed[w.counts == 0] = 0
    spans, digests, kept = [], [], []
    for i, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:])):
        body = data[a:b]
        words = body.split()
        cut: list[list[int]] = []
        if n_removed[i]:
            gone = removed[w.first[i] : w.first[i + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            cut = edges.reshape(-1, 2).tolist()
            words = list(compress(words, ~gone))
        spans.append(cut)
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        if texts:
            kept.append(_cut(body, cut, w, w.first[i], a) if cut else body)
    columns = {f.name: p.table.column(f.name) for f in schema.fields if f.name in p.table.column_names}
    columns |= {"n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "removed_spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                "kept_sha256": pa.array(digests, pa.string())}
    if texts:
        null = p.table.column(text_col).is_null().to_pylist()
        columns["kept_text"] = pa.array([None if z else k.decode() for z, k in zip(null, kept)], pa.string())
    return pa.table(columns).select([f.name for f in schema.fields])


def _cut(body: bytes, spans: list[list[int]], w: Words, first: int, base: int) -> bytes:
    """The text without the spans: from a span's first word up to the next kept word."""
    out, at = [], 0
    for a, b in spans:
        out.append(body[at : w.starts[first + a] - base])
        at = w.starts[first + b] - base if first + b < len(w.starts) and w.starts[first + b] - base < len(body) else len(body)
    out.append(body[at:])
    return b"".join(out)
