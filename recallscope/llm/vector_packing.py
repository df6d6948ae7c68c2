"""Packing examples into sequences: vector bin packing with the dot-product heuristic.

An example demands tokens, one segment and its loss-bearing tokens; a sequence
has a limit on each. Sequences are filled one after the other: of the examples
that still fit, the one whose demand has the largest dot product with the
sequence's free capacities (both as shares of the limits) goes in. When none
fits as a whole, the example with the largest dot product is cut so that its
head fills the sequence. Texts longer than a sequence first give whole
sequences of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.llm.arrays import trim
from recallscope.llm.tokenizing import encoder, slices

GROUP_BYTES = 8 << 20  # text bytes packed together in one task
GROUP_ROWS = 20_000  # examples packed together at most, on average
GROUP = "__group"
SEQUENCE_BITS = 24  # of a sequence's id within its group
WINDOW = 1024  # examples weighed against each other at once


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    least: int = 8  # a cut leaves no piece below this many tokens, and no gap of as many is left uncut


def pack(lengths: np.ndarray, prompts: np.ndarray, limits: Limits) -> np.ndarray:
    """Pieces (example, start, length, sequence, offset) of examples of ``lengths``
    tokens of which the first ``prompts`` bear no loss. Examples are taken in the
    given order; ties go to the earlier one. Every token is in exactly one piece."""
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    todo: list[tuple[int, int]] = []  # example, start
    for i, n in enumerate(lengths.tolist()):
        start = 0
        while n - start > limits.tokens and limits.tokens - max(0, min(prompts[i] - start, limits.tokens)) <= limits.loss:
            out.append((i, start, limits.tokens, sequence, 0))
            start, sequence = start + limits.tokens, sequence + 1
        if n > start:
            todo.append((i, start))
    todo.reverse()

    item = np.zeros(0, np.int64)
    begin = np.zeros(0, np.int64)
    scale = np.array([limits.tokens, limits.segments, limits.loss], float)
    free, offset = scale.copy(), 0
    while True:
        if len(item) < WINDOW // 2 and todo:
            more = [todo.pop() for _ in range(min(len(todo), WINDOW - len(item)))]
            item = np.concatenate([item, [m[0] for m in more]])
            begin = np.concatenate([begin, [m[1] for m in more]])
        if not len(item):
            break
        size = lengths[item] - begin
        loss = lengths[item] - np.maximum(begin, prompts[item])
        score = size * (free[0] / scale[0] ** 2) + free[1] / scale[1] ** 2 + loss * (free[2] / scale[2] ** 2)
        fits = (size <= free[0]) & (loss <= free[2])
        if fits.any() and free[1] >= 1:
            k = int(np.argmax(np.where(fits, score, -1.0)))
            head = int(size[k])
        elif free[1] >= 1 and (free[0] >= limits.least or offset == 0):
            head, k = 0, 0
            for k in np.argsort(-score, kind="stable")[:64].tolist():
                bare = max(0, int(prompts[item[k]] - begin[k]))
                head = int(min(free[0], bare + free[2], max(size[k] - limits.least, 1)))
                if head >= min(limits.least, size[k] - 1) and head > 0:
                    break
                head = 0
            if head == 0 and offset == 0:
                raise ValueError("an example has no part within the limits")
        else:
            head = 0
        if head:
            out.append((int(item[k]), int(begin[k]), head, sequence, offset))
            bears = max(0, head - max(0, int(prompts[item[k]] - begin[k])))
            free -= (head, 1, bears)
            offset += head
            if head == size[k]:
                keep = np.arange(len(item)) != k
                item, begin = item[keep], begin[keep]
            else:
                begin[k] += head
        if not head or free[0] < 1 or free[1] < 1:
            sequence, offset, free = sequence + 1, 0, scale.copy()
    return np.array(out, np.int64).reshape(-1, 5)


def vector_pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                prompt_col: str | None = None, end_id: int = 1, limits: Limits = Limits(), group: Column | None = None,
                group_bytes: int = GROUP_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all examples: the id, ``start`` (tokens of the example before the
    piece), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``loss_tokens`` (of the piece), ``sequence_id`` and ``offset``.

    An example's tokens are those of its prompt (no loss), its text and
    ``end_id``. Examples are dealt to groups by a hash of id and text, one task a
    group of about ``group_bytes``; groups share no sequence, so each leaves one
    sequence that is not full. ``group`` (a number of the caller's, for groups of bounded size)
    deals them otherwise, e.g. by their place in an order; sequences ascend with it. A null text counts as empty (one token, the end);
    a null id or a repeated row is an example like any other; an empty table
    gives no pieces. Extra columns are left out.
    """
    name = F.lit(None).cast("long") if group is None else group.cast("long")
    used = [F.col(text_col).alias("__text"), (F.col(prompt_col) if prompt_col else F.lit(None).cast("string")).alias("__prompt"), name.alias(GROUP)]
    docs = docs.select(F.col(id_col), *used)
    if group is None:
        docs = docs.withColumn(GROUP, _dealt(docs, id_col, group_bytes, group_rows))
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in (
        ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()),
        ("loss_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())))])

    def fill(key, table):
        tokenizer = encoder(vocabulary)
        bare = table.column("__prompt").null_count == table.num_rows  # no prompts: nothing to encode for them
        prompts = [0] * table.num_rows if bare else [x for _, texts in slices(table.column("__prompt")) for x in tokenizer.counts(texts)]
        ids: list[np.ndarray] = []
        end = np.array([end_id], "<u4")
        for first, texts in slices(table.column("__text")):
            if bare:
                ids += [np.append(x, end).astype("<u4", copy=False) for x in tokenizer.ids(texts)]
                continue
            heads = tokenizer.ids([x or b"" for x in _bytes(table, "__prompt", first, len(texts))])
            ids += [np.concatenate([h, x, end]).astype("<u4", copy=False) for h, x in zip(heads, tokenizer.ids(texts))]
        lengths = np.array([len(x) for x in ids], np.int64)
        names = [(x is None, x, c) for x, c in zip(table.column(id_col).to_pylist(), (x[:64].tobytes() for x in ids))]
        # longest first; the id and the ids break ties, so the result does not depend on the order of arrival
        order = sorted(range(len(ids)), key=lambda i: (-lengths[i], names[i][0], names[i][1] or 0, names[i][2]))
        order = np.array(order, np.int64)
        prompts = np.array(prompts, np.int64)
        # long and short examples alternate, so that every window offers both
        woven = np.empty_like(order)
        half = (len(order) + 1) // 2
        woven[0::2], woven[1::2] = order[:half], order[half:][::-1]
        pieces = pack(lengths[woven], prompts[woven], limits)
        row = woven[pieces[:, 0]]
        begin, length = pieces[:, 1], pieces[:, 2]
        unlost = np.clip(prompts[row] - begin, 0, length)
        trim()
        return pa.table({
            id_col: table.column(id_col).take(pa.array(row)), "start": begin, "length": length,
            "ids": pa.array([ids[r][s : s + n].tobytes() for r, s, n in zip(row.tolist(), begin.tolist(), length.tolist())], pa.binary()),
            "doc_tokens": lengths[row], "loss_tokens": length - unlost,
            "sequence_id": pieces[:, 3] + (key[0].as_py() << SEQUENCE_BITS), "offset": pieces[:, 4]})

    return docs.groupBy(GROUP).applyInArrow(fill, schema)


def _dealt(docs: DataFrame, id_col: str, group_bytes: int, group_rows: int) -> Column:
    """A group by a hash of id and text, as many as bytes and rows ask for."""
    size = docs.agg(F.sum(F.octet_length(F.concat_ws("", "__prompt", "__text")) + 16), F.count(F.lit(1))).first()
    groups = max(1, -(-int(size[0] or 0) // group_bytes), -(-int(size[1]) // group_rows))
    return F.pmod(F.xxhash64(F.col(id_col), F.substring("__text", 1, 64)), F.lit(groups)).cast("long")


def _bytes(table: pa.Table, name: str, first: int, n: int) -> list[bytes | None]:
    return table.column(name).slice(first, n).cast(pa.large_binary()).to_pylist()
