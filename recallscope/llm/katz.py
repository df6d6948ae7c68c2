"""Language-model scoring by Katz backoff with Good-Turing discounts.

The model is counted on the training rows: n-gram counts up to ``order``, their
Good-Turing discounts (from the counts of counts of the whole corpus), and for
every history the backoff weight that makes its distribution sum to exactly
one. Counts and backoff weights are stored as tables partitioned by kind and
order, one row per bucket of keys; scoring reads the answers of those buckets
and evaluates P(w|h) = d(c) c(hw) / c(h) if hw was seen, else alpha(h) P(w|h'),
down to the single tokens, where all unseen words are one class.

Tokens are hashed; n-grams are told apart by 48 bits beside their bucket (an
independent hash; buckets grow with the corpus), so among 10^8 distinct n-grams
less than one pair is expected to share a count. Every n-gram of every whole text is counted and
asked for as a packed key set (``exchange``), so a frequent n-gram costs one
entry per part and no key makes a hot task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.llm.arrays import U64, Words, mix, numbered, runs, trim, utf8, windows
from recallscope.llm.exchange import (PART, blobs, bucket_bounds, pack_keys, planes, text_parts, unpack_keys, unplanes,
                                      with_part)
from recallscope.llm.stages import last_reader
from recallscope.session import fresh_path

PART_BYTES = 6 << 20
END = int(mix(np.array([0x5EED], dtype=U64))[0])
TRAIN = "__train"
ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
ROW = "kind string, n int, __bucket int, __part int, __keys binary, __values binary, stats array<bigint>"
TOP = 5  # counts up to this one are discounted


@dataclass(frozen=True)
class Discounts:
    """d(1..TOP) of one order, and the counts they come from."""

    d: tuple[float, ...]
    tokens: int
    types: int
    left: float  # probability kept for unseen tokens (order 1)
    plus: int  # added to the total where nothing would be left

    def of(self, counts: np.ndarray) -> np.ndarray:
        table = np.array([1.0, *self.d, 1.0])
        return table[np.minimum(counts, TOP + 1)]


def good_turing(counts_of_counts: list[int]) -> tuple[float, ...]:
    """Katz's discounts for counts 1..TOP from n_1..n_{TOP+1}. The cut-off falls
    until all discounts lie in (0, 1); if none does, d_r = 1 - n1 / (n1 + 2 n2) / r."""
    n = [0, *counts_of_counts]
    for top in range(TOP, 0, -1):
        if all(n[r] > 0 for r in range(1, top + 2)):
            tail = (top + 1) * n[top + 1] / n[1]
            if tail < 1:
                d = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, top + 1)]
                if all(0 < x < 1 for x in d):
                    return (*d, *[1.0] * (TOP - top))
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return tuple(1 - cut / r for r in range(1, TOP + 1))


def discounts(stats: list[int]) -> Discounts:
    """From [tokens, types, n_1 .. n_{TOP+1}]."""
    tokens, types, counts = stats[0], stats[1], stats[2:]
    d = good_turing(counts)
    lost = sum(counts[r - 1] * r * (1 - d[r - 1]) for r in range(1, TOP + 1))
    plus = int(lost <= 0)
    return Discounts(d, tokens, types, (lost + plus) / (tokens + plus) if tokens + plus else 1.0, plus)


class _Part:
    """Tokens of one part's texts and their n-gram keys."""

    def __init__(self, table: pa.Table, text_col: str, order: int, buckets: int):
        words = Words(*utf8(table.column(text_col)), ascii_lower=True)
        n, counts = len(words.counts), words.counts + 1
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tokens = np.full(self.first[-1], END, U64)
        self.text = np.repeat(np.arange(n, dtype=np.int32), counts)
        is_word = np.ones(len(self.tokens), bool)
        is_word[self.first[1:] - 1] = False
        self.tokens[is_word], self.ends = words.hash, ~is_word
        self.train = table.column(TRAIN).to_numpy()[self.text] if n else np.zeros(0, bool)
        self.order, self.buckets = order, buckets
        self.keys, self.at, self.inside, self.bounds = {}, {}, {}, {}
        for k in range(1, order + 1):
            h, inside = windows(self.tokens, self.text, k)
            key = ((mix(h) >> U64(32)) % U64(buckets)) << U64(48) | (h & U64((1 << 48) - 1))
            self.at[k] = np.zeros(len(key), np.int64)
            self.keys[k], self.at[k][inside] = numbered(key[inside])
            self.inside[k] = inside
            self.bounds[k] = bucket_bounds(self.keys[k] >> U64(48), buckets)

    def rows(self, kind: str, k: int, part: int, values) -> list[tuple]:
        """A row for each bucket; values(i, j) packs the values of keys i to j."""
        b = self.bounds[k]
        return [(kind, k, x, part, pack_keys(self.keys[k][i:j] & U64((1 << 48) - 1)), values(i, j), None)
                for x, (i, j) in enumerate(zip(b[:-1], b[1:])) if j > i]

    def read(self, answers: pa.Table, kind: str, k: int, unpack, kinds) -> list[np.ndarray]:
        out = [np.zeros(len(self.keys[k]), t) for t in kinds]
        rows = answers.filter(pa.array([a == kind and b == k for a, b in zip(
            answers.column("kind").to_pylist(), answers.column("n").to_pylist())], pa.bool_()))
        for b, blob in zip(rows.column("__bucket").to_pylist(), blobs(rows.column("__values"))):
            for x, y in zip(out, unpack(blob)):
                x[self.bounds[k][b] : self.bounds[k][b + 1]] = y
        return out

    def evaluate(self, answers: pa.Table, model: dict[int, Discounts], order: int, counts: int | None = None):
        """P(token | history) by the recursion up to ``order``; totals and owner flags by order."""
        total, owned = {}, {}
        for k in range(1, (counts or order) + 1):
            both = self.read(answers, "count", k, lambda x: [unplanes(x)], [U64])[0]
            total[k], owned[k] = (both >> U64(1)).astype(np.int64), (both & U64(1)).astype(bool)
        m = model[1]
        c = total[1][self.at[1]]
        p = np.where(c > 0, m.of(c) * c / max(m.tokens + m.plus, 1), m.left)
        for k in range(2, order + 1):
            alpha, plus = self.read(answers, "backoff", k - 1, _read_backoff, [float, np.int64])
            spot = np.flatnonzero(self.inside[k])
            h, g = self.at[k - 1][spot], self.at[k][spot]
            c, ch = total[k][g], total[k - 1][h]
            low = p[spot + k - 1]
            p = p.copy()
            p[spot + k - 1] = np.where(c > 0, model[k].of(c) * c / np.maximum(ch + plus[h], 1), np.where(ch > 0, alpha[h] * low, low))
        return p, total, owned


def _read_backoff(blob: bytes):
    n = len(blob) // 9
    return [np.frombuffer(blob, "<f8", n), np.frombuffer(blob, np.uint8, n, 8 * n)]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["kind", "n", "__bucket", "__part", "__keys", "__values", "stats"]
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, kinds))})


def _gather(table: pa.Table):
    """The questions of a bucket in order of part: keys, sizes, sorting order, runs."""
    table = table.sort_by("__part")
    keys = [unpack_keys(x) for x in blobs(table.column("__keys"))]
    everything = np.concatenate(keys)
    order = np.argsort(everything, kind="stable")
    return table, everything[order], [len(k) for k in keys], order, runs(everything[order])


def _back(values: np.ndarray, order: np.ndarray, start: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """A value of each run, given back to every question in the order asked."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(start, len(order))))
    return np.split(out, np.cumsum(sizes)[:-1])


def _answer_counts(key, table):
    """Total count of each key; the first part that counted it owns it."""
    table, keys, sizes, order, start = _gather(table)
    local = np.concatenate([unplanes(x) for x in blobs(table.column("__values"))]).astype(np.int64)[order]
    total = np.add.reduceat(local, start)
    place = np.arange(len(order))
    owner = np.minimum.reduceat(np.where(local > 0, place, len(order)), start)
    owns = np.zeros(len(order) + 1, bool)
    owns[owner] = True
    flags = np.empty(len(order), bool)
    flags[order] = owns[:-1]
    n, b = table.column("n")[0].as_py(), table.column("__bucket")[0].as_py()
    rows = [("count", n, b, p, None, planes(t.astype(U64) << U64(1) | f.astype(U64)), None) for p, t, f in zip(
        table.column("__part").to_pylist(), _back(total, order, start, sizes), np.split(flags, np.cumsum(sizes)[:-1]))]
    seen = total > 0
    stats = [int(total.sum()), int(seen.sum()), *(int((total == r).sum()) for r in range(1, TOP + 2))]
    rows.append(("ngrams", n, b, -1, pack_keys(keys[start][seen]), planes(total[seen].astype(U64)), stats))
    return _table(rows)


def _answer_backoff(key, table):
    """Exactly normalised backoff weight of each history from its parts' sums."""
    table, keys, sizes, order, start = _gather(table)
    kept, low, count = [], [], []
    for n, blob in zip(sizes, blobs(table.column("__values"))):
        kept.append(np.frombuffer(blob, "<f8", n))
        low.append(np.frombuffer(blob, "<f8", n, 8 * n))
        count.append(unplanes(blob[16 * n :]).astype(np.int64))
    kept, low = (np.add.reduceat(np.concatenate(x)[order], start) for x in (kept, low))
    c = np.concatenate(count)[order][start]
    plus = (kept >= c * (1 - 1e-12)).astype(np.uint8)
    alpha = (1 - kept / np.maximum(c + plus, 1)) / np.maximum(1 - low, 1e-12)
    n, b = table.column("n")[0].as_py(), table.column("__bucket")[0].as_py()
    rows = [("backoff", n, b, p, None, a.tobytes() + q.tobytes(), None) for p, a, q in zip(
        table.column("__part").to_pylist(), _back(alpha, order, start, sizes), _back(plus, order, start, sizes))]
    seen = c > 0
    rows.append(("weights", n, b, -1, pack_keys(keys[start][seen]), alpha[seen].tobytes() + plus[seen].tobytes(), None))
    return _table(rows)


def _store(spark, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = fresh_path(spark, name)
    with last_reader(spark):
        df.write.partitionBy("kind", "n").parquet(path)
    return spark.read.schema(ROW).parquet(path)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: "F.Column | None" = None,
                order: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` without the text, with ``n_tokens`` (words, A-Z lower-cased,
    and one end), ``n_known`` (tokens seen in training), ``train_tokens``,
    ``base_score`` (add-0.1 unigrams) and ``score`` (log10 probability under the
    Katz model of ``order``).

    ``train`` says which rows the model learns from (all by default; null is
    true). A null or empty text is the end token alone. Rows that repeat an id
    are scored and counted each. An empty table gives an empty result; with no
    training row every token falls in the unseen class, whose probability is 1.
    Other columns pass through; input columns named like an added one are
    replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in (*ADDED, PART, TRAIN) if c in docs.columns])
    parts = text_parts(docs, text_col, part_bytes)
    buckets = min(-(-parts // 2), 65535)
    flag = F.coalesce(train, F.lit(True)) if train is not None else F.lit(True)
    dealt = with_part(docs.withColumn(TRAIN, flag), id_col, parts)
    deal = lambda: dealt.groupBy(PART)

    def ask_counts(key, table):
        p = _Part(table, text_col, order, buckets)
        rows = []
        for k in range(1, order + 1):
            spot = p.inside[k] & p.train[: len(p.inside[k])]
            local = np.bincount(p.at[k][spot], minlength=len(p.keys[k])).astype(U64)
            rows += p.rows("count", k, key[0].as_py(), lambda i, j: planes(local[i:j]))
        trim()
        return _table(rows)

    counted = _store(spark, deal().applyInArrow(ask_counts, ROW).groupBy("n", "__bucket").applyInArrow(_answer_counts, ROW),
                     "katz-counts")
    stats = (counted.where("kind = 'ngrams'").select("n", F.posexplode("stats").alias("i", "x"))
             .groupBy("n", "i").agg(F.sum("x").alias("x")).collect())  # order x (TOP + 3) numbers
    model = {k: discounts([next((r.x for r in stats if (r.n, r.i) == (k, i)), 0) for i in range(TOP + 3)])
             for k in range(1, order + 1)}
    answers = counted.where("kind = 'count'")

    def backoff_asker(k):
        def ask_backoff(key, table, given):
            if table.num_rows == 0:
                return _table([])
            p = _Part(table, text_col, k, buckets)
            prob, total, owned = p.evaluate(given, model, k - 1, k)
            spot = np.flatnonzero(p.inside[k])
            first = np.zeros(len(p.keys[k]), np.int64)
            first[p.at[k][spot[::-1]]] = spot[::-1]  # one place of each n-gram
            spot = first[owned[k]]
            c = total[k][p.at[k][spot]]
            h = p.at[k - 1][spot]
            kept = np.bincount(h, model[k].of(c) * c, len(p.keys[k - 1]))
            low = np.bincount(h, prob[spot + k - 1], len(p.keys[k - 1]))
            count = total[k - 1].astype(U64)
            return _table(p.rows("backoff", k - 1, key[0].as_py(), lambda i, j: (
                kept[i:j].tobytes() + low[i:j].tobytes() + planes(count[i:j]))))

        return ask_backoff

    for k in range(2, order + 1):
        asked = deal().cogroup(answers.groupBy("__part")).applyInArrow(backoff_asker(k), ROW)
        solved = _store(spark, asked.groupBy("n", "__bucket").applyInArrow(_answer_backoff, ROW), "katz-backoff")
        answers = answers.unionByName(solved.where("kind = 'backoff'"))

    passed = [c for c in docs.columns if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in passed), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(key, table, given):
        if table.num_rows == 0:
            return pa.table({f.name: pa.nulls(0) for f in schema.fields})
        p = _Part(table, text_col, order, buckets)
        prob, total, _ = p.evaluate(given, model, order)
        c, first = total[1][p.at[1]], p.first[:-1]
        base = np.log10((c + 0.1) / (model[1].tokens + 0.1 * (model[1].types + 1)))
        n = np.diff(p.first)
        trim()
        return pa.table({**{c: table.column(c) for c in passed}, "n_tokens": n,
                         "n_known": np.add.reduceat((c > 0).astype(np.int64), first),
                         "train_tokens": np.full(len(n), model[1].tokens, np.int64),
                         "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(prob), first)})

    return deal().cogroup(answers.groupBy("__part")).applyInArrow(score, schema)

