"""Katz backoff against a plain version of the model."""

import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from recallscope.llm.katz import TOP, discounts, good_turing, katz_scores
from tests.conftest import SF001
from tests.llm.util import empty_docs, odd_docs, words


class Plain:
    def __init__(self, texts, order):
        self.order, self.c = order, [None] + [Counter() for _ in range(order)]
        for t in texts:
            w = self.tokens(t)
            for k in range(1, order + 1):
                self.c[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        self.m = {}
        for k in range(1, order + 1):
            of = Counter(self.c[k].values())
            self.m[k] = discounts([sum(self.c[k].values()), len(self.c[k]), *(of[r] for r in range(1, TOP + 2))])
        self.after = defaultdict(list)
        for k in range(2, order + 1):
            for g in self.c[k]:
                self.after[g[:-1]].append(g[-1])
        self.alpha = lru_cache(None)(self._alpha)

    @staticmethod
    def tokens(t):
        return words(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]

    def d(self, k, c):
        return (1.0, *self.m[k].d, 1.0)[min(c, TOP + 1)]

    def _alpha(self, h):
        k = len(h) + 1
        kept = sum(self.d(k, self.c[k][*h, w]) * self.c[k][*h, w] for w in self.after[h])
        c = self.c[k - 1][h]
        plus = int(kept >= c * (1 - 1e-12))
        return (1 - kept / (c + plus)) / (1 - sum(self.p(h[1:], w) for w in self.after[h])), plus

    def p(self, h, w):
        k = len(h) + 1
        c = self.c[k][*h, w]
        if k == 1:
            return self.d(1, c) * c / (self.m[1].tokens + self.m[1].plus) if c else self.m[1].left
        if c:
            return self.d(k, c) * c / (self.c[k - 1][h] + self.alpha(h)[1])
        return (self.alpha(h)[0] if self.c[k - 1][h] else 1.0) * self.p(h[1:], w)

    def row(self, t):
        w, n, v = self.tokens(t), self.m[1].tokens, self.m[1].types
        base = sum(math.log10((self.c[1][x,] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        score = sum(math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i]), x)) for i, x in enumerate(w))
        return len(w), sum(self.c[1][x,] > 0 for x in w), n, base, score


def compare(rows, model):
    for r in rows:
        n, known, train, base, score = model.row(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_documents(spark, order):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    scored = katz_scores(docs.withColumn("keep", train).withColumn("score", F.lit("x")).withColumn("copy", F.col("text")),
                         train=F.col("keep"), order=order, part_bytes=60_000)
    rows = scored.withColumnRenamed("copy", "text").collect()
    assert len(rows) == docs.count()
    model = Plain([r.text for r in rows if r.keep], order)
    compare(rows, model)
    seen = [k[0] for k in model.c[1]]
    if order == 2:  # every distribution sums to one, the unseen class included
        for h in seen[:40]:
            if h is not None:
                assert math.isclose(sum(model.p((h,), w) for w in seen) + model.p((h,), "\0unseen"), 1, rel_tol=1e-9)
    if order > 1:
        held = [r for r in rows if not r.keep]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_texts_and_empty_tables(spark):
    docs = odd_docs(spark, extra=("score", "__train"))
    rows = katz_scores(docs.withColumn("copy", F.col("text")), part_bytes=3000).withColumnRenamed("copy", "text").collect()
    assert len(rows) == docs.count()
    compare(rows, Plain([r.text for r in rows], 2))
    assert katz_scores(empty_docs(spark)).collect() == []
    untrained = katz_scores(docs.select("doc_id", "text"), train=F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in untrained} == {(0, 0, 0.0)}


def test_good_turing():
    n = [1000, 300, 150, 90, 60, 40]
    d = good_turing(n)
    assert all(0 < x < 1 for x in d)
    # Katz's condition: the mass taken from the discounted counts is that of the singletons
    assert math.isclose(sum(n[r - 1] * r * (1 - d[r - 1]) for r in range(1, TOP + 1)), n[0], rel_tol=1e-9)
    assert good_turing([5, 0, 0, 0, 0, 0]) == tuple(1 - 0.5 / r for r in range(1, TOP + 1))
    assert all(0 < x <= 1 for x in good_turing([3, 1, 4, 1, 5, 9]))
