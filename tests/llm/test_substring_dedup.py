"""Substring de-duplication against brute force."""

import hashlib
from collections import Counter

import pytest

from recallscope.llm.substring_dedup import substring_dedup
from tests.conftest import SF001
from tests.llm.util import empty_docs, odd_docs, words

LAST = float("inf")


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (LAST if i is None else i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,part_bytes", [(50, 1 << 20), (50, 2000), (7, 700), (2, 5000)])
def test_odd_texts(spark, window, part_bytes):
    docs = odd_docs(spark, extra=("n_words", "__part", "kept_text", "lang"))
    got = substring_dedup(docs, window=window, part_bytes=part_bytes, texts=True)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "removed_spans", "kept_sha256", "kept_text"]
    rows = got.collect()
    want = brute([(r.doc_id, r.text) for r in rows], window)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows) == Counter(want)
    for r in rows:
        assert r.lang == "extra" and (r.kept_text is None) == (r.text is None)
        kept = [w for i, w in enumerate(words(r.text)) if not any(a <= i < b for a, b in r.removed_spans)]
        assert words(r.kept_text) == kept
        if not r.n_removed:
            assert r.kept_text == r.text
        assert sum(b - a for a, b in r.removed_spans) == r.n_removed


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = substring_dedup(docs, part_bytes=50_000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, 50)) and sum(r.n_removed for r in got) > 0


def test_empty_table(spark):
    assert substring_dedup(empty_docs(spark)).collect() == []
