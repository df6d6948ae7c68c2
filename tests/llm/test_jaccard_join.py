"""N-gram Jaccard join and components against brute force."""

import random
from collections import Counter

import pytest

from recallscope.llm.components import connected_components
from recallscope.llm.jaccard_join import choose_bands, jaccard_join, keep_one
from tests.conftest import SF001
from tests.llm.util import empty_docs, odd_docs, prose, words


def grams(t, n=5):
    w = words(t)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(id, class id, links, copies) of each row."""
    sets, root, links = [grams(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        ids[r] = min((x for x in (ids.get(r), doc) if x is not None), default=None)
    copies = Counter(tuple(words(t)) for _, t in rows)
    return [(doc, ids[find(i)], links[i], copies[tuple(words(t))] if words(t) else 1) for i, (doc, t) in enumerate(rows)]


def edited(text, *places):
    w = text.split()
    for p in places:
        w[p] = "changed"
    return " ".join(w)


def near_rows():
    """A chain and a large group of near copies, copies of copies, and clean texts."""
    base = prose(50, 120)
    rows = [(100 + i, edited(base, i * 3 % 117)) for i in range(40)] + [(300 + i, base) for i in range(5)]
    chain = prose(51, 100)
    for i in range(5):
        rows.append((400 + i, chain))
        chain = edited(chain, 10 * i + 5, 10 * i + 9)
    return rows + [(500 + i, prose(60 + i, 90)) for i in range(10)]


@pytest.mark.parametrize("block", [512, 7])
def test_near_copies(spark, block):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_join(docs, block=block).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got) == Counter(brute(rows))
    kept = [r.doc_id for r in got if r.keep]
    assert sorted(kept) == sorted({r.class_id for r in got})


def test_documents_and_one_of_each_class(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    decided = jaccard_join(docs)
    want = brute(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in decided.collect()) == Counter(want)
    kept = keep_one(docs, decided)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _, _ in want})


def test_odd_texts(spark):
    docs = odd_docs(spark, extra=("class_id", "__node", "keep"))
    decided = jaccard_join(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in decided.collect()) == Counter(brute(rows))
    kept = keep_one(docs.select("doc_id", "text"), decided).collect()
    # every class keeps one row, texts without a word all stay
    classes = {grams(t) for _, t in rows if words(t)}
    assert sum(not words(r.text) for r in kept) == sum(not words(t) for _, t in rows)
    texts = [grams(r.text) for r in kept if words(r.text)]
    assert len(texts) == len(set(texts)) <= len(classes)
    assert jaccard_join(empty_docs(spark)).collect() == []


def test_bands():
    for threshold, recall in ((0.8, 0.99999), (0.5, 0.99), (0.95, 0.9999)):
        bands, rows = choose_bands(threshold, recall)
        assert bands * rows <= 160 and 1 - (1 - threshold**rows) ** bands >= recall


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(2000, 2000 + i) for i in range(1, 200)] + [(None, 3), (4, None), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
