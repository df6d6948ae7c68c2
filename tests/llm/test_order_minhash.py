"""Order MinHash: the sketch by brute force, neighbours, sensitivity to order."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from recallscope.llm.arrays import U64
from recallscope.llm.order_minhash import Sketcher, edited_neighbours, fingerprints, likeness, shown
from tests.conftest import SF001
from tests.llm.util import ODD_TEXTS, empty_docs, odd_docs, prose

S = Sketcher()


M = 2**64
WINDOW, NUMBER, TUPLE_STEP = 0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


def scrambled(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % M
    return x ^ x >> 31


def brute(text):
    """For each slot: the least (k-mer, number) pairs, in text order, hashed; in Python's integers."""
    k = min(S.k, len(text))
    kmers = [scrambled(sum((ord(c) + 1) * pow(WINDOW, i, M) for i, c in enumerate(text[p : p + k])) % M)
             for p in range(len(text) - k + 1)]
    seen, items = Counter(), []
    for place, x in enumerate(kmers):
        items.append((scrambled((x + seen[x] * NUMBER) % M) >> 32, x, place))
        seen[x] += 1
    out = []
    for factor, shift in zip(S.factor[:, 0].tolist(), S.shift[:, 0].tolist()):
        chosen = sorted(sorted(items, key=lambda z: ((z[0] ^ shift) * factor % 2**32, z[1]))[: S.size], key=lambda z: z[2])
        v = len(chosen)
        for _, x, _ in chosen:
            v = scrambled((v * TUPLE_STEP + x) % M)
        out.append(v >> 48)
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("power", range(9, 15))
def test_one_character_more_changes_little(power):
    """At every length about a power of two a text and itself plus one character are near copies."""
    text = "".join(random.Random(power).choices("abcdefghij klmnop", k=2**power + 30))
    for n in range(2**power - 3, 2**power + 13):
        assert likeness(S.sketch(text[:n]), S.sketch(text[: n + 1])) > 0.9, n
    assert likeness(S.sketch(text[: 2**power - 20]), S.sketch(text[: 2**power + 20])) > 0.7


def test_likeness_follows_edit_distance():
    """Copies of unequal length with more and more edits: the likeness falls as the distance grows."""
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghij klmnop", k=1020))
    distance, like = [], []
    for edits in range(0, 121, 4):
        other = list(text)
        for _ in range(edits):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice(["", "x", other[at] + "y"])
        other = "".join(other)
        distance.append(edit_distance(text, other))
        like.append(likeness(S.sketch(text), S.sketch(other)))
    assert len({len(str(d)) for d in distance}) > 1 and like[0] == 1.0
    ranks = lambda v: np.argsort(np.argsort(v))
    assert np.corrcoef(ranks(distance), ranks(like))[0, 1] < -0.85


def test_prefixes_are_near_neighbours(spark):
    text = prose(41, 700)
    rows = [(i, text[:n]) for i, n in enumerate((4093, 4099, 4106))]
    got = {r.doc_id: r for r in edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.near_next > 0.9 for r in got.values()) and all(r.near_edited > 0.4 for r in got.values())


def test_close_hashes(monkeypatch):
    """K-mers that differ only where the position is kept are still told apart."""
    import recallscope.llm.order_minhash as module

    few = lambda points, text, k, which=0: (np.array([5, 7, 5, 6, 7, 5] * 50, U64)[: len(points) - k + 1],
                                            np.ones(len(points) - k + 1, bool))
    monkeypatch.setattr(module, "windows", few)
    close = S.sketch("x" * 200)
    monkeypatch.setattr(module, "windows", lambda *a: (few(*a)[0] << U64(50), few(*a)[1]))
    apart = S.sketch("x" * 200)
    assert close.any() and apart.any()
    item = {5: 0, 6: 0, 7: 0}
    kmer = [5, 7, 5, 6, 7, 5] * 50
    values = []
    for x in kmer[:193]:
        values.append(scrambled((x + item[x] * NUMBER) % M) >> 32)
        item[x] += 1
    factor, shift = int(S.factor[0, 0]), int(S.shift[0, 0])
    best = sorted(sorted(range(193), key=lambda p: ((values[p] ^ shift) * factor % 2**32, kmer[p]))[:2])
    v = 2
    for p in best:
        v = scrambled((v * TUPLE_STEP + kmer[p]) % M)
    assert close[0] == v >> 48


@pytest.mark.parametrize("text", ["a", "abcdefgh", "ab a", "a" * 40, "Une été \U0001f600 très", prose(1, 60), "xyz " * 50])
def test_sketch(text):
    assert S.sketch(text).tolist() == brute(text)


def test_long_texts_in_pieces():
    text = "".join(random.Random(1).choices("abcdefghij ", k=40_000))
    whole = Sketcher()
    assert S.sketch(text).tolist() == whole.sketch(text).tolist() == brute(text)


def test_order_matters():
    blocks = [prose(70 + i, 40) for i in range(8)]
    text = " ".join(blocks)
    one_edit = text.replace(blocks[3].split()[5], "changed", 1)
    swapped = " ".join(blocks[4:] + blocks[:4])  # the same k-mers but for the seams
    assert likeness(S.sketch(text), S.sketch(one_edit)) > 0.8
    assert 0.3 < likeness(S.sketch(text), S.sketch(swapped)) < 0.8
    assert likeness(S.sketch(text), S.sketch(prose(90, 320))) < 0.05
    assert likeness(S.sketch(text), S.sketch(text)) == 1.0 and not S.sketch("").any()


def neighbours(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for n, (i, t) in enumerate(rows):
        t, after = t or "", rows[(n + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = S.sketch(t), S.sketch(edited), S.sketch(after)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), likeness(a, b), likeness(a, c)))
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 800])
def test_odd_texts(spark, part_bytes):
    got = edited_neighbours(odd_docs(spark, extra=("fingerprint", "__tail")), part_bytes=part_bytes)
    assert Counter(map(tuple, got.collect())) == Counter(neighbours(ODD_TEXTS))
    assert edited_neighbours(empty_docs(spark)).collect() == []
    one = spark.createDataFrame([(7, "only one text here")], "doc_id long, text string")
    assert [tuple(r) for r in edited_neighbours(one).collect()] == neighbours([(7, "only one text here")])


def test_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = edited_neighbours(docs.repartition(6), part_bytes=40_000).collect()
    assert Counter(map(tuple, got)) == Counter(neighbours(rows))
    long = [r for r in got if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95
    named = fingerprints(docs.selectExpr("doc_id", "text", "'x' as fingerprint")).collect()
    by = {r.doc_id: r.fingerprint for r in got}
    assert all(r.fingerprint == by[r.doc_id] for r in named)
