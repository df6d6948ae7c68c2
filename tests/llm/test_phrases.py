import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from recallscope.llm.phrases import KIND, chunks, numbered_words, phrase_collocations
from tests.llm.util import empty_docs, odd_docs, same_rows

SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("score", T.StringType())])
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, top):
    """Every phrase counted, every cut and every longer phrase looked at."""
    count, n = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for m in (1, 2, 3, 4):
                count[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in count.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        longest = Counter()
        for q in candidates:
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    longest[q[i : i + m]] = max(longest[q[i : i + m]], f[q])
        found = []
        for p in candidates:
            if 100 * longest[p] >= 80 * f[p]:
                continue
            score, _, l, r = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, l, r, n[lang], -score))
    return out


def corpus(seed, size, vocabulary, langs=("en", "de", None)):
    """Words by a skewed draw, with fixed phrases of two to six words strewn in."""
    rng = np.random.default_rng(seed)
    fixed = [rng.integers(0, vocabulary, rng.integers(2, 7)) for _ in range(25)]
    rows = []
    for _ in range(size):
        words = []
        for _ in range(rng.integers(0, 40)):
            draw = fixed[rng.integers(0, 25)] if rng.random() < 0.3 else [int(vocabulary * rng.random() ** 3)]
            words += [("W" if rng.random() < 0.2 else "w") + str(w) for w in draw]
            words += [["", ", ", ". ", "\n", "\t", "!x"][rng.integers(0, 6)]] if rng.random() < 0.15 else []
        rows.append((" ".join(words), langs[rng.integers(0, len(langs))], "extra"))
    return rows


@pytest.mark.parametrize("seed,least,top,chunk_bytes", [(1, 3, 20, 8 << 20), (2, 2, 7, 500), (4, 3, 10**6, 1000)])
def test_equals_brute_force(spark, seed, least, top, chunk_bytes):
    rows = corpus(seed, 400, 60)
    out = phrase_collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, top=top, chunk_bytes=chunk_bytes)
    assert out.columns == COLUMNS
    same_rows([tuple(r) for r in out.collect()], plain(rows, least, top))


def test_ties_at_the_end(spark):
    """Many phrases with one score: a, then bytes, decide; all of them are settled."""
    rows = [(f"a{i} b{i}. a{i} b{i} c{i}. a{i} x", "en", None) for i in range(40)] * 3
    rows += [(f"ä{i} z{i}, Ä{i} z{i}", "en", None) for i in range(20)] * 3
    for top in (15, 41):
        out = phrase_collocations(spark.createDataFrame(rows, SCHEMA), least=3, top=top).collect()
        same_rows([tuple(r) for r in out], plain(rows, 3, top))


def test_replaced_from_the_left_only(spark):
    """x y z is always preceded by w, whose pair with x is much more frequent and scores low."""
    rows = [("w x y z", "en", None)] * 10 + [("w x", "en", None)] * 90 + [("w", "en", None)] * 500 + [("p q", "en", None)] * 9
    for top in (1, 50):
        out = phrase_collocations(spark.createDataFrame(rows, SCHEMA), least=3, top=top, ease=(1, 1)).collect()
        same_rows([tuple(r) for r in out], plain(rows, 3, top))


def test_odd_rows(spark):
    docs = odd_docs(spark, extra=("lang", "phrase", "chunk"))
    rows = [(r.text, r.lang) for r in docs.collect()]
    got = phrase_collocations(docs, least=2, top=50, chunk_bytes=4000).collect()
    same_rows([tuple(r) for r in got], plain(rows, 2, 50))
    none = phrase_collocations(empty_docs(spark).selectExpr("*", "'en' as lang"))
    assert none.columns == COLUMNS and none.count() == 0


def test_chunks_and_words():
    text = ("one two, three\x0bfour " * 50 + "ONE\ttwo" * 100 + ". é\x1cé Ä").encode()
    flat = np.frombuffer(text, np.uint8)
    parts = list(chunks(flat, 64))
    assert b"".join(p.tobytes() for p in parts) == text and len(parts) > 10
    assert all(KIND[p[-1]] == 2 for p in parts[:-1])
    seq, words, counts = numbered_words(flat)
    names = words.to_pylist()
    got = [" ".join(names[i] for i in run) for run in np.split(seq, np.flatnonzero(seq == -1)) for run in [run[run >= 0]] if len(run)]
    pieces = [" ".join(re.split(r"[ \t]+", p.strip(" \t"))) for p in re.split(r"[.,;:!?\x0A-\x0D]", text.decode())]
    want = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in p) for p in pieces if p]
    assert got == want and counts.sum() == (seq >= 0).sum()
