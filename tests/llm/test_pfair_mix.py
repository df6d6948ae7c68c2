"""Pfair mixing: the schedule against a plain one, its deviation, block positions."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recallscope.llm.pfair_mix import integer_shares, pfair_mix, schedule, tempered_targets
from tests.llm.util import empty_docs, odd_docs


def plain(shares):
    total, done, out = sum(shares), [0] * len(shares), []
    for t in range(total):
        due = [(-(-(done[i] + 1) * total // w), i) for i, w in enumerate(shares) if done[i] * total // w <= t]
        i = min(due)[1]
        out.append((i, done[i], t))
        done[i] += 1
    return out


@pytest.mark.parametrize("shares", [[1], [5, 5], [500, 300, 199, 1], [7, 1, 1, 1], list(range(1, 21)), [334, 333, 333]])
def test_schedule(spark, shares):
    got = sorted((r["index"], r.ordinal, r.slot) for r in schedule(spark, shares).collect())
    assert got == sorted(plain(shares))
    total, done = sum(shares), Counter()
    for i, k, t in sorted(got, key=lambda x: x[2]):
        assert k * total // shares[i] <= t < -(-(k + 1) * total // shares[i])  # between release and deadline
        done[i] += 1
        assert all(abs(done[j] - (t + 1) * w / total) < 1 for j, w in enumerate(shares))
    assert done == Counter(dict(enumerate(shares)))


def test_integer_shares():
    s = integer_shares({"a": 1, "b": 1, None: 1})
    assert sum(s.values()) == 1000 and sorted(s.values()) == [333, 333, 334]
    tiny = integer_shares({f"s{i}": 1e-6 for i in range(20)} | {"big": 1.0})
    assert sum(tiny.values()) == 1000 and min(tiny.values()) == 1
    for bad in ({"a": 0.0}, {"a": -1.0}, {str(i): 1.0 for i in range(1001)}):
        with pytest.raises(ValueError):
            integer_shares(bad)


def brute(rows, shares, block_chars):
    names, total = list(shares), sum(shares.values())
    slot = {(i, k): t for i, k, t in plain(list(shares.values()))}
    out = []
    for n, s in enumerate(names):
        at = 0
        mine = [(hashlib.md5((str(i) if i is not None else "").encode()).hexdigest(), i is not None, i or 0, len(t or ""), i) for i, t, x in rows if x == s]
        for *_, length, i in sorted(mine):
            b, w = at // block_chars, shares[s]
            out.append((i, s, b + 1, b * total // w, -(-(b + 1) * total // w), b // w * total + slot[n, b % w], at % block_chars))
            at += length
    return out


COLUMNS = ("doc_id", "source", "block", "release", "deadline", "slot", "block_offset")


def test_blocks(spark):
    rows = [(i, "x" * (i * 37 % 900), "hot" if i % 3 == 0 else (None if i % 10 == 1 else f"s{i % 4}")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    targets = tempered_targets(docs)
    assert set(targets) == {"hot", None, "s0", "s1", "s2", "s3"}
    import recallscope.llm.pfair_mix as module

    old, module.RANGE_ROWS = module.RANGE_ROWS, 100
    try:
        mixed = pfair_mix(docs, targets, block_chars=1000)
    finally:
        module.RANGE_ROWS = old
    got = [tuple(r[c] for c in COLUMNS) for r in mixed.collect()]
    assert Counter(got) == Counter(brute(rows, integer_shares(targets), 1000))
    # while no source has ended, every prefix of slots holds each source's share to within a block
    last = min(max(g[5] for g in got if g[1] == s) for s in targets)
    blocks = {(g[1], g[2]): g[5] for g in got}
    share = integer_shares(targets)
    for t in range(0, last, 7):
        for s, w in share.items():
            done = sum(1 for k, v in blocks.items() if k[0] == s and v <= t)
            assert abs(done - (t + 1) * w / 1000) < 1 + 1e-9
    assert not re.search("Python|Pandas|Arrow", mixed._jdf.queryExecution().executedPlan().toString())


def test_odd_input(spark):
    docs = odd_docs(spark, extra=("slot", "block", "note", "__index", "ordinal")).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "even"))
    mixed = pfair_mix(docs, {"even": 1.0, None: 3.0, "absent": 1.0}, block_chars=100)
    rows = mixed.collect()
    assert mixed.columns == ["doc_id", "text", "note", "__index", "ordinal", "source", "block", "release", "deadline", "slot", "block_offset"]
    given = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert len(rows) == len(given)
    # rows that repeat an id tie by length, as in the plain version
    want = brute(given, integer_shares({"even": 1.0, None: 3.0, "absent": 1.0}), 100)
    assert Counter((r.doc_id, r.source, r.block, r.slot) for r in rows) == Counter((w[0], w[1], w[2], w[5]) for w in want)
    none = empty_docs(spark).withColumn("source", F.lit("a"))
    assert pfair_mix(none, {"a": 1.0}).collect() == [] and pfair_mix(none, tempered_targets(none)).collect() == []
    with pytest.raises(Exception, match="no target weight"):
        pfair_mix(docs, {"even": 1.0}).collect()
