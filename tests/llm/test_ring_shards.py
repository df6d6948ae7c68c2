import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.llm.queries import op11_ring_shards
from recallscope.llm.ring_shards import Ring, capacities, ring_shards
from tests.conftest import SF001
from tests.llm.util import empty_docs, odd_docs


def plain(keys, shards, points, capacity):
    """One key at a time: rounds of keys along the circle, each walking the ring by itself.
    Gives (shard, full shards passed) of every key of a list without repeats."""
    spot = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    ring = sorted((spot(f"shard {s} point {v}"), s) for s in range(shards) for v in range(points))

    def walk(at):
        first = next((i for i, (p, _) in enumerate(ring) if p >= at), 0)
        return list(dict.fromkeys(s for _, s in ring[first:] + ring[:first]))

    waiting = [(k, walk(spot(str(k)))) for k in sorted(keys, key=lambda k: spot(str(k)))]
    load, found = [0] * shards, {}
    for hop in range(shards):
        turned = []
        for key, shard in waiting:
            if load[shard[hop]] < capacity[shard[hop]]:
                load[shard[hop]] += 1
                found[key] = shard[hop], hop
            else:
                turned.append((key, shard))
        waiting = turned
    assert not waiting
    return found


def checked(rows, shards):
    """Slots gapless from 0 in every shard."""
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    return [sum(r.shard == s for r in rows) for s in range(shards)]


@pytest.mark.parametrize("shards,points,slack,n", [(24, 256, 0.0, 1500), (5, 3, 0.0, 403), (7, 1, 0.1, 500), (1, 4, 0.0, 50), (30, 8, 0.0, 11)])
def test_equals_brute_force(spark, shards, points, slack, n):
    ids = spark.range(n).select((F.col("id") * 3 - 40).alias("doc_id")).repartition(4)
    rows = ring_shards(ids, shards=shards, points=points, slack=slack, rows_per_task=100).collect()
    want = plain([r.doc_id for r in rows], shards, points, capacities(n, shards, slack))
    assert {r.doc_id: (r.shard, r.hops) for r in rows} == want and len(rows) == n
    sizes = checked(rows, shards)
    assert max(sizes) <= np.ceil(n * (1 + slack) / shards)
    if not slack:
        assert max(sizes) - min(sizes) <= 1


def test_independent_of_storage(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    a = ring_shards(ids.repartition(7), rows_per_task=200).collect()
    b = ring_shards(ids.orderBy(F.col("doc_id").desc()).coalesce(2), rows_per_task=900).collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}


@pytest.mark.parametrize("slack,most", [(0.0, 0.07), (0.15, 0.05)])
def test_one_more_shard_moves_few(spark, slack, most):
    """A new shard of 25 must take 4 %; the rest is what full shards pass on. Dealing by remainder moves 96 %."""
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    of = lambda n: {r.doc_id: r.shard for r in ring_shards(ids, shards=n, slack=slack).collect()}
    old, new = of(24), of(25)
    moved = sum(old[k] != new[k] for k in old) / len(old)
    assert 0.03 < moved < most


def test_runs_are_bounded_by_the_ring():
    ring = Ring(24)
    counts = np.random.default_rng(1).integers(0, 10**9, len(ring.spots) + 1)
    runs = ring.runs(counts, capacities(int(counts.sum()), 24))
    assert len(runs) <= len(ring.spots) + 1 + 24
    with pytest.raises(ValueError, match="capacities"):
        ring.runs(counts, [1] * 24)


def test_a_hot_id_is_split(spark):
    """A third of the rows share an id (and a part of those every column): the balance holds, and no
    task of the numbering gets them all."""
    ids = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
                                   F.when(F.col("id") % 6 == 0, 1).otherwise(F.col("id")).alias("x"))
    rows = ring_shards(ids, rows_per_task=100).collect()
    sizes = checked(rows, 24)
    assert len(rows) == 3000 and max(sizes) - min(sizes) <= 1


def test_odd_rows(spark):
    """Null ids and texts, repeated rows and ids, columns named like the results."""
    docs = odd_docs(spark, extra=("shard", "slot", "at"))
    out = ring_shards(docs, shards=4)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "at", "shard", "slot", "hops"]
    sizes = checked(rows, 4)
    assert len(rows) == docs.count() and max(sizes) - min(sizes) <= 1
    assert sorted(map(str, out.select("doc_id", "text", "at").collect())) == sorted(
        map(str, docs.select("doc_id", "text", "at").collect()))
    empty = ring_shards(empty_docs(spark))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "shard", "slot", "hops"]
    with pytest.raises(ValueError):
        ring_shards(docs, shards=0)


def test_query(spark):
    """The contract's columns on the whole table, against the plain version."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = op11_ring_shards(spark, SF001)
    assert [(f.name, f.dataType) for f in out.schema.fields][:7] == [
        ("doc_id", T.LongType()), ("size", T.LongType()), ("text_crc32", T.LongType()), ("law", T.StringType()),
        ("shard", T.IntegerType()), ("slot", T.LongType()), ("grown_shard", T.IntegerType())]
    rows = out.collect()
    want = plain(list(docs), 24, 256, capacities(len(docs), 24))
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
        assert (r.shard, r.hops) == want[r.doc_id]
    sizes = checked(rows, 24)
    assert len(rows) == len(docs) and max(sizes) - min(sizes) <= 1
