"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``points`` pseudo-random points of a circle of 60-bit positions. A key
(the md5 of the id) belongs to the first point clockwise of it, and to that point's
shard unless the shard is full: then it continues clockwise to the next shard, and
so on. With capacities that add up to the number of rows no shard can be over full or
under full, so the balance is exact; with ``slack`` capacities are larger by that share
and fewer keys move on.

Keys arrive in rounds, which makes the outcome independent of how the rows are stored:
first every key tries its own shard, then those turned away try their second
distinct shard clockwise, and so on; within a round keys come in the order of the
circle. All keys between two points (an arc) try the same shards, so the rounds are
decided from one count per arc, a table bounded by the ring. What an arc gives to
a shard is a run of its keys in circle order. Rows are numbered along the circle (a
range-partitioned sort of narrow rows, where equal ids are split by the rest of the row and
its place, so no id can fill a task), and a row's number picks its run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.llm.passing import ROW, packed, unpacked
from recallscope.session import materialize

POINTS = 256  # virtual nodes of a shard
ROWS_PER_TASK = 100_000
MOST_TASKS = 8192  # so what the driver sees of the numbering is bounded: a count per task


def position(key: Column) -> Column:
    """A key's place on the circle: the first 60 bits of the md5 of its text (null: of '')."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


class Ring:
    def __init__(self, shards: int, points: int = POINTS):
        if shards < 1 or points < 1:
            raise ValueError("a ring needs at least one shard and one point")
        spot = lambda s, v: int(hashlib.md5(f"shard {s} point {v}".encode()).hexdigest()[:15], 16)
        ring = sorted((spot(s, v), s) for s in range(shards) for v in range(points))
        self.shards = shards
        self.spots = np.array([p for p, _ in ring], np.int64)
        self.owners = [s for _, s in ring]

    def arcs(self, positions: np.ndarray) -> np.ndarray:
        """Index of the first point at or after each position. Keys after the last point
        form an arc of their own, which continues at the first point."""
        return np.searchsorted(self.spots, positions, "left")

    def clockwise(self, arc: int) -> Iterator[int]:
        """The distinct shards met from an arc on."""
        seen = set()
        for k in range(len(self.owners)):
            s = self.owners[(arc + k) % len(self.owners)]
            if s not in seen:
                seen.add(s)
                yield s

    def runs(self, counts: np.ndarray, capacity: list[int]) -> np.ndarray:
        """Who gets what: rows (first number along the circle, shard, first slot, full
        shards passed) in ascending order of number, for the key count of every arc. An
        arc that is turned away in part fills a shard, so there are at most as many
        rows as arcs and shards."""
        free, out = list(capacity), []
        start = np.concatenate([[0], np.cumsum(counts)])
        waiting = [(a, int(start[a]), int(start[a + 1]), self.clockwise(a)) for a in np.flatnonzero(counts)]
        hops = 0
        while waiting:
            turned = []
            for a, low, high, walk in waiting:
                s = next(walk, None)
                if s is None:
                    raise ValueError("the capacities are less than the number of rows")
                take = min(free[s], high - low)
                free[s] -= take
                if take:
                    out.append([low, s, 0, hops])
                if low + take < high:
                    turned.append((a, low + take, high, walk))
            waiting, hops = turned, hops + 1
        out = np.array(sorted(out), np.int64).reshape(-1, 4)
        size = np.diff(np.append(out[:, 0], start[-1]))
        for s in range(self.shards):
            own = out[:, 1] == s
            out[own, 2] = np.cumsum(size[own]) - size[own]
        return out


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Of each shard. Without slack they differ by one at most and add up to ``rows``."""
    if slack < 0:
        raise ValueError("slack must not be negative")
    if slack:
        return [int(np.ceil(rows * (1 + slack) / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def ring_shards(docs: DataFrame, id_col: str = "doc_id", shards: int = 24, points: int = POINTS, slack: float = 0.0,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1), ``slot`` (gapless from 0 in the shard, along
    the circle) and ``hops`` (full shards passed on the way).

    Without ``slack`` the numbers of rows differ by one at most; with it none exceeds
    ``ceil(rows * (1 + slack) / shards)``. Null ids are one key; rows that repeat an id
    have one place on the circle, stand there in the order of a hash of the whole row, and
    may end in neighbouring shards when theirs is full. An empty table gives an empty
    result. All columns given travel through two shuffles of the table, so give only those
    that are needed; input columns named like an added one are replaced.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot", "hops")]
    ring = Ring(shards, points)
    placed = materialize(docs.select(packed(columns), position(F.col(f"`{id_col}`")).alias("at"),
                                     F.xxhash64(*[F.col(f"`{c}`") for c in columns]).alias("tie"),
                                     F.monotonically_increasing_id().alias("place")))
    rows = placed.count()
    tasks = min(MOST_TASKS, max(1, -(-rows // rows_per_task)))
    ranged = placed.repartitionByRange(tasks, "at", "tie", "place").sortWithinPartitions("at", "tie", "place")
    ranged = materialize(ranged.select(ROW, "at", F.monotonically_increasing_id().alias("number")))  # task << 33 | row

    def tally(batches):
        """Rows per task (negative keys) and per arc of each batch."""
        for batch in batches:
            task, n_task = np.unique(batch.column(1).to_numpy() >> 33, return_counts=True)
            arc, n_arc = np.unique(ring.arcs(batch.column(0).to_numpy()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([-1 - task, arc]), pa.int64()),
                                              pa.array(np.concatenate([n_task, n_arc]), pa.int64())], ["key", "n"])

    seen = dict(ranged.select("at", "number").mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n")).collect())
    counts = np.zeros(len(ring.spots) + 1, np.int64)
    sizes = np.zeros(1 + max((-1 - k for k in seen if k < 0), default=0), np.int64)
    for key, n in seen.items():
        if key < 0:
            sizes[-1 - key] = n
        else:
            counts[key] = n
    base = np.cumsum(sizes) - sizes
    runs = ring.runs(counts, capacities(rows, shards, slack))
    low = (1 << 33) - 1

    def assign(batches):
        for batch in batches:
            number = batch.column(1).to_numpy()
            along = base[number >> 33] + (number & low)
            run = runs[np.searchsorted(runs[:, 0], along, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(run[:, 1], pa.int32()), pa.array(run[:, 2] + along - run[:, 0], pa.int64()),
                 pa.array(run[:, 3], pa.int32())], names=[ROW, "shard", "slot", "hops"])

    schema = T.StructType([ranged.schema[ROW], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()),
                           T.StructField("hops", T.IntegerType())])
    return ranged.select(ROW, "number").mapInArrow(assign, schema).select(*unpacked(columns), "shard", "slot", "hops")
