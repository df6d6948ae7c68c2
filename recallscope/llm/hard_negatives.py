"""Hard negatives by Strassen products of anchor and candidate tiles.

Scores are integer inner products. Anchors (a stated query set) and candidates are
dealt to cells: a cell holds one group of anchors and one group of candidates, both
of a bounded number of rows, and multiplies them tile by tile with Strassen's
recursion on zero-padded int64 tiles. Its seven products need only additions,
subtractions and multiplications, which int64 does exactly modulo 2**64; a bound on
the operands, checked for every cell, makes sure that no score leaves 64 bits.

Two passes over the cells: the first keeps, per anchor, a heap of its best rows of
the same label (the positives), the second, per anchor and positive, a heap of the
best rows of another label in that positive's score window. A heap of a cell has at
most k rows; heaps merge by keeping the first k of their union, which Spark does
before and after the shuffle (a rank filter over a window keeps k rows per task).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallscope.session import materialize

LEAF = 16  # tiles at or below this side are multiplied directly
TILE = (512, 4096)  # anchors x candidates of one product
GROUP_BYTES = 4 << 20  # int64 components of the anchors, and of the candidates, of a cell
SCALE = 256.0


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` over int64 (modulo 2**64) by Strassen's recursion. The sides are padded
    with zeros to equal multiples of a power of two, so every level halves evenly;
    the recursion ends when the least side is at most ``leaf``."""
    (m, k), n = a.shape, b.shape[1]
    least, depth = min(m, k, n), 0
    while least > leaf << depth:
        depth += 1
    if depth == 0:
        return a @ b
    unit = 1 << depth
    pad = lambda x: np.pad(x, [(0, -s % unit) for s in x.shape])
    return _halves(pad(a), pad(b), depth)[:m, :n]


def _halves(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if depth == 0:
        return a @ b
    i, k, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    d = depth - 1
    p1 = _halves(a11 + a22, b11 + b22, d)
    p2 = _halves(a21 + a22, b11, d)
    p3 = _halves(a11, b12 - b22, d)
    p4 = _halves(a22, b21 - b11, d)
    p5 = _halves(a11 + a12, b22, d)
    out = np.empty((a.shape[0], b.shape[1]), np.int64)
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    p3 += p1
    p3 -= p2
    p3 += _halves(a21 - a11, b11 + b12, d)
    out[i:, j:] = p3
    p1 += p4
    p1 -= p5
    p1 += _halves(a12 - a22, b21 + b22, d)
    out[:i, :j] = p1
    return out


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(256 * x) of each component as an int64 matrix, shorter vectors padded with zeros."""
    lengths = pc.list_value_length(vectors).to_numpy().astype(np.int64)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise ValueError("a component is too large for 64-bit scores")
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat.astype(np.int64)
    return out


def first_k(scores: np.ndarray, valid: np.ndarray, k: int):
    """Of each row the ``k`` best valid columns, larger scores first and ties by smaller
    column: yields (row, columns) for rows that have any."""
    low = np.iinfo(np.int64).min
    masked = np.where(valid, scores, low)
    if masked.shape[1] > k:
        least = np.partition(masked, masked.shape[1] - k, axis=1)[:, -k]
    else:
        least = np.full(len(masked), low)
    keep = valid & (masked >= least[:, None])
    rows, columns = np.nonzero(keep)
    ends = np.searchsorted(rows, np.arange(len(masked) + 1))
    for r in np.flatnonzero(np.diff(ends)):
        at = columns[ends[r] : ends[r + 1]]  # ascending, so a stable sort keeps ties in order
        yield r, at[np.argsort(-masked[r, at], kind="stable")[:k]]


class _Cell:
    """The anchors and candidates of a cell, candidates by ascending id, labels as common codes."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table):
        candidates = candidates.rename_columns([c.removeprefix("c_") for c in candidates.column_names]).sort_by("id")
        self.anchor_ids, self.ids = (t.column("id").to_numpy() for t in (anchors, candidates))
        labels = pa.chunked_array([*anchors.column("label").chunks, *candidates.column("label").chunks],
                                  anchors.schema.field("label").type).combine_chunks().dictionary_encode()
        codes = labels.indices.to_numpy()
        self.anchor_labels, self.labels = codes[: anchors.num_rows], codes[anchors.num_rows :]
        a, c = (quantised(t.column("v").combine_chunks()) for t in (anchors, candidates))
        width = max(a.shape[1], c.shape[1])
        self.a, self.c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, c))
        # the windows compare 100 times a score; Python's integers cannot overflow here
        bound = 100 * width * int(np.abs(self.a).max(initial=0)) * int(np.abs(self.c).max(initial=0))
        if bound >= 1 << 63:
            raise ValueError("scores of these vectors would not fit in 64 bits")

    def tiles(self, same_label: bool):
        """(anchor rows, candidate rows, their scores); with ``same_label`` only of equal labels."""
        pairs = [(np.flatnonzero(self.anchor_labels == x), np.flatnonzero(self.labels == x))
                 for x in np.unique(self.anchor_labels)] if same_label else [
                     (np.arange(len(self.a)), np.arange(len(self.c)))]
        for rows, columns in pairs:
            for i in range(0, len(rows), TILE[0]):
                for j in range(0, len(columns), TILE[1]):
                    r, c = rows[i : i + TILE[0]], columns[j : j + TILE[1]]
                    yield r, c, strassen(self.a[r], self.c[c].T)


def _heap_rows(cell: _Cell, found: list[tuple], extra: list[str]) -> pa.Table:
    """Rows (anchor, *extra, id, score) of heaps given as (anchor row, extra values, candidate rows, scores)."""
    size = [len(f[2]) for f in found]
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    out = {"anchor_id": cell.anchor_ids[np.repeat(np.array([f[0] for f in found], np.int64), size)]}
    for e, name in enumerate(extra):
        out[name] = np.repeat(np.array([f[1][e] for f in found], np.int64), size)
    out["id"] = cell.ids[join([f[2] for f in found])]
    out["score"] = join([f[3] for f in found])
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _positives(k: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        cell, found = _Cell(anchors, candidates), []
        for r, c, scores in cell.tiles(True):
            other = cell.anchor_ids[r][:, None] != cell.ids[c][None, :]
            found += [(r[i], (), c[at], scores[i, at]) for i, at in first_k(scores, other, k)]
        return _heap_rows(cell, found, [])
    return run


def _negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        cell, found = _Cell(anchors, candidates), []
        positives = [[(x["id"], x["score"]) for x in p] for p in anchors.column("positives").to_pylist()]
        for r, c, scores in cell.tiles(False):
            other = cell.anchor_labels[r][:, None] != cell.labels[c][None, :]
            hundredfold = scores * 100
            for slot in range(max((len(positives[i]) for i in r), default=0)):
                have = np.array([slot < len(positives[i]) for i in r])
                own = [positives[i][slot] if slot < len(positives[i]) else (0, 0) for i in r]
                p = np.array([score for _, score in own], np.int64)[:, None]
                window = other & have[:, None] & (low * p <= hundredfold) & (hundredfold <= high * p)
                found += [(r[i], own[i], c[at], scores[i, at]) for i, at in first_k(scores, window, k)]
        return _heap_rows(cell, found, ["positive_id", "positive_score"])
    return run


def _merged(heaps: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key's heaps, with ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _clean(rows: DataFrame) -> DataFrame:
    """Rows that take part, one per id: the least (label, vector) of those that repeat an id."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    repeats = rows.groupBy("id").count().agg(F.max("count")).first()[0] or 0  # combined map-side, ids only
    if repeats > 1:
        least = rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("row"))
        rows = least.select("id", "row.label", "row.v", "row.anchor")
    return rows


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label: Column | None = None, positives: int = 5, negatives: int = 10,
                   window: tuple[int, int] = (30, 90), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For each anchor (a row where ``anchors`` holds) and each of its first ``positives``
    other rows of the same label, the first ``negatives`` rows of another label whose
    score lies in the window (percent of the positive's score, both ends included).

    Components are quantised to ``floor(256 * x)``; a score is the integer inner product
    with the anchor; larger scores come first, ties by smaller id. Rows with a null id,
    label or vector, or with a null or non-finite component, take no part. An id counts
    once: of rows that repeat one, the least by (label, vector). Vectors of different
    lengths are padded with zeros; the empty vector scores 0. A score that could leave
    64 bits is an error. An anchor without positives, or a positive without rows in its
    window, gives no rows; an empty table gives an empty result. Columns besides id,
    label and vector are left out, whatever they are called.

    Result: anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score.
    """
    kept = _clean(rows.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).alias("label"),
                              F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor")))
    n, n_anchors, width = kept.agg(F.count("id"), F.count_if("anchor"), F.max(F.size("v"))).first()
    per_group = max(256, group_bytes // (8 * max(width or 0, 1)))
    p, q = max(1, -(-n_anchors // per_group)), max(1, -(-n // per_group))
    spark = rows.sparkSession
    tasks = min(p * q, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))

    def dealt(side: DataFrame, own: Column, groups: int, cell: Column) -> DataFrame:
        """Each row once for every group of the other side."""
        return (side.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
                .withColumn("cell", cell).drop("own", "other", "anchor").repartition(tasks, "cell"))

    candidates = dealt(kept, F.pmod(F.xxhash64("id"), F.lit(q)), p, F.col("other") * F.lit(q).cast("long") + F.col("own"))
    candidates = candidates.select(*[F.col(c).alias(f"c_{c}") for c in candidates.columns])  # apart from the anchors' columns
    asked = kept.where("anchor")
    in_cells = lambda x: dealt(x, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(p)), q,
                               F.col("own") * F.lit(q).cast("long") + F.col("other")).groupBy("cell").cogroup(
                                   candidates.groupBy("c_cell"))
    heaps = in_cells(asked).applyInArrow(_positives(positives), "anchor_id long, id long, score long")
    best = materialize(_merged(heaps, ["anchor_id"], positives))
    best = best.groupBy(F.col("anchor_id").alias("id")).agg(  # at most ``positives`` entries
        F.array_sort(F.collect_list(F.struct("rank", F.col("id"), "score"))).alias("positives"))
    heaps = in_cells(asked.join(best, "id")).applyInArrow(
        _negatives(negatives, *window), "anchor_id long, positive_id long, positive_score long, id long, score long")
    merged = _merged(heaps, ["anchor_id", "positive_id"], negatives)
    return merged.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                         F.col("score").alias("negative_score"))
