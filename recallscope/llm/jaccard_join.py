"""N-gram Jaccard self-join by MinHash banding.

1. Copies first: texts with the same words in the same order are one node.
2. A node's MinHash signature over its word n-grams is cut into bands; band and
   row counts follow from the target recall at the threshold. Nodes that agree
   in a band meet by a shuffle on the band's hash, and each is linked to the
   least node of that bucket only, so a bucket of any size gives as many rows as
   it has members.
3. The components of those links hold all candidate pairs. Each is verified on
   full n-gram sets: small ones many to a task; a large one is cut into blocks,
   and every two blocks meet in a task of their own. A task returns one row per
   node (its number of links and a representative it is linked with), never pairs.
4. The components of the verified links are the classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.llm.arrays import U64, Words, byte_slices, distinct, mix, runs, trim, utf8, windows
from recallscope.llm.components import connected_components
from recallscope.llm.stages import materialize

NODE = "__node"
BLOCK = 512  # nodes of a component verified against each other in one task
BIN_BYTES = 4 << 20  # text of small components verified in one task
SMALL = 24  # up to so many nodes, components are verified together


def choose_bands(threshold: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which bands enough to find a pair at
    the threshold with probability ``recall`` need at most ``most_hashes``."""
    for rows in range(16, 0, -1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no banding reaches the recall with so few hashes")


def node_key(text_col: str):
    """64-bit hash of a text's word sequence; null without a word."""
    words = F.trim(F.regexp_replace(F.col(text_col), r"[\x20\x09-\x0D]+", " "))
    return F.when(words != "", F.xxhash64(words))


def ngram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All n-gram hashes of the texts, and where each text's begin and end. A text
    of fewer than ``n`` words has one: all its words."""
    grams, _ = windows(words.hash, words.text, n)
    first, count = words.first[:-1], words.counts
    short = np.flatnonzero((count > 0) & (count < n))
    whole = np.array([_fold(words.hash[first[i] : first[i] + count[i]]) for i in short], U64)
    begin = np.minimum(first, len(grams))
    end = np.minimum(first + np.maximum(count - n + 1, 0), len(grams))
    begin[short] = len(grams) + np.arange(len(short))
    end[short] = begin[short] + 1
    return np.concatenate([grams, whole]), begin, end


def _fold(hashes: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        out = U64(len(hashes))
        for h in hashes:
            out = mix(np.array([out * U64(0x9E3779B97F4A7C15) + h], U64))[0]
    return int(out)


def signatures(grams, begin, end, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """Band hashes (texts x bands) of MinHash signatures; texts without n-grams give zeros."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, bands * rows, dtype=U64) * U64(2) + U64(1)
    b = rng.integers(0, 1 << 63, bands * rows, dtype=U64)
    weight = rng.integers(0, 1 << 63, rows, dtype=U64) * U64(2) + U64(1)
    least = np.zeros((len(begin), bands * rows), U64)
    for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist())):
        for z in range(x, y, 2048):
            low = (grams[z : min(y, z + 2048), None] * a + b).min(axis=0)
            least[i] = low if z == x else np.minimum(least[i], low)
    folded = (mix(least).reshape(-1, bands, rows) * weight).sum(axis=2, dtype=U64)
    return mix(folded + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(set, column) of the n-grams that lie in at least two of the sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    gram = np.concatenate(sets) if sets else np.zeros(0, U64)
    order = np.argsort(gram, kind="stable")
    start = runs(gram[order])
    size = np.diff(np.append(start, len(order)))
    keep = np.repeat(size > 1, size)
    column = np.repeat(np.cumsum(size > 1) - 1, size)[keep]
    return row[order][keep], column, int((size > 1).sum())


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets (of left, or of left with right)."""
    row, column, width = _incidence(left + (right or []))
    m = len(left)
    out = np.zeros((m, len(right) if right is not None else m), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, width, 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        dense = np.zeros((m + len(right or []), min(4096, width - low)), np.float32)
        dense[row[i:j], column[i:j] - low] = 1
        out += dense[:m] @ (dense[m:] if right is not None else dense).T
    return out


def _pairs_of_small(sets: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of sets of one group with a common n-gram, and how many they share."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    key = np.concatenate([mix(s ^ mix(np.array([g], U64))) for s, g in zip(sets, group.astype(U64))])
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    found, step = [], 1
    while True:
        same = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        found.append(row[same] * len(sets) + row[same + step])
        step += 1
    pairs = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    start = runs(pairs)
    pair, n = pairs[start], np.diff(np.append(start, len(pairs)))
    return pair // max(len(sets), 1), pair % max(len(sets), 1), n


class _Links:
    """Links found in a task: weighted number by node, and a forest over them."""

    def __init__(self, copies: np.ndarray):
        self.copies, self.links, self.root = copies, np.zeros(len(copies), np.int64), list(range(len(copies)))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.links, x, self.copies[y])
        np.add.at(self.links, y, self.copies[x])
        for a, b in zip(x.tolist(), y.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)


def _verify(n: int, threshold: float, text_col: str):
    """A task's table (component, block pair, node, copies, text) -> (node, linked, links)."""

    def similar(common, x, y):
        return common * (1 + threshold) >= threshold * (x + y) - 1e-9

    def verify(table):
        table = table.sort_by([("__component", "ascending"), (NODE, "ascending")])
        node = table.column(NODE).to_numpy()
        once = np.concatenate([[True], node[1:] != node[:-1]])  # rows that repeat an id and its text
        table, node = table.filter(pa.array(once)), node[once]
        grams, begin, end = ngram_sets(Words(*utf8(table.column(text_col))), n)
        sets = [distinct(grams[x:y]) for x, y in zip(begin, end)]
        size = np.array([len(s) for s in sets], np.int64)
        component, block = table.column("__component").to_numpy(), table.column("__block").to_numpy()
        first, second = table.column("__i")[0].as_py(), table.column("__j")[0].as_py()
        links = _Links(table.column("__copies").to_numpy())
        if first < 0:
            start = runs(component)
            count = np.diff(np.append(start, len(component)))
            small = np.repeat(count <= SMALL, count)
            if small.any():
                spot = np.flatnonzero(small)
                x, y, common = _pairs_of_small([sets[i] for i in spot], component[spot])
                x, y = spot[x], spot[y]
                good = (x != y) & similar(common, size[x], size[y])
                links.add(x[good], y[good])
            wholes = [np.arange(s, s + c) for s, c in zip(start, count) if c > SMALL]
        else:
            wholes = [np.arange(len(node))] if first == second else []
        for spot in wholes:
            common = _common([sets[i] for i in spot], None)
            x, y = np.nonzero(np.triu(similar(common, size[spot][:, None], size[spot][None, :]), 1))
            links.add(spot[x], spot[y])
        if first >= 0 and first != second:
            left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
            common = _common([sets[i] for i in left], [sets[i] for i in right])
            x, y = np.nonzero(similar(common, size[left][:, None], size[right][None, :]))
            links.add(left[x], right[y])
        trim()
        return pa.table({NODE: node, "linked": node[[links.find(i) for i in range(len(node))]], "links": links.links})

    return verify


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8,
                 recall: float = 0.99999, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: the id, the node (null without a word),
    ``class_id`` (least id of its class), ``n_links`` (other documents with a Jaccard
    similarity of at least ``threshold`` over word n-grams, copies included),
    ``n_copies`` (documents with the same words) and ``keep`` (true for one row's id
    and node of each class).

    A text of fewer than ``n`` words is one n-gram. A null, empty or blank text has
    no n-grams, no links and a class of its own (``class_id`` is its id). Rows that
    repeat an id are documents of their own; a class in which every id is null has
    a null ``class_id``. An empty table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col(id_col).alias("__id"), node_key(text_col).alias(NODE), F.col(text_col).alias("__text"))

    def sign(batches):
        for batch in (x for whole in batches for x in byte_slices(whole, 2)):
            words = Words(*utf8(batch.column(2)))
            s = signatures(*ngram_sets(words, n), bands, rows).view(np.int64)
            offsets = pa.array(np.arange(len(s) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words.counts, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(s.ravel()))], names=["__id", NODE, "words", "bands"])

    signed = materialize(texts.mapInArrow(sign, T.StructType([
        T.StructField("__id", docs.schema[id_col].dataType), T.StructField(NODE, T.LongType()),
        T.StructField("words", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])))

    nodes = signed.where(F.col(NODE).isNotNull()).groupBy(NODE).agg(
        F.min("__id").alias("__least"), F.count(F.lit(1)).alias("__copies"), F.max("words").alias("words"),
        F.first("bands").alias("bands"))
    nodes = materialize(nodes)
    buckets = nodes.select(NODE, F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min(NODE).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    edges = buckets.join(shared, "bucket").where(F.col(NODE) != F.col("hub")).select(F.col(NODE).alias("a"), F.col("hub").alias("b"))
    candidate = connected_components(edges)

    verified = materialize(_verified(texts, nodes, candidate, n, threshold, block))
    classes = connected_components(verified.select(F.col(NODE).alias("a"), F.col("linked").alias("b")))
    links = verified.groupBy(NODE).agg(F.sum("links").alias("links"))
    found = (nodes.select(NODE, "__least", "__copies")
             .join(classes.withColumnRenamed("node", NODE), NODE, "left").join(links, NODE, "left")
             .withColumn("component", F.coalesce("component", NODE)))
    # the document that stays: least id, then least node; a null id comes last
    heads = found.groupBy("component").agg(F.min(F.struct(
        F.col("__least").isNull().alias("z"), F.col("__least").alias("id"), F.col(NODE).alias("node"))).alias("head"))
    found = found.join(heads, "component").select(
        NODE, F.col("head.id").alias("class_id"), F.col("head.node").alias("__head"), "__copies",
        (F.coalesce("links", F.lit(0)) + F.col("__copies") - 1).alias("n_links"))
    out = signed.select("__id", NODE).join(found, NODE, "left")
    alone = F.col(NODE).isNull()
    return out.select(
        F.col("__id").alias(id_col), NODE,
        F.when(alone, F.col("__id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("__copies", F.lit(1)).alias("n_copies"),
        (alone | ((F.col(NODE) == F.col("__head")) & F.col("__id").eqNullSafe(F.col("class_id")))).alias("keep"))


def _verified(texts: DataFrame, nodes: DataFrame, candidate: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(node, linked, links) of the candidate components, a row per node and task."""
    sizes = candidate.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    total = candidate.join(nodes, candidate["node"] == nodes[NODE]).agg(F.sum("words")).first()[0] or 0
    bins = max(1, -(-int(total) * 8 // BIN_BYTES))
    many = F.ceil(F.col("size") / F.lit(block)).cast("int")
    wanted = (candidate.join(sizes, "component").join(nodes, candidate["node"] == nodes[NODE])
              .select(NODE, "__least", "__copies", "component", many.alias("__many")))
    found = texts.withColumnRenamed(NODE, "__own").join(
        wanted, F.col("__id").eqNullSafe(F.col("__least")) & (F.col("__own") == F.col(NODE)))
    own = F.when(F.col("__many") > 1, F.pmod(F.xxhash64(NODE), F.col("__many")).cast("int")).otherwise(F.lit(-1))
    partners = F.when(F.col("__many") > 1, F.sequence(F.lit(0), F.col("__many") - 1)).otherwise(F.array(F.lit(-1)))
    task = F.when(F.col("__many") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins)))
    dealt = (found.select(NODE, "__copies", F.col("component").alias("__component"), task.alias("__task"),
                          own.alias("__block"), F.explode(partners).alias("__other"), "__text")
             .withColumn("__i", F.least("__block", "__other")).withColumn("__j", F.greatest("__block", "__other"))
             .drop("__other"))
    return dealt.groupBy("__task", "__i", "__j").applyInArrow(
        _verify(n, threshold, "__text"), f"{NODE} long, linked long, links long")


def keep_one(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``jaccard_join`` keeps, one of each class (texts
    without a word all stay)."""
    kept = (decided.where(F.col("keep") & F.col(NODE).isNotNull())
            .select(F.xxhash64(F.col(id_col), F.col(NODE)).alias("__own")).distinct())
    own = docs.withColumn("__own", node_key(text_col))
    own = own.withColumn("__own", F.when(F.col("__own").isNotNull(), F.xxhash64(F.col(id_col), F.col("__own"))))
    # one key for join and de-duplication, so the texts are shuffled once
    worded = own.where(F.col("__own").isNotNull()).join(materialize(kept), "__own", "left_semi").dropDuplicates(["__own"])
    return worded.unionByName(own.where(F.col("__own").isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
