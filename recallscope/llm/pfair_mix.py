"""Mixing sources to target weights by Pfair scheduling.

Each source's texts, in an order given by a hash of their ids, are cut into blocks
of equal length. Slot by slot one block is taken. With weight w, block k of a source
is released at slot floor((k - 1) / w) and due by slot ceil(k / w); of the released
blocks the one due first goes next, so at any slot every source has had its share to
within less than one block. Weights are shares of a period, after which the schedule
repeats: only one period is ever scheduled, in one expression.

DataFrame functions only. Positions within a source come from sums over hash ranges
of bounded size, not from one window over the source, so a source with a third of
all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallscope.llm.passing import packed, unpacked

PERIOD = 1000  # slots after which the schedule repeats; also the finest share of a weight
BLOCK_CHARS = 8192
RANGE_ROWS = 4000  # rows of a source ordered in one window, on average
ADDED = ("block", "release", "deadline", "slot", "block_offset")


def integer_shares(targets: dict[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Whole slots per period for each source: largest remainders, at least one each."""
    if any(not w > 0 for w in targets.values()):
        raise ValueError("target weights must be positive")
    if len(targets) > period:
        raise ValueError("more sources than slots in a period")
    total = sum(targets.values())
    names = sorted(targets, key=lambda s: (s is None, s or ""))
    exact = {s: targets[s] / total * period for s in names}
    share = {s: max(1, int(exact[s])) for s in names}
    for s in sorted(names, key=lambda s: share[s] - exact[s])[: max(0, period - sum(share.values()))]:
        share[s] += 1
    while sum(share.values()) > period:  # the floor of one slot gave too many
        share[max(names, key=lambda s: share[s] - exact[s] if share[s] > 1 else -period)] -= 1
    return share


def schedule(spark, share: list[int]) -> DataFrame:
    """(source index, ordinal in the period, slot): earliest deadline first among the
    released blocks, ties to the earlier source; weights are ``share`` / their sum."""
    period = sum(share)
    weights = F.array(*[F.lit(w) for w in share])
    state = F.struct(F.array_repeat(F.lit(0), len(share)).alias("done"), F.array().cast("array<int>").alias("picked"))

    def step(s, t):
        due = F.transform(weights, lambda w, i: F.when(
            F.floor(F.get(s["done"], i) * period / w) <= t,
            F.struct(F.ceil((F.get(s["done"], i) + 1) * period / w).alias("due"), i.alias("i"))))
        pick = F.array_min(F.filter(due, lambda x: x.isNotNull()))["i"]
        return F.struct(F.transform(s["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d)).alias("done"),
                        F.concat(s["picked"], F.array(pick)).alias("picked"))

    picked = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), state, step)["picked"]
    slots = spark.range(1).select(F.posexplode(picked).alias("slot", "index"))
    in_turn = Window.partitionBy("index").orderBy("slot")  # at most a period's rows
    return slots.select("index", (F.row_number().over(in_turn) - 1).alias("ordinal"), "slot")


def tempered_targets(docs: DataFrame, source_col: str = "source", length: Column | None = None,
                     power: float = 0.7) -> dict[str | None, float]:
    """Weights proportional to a power of the sources' amounts of text (a row per source;
    at most PERIOD sources)."""
    sizes = docs.groupBy(source_col).agg(F.sum(F.char_length("text") if length is None else length).alias("n")).limit(PERIOD + 1).collect()
    return {r[0]: max(1, int(r[1] or 0)) ** power for r in sizes}


def pfair_mix(docs: DataFrame, targets: dict[str | None, float], id_col: str = "doc_id", source_col: str = "source",
              length: Column | None = None, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """``docs`` with ``block`` (from 1, in its source), ``release``, ``deadline``, ``slot`` and
    ``block_offset`` (characters of the block before the text). Ascending (slot,
    block_offset, id) is the mixed order.

    ``length`` is the column of a text's length, by default the characters of ``text``;
    all columns of ``docs`` travel along, so leave out a text that is not needed.
    Every row is kept: a source that ends leaves its later slots empty. A text belongs
    to the block in which it begins; a null or empty text has no length. A null source
    is a source of its own; a source without a target is an error. Rows that repeat an
    id each take part. An empty table gives an empty result. Input columns named like
    an added one are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ADDED if c in docs.columns and c not in (id_col, source_col)])
    columns = docs.columns
    share = integer_shares(targets, period)
    names = list(share)
    index = F.coalesce(*[F.when(F.col(source_col).eqNullSafe(F.lit(s).cast("string")), F.lit(i)) for i, s in enumerate(names)],
                       F.lit(-1)) if names else F.lit(-1)
    known = F.when(index >= 0, index).otherwise(F.raise_error(F.concat(
        F.lit("no target weight for source "), F.coalesce(F.col(source_col).cast("string"), F.lit("null")))).cast("int"))
    ranges = max(1, -(-docs.count() // RANGE_ROWS))
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(packed(columns), known.alias("__index"), order.alias("__order"), F.col(id_col).alias("__id"),
                       F.coalesce(F.char_length("text") if length is None else length, F.lit(0)).cast("long").alias("__chars"))
    place = F.conv(F.substring("__order", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("__range", F.floor(place * F.lit(ranges) / F.lit(1 << 28)).cast("int"))

    sizes = rows.groupBy("__index", "__range").agg(F.sum("__chars").alias("__sum"))
    before = Window.partitionBy("__index").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__index", "__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    # repeated rows tie, and any order of theirs gives the same result
    within = (Window.partitionBy("__index", "__range").orderBy("__order", "__id", "__chars")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("__before", F.coalesce(F.sum("__chars").over(within), F.lit(0))).join(offsets, ["__index", "__range"])
    begin = F.col("__before") + F.col("__offset")
    weight = F.get(F.array(*[F.lit(share[s]) for s in names] or [F.lit(1)]), F.col("__index")).cast("long")
    placed = placed.withColumns({
        "block": F.floor(begin / block_chars) + 1, "block_offset": F.pmod(begin, F.lit(block_chars)), "__weight": weight})
    turn = F.col("block") - 1
    if not names:
        return placed.select(*unpacked(columns), *[F.lit(None).cast("long").alias(c) for c in ADDED]).limit(0)
    # one row per slot of a period: at most ``period`` rows
    slots = F.broadcast(schedule(spark, [share[s] for s in names]))
    total = sum(share.values())
    out = placed.withColumns({
        "release": F.floor(turn * total / F.col("__weight")), "deadline": F.ceil(F.col("block") * total / F.col("__weight")),
        "__ordinal": F.pmod(turn, F.col("__weight")).cast("int"), "__period": F.floor(turn / F.col("__weight"))})
    out = out.join(slots, (F.col("__index") == F.col("index")) & (F.col("__ordinal") == F.col("ordinal")))
    slot = (F.col("__period") * total + F.col("slot")).alias("slot")
    return out.select(*unpacked(columns), "block", "release", "deadline", slot, "block_offset")
