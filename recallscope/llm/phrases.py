"""Phrase collocations by best-first branch-and-bound growth.

Texts become chunks of local word numbers once; words and word pairs that occur often
enough are counted completely (every word has the same optimistic bound, so every
root has to be expanded). From there a phrase is grown only if it can matter. All
extensions of a prefix p with first word w score at most

    bound(p) = floor(2000000 * f(p) / (f(w) + f(p)))

since an extension occurs at most f(p) times, its first cut has f(w) on the left and at
least its own count on the right. Each wave takes the frontier from the top: prefixes whose
bound reaches the language's current threshold (the score of its ``top``-th best phrase
that no known longer phrase replaces), and the prefixes that could replace a phrase
above it from the left. The wave counts all extensions of those in one scan of the
chunks; thresholds move; the loop ends when no prefix of either kind is left
unexpanded. Then every phrase at or above a threshold, ties included, has its exact
count, its cuts and everything that could replace it. (If any longer phrase replaces a
phrase, one that is longer by a single word does: its count is at least as large.)

Counts of a scan travel as one row per chunk and distinct phrase, so a phrase that stands
in a third of all rows costs a row per chunk. Phrases are compared as strings, never as
hashes. What a chunk needs back (which of its phrases are frequent) is found by the
same shuffle that sums the counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallscope.llm.arrays import distinct, lookup, trim
from recallscope.llm.stages import last_reader
from recallscope.session import fresh_path

SCALE = 2_000_000
CHUNK_BYTES = 8 << 20
BROADCAST_ROWS = 300_000  # of phrases, or languages, that are sent to every task; more are joined by a shuffle
HARD, SOFT = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
KIND = np.zeros(256, np.uint8)
KIND[list(SOFT)], KIND[list(HARD)] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NONE = np.int32(-1)  # between pieces, and where a phrase is not frequent

TOKENS = "chunk long, lang string, local int, phrase string, n long, seq binary"
COUNTS = "chunk long, lang string, local int, second int, phrase string, n long"
PAIR_CHUNKS = "chunk long, lang string, seq binary, locals binary, names array<string>"


def chunks(flat: np.ndarray, limit: int = CHUNK_BYTES):
    """A buffer in runs of about ``limit`` bytes, cut only where a piece ends."""
    cuts = np.flatnonzero(KIND[flat] == 2) + 1
    low = 0
    while low < len(flat):
        high = len(flat)
        if high - low > limit and len(cuts):
            at = np.searchsorted(cuts, low + limit, "right")  # the last cut within the limit, else the next one
            at = at - 1 if at and cuts[at - 1] > low else at
            high = int(cuts[at]) if at < len(cuts) else high
        yield flat[low:high]
        low = high


def numbered_words(flat: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Local word numbers with NONE between pieces, the words, and their counts."""
    kind = KIND[flat]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) == 0:
        return np.zeros(0, np.int32), pa.array([], pa.string()), np.zeros(0, np.int64)
    body = np.ascontiguousarray(LOWER[flat[inside]])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body)).dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int32)
    hard = np.cumsum(kind == 2)
    apart = np.flatnonzero(hard[starts[1:]] != hard[ends[:-1] - 1]) + 1
    return np.insert(ids, apart, NONE), words.dictionary, np.bincount(ids, minlength=len(words.dictionary))


def _tokens(chunk_bytes: int):
    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column(1).filter(pc.equal(langs.indices, code)).cast(pa.large_binary())
                flat = np.frombuffer(b"\n".join(own.to_pylist()), np.uint8)
                for part in chunks(flat, chunk_bytes):
                    seq, words, counts = numbered_words(part)
                    if not len(seq):
                        continue
                    k = len(words)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(k + 1, serial)), pa.array([lang] * (k + 1), pa.string()),
                        pa.array(np.append(np.arange(k), -1), pa.int32()), pa.concat_arrays([words, pa.nulls(1, pa.string())]),
                        pa.array(np.append(counts, 0), pa.int64()), pa.array([None] * k + [seq.tobytes()], pa.binary())],
                        ["chunk", "lang", "local", "phrase", "n", "seq"])
                    serial += 1
            trim()
    return run


def _by_local(rows: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """The frequent local numbers in ascending order, and their phrases."""
    rows = rows.sort_by("local")
    return rows.column("local").to_numpy(), rows.column("phrase").combine_chunks()


def _recoded(seq: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Numbers among the kept ones, NONE for others."""
    at, found = lookup(seq, kept)
    return np.where(found, at, NONE).astype(np.int64)


def _pairs(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the pair that starts at each place, and whether both halves are there."""
    a, b = codes[:-1], codes[1:]
    return a * n + b, (a >= 0) & (b >= 0)


def _counted(chunk: int, lang: str, first, second, phrase: pa.Array, n) -> pa.Table:
    k = len(n)
    return pa.table({"chunk": pa.array(np.full(k, chunk, np.int64)), "lang": pa.array([lang] * k, pa.string()),
                     "local": pa.array(first, pa.int32()), "second": pa.array(second, pa.int32()), "phrase": phrase,
                     "n": pa.array(n, pa.int64())})


def _seq(table: pa.Table) -> tuple[int, str, np.ndarray]:
    value = lambda c: table.column(c)[0].as_py()
    return value("chunk"), value("lang"), np.frombuffer(value("seq"), np.int32)


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(a, b, pa.scalar(" "))


def _word_pairs(seqs: pa.Table, words: pa.Table) -> pa.Table:
    """Distinct pairs of neighbouring frequent words of a chunk, numbered in key order."""
    if seqs.num_rows == 0 or words.num_rows == 0:
        return _counted(0, "", [], [], pa.array([], pa.string()), np.zeros(0, np.int64))
    chunk, lang, seq = _seq(seqs)
    kept, names = _by_local(words)
    key, ok = _pairs(_recoded(seq, kept), len(kept))
    key, n = np.unique(key[ok], return_counts=True)
    out = _counted(chunk, lang, np.arange(len(key)), np.full(len(key), -1),
                   _joined(names.take(pa.array(key // len(kept))), names.take(pa.array(key % len(kept)))), n)
    trim()
    return out


def _pair_chunks(seqs: pa.Table, answers: pa.Table) -> pa.Table:
    """The chunk in numbers of its frequent pairs, places without one drawn together, and those
    pairs: their local numbers and names."""
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("seq", pa.binary()), ("locals", pa.binary()),
                        ("names", pa.list_(pa.string()))])
    if seqs.num_rows == 0 or answers.num_rows == 0:
        return schema.empty_table()
    level = answers.column("level")
    kept, _ = _by_local(answers.filter(pc.equal(level, 1)))
    pairs, names = _by_local(answers.filter(pc.equal(level, 2)))
    if not len(pairs):
        return schema.empty_table()
    chunk, lang, seq = _seq(seqs)
    key, ok = _pairs(_recoded(seq, kept), len(kept))
    at, found = lookup(key, distinct(key[ok])[pairs])
    codes = np.where(ok & found, at, NONE).astype(np.int32)
    keep = (codes >= 0) | np.concatenate([[True], codes[:-1] >= 0])
    trim()
    names = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
    return pa.Table.from_arrays([pa.array([chunk], pa.int64()), pa.array([lang], pa.string()), pa.array([codes[keep].tobytes()], pa.binary()),
                                 pa.array([pairs.astype(np.int32).tobytes()], pa.binary()), names], schema=schema)


def _extensions(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """Counts of all extensions by one word of the prefixes to expand. ``answers`` holds the
    chunk's pairs to expand (``second`` < 0) and triples (numbers of their two pairs)."""
    nothing = _counted(0, "", [], [], pa.array([], pa.string()), np.zeros(0, np.int64))
    if chunks.num_rows == 0 or answers.num_rows == 0:
        return nothing
    chunk, lang, seq = _seq(chunks)
    # local numbers count all distinct pairs of the chunk, its codes the frequent ones
    local = np.frombuffer(chunks.column("locals")[0].as_py(), np.int32)
    names = chunks.column("names").combine_chunks().flatten()
    n = len(local)
    first, second = (np.searchsorted(local, answers.column(c).to_numpy()) for c in ("local", "second"))
    pair = answers.column("second").to_numpy() < 0
    expand = np.zeros(n + 1, bool)  # the last stands for places without a pair
    expand[first[pair]] = True
    wanted = np.sort((first * n + second)[~pair])
    codes = seq.astype(np.int64)
    key, ok = _pairs(codes, n)
    out = []
    grown = ok & expand[codes[:-1]]
    three, count = np.unique(key[grown], return_counts=True)
    if len(three):
        a, b = three // n, three % n
        last = pc.replace_substring_regex(names.take(pa.array(b)), pattern=r"^[^ ]* ", replacement="")
        out.append(_counted(chunk, lang, local[a], local[b], _joined(names.take(pa.array(a)), last), count))
    if len(wanted):
        at, found = lookup(key[:-1], wanted)
        four = (ok[:-1] & found) & (codes[2:] >= 0)
        four, count = np.unique((at * n + codes[2:])[four], return_counts=True)
        if len(four):
            a, c = wanted[four // n] // n, four % n
            out.append(_counted(chunk, lang, np.full(len(four), -1), np.full(len(four), -1),
                                _joined(names.take(pa.array(a)), names.take(pa.array(c))), count))
    trim()
    return pa.concat_tables(out) if out else nothing


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    """The chunks' rows of phrases that occur ``least`` times or more in their language, with ``f``."""
    whole = F.sum("n").over(Window.partitionBy("lang", "phrase"))
    return counts.withColumn("f", whole).where(F.col("f") >= least).drop("n")


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder; the shuffles behind it are not read again."""
    path = fresh_path(spark, f"phrases-{name}")
    with last_reader(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _table(places: DataFrame) -> DataFrame:
    return places.groupBy("lang", "phrase").agg(F.max("f").alias("f"))


def _words(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def _span(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _exact(numerator: Column, denominator: Column) -> Column:
    """floor(2000000 * numerator / denominator); the product is a decimal of 38 digits."""
    return F.call_function("div", (numerator.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(7,0)")),
                           denominator.cast("decimal(19,0)"))


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase, f) with the lowest-scoring cut: score, l, r (ties: smallest
    first part). Phrases of which a part is not counted yet are left out."""
    words = _words()
    size = F.size(words)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "f", "k", _span(words, 1, F.col("k")).alias("left"),
                       _span(words, F.col("k") + 1, size - F.col("k")).alias("right"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", _exact(F.col("f"), F.col("l") + F.col("r")))
    best = cuts.groupBy("lang", "phrase").agg(F.max("f").alias("f"), F.count(F.lit(1)).alias("cuts"),
                                              F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.where(F.col("cuts") == F.size(_words()) - 1).select("lang", "phrase", "f", "best.score", "best.l", "best.r")


def _live(scored: DataFrame, longer: DataFrame) -> DataFrame:
    """Scored phrases that no known phrase longer by a word replaces (100 * f(longer) >= 80 * f)."""
    words = _words()
    inner = longer.select("lang", "f", F.explode(F.array(_span(words, 1, F.size(words) - 1),
                                                         _span(words, 2, F.size(words) - 1))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    return joined.where(F.col("longest").isNull() | (F.col("longest") * 5 < F.col("f") * 4)).drop("longest")


def _first(live: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("f").desc(), F.col("phrase"))
    return live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _small(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` computed; sent to every task if it is counted to be small, else joined by a shuffle."""
    df = _kept(spark, df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def phrase_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000,
                        chunk_bytes: int = CHUNK_BYTES, ease: tuple[int, int] = (7, 8)) -> DataFrame:
    """The first ``top`` phrases of 2 to 4 words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
    words ``[^\\x20\\x09]+``; phrases lie in one piece. n counts a language's words, a a
    phrase's occurrences (at least ``least``), overlaps included. A phrase's score is that of
    its lowest-scoring cut into two parts, floor(2000000 * a / (l + r)) with the counts l
    and r of the parts (ties: the shorter first part). A phrase that lies in a longer
    one (of up to 4 words) which occurs at least 80 % as often is left out. Order:
    score, a, both descending, then phrase ascending by bytes.

    Null texts are empty, a null language is ``und``; empty texts, and languages without
    a phrase of enough occurrences, give no rows; repeated rows count as often as they
    stand there; an empty table gives an empty result; other columns are left out,
    whatever they are called. Long texts are cut into chunks where pieces end. ``ease`` lets a
    wave expand a little below the threshold, which saves waves and changes nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tokens = _kept(spark, texts.mapInArrow(_tokens(chunk_bytes), TOKENS), "tokens")
    seqs = tokens.where("local = -1").select("chunk", "lang", "seq")
    word_rows = tokens.where("local >= 0").select("chunk", "lang", "local", "phrase", "n")
    total = word_rows.groupBy("lang").agg(F.sum("n").alias("n"))
    words = _kept(spark, _frequent(word_rows, least), "words")
    pair_rows = seqs.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(_word_pairs, COUNTS)
    pairs = _kept(spark, _frequent(pair_rows, least), "pairs")
    answers = words.select("chunk", "local", "phrase", F.lit(1).alias("level")).unionByName(
        pairs.select("chunk", "local", "phrase", F.lit(2).alias("level")))
    pair_seqs = seqs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_pair_chunks, PAIR_CHUNKS)
    # kept on the executors' disks with its partitioning, so no wave shuffles the chunks again; what is lost with an
    # executor is computed again from the tables
    pair_seqs = pair_seqs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").persist(
        StorageLevel.DISK_ONLY)

    ones, twos = (_kept(spark, _table(t), "counts") for t in (words, pairs))
    roots = ones.select("lang", F.col("phrase").alias("first"), F.col("f").alias("w"))
    gram = lambda df: (_scored(df, known).withColumn("first", F.substring_index("phrase", " ", 1)).join(roots, ["lang", "first"])
                       .withColumn("bound", _exact(F.col("f"), F.col("w") + F.col("f"))).drop("w"))
    known = ones
    scored2 = _kept(spark, gram(twos), "pairs-scored")
    longer = spark.createDataFrame([], scored2.schema)
    done = longer.select("lang", "phrase")
    size = F.size(_words())
    waves, folder = 0, fresh_path(spark, "phrases-grown")

    while True:
        live = _kept(spark, _live(scored2.unionByName(longer), longer), "live")
        best = _first(live, top)
        limit = F.when(F.count(F.lit(1)) >= top, F.min("score") * ease[0] / ease[1]).otherwise(0).cast("long")
        limits = _small(spark, best.groupBy("lang").agg(limit.alias("limit")), "limits")
        # a phrase above the limit is replaced from the left by an extension of (.., its first words)
        above = live.join(limits, "lang").where(F.col("score") >= F.col("limit"))
        heads = F.array(F.col("first"), F.when(size == 3, F.substring_index("phrase", " ", 2)))
        left = above.select("lang", "f", F.explode(heads).alias("tail")).groupBy("lang", "tail").agg(F.min("f").alias("m"))
        prefixes = scored2.unionByName(longer.where(size == 3)).join(done, ["lang", "phrase"], "left_anti").withColumn(
            "tail", _span(_words(), 2, size - 1))
        frontier = prefixes.join(limits, "lang", "left").join(left, ["lang", "tail"], "left").where(
            (F.col("bound") >= F.coalesce("limit", F.lit(0))) | (F.col("f") * 5 >= F.col("m") * 4))
        # a four-word phrase's last three words are counted as well: their first two are expanded with its prefix
        names = F.array(F.col("phrase"), F.when(size == 3, F.col("tail")))
        wave = frontier.select("lang", F.explode(names).alias("phrase")).where("phrase is not null").distinct()
        wave = _small(spark, wave.join(done, ["lang", "phrase"], "left_anti"), "wave")
        if wave.isEmpty():
            break
        hits = pairs.join(wave, ["lang", "phrase"]).select("chunk", "local", F.lit(-1).alias("second"))
        if waves:
            places = spark.read.parquet(folder).where("local >= 0")
            hits = hits.unionByName(places.join(wave, ["lang", "phrase"]).select("chunk", "local", "second"))
        grown = pair_seqs.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extensions, COUNTS)
        with last_reader(spark):
            _frequent(grown, least).write.option("compression", "zstd").parquet(f"{folder}/wave={waves}")
        grown = spark.read.parquet(f"{folder}/wave={waves}")
        waves += 1
        new = _table(grown)
        threes = longer.where(size == 3).select("lang", "phrase", "f").unionByName(new.where(size == 3))
        known = ones.unionByName(twos).unionByName(threes)
        longer = _kept(spark, longer.unionByName(gram(new)), "longer")
        done = _kept(spark, done.unionByName(wave), "done")

    pair_seqs.unpersist()
    out = best.join(_small(spark, total, "totals"), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
