"""Language identification by Bayesian fusion of evidence.

A text's class gets a log score from each source of evidence, added up:

* text: byte-trigram log likelihoods under a model of each language with a share of
  noise, tempered (overlapping trigrams are not independent), beside a uniform
  background that wins where no language fits;
* the declared language (a table column, or the page's ``<html lang>``);
* the address suffix (top-level domain, or a language code as first path part);
* the host's prior: languages of its other texts, smoothed towards its domain's,
  and that towards the corpus's. The priors come from grouped aggregates of the
  texts' own posteriors, each row taking its own share out again.

The text model is fitted on a bounded number of distinct texts of every declared
language (``sample_rows`` each); scores, priors and decisions cover every row and every whole text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.llm.arrays import CHUNK_BYTES, byte_slices, trim, utf8
from recallscope.llm.passing import packed, unpacked
from recallscope.llm.stages import materialize

SLOTS = 1 << 16  # hashed trigrams
SAMPLE_ROWS = 4000  # distinct texts of a language its model is fitted on, at most
SAMPLE_TASKS = 8  # tasks that count them: each sends a vector per language
MOST_LANGUAGES = 64
FEW_TEXTS = 10  # labelled texts below which every trigram of a language counts
OTHER = "und"
TEMPER = 0.15
NOISE = 0.5  # share of a text's trigrams that the language need not explain
DECLARED_TRUST = 0.9  # probability that a declaration names the text's language
SUFFIX_TRUST = 0.8
SMOOTHING = 20.0  # rows a host's (domain's) prior weighs its domain (the corpus) with
LEAST = 0.5  # least posterior of an accepted text
ADDED = ("predicted", "posterior", "kept")


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Slot of the trigram that starts at each byte (A-Z folded to a-z)."""
    fold = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    return ((fold[:-2] * np.uint32(0x9E3779B1) + fold[1:-1] * np.uint32(0x85EBCA77) + fold[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)) if len(data) > 2 else np.zeros(0, np.uint32)  # noqa: E501


def fit(docs: DataFrame, text_col: str, label: Column, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities: languages and background x slots) from every label's
    distinct texts, at most ``sample_rows`` of each, those of the least text hashes: a
    label is fitted however rare it is, and copies count once. More than MOST_LANGUAGES
    labels are an error. Counts are summed per language in Spark; what reaches the driver
    is a few numbers and one vector per language."""
    labelled = docs.select(F.col(text_col).alias("t"), label.alias("l")).where("l is not null and t is not null")
    labelled = labelled.withColumn("h", F.xxhash64("t"))
    texts = materialize(labelled.select("l", "h").distinct())
    sizes = {r.l: r.n for r in texts.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are declared")

    def up_to(last: dict[str, int]) -> Column:
        return F.coalesce(*[F.when(F.col("l") == x, F.col("h") <= h) for x, h in sorted(last.items())], F.lit(False))

    # thin out before sorting: hashes are even, so the least ones are found among little more than twice as many
    thin = {x: min((1 << 63) - 1, int((2 * sample_rows + 50) / n * (1 << 64)) - (1 << 63)) for x, n in sizes.items()}
    least = texts.where(up_to(thin)).groupBy("l").agg(F.array_max(F.slice(F.sort_array(F.collect_list("h")), 1, sample_rows)).alias("h"))
    last = {r.l: r.h for r in least.collect()}
    sample = labelled.where(up_to(last)).groupBy("l", "h").agg(F.min("t").alias("t")).select("t", "l").coalesce(SAMPLE_TASKS)

    def count(batches):  # per language: occurrences and texts of each trigram, and the number of texts
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(_trigrams(np.frombuffer(t.encode(), np.uint8)), minlength=SLOTS)
                total[label] = total.get(label, 0) + np.concatenate([n, n > 0, [1]])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                          pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["l", "n"])

    def add(table):
        n = sum(np.frombuffer(x, "<i8") for x in table.column("n").to_pylist())
        return pa.table({"l": table.column("l").slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    counted = sample.mapInArrow(count, "l string, n binary").groupBy("l").applyInArrow(add, "l string, n binary")
    rows = sorted((r.l, np.frombuffer(r.n, "<i8")) for r in counted.collect())
    names = [name for name, _ in rows]
    # a trigram of one text alone tells more of that text (or of a wrong label) than of the language
    seen = [np.where((n[SLOTS : 2 * SLOTS] > 1) | (n[-1] < FEW_TEXTS), n[:SLOTS], 0) for _, n in rows]
    counts = np.array(seen, float).reshape(len(rows), SLOTS) + 0.05
    model = counts / counts.sum(1, keepdims=True)
    # part of any text is in no language (numbers, keys, markup): such trigrams cost a language little
    model = (1 - NOISE) * model + NOISE / SLOTS
    return names, np.log(np.vstack([model, np.full((1, SLOTS), 1 / SLOTS)])).astype(np.float32)


def _scores(data: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log likelihood of each text under each class (texts x classes)."""
    out = np.zeros((len(offsets) - 1, len(model)))
    a = 0
    while a < len(out):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        part, edge = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        slots = _trigrams(part)
        for j, weight in enumerate(model):
            total = np.concatenate([[0.0], np.cumsum(weight[slots], dtype=np.float64)])
            last = np.clip(edge[1:] - 2, edge[:-1], len(total) - 1)  # trigrams inside the text
            out[a:b, j] = total[last] - total[np.minimum(edge[:-1], len(total) - 1)]
        a = b
    return out


def language_id(docs: DataFrame, text_col: str = "text", declared: Column | None = None, host: Column | None = None,
                domain: Column | None = None, suffix: Column | None = None, label: Column | None = None,
                accepted: tuple[str, ...] | None = None, least: float = LEAST, sample_rows: int = SAMPLE_ROWS,
                fitted: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """The rows of ``docs`` without the text, with ``predicted``, ``posterior`` (of the
    prediction) and ``kept`` (one of ``accepted``, all fitted languages by default,
    with a posterior of at least ``least``).

    ``declared``, ``suffix``, ``host`` and ``domain`` are columns or None; a null, or a
    language the model does not know, is no evidence. ``label`` (the declared
    language by default) names the labelled rows for ``fit`` unless a fitted model
    is given. A null or empty text has no text evidence; without a known
    declaration or address either, the background class is predicted and the row is
    not kept. Rows without a host have
    the corpus's prior. Repeated rows count each; an empty table gives an empty
    result; without labelled rows everything is background. Input columns named
    like an added one are replaced.
    """
    nothing = F.lit(None).cast("string")
    declared, host, domain, suffix = (nothing if c is None else c for c in (declared, host, domain, suffix))
    names, model = fitted or fit(docs, text_col, declared if label is None else label, sample_rows)
    n = len(names) + 1
    passed = [c for c in docs.columns if c not in ADDED and c != text_col]
    order = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    place = lambda c: F.coalesce(F.array_position(order, c), F.lit(0)).cast("int")
    rows = docs.select(packed(passed), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), place(declared).alias("__declared"),
                       place(suffix).alias("__suffix"), host.alias("__host"), domain.alias("__domain"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).alias("__bytes"))
    kinds = [f for f in rows.schema.fields if f.name != "__text"]

    def score(batches):
        for batch in (x for whole in batches for x in byte_slices(whole, whole.schema.get_field_index("__text"))):
            data, offsets = utf8(batch.column(batch.schema.get_field_index("__text")))
            s = (_scores(data, offsets, model) * TEMPER).ravel()
            at = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in kinds), pa.ListArray.from_arrays(at, pa.array(s))],
                names=[*(f.name for f in kinds), "__text_score"])
        trim()

    scored = rows.mapInArrow(score, T.StructType([*kinds, T.StructField("__text_score", T.ArrayType(T.DoubleType()))]))

    def log_trust(c: str, trust: float) -> Column:
        """Log probability of the evidence under each class; zeros without evidence."""
        classes = F.sequence(F.lit(1), F.lit(n))
        miss = (1 - trust) / max(1, n - 1)
        hit = F.transform(classes, lambda x: F.log(F.when(x == F.col(c), F.lit(trust)).otherwise(F.lit(miss))))
        return F.when(F.col(c) > 0, hit).otherwise(F.array_repeat(F.lit(0.0), n))

    # the background class answers for texts of no known language, so plain absence of text is no evidence for it
    flat = F.array(*[F.lit(1.0)] * (n - 1), F.lit(0.5)) if names else F.array(F.lit(1.0))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    evidence = add(add(F.col("__text_score"), log_trust("__declared", DECLARED_TRUST)), log_trust("__suffix", SUFFIX_TRUST))
    scored = materialize(scored.withColumn("__evidence", evidence)
                         .withColumn("__own", _posterior(add(F.col("__evidence"), F.transform(flat, lambda x: F.log(x))))))

    sums = [F.sum(F.get("__own", F.lit(i))).alias(f"s{i}") for i in range(n)]
    collected = F.array(*[F.col(f"s{i}") for i in range(n)])
    # corpus, then domain, then host: one row per distinct value, combined map-side
    hosts = scored.groupBy("__domain", "__host").agg(*sums).select("__domain", "__host", collected.alias("__h"))
    hosts = materialize(hosts)
    exploded = [F.sum(F.get("__h", F.lit(i))).alias(f"s{i}") for i in range(n)]
    domains = hosts.where("__domain is not null").groupBy("__domain").agg(*exploded).select("__domain", collected.alias("__d"))
    corpus = hosts.agg(*exploded).first()
    corpus = [float(x or 0) for x in corpus]
    known = (hosts.where("__host is not null or __domain is not null").join(domains, "__domain", "left")
             .select(F.col("__domain").alias("__kd"), F.col("__host").alias("__kh"), "__h", "__d"))
    joined = scored.join(known, F.col("__domain").eqNullSafe(F.col("__kd")) & F.col("__host").eqNullSafe(F.col("__kh")), "left")

    everything = F.array(*[F.lit(x + 1.0 / n) for x in corpus])
    prior = _normal(_without(everything, "__own"))
    prior = F.when(F.col("__d").isNull(), prior).otherwise(_smoothed("__d", "__own", prior))
    prior = F.when(F.col("__kh").isNull(), prior).otherwise(_smoothed("__h", "__own", prior))
    fused = _posterior(add(F.col("__evidence"), F.transform(prior, lambda x: F.log(F.greatest(x, F.lit(1e-9))))))
    best = F.array_max(F.transform(fused, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    names_all = F.array(*[F.lit(x) for x in [*names, OTHER]])
    taken = F.array(*[F.lit(x) for x in (names if accepted is None else accepted)]).cast("array<string>")
    # without a trigram and without a known declaration or address there is nothing to go by
    heard = (F.col("__bytes") > 2) | (F.col("__declared") > 0) | (F.col("__suffix") > 0)
    decide = _let(best, lambda b: _let(
        F.struct(F.when(heard, F.get(names_all, -b["i"])).otherwise(OTHER).alias("predicted"),
                 F.when(heard, b["p"]).otherwise(1.0 / n).alias("posterior")),
        lambda d: F.struct(d["predicted"].alias("predicted"), d["posterior"].alias("posterior"),
                           (heard & F.array_contains(taken, d["predicted"]) & (d["posterior"] >= least)).alias("kept"))))
    out = joined.withColumn("__decided", decide)
    return out.select(*unpacked(passed), *[F.col("__decided")[c].alias(c) for c in ADDED])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it
    (an expression named twice is computed twice, and so on in powers of two)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _posterior(scores: Column) -> Column:
    return _let(scores, lambda s: _let(F.array_max(s), lambda top: _normal(F.transform(s, lambda x: F.exp(x - top)))))


def _normal(weights: Column) -> Column:
    return _let(weights, lambda w: _let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x),
                                        lambda total: F.transform(w, lambda x: x / total)))


def _without(total: Column, own: str) -> Column:
    """A group's sums without the row's own share."""
    return F.zip_with(total, F.col(own), lambda x, y: F.greatest(x - y, F.lit(0.0)) + F.lit(1e-6))


def _smoothed(total: str, own: str, prior: Column) -> Column:
    """(sums without the row + SMOOTHING x parent prior), as shares."""
    return _normal(F.zip_with(_without(F.col(total), own), prior, lambda x, p: x + SMOOTHING * p))


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html", codes: tuple[str, ...] = ("en", "de", "fr", "es")) -> DataFrame:
    """``pages`` with ``__page_text`` (html without tags, scripts and styles), ``__markup``
    (the declared ``<html lang>``), ``__address`` (language of the address: a country's
    domain or a language code as first path part), ``__page_host`` and ``__page_domain``."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://([^/?#]*)", 1))
    first = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.element_at(F.split(host, r"\."), -1)
    code = lambda c: F.when(c.isin(*codes), c)
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return pages.withColumns({
        "__page_text": body, "__markup": code(F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1))),
        "__address": F.coalesce(code(first), code(top)), "__page_host": F.when(host != "", host),
        "__page_domain": F.when(host != "", F.regexp_extract(host, r"([^.]+\.[^.]+)$|([^.]+)$", 0))})
