"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Counts of every whole text are turned into a vector of transformed statistics.
For each language and source the mean and covariance of the subset of rows with
the least covariance determinant are estimated by concentration steps: distances
to the current estimate, their quantile, and a new estimate from the rows below
it. Two deterministic starts are tried (coordinate-wise medians and deviations,
and the classical estimate); the smaller determinant wins, is rescaled and
re-weighted, and rows whose Mahalanobis distance exceeds the limit are rejected.

DataFrame functions only. A step is one grouped aggregate (moments, combined
map-side) and one join with the table of estimates, a row per cell, so a source
with a third of all rows is an aggregate like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallscope.llm.passing import packed, unpacked
from recallscope.session import materialize

SHARE = 0.75  # of a cell's rows in the subset
STEPS = 3  # concentration steps
LEAST_ROWS = 60  # a smaller cell is pooled with its language, then with all
# chi-square, as many degrees of freedom as features: the median, the 97.5 % and the 1 - 1e-6 point (fixed values)
CHI2_MEDIAN, CHI2_975, CHI2_FAR = 4.3515, 12.8325, 35.8882
LIMIT = CHI2_FAR**0.5  # Mahalanobis distance beyond which a row is an outlier
FEATURES = ("x1", "x2", "x3", "x4", "x5")
#: Least standard deviation of a feature: what is not told apart below it. Clean texts have no
#: symbols, but some repeat lines and words (x4 to 0.58, x5 to 0.56 together): narrower last two
#: reject those, wider ones could not reject x4 (at most 1) or x5 (to 0.785 under the base rule) alone.
FLOOR = (0.25, 0.25, 0.05, 0.14, 0.11)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "distance", "kept")
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def _length(c: Column) -> Column:
    return F.char_length(c).cast("long")


def text_counts(docs: DataFrame, kept: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``kept`` of ``docs`` with the base counts (null text: no words).

    ``n_repeat_words`` needs every 3-word window that occurs twice: the windows'
    hashes are packed with their positions into one integer each (as many low bits
    as the text needs), sorted, and compared with their neighbours.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    step = docs.select(
        *kept, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("__w"), lines.alias("__lines"),
        _length(F.regexp_replace(text, GAP, "")).alias("word_chars"),
        _length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).alias("n_symbols"))
    kept = [F.col(c) for c in step.columns if c not in ("__w", "__lines")]
    step = step.select(*kept, "__w", F.size("__w").cast("long").alias("n_words"), F.size("__lines").cast("long").alias("__n_lines"),
                       (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    kept += [F.col(c) for c in ("n_words", "__n_lines", "n_dup_lines")]
    step = step.withColumn("__low", F.expr("shiftleft(1L, length(bin(n_words))) - 1"))

    def window(x, i):
        h = F.xxhash64(x, F.get("__w", i + 1), F.get("__w", i + 2))
        return h.bitwiseAND(F.bitwise_not("__low")).bitwiseOR(i.cast("long"))

    heads = F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0)))
    step = step.select(*kept, "__low", F.sort_array(F.transform(heads, window)).alias("__s"))
    high = lambda c: c.bitwiseAND(F.bitwise_not("__low"))
    twin = lambda x, i: F.coalesce(high(F.get("__s", i)) == high(x), F.lit(False))
    step = step.select(*kept, "__low", F.filter("__s", lambda x, i: (F.when(i > 0, twin(x, i - 1)).otherwise(False)) | twin(x, i + 1)).alias("__t"))
    step = step.select(*kept, F.sort_array(F.transform("__t", lambda x: x.bitwiseAND(F.col("__low")))).alias("__p"))
    three = F.lit(3).cast("long")
    cover = F.transform("__p", lambda x, i: F.least(three, F.coalesce(F.get("__p", i + 1) - x, three)))
    return step.select(*kept, F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))


def features() -> list[Column]:
    """Transformed statistics: length and ratios on scales where plain prose is near normal."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(words.cast("double")),
            F.col("word_chars") / words,
            F.sqrt(F.col("n_symbols") / words),
            F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("__n_lines"), F.lit(1))),
            F.asin(F.sqrt(F.least(F.col("n_repeat_words") / words, F.lit(1.0))))]


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__cell``: the keys' values, fewer of them where the cell is small (null:
    fewer than the least number of rows in the whole table)."""
    name = lambda n: F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("null")) for k in keys[:n]])) if n else F.lit("[]")  # noqa: E731,E501
    out = rows.withColumn("__cell", F.lit(None).cast("string"))
    for n in range(len(keys), -1, -1):
        out = out.withColumn("__name", F.when(F.col("__cell").isNull(), name(n)))
        large = (out.where(F.col("__name").isNotNull()).groupBy("__name").agg(F.count(F.lit(1)).alias("__n"))
                 .where(F.col("__n") >= LEAST_ROWS).select("__name", F.lit(True).alias("__large")))
        out = (out.join(large, "__name", "left")
               .withColumn("__cell", F.coalesce("__cell", F.when(F.col("__large"), F.col("__name")))).drop("__name", "__large"))
    return out


def _cholesky(table: DataFrame, floor: tuple[float, ...]) -> DataFrame:
    """Adds the lower triangular factor of covariance + floor^2 and the log determinant."""
    d = len(floor)
    for i in range(d):
        for j in range(i + 1):
            c = F.coalesce(F.col(f"c{j}{i}"), F.lit(0.0)) + (floor[i] ** 2 if i == j else 0.0)
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            table = table.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-12))) if i == j else c / F.col(f"l{j}{j}"))
    logdet = sum((F.log(F.col(f"l{i}{i}")) for i in range(d)), F.lit(0.0))
    return table.withColumn("logdet", logdet).select(
        *[c for c in table.columns if not c.startswith("c") or c == "__cell"], "logdet")


def _distance2(d: int) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i in range(d):
        x = F.col(FEATURES[i]) - F.col(f"m{i}")
        for j in range(i):
            x = x - F.col(f"l{i}{j}") * z[j]
        z.append(x / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def _moments(rows: DataFrame, by: list[str], extra: list[Column] = ()) -> DataFrame:
    d = len(FEATURES)
    return rows.groupBy(*by).agg(
        *[F.avg(FEATURES[i]).alias(f"m{i}") for i in range(d)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in range(d) for j in range(i, d)], *extra)


def _near(rows: DataFrame, model: DataFrame, by: list[str], share: float) -> DataFrame:
    """The rows below the quantile ``share`` of the distances to their cell's estimate."""
    far = rows.join(model, by).withColumn("__d2", _distance2(len(FEATURES))).select(*by, *FEATURES, "__d2")
    cut = far.groupBy(*by).agg(F.percentile_approx("__d2", share, 10000).alias("__cut"))
    return far.join(cut, by).where(F.col("__d2") <= F.col("__cut"))


def estimates(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """One row per ``__cell``: mean, Cholesky factor and ``scale`` (factor of squared distances)."""
    by = ["__cell", "__start"]
    middle = materialize(rows.groupBy("__cell").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"m{i}") for i, x in enumerate(FEATURES)]))
    spread = rows.join(middle, "__cell").groupBy("__cell").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(len(FEATURES))],
        *[(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 10000) * 1.4826).alias(f"s{i}") for i, x in enumerate(FEATURES)])
    d = len(FEATURES)
    robust = spread.select("__cell", F.lit(0).alias("__start"), *[f"m{i}" for i in range(d)], *[
        (F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(d) for j in range(i, d)])
    classical = _moments(rows, ["__cell"]).withColumn("__start", F.lit(1))
    model = materialize(_cholesky(robust.unionByName(classical), FLOOR))
    both = rows.withColumn("__start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(steps):
        model = materialize(_cholesky(_moments(_near(both, model, by, share), by), FLOOR))
    names = [c for c in model.columns if c not in ("__cell", "__start", "logdet")]
    best = model.groupBy("__cell").agg(F.min_by(F.struct(*names), F.struct("logdet", "__start")).alias("b")).select("__cell", "b.*")
    best = _scaled(rows, best)
    # re-weighting: the estimate from all rows that the scaled subset estimate finds ordinary
    ordinary = (rows.join(best, "__cell").where(_distance2(d) * F.col("scale") <= CHI2_975).select("__cell", *FEATURES))
    return _scaled(rows, materialize(_cholesky(_moments(ordinary, ["__cell"]), FLOOR).drop("logdet")))


def _scaled(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Scales distances so that their median is that of the chi-square law, never upwards."""
    far = rows.join(model, "__cell").select("__cell", _distance2(len(FEATURES)).alias("__d2"))
    median = far.groupBy("__cell").agg(F.percentile_approx("__d2", 0.5, 10000).alias("__m"))
    return materialize(model.join(median, "__cell").withColumn(
        "scale", F.least(F.lit(1.0), F.lit(CHI2_MEDIAN) / F.greatest(F.col("__m"), F.lit(1e-9)))).drop("__m"))


def outlier_rules(docs: DataFrame, text_col: str = "text", cell_cols: tuple[str, ...] = ("lang", "source"),
                  limit: float = LIMIT, base_rule: Callable[[], Column] | None = None) -> DataFrame:
    """The rows of ``docs`` without the text, with the base counts, ``base_failed``
    (fewer than 50 words, or more than half of them in repeated 3-word windows),
    ``distance`` (robust Mahalanobis distance in the row's cell) and ``kept``.

    Rows that fail the base rule are rejected and take no part in the estimates. A
    cell with fewer than the least number of rows is pooled with its language, then
    with all rows; if even those are too few, ``distance`` is null and the base rule
    alone decides. A null language or source is a value of its own; a null text has
    no words; repeated rows count each; an empty table gives an empty result; input
    columns named like an added one are replaced.
    """
    docs = docs.drop(*[c for c in ADDED if c in docs.columns and c != text_col])
    passed = [c for c in docs.columns if c != text_col]
    cells = [f"__c{i}" for i in range(len(cell_cols))]
    failed = base_rule() if base_rule else (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = [packed(passed), *[F.col(c).alias(x) for c, x in zip(cell_cols, cells)]]
    counted = text_counts(docs, kept, text_col).withColumn("base_failed", failed)
    counted = materialize(counted.select("*", *[f.cast("double").alias(x) for f, x in zip(features(), FEATURES)]))
    good = materialize(_cells(counted.where(~F.col("base_failed")), cells))
    model = estimates(good.where(F.col("__cell").isNotNull()).select("__cell", *FEATURES))
    judged = (good.join(model, "__cell", "left")
              .withColumn("distance", F.sqrt(_distance2(len(FEATURES)) * F.col("scale")))
              .withColumn("kept", F.coalesce(F.col("distance") <= limit, F.lit(True))))
    bad = counted.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    columns = [*unpacked(passed), *BASE, "base_failed", "distance", "kept"]
    return judged.select(*columns).unionByName(bad.select(*columns))
