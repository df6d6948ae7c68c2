"""Randomised checks of properties: what must hold of parsing,
formatting, intervals and counts, on constructed inputs whose answer is known."""

from decimal import ROUND_HALF_EVEN, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recallscope.functions import WHITESPACE, format_ci, format_fixed, parse_output, wald_ci
from recallscope.operators import metrics

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

# --- parsing: answers built so that their class is known ---------------------------

gap = st.text(alphabet=WHITESPACE, max_size=3)
CLASSES = {
    "POSITIVE": st.sampled_from(["POSITIVE", "positive", "Positive", "poſitive"]),  # the long s upper-cases to S
    "NEGATIVE": st.sampled_from(["NEGATIVE", "negative", "nEgAtIvE"]),
    "INVALID": st.sampled_from(["", "yes", "POSITIVE.", "NEG", "positive negative", "x", "nega\u0307tive"]),
}
answer = st.one_of(st.just(("ERROR", None)), *[
    st.tuples(st.just(k), st.builds(lambda a, b, c: a + b + c, gap, core, gap)) for k, core in CLASSES.items()])


@SETTINGS
@given(st.lists(answer, min_size=1, max_size=60))
def test_constructed_answers_get_their_class(spark, cases):
    df = spark.createDataFrame([(i, raw) for i, (_, raw) in enumerate(cases)], "i int, raw string")
    got = {r.i: r.p for r in df.select("i", parse_output("raw").alias("p")).collect()}
    assert [got[i] for i in range(len(cases))] == [k for k, _ in cases]


# --- fixed-point formatting: the decimal rounding of the exact binary value ---------

ties = st.builds(lambda k, d: (k + 0.5) / d, st.integers(0, 999), st.sampled_from([100, 1000]))
unit = st.one_of(st.floats(0, 1, allow_nan=False), ties.filter(lambda x: x <= 1))


def exact(x: float, digits: int) -> Decimal:
    return Decimal(x).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN)


@SETTINGS
@given(st.lists(unit, min_size=1, max_size=80))
def test_formatting_rounds_the_binary_value(spark, xs):
    df = spark.createDataFrame([(i, x, x * 100) for i, x in enumerate(xs)], "i int, x double, p double")
    out = df.orderBy("i").select("x", "p", format_fixed(F.col("x"), 2).alias("s"), format_fixed(F.col("p"), 1).alias("t")).collect()
    for r in out:
        assert Decimal(r.s) == exact(r.x, 2) and len(r.s.split(".")[1]) == 2
        assert Decimal(r.t) == exact(r.p, 1) and len(r.t.split(".")[1]) == 1


# --- intervals: symmetry, width, bounds ----------------------------------------------

@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300)), min_size=1, max_size=40))
def test_intervals(spark, pairs):
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(pairs)], "i int, k int, n int")
    p = F.try_divide(F.col("k").cast("double"), (F.col("k") + F.col("n")).cast("double"))
    size = F.col("k") + F.col("n")
    ci = wald_ci(p, size)
    out = df.orderBy("i").select(p.alias("p"), size.alias("size"), ci["lower"].alias("lo"), ci["upper"].alias("hi"),
                                 format_ci(p, ci["lower"], ci["upper"]).alias("s")).collect()
    for r in out:
        if r.size == 0:
            assert (r.p, r.lo, r.hi, r.s) == (None, None, None, "N/A")
            continue
        assert 0 <= r.lo <= r.p <= r.hi <= 1
        if r.lo > 0 and r.hi < 1:
            assert abs((r.hi - r.p) - (r.p - r.lo)) < 1e-12
        for side, free in ((r.p - r.lo, r.lo > 0), (r.hi - r.p, r.hi < 1)):
            square = 1.96**2 * r.p * (1 - r.p)  # n times the squared half width
            assert abs(side**2 * r.size - square) < 1e-9 if free else side**2 * r.size <= square + 1e-9
        body = r.s.replace("(", "").replace(")", "")
        shown, low, high = body.split(" ")[0], *body.split(" ")[1].split("-")
        assert [Decimal(v) for v in (shown, low, high)] == [exact(v, 2) for v in (r.p, r.lo, r.hi)]


# --- counts: rows built from chosen counts give those counts back --------------------

CELLS = [(t, p) for t in ("POSITIVE", "NEGATIVE", None) for p in ("POSITIVE", "NEGATIVE", "INVALID", "ERROR")]
chosen = st.lists(st.integers(0, 4), min_size=len(CELLS), max_size=len(CELLS))


@SETTINGS
@given(st.dictionaries(st.sampled_from([("a", "c1"), ("a", "c2"), ("b", "c1")]), chosen, min_size=1), st.integers(1, 3))
def test_chosen_counts_come_back(spark, settings_, models):
    rows = [(v, f"m{i % models}", c, t, p) for (v, c), ns in settings_.items()
            for (t, p), n in zip(CELLS, ns) for i in range(n)]
    rows += [(None, "m0", "c1", "POSITIVE", "POSITIVE"), ("a", "m0", None, "POSITIVE", "POSITIVE")]
    df = spark.createDataFrame(rows, "vendor string, model string, condition string, ground_truth string, parsed_output string")
    counts = {(r.vendor, r.condition): r for r in metrics.setting_counts(df).collect()}
    table = metrics.metrics_by_setting(df).collect()
    assert set(counts) == {k for k, ns in settings_.items() if sum(ns)}
    for key, ns in settings_.items():
        if not sum(ns):
            continue
        by = dict(zip(CELLS, ns))
        r = counts[key]
        pos, neg = "POSITIVE", "NEGATIVE"
        assert (r.tp, r.fn, r.fp, r.tn) == (by[pos, pos], by[pos, neg], by[neg, pos], by[neg, neg])
        assert r.n_total == sum(ns) and r.n_invalid == sum(by[t, "INVALID"] for t in (pos, neg, None))
        mine = [m for m in table if (m.vendor, m.condition) == key]
        assert 1 <= len(mine) <= models and len({(m.accuracy, m.f1_macro, m.n_total) for m in mine}) == 1
        n = r.tp + r.fn + r.fp + r.tn
        m = mine[0]
        assert (m.accuracy is None) == (m.f1_macro is None) == (n == 0)
        if n:
            assert round(m.accuracy * n) == r.tp + r.tn
            # swapping the two labels in truth and answer leaves macro F1 as it is; all right is 1, all wrong 0
            assert (m.f1_macro == 1.0) == (r.fn + r.fp == 0 and r.tp > 0 and r.tn > 0)
            assert (m.f1_macro == 0.0) == (r.tp + r.tn == 0)
