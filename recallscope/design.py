"""Experiment design: vendors, conditions, labels and their orders.

Every operator takes a :class:`Design` so that data with other vendor or
condition names (for example the driver's test views) can be analysed with
the same code. Dimension lookups are literal maps inside expressions, so no
join is needed to attach an order or a label.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You will be provided with information about a randomized controlled oncology trial.\n"
    "Your task will be to classify if the trial was positive, i.e. if it met its primary\n"
    "endpoint, or negative, i.e. if it did not meet its primary endpoint. Your response\n"
    "should be either the word POSITIVE (in all caps) or NEGATIVE (in all caps). Do not output anything else."
)
VENDORS = ("openai", "gemini", "anthropic")
MODELS = {
    "openai": "gpt-5.2-2025-12-11",
    "gemini": "gemini-3-flash-preview",
    "anthropic": "claude-opus-4-5-20251101",
}
CONDITIONS = ("baseline", "title_only", "doi_only", "counterfactual", "counterfactual_with_doi")
REWRITTEN_CONDITIONS = ("counterfactual", "counterfactual_with_doi")
BASELINE = "baseline"
COUNTERFACTUAL = "counterfactual"
REPORT_CONDITION_LABELS = {
    "baseline": "Baseline",
    "title_only": "Title only",
    "doi_only": "DOI only",
    "counterfactual": "Counterfactual",
    "counterfactual_with_doi": "Counterfactual + DOI",
}
VENDOR_LABELS = {
    "openai": "GPT-5.2",
    "gemini": "Gemini 3 Flash",
    "anthropic": "Claude Opus 4.5",
}
PLOT_CONDITION_LABELS = {
    "baseline": "Baseline\n(Title + Abstract)",
    "title_only": "Title Only",
    "doi_only": "DOI Only",
    "counterfactual": "Counterfactual",
    "counterfactual_with_doi": "Counterfactual\n+ DOI",
}
HEATMAP_CONDITION_LABELS = {
    "baseline": "Baseline",
    "title_only": "Title Only",
    "doi_only": "DOI Only",
    "counterfactual": "Counterfactual",
    "counterfactual_with_doi": "Counterfactual + DOI",
}
SECTIONS = ("title", "methods", "results", "conclusion")
SECTION_REPORT_ROWS = ("Title", "Introduction", "Methods", "Results", "Conclusion")
DEGRADATION_SERIES = ("baseline", "title_only", "doi_only")
LABELS = ("POSITIVE", "NEGATIVE")
STATUS_INVALID = "INVALID"
STATUS_ERROR = "ERROR"
MAX_OUTPUT_TOKENS = 500
# ---------------------------------------------------------------------------


def literal_map(mapping: dict) -> Column:
    """A literal MapType column; lookups stay inside whole-stage codegen."""
    if not mapping:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


@dataclass(frozen=True)
class Design:
    vendors: tuple[str, ...] = VENDORS
    conditions: tuple[str, ...] = CONDITIONS
    models: dict = field(default_factory=lambda: dict(MODELS))
    baseline: str = BASELINE
    counterfactual: str = COUNTERFACTUAL
    rewritten_conditions: tuple[str, ...] = REWRITTEN_CONDITIONS
    report_condition_labels: dict = field(default_factory=lambda: dict(REPORT_CONDITION_LABELS))
    vendor_labels: dict = field(default_factory=lambda: dict(VENDOR_LABELS))
    plot_condition_labels: dict = field(default_factory=lambda: dict(PLOT_CONDITION_LABELS))
    heatmap_condition_labels: dict = field(default_factory=lambda: dict(HEATMAP_CONDITION_LABELS))
    system_prompt: str = SYSTEM_PROMPT
    degradation_series: tuple[str, ...] = DEGRADATION_SERIES  # conditions of the degradation chart

    @property
    def counterfactual_series(self) -> tuple[str, ...]:
        return (self.baseline, *self.rewritten_conditions)

    def vendor_ord(self, col: Column | str = "vendor") -> Column:
        return literal_map({v: i for i, v in enumerate(self.vendors)})[F.col(col) if isinstance(col, str) else col]

    def condition_ord(self, col: Column | str = "condition") -> Column:
        return literal_map({c: i for i, c in enumerate(self.conditions)})[F.col(col) if isinstance(col, str) else col]

    def check_vendors(self, vendors) -> tuple[str, ...]:
        return _check(vendors, self.vendors, "vendor")

    def check_conditions(self, conditions) -> tuple[str, ...]:
        return _check(conditions, self.conditions, "condition")


def _check(chosen, allowed, what):
    if chosen is None:
        return tuple(allowed)
    if isinstance(chosen, str):
        chosen = (chosen,)
    bad = [c for c in chosen if c not in allowed]
    if bad:
        raise ValueError(f"unknown {what}: {bad}; choose from {list(allowed)}")
    return tuple(chosen)


DEFAULT_DESIGN = Design()

# Design for the driver's test tables: return flags play vendors and order
# priorities play conditions (1-URGENT is the baseline, 4-NOT SPECIFIED the
# rewritten-text condition).
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
FLAG_DESIGN = Design(
    vendors=("A", "N", "R"),
    conditions=PRIORITIES,
    models={"A": "m-A", "N": "m-N", "R": "m-R"},
    baseline="1-URGENT",
    counterfactual="4-NOT SPECIFIED",
    rewritten_conditions=("4-NOT SPECIFIED", "5-LOW"),
    degradation_series=("1-URGENT", "2-HIGH", "3-MEDIUM"),
    report_condition_labels={p: p.split("-", 1)[1].title() for p in PRIORITIES},
    vendor_labels={"A": "Flag A", "N": "Flag N", "R": "Flag R"},
    plot_condition_labels={},
    heatmap_condition_labels={},
)
