"""Column expressions: JVM-side building blocks used by the operators."""

from recallscope.functions.stats import (
    accuracy,
    f1_macro,
    sensitivity,
    specificity,
    wald_ci,
)
from recallscope.functions.text import (
    WHITESPACE,
    format_ci,
    format_fixed,
    parse_output,
    python_strip,
)

__all__ = [
    "WHITESPACE",
    "accuracy",
    "f1_macro",
    "format_ci",
    "format_fixed",
    "parse_output",
    "python_strip",
    "sensitivity",
    "specificity",
    "wald_ci",
]
