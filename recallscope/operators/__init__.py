"""DataFrame operators: worklist, scoring, metrics, comparisons, sections,
report, chart data."""
