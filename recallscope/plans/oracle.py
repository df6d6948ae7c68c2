"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every statement inlines the FIXTURES §3 views as CTEs over the driver's
pre-registered tables. Arithmetic follows the Spark expressions' operation
order with explicit double casts, so values agree bit for bit.
"""

from __future__ import annotations

from recallscope.design import DEFAULT_DESIGN, FLAG_DESIGN, Design

# The code points that Python's str.strip() removes.
STRIPPED = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199,
            8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288)

D = "cast({} as double)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


def sql_chars(text: str) -> str:
    """A SQL expression for a string of arbitrary characters."""
    return "(" + " || ".join(f"chr({ord(ch)})" for ch in text) + ")"


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    if not mapping:
        return default
    whens = " ".join(f"when {col} = {q(k)} then {q(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"(case {whens} else {default} end)"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# --- views of FIXTURES §3 -------------------------------------------------------
TRIALS_V = """trials_v as (
  select d.doc_id as trial_idx, split_part(d.text, chr(10), 1) as title, d.text as abstract,
    concat('10.5555/', d.source, '.', cast(d.doc_id as varchar)) as doi,
    case when l.quality = 1 then 'POSITIVE' when l.quality is not null then 'NEGATIVE' end as annotation_accept,
    concat('Revised: ', split_part(d.text, chr(10), 1)) as counterfactual_title,
    concat('Revised. ', d.text) as counterfactual_abstract,
    case when l.quality = 1 then 'NEGATIVE' when l.quality is not null then 'POSITIVE' end as target_label,
    case when d.doc_id % 20 = 0 then '["title", "results", "conclusion"]'
         when d.doc_id % 20 = 1 then '["methods", "results", "conclusion"]'
         when d.doc_id % 20 = 2 then '[]'
         else '["results", "conclusion"]' end as sections_modified
  from documents d left join labels l on d.doc_id = l.doc_id)"""

GRID_V = """grid_v as (
  select * from (values ('openai',0),('gemini',1),('anthropic',2)) v(vendor, v_ix)
  cross join (values ('baseline',0,95),('title_only',1,80),('doi_only',2,60),
    ('counterfactual',3,98),('counterfactual_with_doi',4,96)) c(condition, c_ix, skill))"""

RAW_V = """raw_v as (
  select trial_idx, vendor, concat(vendor, '-v1') as model, condition, gt as ground_truth,
    case when h % 50 = 0 then 'I cannot tell'
         when h % 61 = 0 then cast(null as varchar)
         when h % 67 = 0 then ''
         when h % 7 = 0 then concat('  ', lower(ans), chr(10))
         when h % 11 = 0 then concat(chr(160), ans, chr(9))
         else ans end as raw_output
  from (select *, case when gt is null then case when h % 2 = 0 then 'POSITIVE' else 'NEGATIVE' end
                       when (h % 100) < skill then gt
                       when gt = 'POSITIVE' then 'NEGATIVE' else 'POSITIVE' end as ans
    from (select t.trial_idx, g.vendor, g.condition, g.skill,
            (t.trial_idx*37 + g.v_ix*53 + g.c_ix*71 + t.trial_idx*t.trial_idx) % 9973 as h,
            case when g.condition in ('counterfactual','counterfactual_with_doi')
                 then t.target_label else t.annotation_accept end as gt
          from trials_v t cross join grid_v g) a) b)"""

PREDS_V = """preds_v as (
  select l_returnflag as vendor, concat('m-', l_returnflag) as model, o_orderpriority as condition,
    l_orderkey as trial_idx, l_linenumber as rep,
    case when o_orderstatus = 'F' then 'POSITIVE' when o_orderstatus = 'O' then 'NEGATIVE'
         else null end as ground_truth,
    case when (l_orderkey*7 + l_linenumber) % 50 = 0 then 'INVALID'
         when (l_partkey + l_linenumber) % 40 = 0 then 'ERROR'
         when (l_quantity <= ascii(o_orderpriority) - 20) = (o_orderstatus = 'F')
           then 'POSITIVE' else 'NEGATIVE' end as parsed_output
  from lineitem join orders on l_orderkey = o_orderkey)"""


def parse_sql(col: str) -> str:
    norm = f"upper(trim({col}, {sql_chars(''.join(map(chr, STRIPPED)))}))"
    return (f"(case when {col} is null then 'ERROR' when {norm} = 'POSITIVE' then 'POSITIVE' "
            f"when {norm} = 'NEGATIVE' then 'NEGATIVE' else 'INVALID' end)")


PARSED_V = f"""parsed_v as (
  select trial_idx, vendor, model, condition, ground_truth, raw_output,
    {parse_sql('raw_output')} as parsed_output from raw_v)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


BASE_TRIALS = (TRIALS_V,)
BASE_RAW = (TRIALS_V, GRID_V, RAW_V, PARSED_V)
BASE_PREDS = (PREDS_V,)

# --- metrics -------------------------------------------------------------------


def count_cols(pred="parsed_output", truth="ground_truth") -> str:
    # DuckDB's count_if is HUGEINT; counts are BIGINT in Spark
    return f"""count(*) as n_total,
    cast(count_if({pred} in ('POSITIVE','NEGATIVE')) as bigint) as n_valid,
    cast(count_if({pred} = 'INVALID') as bigint) as n_invalid,
    cast(count_if({pred} = 'ERROR') as bigint) as n_error,
    cast(count_if({truth} = 'POSITIVE' and {pred} = 'POSITIVE') as bigint) as tp,
    cast(count_if({truth} = 'POSITIVE' and {pred} = 'NEGATIVE') as bigint) as fn,
    cast(count_if({truth} = 'NEGATIVE' and {pred} = 'POSITIVE') as bigint) as fp,
    cast(count_if({truth} = 'NEGATIVE' and {pred} = 'NEGATIVE') as bigint) as tn"""


def counts_cte(src: str, name: str = "counts", by=("vendor", "condition")) -> str:
    keys = ", ".join(by)
    return f"""{name} as (
  select {keys}, {count_cols()} from {src}
  where vendor is not null and condition is not null group by {keys})"""


def score_exprs() -> str:
    n = "(tp + fn + fp + tn)"
    f1p = f"coalesce(case when (2*tp + fp + fn) = 0 then null else {D.format('2*tp')} / {D.format('2*tp + fp + fn')} end, 0.0)"
    f1n = f"coalesce(case when (2*tn + fn + fp) = 0 then null else {D.format('2*tn')} / {D.format('2*tn + fn + fp')} end, 0.0)"
    return f"""{n} as n_pairs,
    case when {n} = 0 then null else {D.format('tp + tn')} / {D.format(n)} end as accuracy,
    case when {n} > 0 then ({f1p} + {f1n}) / cast(2.0 as double) end as f1_macro,
    case when (tp + fn) = 0 then null else {D.format('tp')} / {D.format('tp + fn')} end as sensitivity,
    case when (tn + fp) = 0 then null else {D.format('tn')} / {D.format('tn + fp')} end as specificity,
    {D.format('n_valid')} / {D.format('n_total')} * cast(100.0 as double) as pct_valid"""


def scored_cte(src_counts: str = "counts", name: str = "scored") -> str:
    return f"""{name} as (select *, {score_exprs()} from {src_counts})"""


def metrics_cte(src: str) -> str:
    """One row per (vendor, model, condition), numbers over (vendor, condition)."""
    return f"""{counts_cte(src)},
{scored_cte()},
settings as (select distinct vendor, model, condition from {src}
  where vendor is not null and condition is not null),
metrics as (
  select s.vendor, s.model, s.condition, c.accuracy, c.f1_macro, c.n_total, c.n_valid, c.n_invalid,
    c.n_error, c.pct_valid, c.tp, c.fn, c.fp, c.tn, c.n_pairs, c.sensitivity, c.specificity
  from settings s join scored c on s.vendor = c.vendor and s.condition = c.condition)"""


METRIC_SELECT = "vendor, model, condition, accuracy, f1_macro, n_total, n_valid, n_invalid, n_error, pct_valid"


def wald_sql(p: str, n: str, z: float = 1.96) -> tuple[str, str]:
    se = f"sqrt({p} * (cast(1.0 as double) - {p}) / {D.format(n)})"
    undefined = f"({p} is null or {n} is null or {n} = 0)"
    zz = f"cast({z!r} as double)"
    lo = f"(case when not {undefined} then greatest(cast(0.0 as double), {p} - {zz} * {se}) end)"
    hi = f"(case when not {undefined} then least(cast(1.0 as double), {p} + {zz} * {se}) end)"
    return lo, hi


def fmt(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x})"


def format_ci_sql(p: str, n: str) -> str:
    lo, hi = wald_sql(p, n)
    return (f"(case when {p} is null then 'N/A' else "
            f"{fmt(p, 2)} || ' (' || {fmt(lo, 2)} || '-' || {fmt(hi, 2)} || ')' end)")


INTERVAL_SIZES = {
    "accuracy": "n_pairs",
    "sensitivity": "(tp + fn)",
    "specificity": "(tn + fp)",
    "f1_macro": "n_pairs",
}


def ord_sql(col: str, values) -> str:
    return case_map(col, {v: i for i, v in enumerate(values)})


# --- pivots / comparisons --------------------------------------------------------

def f1_pivot_sql(design: Design, present_conditions) -> str:
    cols = ", ".join(
        f"max(case when condition = {q(c)} then f1_macro end) as {ident(c)}" for c in present_conditions)
    return f"""select vendor{', ' + cols if cols else ''} from metrics
where vendor in {in_list(design.vendors)}
  and vendor in (select vendor from metrics where f1_macro is not null)
group by vendor"""


def present_sql(column: str, known) -> str:
    return f"select distinct {column} from metrics where f1_macro is not null and {column} in {in_list(known)}"


def top_f1_sql(design: Design, k: int = 5) -> str:
    return f"""select vendor, condition, f1_macro, accuracy, pct_valid from metrics
order by f1_macro desc nulls last, {ord_sql('condition', design.conditions)} nulls last,
  {ord_sql('vendor', design.vendors)} nulls last, condition nulls last, vendor nulls last, model nulls last
limit {k}"""


def degradation_sql(design: Design) -> str:
    return f"""select m.vendor, m.condition, m.f1_macro, b.baseline_f1,
  b.baseline_f1 - m.f1_macro as abs_degradation,
  case when b.baseline_f1 > 0 then (b.baseline_f1 - m.f1_macro) / b.baseline_f1 * cast(100.0 as double)
       else cast(0.0 as double) end as rel_degradation_pct
from metrics m join (
  select vendor, max(f1_macro) as baseline_f1 from metrics where condition = {q(design.baseline)} group by vendor
) b on m.vendor = b.vendor"""


def compare_sql(first: str, second: str) -> str:
    return f"""select a.vendor, a.f1 as baseline_f1, b.f1 as counterfactual_f1, a.f1 - b.f1 as f1_difference
from (select vendor, max(f1_macro) as f1 from metrics where condition = {q(first)} group by vendor) a
join (select vendor, max(f1_macro) as f1 from metrics where condition = {q(second)} group by vendor) b
  on a.vendor = b.vendor"""


def report_select(design: Design, with_order: bool = False) -> str:
    cols = [
        f"{case_map('condition', design.report_condition_labels)} as \"Condition\"",
        f"{case_map('vendor', design.vendor_labels)} as \"Model\"",
        f"{fmt('pct_valid', 1)} as \"Valid predictions (%)\"",
    ]
    titles = {"accuracy": "Accuracy (95% CI)", "sensitivity": "Sensitivity (95% CI)",
              "specificity": "Specificity (95% CI)", "f1_macro": "F1 Score (95% CI)"}
    for m, size in INTERVAL_SIZES.items():
        cols.append(f"{format_ci_sql(m, size)} as {ident(titles[m])}")
    if with_order:
        cols += [f"{ord_sql('condition', design.conditions)} as condition_ord",
                 f"{ord_sql('vendor', design.vendors)} as vendor_ord"]
    return ("select " + ",\n  ".join(cols) + "\nfrom scored\n"
            + f"where condition in {in_list(design.conditions)} and vendor in {in_list(design.vendors)}")


def _report_ctes(src) -> tuple:
    return (*src, counts_cte("parsed_v" if "parsed_v" in src[-1] else "preds_v"), scored_cte())


def report_sql(design: Design, src) -> str:
    return with_(*_report_ctes(src)) + report_select(design)


REPORT_TITLES = ("Condition", "Model", "Valid predictions (%)", "Accuracy (95% CI)", "Sensitivity (95% CI)",
                 "Specificity (95% CI)", "F1 Score (95% CI)")


def report_lines_sql(design: Design, src) -> str:
    """The report as fixed-width lines: titles as one more row, widths by window."""
    titles = ", ".join(q(t) for t in REPORT_TITLES)
    widths = ", ".join(f"max(length({ident(t)})) over () as w{i}" for i, t in enumerate(REPORT_TITLES))
    padded = " || ' ' || ".join(f"lpad({ident(t)}, cast(w{i} as integer), ' ')" for i, t in enumerate(REPORT_TITLES))
    return (with_(*_report_ctes(src), f"rep as ({report_select(design, with_order=True)})",
                  f"cells as (select * from rep union all select {titles}, -1, -1)",
                  f"sized as (select *, count(*) over () as n_cells, {widths} from cells)")
            + f"""select cast(row_number() over (order by condition_ord, vendor_ord) - 1 as bigint) as line_no,
  case when n_cells = 1 then 'Empty DataFrame' || chr(10) || 'Columns: []' || chr(10) || 'Index: []'
       else {padded} end as line
from sized""")


def grid_values(vendors, conditions) -> str:
    rows = ", ".join(f"({q(v)}, {q(c)}, {vi}, {ci})"
                     for ci, c in enumerate(conditions) for vi, v in enumerate(vendors))
    return f"(values {rows}) g(vendor, condition, vendor_ord, condition_ord)"


def vendor_display_sql(design: Design, col: str = "vendor") -> str:
    return f"coalesce({case_map(col, design.vendor_labels)}, upper({col}))"


def fill_grid_sql(design: Design, value: str, fill, vendors=None, conditions=None) -> str:
    vendors = design.vendors if vendors is None else vendors
    conditions = design.conditions if conditions is None else conditions
    fill_sql = "cast(null as double)" if fill is None else f"cast({fill!r} as double)"
    return f"""select g.vendor, g.condition, g.vendor_ord, g.condition_ord,
  {vendor_display_sql(design, 'g.vendor')} as vendor_display,
  case when c._rows is null then {fill_sql} else c._v end as {value}
from {grid_values(vendors, conditions)}
left join (select vendor, condition, max({value}) as _v, count(*) as _rows from metrics
           where vendor in {in_list(vendors)} and condition in {in_list(conditions)}
           group by vendor, condition) c
  on g.vendor = c.vendor and g.condition = c.condition"""


def panels_sql(design: Design, conditions, src: str) -> str:
    return f"""select g.condition, g.vendor, g.condition_ord, g.vendor_ord,
  coalesce(s.tp, 0) as tp, coalesce(s.fn, 0) as fn, coalesce(s.fp, 0) as fp, coalesce(s.tn, 0) as tn,
  case when coalesce(s.tp + s.fn + s.fp + s.tn, 0) > 0 then s.f1_macro end as f1_macro,
  coalesce(s.tp + s.fn + s.fp + s.tn, 0) > 0 as has_valid
from {grid_values(design.vendors, conditions)}
left join (select * from scored where vendor in {in_list(design.vendors)}
           and condition in {in_list(conditions)}) s
  on g.vendor = s.vendor and g.condition = s.condition"""


PROMPT_SQL = """(case
  when condition = 'baseline' then
    'Title: ' || coalesce(title, 'nan') || chr(10) || chr(10) || 'Abstract: ' || coalesce(abstract, 'nan')
  when condition = 'title_only' then 'Title: ' || coalesce(title, 'nan')
  when condition = 'doi_only' then 'DOI: ' || coalesce(doi, 'nan')
  when condition = 'counterfactual' then
    'Title: ' || coalesce(title, 'nan') || chr(10) || chr(10) || 'Abstract: ' || coalesce(abstract, 'nan')
  when condition = 'counterfactual_with_doi' then
    'DOI: ' || coalesce(doi, 'nan') || chr(10) || chr(10) || 'Title: ' || coalesce(title, 'nan')
    || chr(10) || chr(10) || 'Abstract: ' || coalesce(abstract, 'nan')
  end)"""


def prompt_sql() -> str:
    """The five prompt layouts, written out here independently of the code under test."""
    return PROMPT_SQL


def routed_sql(design: Design = DEFAULT_DESIGN) -> str:
    rw = in_list(design.rewritten_conditions)
    return f"""select trial_idx, vendor, condition,
  case when condition in {rw} then counterfactual_title else title end as title,
  case when condition in {rw} then counterfactual_abstract else abstract end as abstract,
  doi,
  case when condition in {rw} then target_label else annotation_accept end as ground_truth
from work"""


def work_cte(design: Design = DEFAULT_DESIGN, vendors=None, conditions=None) -> str:
    vendors = design.vendors if vendors is None else vendors
    conditions = design.conditions if conditions is None else conditions
    cells = ", ".join(f"({q(c)}, {q(v)})" for c in conditions for v in vendors)
    return f"work as (select t.*, s.condition, s.vendor from trials_v t cross join (values {cells}) s(condition, vendor))"


def scorer_sql(prompt: str) -> str:
    r = f"(strlen({prompt}) % 16)"
    return (f"(case when {r} = 0 then cast(null as varchar) when {r} = 1 then 'I cannot tell' "
            f"when {r} = 2 then ' positive' || chr(10) when {r} % 2 = 0 then 'POSITIVE' else 'NEGATIVE' end)")


def scored_predictions_sql(design: Design = DEFAULT_DESIGN) -> str:
    """Worklist over trials_v -> prompts -> deterministic scorer -> 7 columns."""
    models = case_map("vendor", design.models)
    return (with_(TRIALS_V, work_cte(design),
                  f"routed as ({routed_sql(design)})",
                  f"prompted as (select *, {prompt_sql()} as prompt from routed)",
                  f"answered as (select *, {scorer_sql('prompt')} as raw_output from prompted)")
            + f"""select trial_idx, vendor, {models} as model, condition, raw_output,
  {parse_sql('raw_output')} as parsed_output, ground_truth from answered""")


def sections_list_sql(col: str = "sections_modified") -> str:
    return f"cast(json({col}) as varchar[])"


FLAG = FLAG_DESIGN
DEFAULT = DEFAULT_DESIGN


def section_report_lines_sql(report_rows) -> str:
    """S5 + S6 as the text report's (block, pos, line) rows."""
    lst = sections_list_sql()
    parts = []
    for i, label in enumerate(report_rows):
        occ = f"cast(coalesce(sum(len(list_filter({lst}, lambda x: x = {q(label.lower())}))), 0) as bigint)"
        parts.append(f"select {i} as ord, {q(label)} as section, {occ} as n_modified, "
                     f"cast(count(*) as double) as total from trials_v")
    sec = "\nunion all\n".join(parts)

    def pct_cell(x):
        return f"lpad(coalesce(printf('%.1f', {x}), 'nan'), 12, ' ') || '%'"

    def left(x, w):
        return f"rpad({x}, cast(greatest({w}, length({x})) as integer), ' ')"

    def right(x, w):
        return f"lpad({x}, cast(greatest({w}, length({x})) as integer), ' ')"

    fixed = [
        (0, 0, "'Counterfactual Abstract Section Modifications (N=' || cast(n_trials as varchar) || ' trials)'"),
        (0, 1, q("=" * 60)), (0, 2, "''"), (0, 3, q("Section Modification Frequency")), (0, 4, q("-" * 40)),
        (0, 5, q("Section".ljust(16) + "Trials Modified".rjust(15) + "Percentage".rjust(13))), (0, 6, q("-" * 40)),
        (2, 0, q("-" * 40)), (2, 1, "''"), (2, 2, q("Number of Sections Modified per Trial")), (2, 3, q("-" * 40)),
        (2, 4, q("Sections Modified".ljust(18) + "Trials".rjust(13) + "Percentage".rjust(13))), (2, 5, q("-" * 40)),
        (4, 0, q("-" * 40)), (4, 1, "''"),
        (4, 2, "'Mean: ' || coalesce(printf('%.2f', mean_sections), 'nan') || ' sections'"),
        (4, 3, "'Median: ' || coalesce(printf('%.1f', median_sections), 'nan') || ' sections'"),
    ]
    fixed_sql = "\nunion all\n".join(f"select {b} as block, cast({p} as bigint) as pos, {line} as line from summ"
                                       for b, p, line in fixed)
    n_cast = "cast(n_modified as varchar)"
    return (with_(*BASE_TRIALS,
                  f"sec as ({sec})",
                  f"sized as (select cast(len({lst}) as bigint) as n_sections from trials_v)",
                  "dist as (select n_sections, count(*) as n_trials, cast(count(*) as double) / "
                  "cast((select count(*) from trials_v) as double) * cast(100.0 as double) as pct_trials "
                  "from sized group by n_sections)",
                  "summ as (select count(*) as n_trials, avg(n_sections) as mean_sections, "
                  "cast(median(n_sections) as double) as median_sections from sized)")
            + fixed_sql
            + f"""
union all
select 1, cast(ord as bigint), {left('section', 16)} || {right(n_cast, 15)}
  || {pct_cell("cast(n_modified as double) / total * cast(100.0 as double)")} from sec
union all
select 3, n_sections, {left('cast(n_sections as varchar)', 18)} || {right('cast(n_trials as varchar)', 13)}
  || {pct_cell('pct_trials')} from dist""")
