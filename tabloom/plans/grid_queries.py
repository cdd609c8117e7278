"""Queries on printed grids and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.functions import values as V
from tabloom.operators import grid as G
from tabloom.plans import value_sql as Q
from tabloom.runtime import checkpoint, table


def _cells(s: SparkSession, d: str) -> DataFrame:
    return G.unique_cells(table(s, d, "ext_cell"))


def _grid(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unique cells, row views and body starts; the cells are read, cleaned and brought together once."""
    cells = checkpoint(_cells(s, d))
    views = G.row_views(cells)
    return cells, views, G.body_starts(views)


def _rows(s: SparkSession, d: str) -> DataFrame:
    return G.row_views(_cells(s, d))


def nrm1_clean_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "ext_cell").select(F.col("text"), T.clean_text(F.col("text")).alias("clean")).distinct()


def nrm3_symbols(s: SparkSession, d: str) -> DataFrame:
    """Comparators as printed and after cleaning, per table."""
    cells = _cells(s, d)
    seen = F.regexp_count("text", F.lit("[≤≥≦≧＜＞<>]"))
    after = F.regexp_count("clean", F.lit("<=|>=|<|>"))
    return cells.groupBy("table_id").agg(F.sum(F.coalesce(seen, F.lit(0))).alias("n_printed"), F.sum(after).alias("n_clean"))


def nrm4_label_text(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "ext_cell").where("col_idx = 0").select("text").distinct()
    return labels.select("text", T.label_text(F.col("text")).alias("label_norm"), T.alpha_text(F.col("text")).alias("label_alpha"))


def nrm6_row_views(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, d).select("table_id", "row_idx", "n_filled", "n_numeric", "n_trailing", (F.col("n_trailing") > 0).alias("has_trailing"))


def nrm7_indent(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, d).select("table_id", "row_idx", "indent")


def nrm11_body_start(s: SparkSession, d: str) -> DataFrame:
    return G.body_starts(_rows(s, d))


def nrm13_value_like(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, d).groupBy("table_id").agg(F.sum("n_value_like").alias("n_value_like"), F.sum("n_trailing").alias("n_trailing"))


def row1_value_family(s: SparkSession, d: str) -> DataFrame:
    cells = _cells(s, d).where("col_idx > 0 and clean <> ''").withColumn("family", V.value_family(F.col("clean")))
    return cells.groupBy("table_id", "family").agg(F.count("*").alias("n_cells"))


def row7_indent_informative(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d).where("indent is not null").select("table_id", "indent")
    base = rows.groupBy("table_id").agg(F.min("indent").alias("base"), F.countDistinct("indent").alias("n_distinct"), F.count("*").alias("n_indents"))
    far = rows.join(base, "table_id").groupBy("table_id", "n_distinct", "n_indents").agg(F.count_if(F.col("indent") - F.col("base") >= 2).alias("n_far"))
    return far.select("table_id", ((F.col("n_indents") >= 3) & (F.col("n_far") >= 2) & (F.col("n_distinct") >= 2)).alias("informative"))


def val1_components(s: SparkSession, d: str) -> DataFrame:
    """Each distinct raw value with its pattern and numbers."""
    raw = table(s, d, "cell_value").select("raw_value").where("raw_value is not null").distinct().withColumn("clean", T.clean_text(F.col("raw_value")))
    parts = V.with_components(raw, "raw_value", "clean")
    return parts.select("raw_value", "pattern", F.posexplode_outer("components").alias("ordinal", "p")).select("raw_value", "pattern", "ordinal", "p.kind", "p.value_num", "p.relation", "p.confidence")


def val3_parsed_cells(s: SparkSession, d: str) -> DataFrame:
    cells, _, starts = _grid(s, d)
    return G.parsed_cells(cells, starts).groupBy("table_id", "pattern").agg(F.count("*").alias("n_cells"))


def _roles(s: SparkSession, d: str) -> DataFrame:
    cells, _, starts = _grid(s, d)
    return checkpoint(G.column_roles(G.header_labels(cells, starts)))


def col4_column_roles(s: SparkSession, d: str) -> DataFrame:
    return _roles(s, d).select("table_id", "col_idx", "header", "match_text", "role", "confidence", "denominator")


def _records(s: SparkSession, d: str) -> DataFrame:
    cells, _, starts = _grid(s, d)
    starts = checkpoint(starts)
    roles = G.column_roles(G.header_labels(cells, starts))
    return G.value_records(G.parsed_cells(cells, starts), table(s, d, "def_variable"), table(s, d, "def_level"), roles)


def val5_value_records(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).select("table_id", "variable_id", "level_id", "row_idx", "col_idx", "role", "pattern", F.size("components").alias("n_components"))


def val6_semantic_kinds(s: SparkSession, d: str) -> DataFrame:
    """Kinds of the components once the variable's style hint is known."""
    records = V.with_components(_records(s, d).drop("pattern", "components"), "text", "clean", "summary_style_hint")
    return records.select(F.coalesce("summary_style_hint", F.lit("none")).alias("style"), F.explode_outer("components.kind").alias("kind")).groupBy("style", "kind").agg(F.count("*").alias("n_components"))


def val7_count_percent_audit(s: SparkSession, d: str) -> DataFrame:
    audit = G.count_percent_audit(checkpoint(_records(s, d)))
    return audit.select("table_id", "variable_id", "col_idx", "role", F.round("percent_sum", 3).alias("percent_sum"), F.round("expected", 3).alias("expected"), "agrees")


def r1_observed_statistics(s: SparkSession, d: str) -> DataFrame:
    """Records in statistic columns, with p values and their relation."""
    stats = _records(s, d).where("role in ('p_value', 'smd')").select("table_id", "variable_id", "level_id", "col_idx", "role", F.explode_outer("components").alias("c"))
    return stats.select("table_id", "variable_id", "level_id", "col_idx", "role", "c.kind", "c.value_num", "c.relation")


def r2_observed_continuous(s: SparkSession, d: str) -> DataFrame:
    kept = _records(s, d).where("level_id is null and coalesce(role, 'unknown') not in ('p_value', 'smd')")
    cont = table(s, d, "def_variable").where("variable_type = 'continuous'").select("variable_id").distinct()
    first = F.col("components")[0]["value_num"]
    return kept.join(cont, "variable_id", "left_semi").select("table_id", "variable_id", "col_idx", "pattern", first.alias("first_value"))


def r3_observed_categorical(s: SparkSession, d: str) -> DataFrame:
    kept = _records(s, d).where("level_id is not null and coalesce(role, 'unknown') not in ('p_value', 'smd')")
    return kept.select("table_id", "variable_id", "level_id", "col_idx", G.component(F.col("components"), "count").alias("n"), G.component(F.col("components"), "percent").alias("percent"))


_C = f"""
with cells as (
  select table_id, row_idx, col_idx, min(text) as text, min(bbox.x0) as x0 from ext_cell group by all),
c as (select *, coalesce({T.sql_clean('text')}, '') as clean from cells),
vl as (select *, {T.sql_value_like('clean')} as is_value from c),
rows as (
  select table_id, row_idx, max(case when col_idx = 0 then text end) as label_raw,
    coalesce(max(case when col_idx = 0 then clean end), '') as label,
    max(case when col_idx = 0 then x0 end) as label_x0,
    count(*) filter (where clean <> '') as n_filled,
    count(*) filter (where regexp_matches(clean, '[0-9]')) as n_numeric,
    count(*) filter (where clean <> '' and col_idx > 0) as n_trailing,
    count(*) filter (where is_value and col_idx > 0) as n_value_like,
    count(distinct case when clean <> '' and col_idx > 0 then clean end) as n_distinct,
    max(col_idx) + 1 as n_cols
  from vl group by table_id, row_idx),
indents as (
  select *, coalesce(cast(round_even(label_x0 - min(label_x0) over (partition by table_id), 0) as integer),
    nullif(length(regexp_extract(label_raw, '^( +)', 1)), 0)) as indent from rows),
anchors as (
  select table_id, min(row_idx) as anchor_row from rows
  where label <> '' and n_trailing > 0 and n_value_like >= case when n_cols <= 3 then 1 else greatest(2, floor(n_trailing * 0.6)) end
  group by table_id),
above as (
  select a.table_id, max(case when not (label <> '' and (n_trailing = 0 or (n_trailing = 1 and n_value_like > 0)
      or (n_trailing > 1 and n_value_like = 0 and n_distinct <= greatest(1, n_trailing // 2)))) then row_idx end) as last_header,
    min(row_idx) as first_row
  from rows r join anchors a using (table_id) where row_idx < anchor_row group by a.table_id),
starts as (
  select a.table_id, anchor_row, cast(coalesce(last_header + 1, first_row, anchor_row) as integer) as body_start
  from anchors a left join above using (table_id)),
heads as (
  select c.table_id, c.col_idx, coalesce(string_agg(clean, ' ' order by row_idx) filter (where row_idx < body_start and clean <> ''), '') as header,
    max(c.col_idx) over (partition by c.table_id) + 1 as n_cols
  from c join starts using (table_id) group by c.table_id, c.col_idx),
matched as (select *, {T.sql_header('header')} as match_text, lower(header) as low from heads),
roles as (
  select *, case when header = '' then 'unknown'
    when regexp_full_match(match_text, 'p(?: *value| +for +trend| *trend)?') and not (match_text = 'p' and col_idx < greatest(0, n_cols - 2)) then 'p_value'
    when contains(low, 'smd') then 'smd' when contains(low, 'overall') or low in ('all', 'total') then 'overall'
    when low in ('control', 'controls') then 'comparison_group' when low in ('case', 'cases') then 'group'
    when low like 'q%' and length(low) <= 3 then 'group'
    when contains(low, '(') and regexp_matches(low, '\\bn *=') then 'group' else 'unknown' end as role,
    try_cast(replace(regexp_extract(header, '(?i)\\bn *= *([0-9][0-9,]*)', 1), ',', '') as integer) as denominator
  from matched),
parsed as (
  select c.table_id, c.row_idx, c.col_idx, c.text, c.clean, {Q.pattern('c.clean')} as pattern
  from c join starts using (table_id) where c.row_idx >= body_start and c.col_idx > 0 and c.clean <> ''),
keys as (
  select distinct table_id, row_start as row_idx, variable_id, cast(null as bigint) as level_id, summary_style_hint from def_variable
  union all
  select distinct l.table_id, l.row_idx, l.variable_id, l.level_id, v.summary_style_hint
  from def_level l join (select distinct variable_id, summary_style_hint from def_variable) v using (variable_id)),
records as (
  select p.*, k.variable_id, k.level_id, k.summary_style_hint, r.role, r.denominator
  from parsed p join keys k using (table_id, row_idx) left join roles r on r.table_id = p.table_id and r.col_idx = p.col_idx)
"""
_PERCENT = Q.second("clean", "pattern")
_COUNT = "case when pattern in ('integer', 'count_parenthesized_percent') then " + Q.first("clean", "pattern") + " end"


SQL: dict[str, str] = {
    "nrm1_clean_text": f"select distinct text, {T.sql_clean('text')} as clean from ext_cell",
    "nrm3_symbols": _C + "select table_id, sum(coalesce(length(regexp_replace(text, '[^≤≥≦≧＜＞<>]', '', 'g')), 0)) as n_printed, sum(length(regexp_replace(regexp_replace(clean, '<=|>=', '<', 'g'), '[^<>]', '', 'g'))) as n_clean from c group by table_id",
    "nrm4_label_text": f"select distinct text, {T.sql_label('text')} as label_norm, {T.sql_alpha('text')} as label_alpha from ext_cell where col_idx = 0",
    "nrm6_row_views": _C + "select table_id, row_idx, n_filled, n_numeric, n_trailing, n_trailing > 0 as has_trailing from rows",
    "nrm7_indent": _C + "select table_id, row_idx, indent from indents",
    "nrm11_body_start": _C + "select table_id, anchor_row, body_start from starts",
    "nrm13_value_like": _C + "select table_id, sum(n_value_like) as n_value_like, sum(n_trailing) as n_trailing from rows group by table_id",
    "row1_value_family": _C + f"select table_id, {Q.family('clean')} as family, count(*) as n_cells from c where col_idx > 0 and clean <> '' group by all",
    "row7_indent_informative": _C + "select table_id, count(*) >= 3 and count(*) filter (where indent - base >= 2) >= 2 and count(distinct indent) >= 2 as informative from (select *, min(indent) over (partition by table_id) as base from indents where indent is not null) group by table_id",
    "val1_components": f"with v as (select raw_value, clean, {Q.pattern('clean')} as pattern from (select distinct raw_value, {T.sql_clean('raw_value')} as clean from cell_value where raw_value is not null)) " + Q.components("v", "raw_value, pattern"),
    "val3_parsed_cells": _C + "select table_id, pattern, count(*) as n_cells from parsed group by all",
    "col4_column_roles": _C
    + """select table_id, col_idx, header, match_text, role, denominator, cast(case role when 'p_value' then case when col_idx = n_cols - 1 then 0.98 when col_idx >= greatest(0, n_cols - 2) then 0.94 else 0.85 end
      when 'smd' then 0.98 when 'overall' then 0.95 when 'comparison_group' then 0.92
      when 'group' then case when low in ('case', 'cases') then 0.92 when low like 'q%' and length(low) <= 3 then 0.8 else 0.78 end
      else case when header = '' then 0.4 else 0.45 end end as double) as confidence from roles""",
    "val5_value_records": _C + "select table_id, variable_id, level_id, row_idx, col_idx, role, pattern, case when pattern = 'median_iqr' then 3 when pattern in ('count_parenthesized_percent', 'numeric_parenthesized_uncertainty', 'numeric_plusminus_uncertainty', 'numeric_spaced_six_uncertainty', 'numeric_dash_uncertainty') then 2 else 1 end as n_components from records",
    "val6_semantic_kinds": _C + ", k as (" + Q.components("records", "coalesce(summary_style_hint, 'none') as style", "coalesce(summary_style_hint, 'none')") + ") select style, kind, count(*) as n_components from k group by all",
    "val7_count_percent_audit": _C
    + f""", l as (select *, case when pattern = 'count_parenthesized_percent' then {_PERCENT} end as percent from records where level_id is not null and summary_style_hint = 'count_pct' and coalesce(role, 'unknown') not in ('p_value', 'smd')),
    s as (select table_id, variable_id, col_idx, role, denominator, sum(percent) as percent_sum from l group by all having count(percent) = count(distinct row_idx) and count(*) = count(distinct row_idx)),
    o as (select table_id, max(denominator) as overall_n from records where role = 'overall' and col_idx = 1 group by table_id),
    e as (select s.*, role = 'overall' and col_idx = 1 as is_all, case when role = 'overall' and col_idx = 1 then 100.0 else denominator / nullif(overall_n, 0) * 100.0 end as expected from s left join o using (table_id))
    select table_id, variable_id, col_idx, role, round(percent_sum, 3) as percent_sum, round(cast(expected as double), 3) as expected, abs(percent_sum - expected) <= case when is_all then 2.0 else 3.0 end as agrees from e""",
    "r1_observed_statistics": _C + ", k as (" + Q.components("(select * from records where role in ('p_value', 'smd'))", "table_id, variable_id, level_id, col_idx, role, clean, pattern")
    + f") select table_id, variable_id, level_id, col_idx, role, kind, value_num, relation from k",
    "r2_observed_continuous": _C + f"select table_id, variable_id, col_idx, pattern, {Q.first("clean", "pattern")} as first_value from records where level_id is null and coalesce(role, 'unknown') not in ('p_value', 'smd') and variable_id in (select variable_id from def_variable where variable_type = 'continuous')",
    "r3_observed_categorical": _C + f"select table_id, variable_id, level_id, col_idx, {_COUNT} as n, case when pattern = 'count_parenthesized_percent' then {_PERCENT} end as percent from records where level_id is not null and coalesce(role, 'unknown') not in ('p_value', 'smd')",
}
QUERIES = {name: globals()[name] for name in SQL}
