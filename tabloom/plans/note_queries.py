"""Queries on notes, blocks and display rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import blocks as K
from tabloom.operators import footnotes as N
from tabloom.operators import grid as G
from tabloom.operators import quality as Q
from tabloom.plans.grid_queries import _C, _cells, _roles
from tabloom.plans.paper_queries import _LINES
from tabloom.plans.quality_queries import SQL as _QUALITY
from tabloom.plans.quality_queries import _families
from tabloom.runtime import checkpoint, table


def geo9_cell_markers(s: SparkSession, d: str) -> DataFrame:
    return N.cell_markers(_cells(s, d)).withColumn("kind", N.glyph_kind(F.col("glyph")))


def jon13_note_definitions(s: SparkSession, d: str) -> DataFrame:
    return N.definitions(table(s, d, "documents"))


def jon15_note_links(s: SparkSession, d: str) -> DataFrame:
    linked = N.link_notes(N.cell_markers(_cells(s, d)), N.definitions(table(s, d, "documents")), table(s, d, "ext_table"))
    return linked.select("table_id", "row_idx", "col_idx", "ordinal", "glyph", "n_definitions", "status", "confidence")


def _kinds(s: SparkSession, d: str) -> DataFrame:
    cells = _families(s, d)
    rows = checkpoint(G.row_views(cells))
    return K.row_kinds(rows, Q.likely_levels(cells, rows, _roles(s, d)), G.body_starts(rows))


def row4_row_kinds(s: SparkSession, d: str) -> DataFrame:
    return _kinds(s, d).groupBy("table_id", "kind").agg(F.count("*").alias("n_rows"))


def row10_variable_blocks(s: SparkSession, d: str) -> DataFrame:
    return K.variable_blocks(_kinds(s, d))


def syn1_display_rows(s: SparkSession, d: str) -> DataFrame:
    return K.display_rows(table(s, d, "def_variable"), table(s, d, "def_level"))


def doc13_reference_starts(s: SparkSession, d: str) -> DataFrame:
    """Lines that begin a reference list, and lines that are numbered entries, per document."""
    from tabloom.operators.documents import ENTRY, lines

    at = lines(table(s, d, "documents"))
    return at.groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"(?i)^ *(?:references|bibliography|works cited|literature cited)\b")).alias("n_headings"), F.count_if(F.col("line").rlike(ENTRY)).alias("n_numbered"))


_LEVELS = _QUALITY["row2_likely_levels"]
_HEAD, _, _TAIL = _LEVELS.rpartition("select l.table_id, l.row_idx from labels")
_KINDS = _HEAD.rstrip() + ", levels as (select l.table_id, l.row_idx from labels" + _TAIL + """), kinds as (select r.table_id, r.row_idx, case when label = '' then 'unknown' when n_trailing = 0 then 'header' when l.table_id is not null then 'level' else 'variable' end as kind
  from rows r join starts using (table_id) left join levels l on l.table_id = r.table_id and l.row_idx = r.row_idx where r.row_idx >= body_start)"""
SQL: dict[str, str] = {
    "geo9_cell_markers": _C + f", g as (select table_id, row_idx, col_idx, regexp_extract_all(clean, '({N.SIGNS})', 1) as gs from c) select table_id, row_idx, col_idx, cast(unnest(range(len(gs))) as integer) as ordinal, unnest(gs) as glyph, 'symbol' as kind from g where len(gs) > 0",
    "jon13_note_definitions": _LINES + f", p as (select paper_id, doc_id, unnest(regexp_extract_all(line, '({N.DEFINITION})', 1)) as part from lines where paper_id is not null and regexp_matches(line, '^{N.SIGNS} ')) select distinct paper_id, doc_id, substring(part, 1, 1) as glyph, trim(substring(part, 3)) as definition from p",
    "jon15_note_links": _C + ", " + _LINES.removeprefix("with ") + f""", p as (select paper_id, unnest(regexp_extract_all(line, '({N.DEFINITION})', 1)) as part from lines where paper_id is not null and regexp_matches(line, '^{N.SIGNS} ')),
      d as (select paper_id, substring(part, 1, 1) as glyph, count(distinct trim(substring(part, 3))) as n from p group by all), g as (select table_id, row_idx, col_idx, regexp_extract_all(clean, '({N.SIGNS})', 1) as gs from c),
      m as (select table_id, row_idx, col_idx, cast(unnest(range(len(gs))) as integer) as ordinal, unnest(gs) as glyph from g where len(gs) > 0), t as (select table_id, min(paper_id) as paper_id from ext_table group by 1)
      select m.table_id, m.row_idx, m.col_idx, m.ordinal, m.glyph, coalesce(n, 0) as n_definitions, case when n = 1 then 'resolved' when n > 1 then 'ambiguous' else 'unresolved' end as status, cast(case when coalesce(n, 0) = 0 then 0 else 0.5 end as double) as confidence
      from m left join t using (table_id) left join d on d.paper_id = t.paper_id and d.glyph = m.glyph""",
    "row4_row_kinds": _KINDS + " select table_id, kind, count(*) as n_rows from kinds group by all",
    "row10_variable_blocks": _KINDS + """, runs as (select *, sum(case when kind in ('header', 'variable') then 1 else 0 end) over (partition by table_id order by row_idx) as block from kinds),
      b as (select table_id, block, min(row_idx) as row_start, max(row_idx) as last, min_by(kind, row_idx) as kind, count(*) filter (where kind = 'level') as n from runs where block > 0 and kind <> 'unknown' group by table_id, block)
      select table_id, row_start, case when kind = 'header' then last else row_start end as row_end, kind, case when kind = 'header' then n else 0 end as n_levels from b""",
    "syn1_display_rows": """with v as (select distinct table_id, variable_id, variable_label, variable_type, row_start from def_variable), l as (select distinct table_id, variable_id, level_id, level_label, row_idx from def_level),
      u as (select table_id, row_start as at_, variable_id as id, case when variable_id in (select variable_id from l) then 'categorical_parent' when variable_type = 'continuous' then 'continuous' else 'categorical_inline' end as row_type, variable_label as label, cast(null as varchar) as parent_label from v
      union all select l.table_id, row_idx, level_id, 'level', level_label, v.variable_label from l join v using (variable_id))
      select table_id, row_number() over (partition by table_id order by at_, row_type, id) - 1 as body_row_idx, row_type, label, parent_label from u""",
    "doc13_reference_starts": _LINES + " select doc_id, count(*) filter (where regexp_matches(line, '(?i)^ *(?:references|bibliography|works cited|literature cited)\\b')) as n_headings, count(*) filter (where regexp_matches(line, '^(?:\\[ *([0-9]{1,3}) *\\]|([0-9]{1,3})[.)]) +(\\S.*)$')) as n_numbered from lines group by 1",
}
QUERIES = {name: globals()[name] for name in SQL}
