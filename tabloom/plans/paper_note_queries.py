"""Queries on resolved tables, continued variables, note anchors and reference lists, and their SQL written from the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import continuation as C
from tabloom.operators import documents as D
from tabloom.operators import footnotes as N
from tabloom.plans.grid_queries import SQL as _GRID
from tabloom.plans.grid_queries import _C, _cells, _roles
from tabloom.plans.paper_queries import SQL as _PAPERS
from tabloom.plans.paper_queries import _LINES, _numbered
from tabloom.runtime import checkpoint, table


def _resolved(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    numbered = checkpoint(_numbered(s, d))
    groups = C.continuation_groups(numbered)
    checks = C.column_checks(C.parents(numbered), C.comparison_labels(_roles(s, d)))
    return groups, C.resolved_tables(groups, checks)


def jon1_resolved_tables(s: SparkSession, d: str) -> DataFrame:
    return _resolved(s, d)[1]


def jon8_integrated_variables(s: SparkSession, d: str) -> DataFrame:
    """Variables of tables in one order, those that go on over fragments with those before."""
    groups, resolved = _resolved(s, d)
    return C.integrated_variables(resolved, groups, table(s, d, "def_variable")).select("resolved_id", "table_id", "variable_id", "place")


def jon9_boundary_decisions(s: SparkSession, d: str) -> DataFrame:
    """Fragments of one number, whether or not their columns agree, so that every boundary is judged."""
    groups, _ = _resolved(s, d)
    whole = groups.select("table_id", F.col("base_id").alias("resolved_id"))
    variables = table(s, d, "def_variable")
    return C.boundary_decisions(C.integrated_variables(whole, groups, variables), variables, table(s, d, "def_level"))


def jon10_note_anchors(s: SparkSession, d: str) -> DataFrame:
    return N.anchors(_cells(s, d), table(s, d, "ext_table")).withColumn("kind", N.glyph_kind(F.col("glyph")))


def jon11_footer_lines(s: SparkSession, d: str) -> DataFrame:
    return N.footer_lines(D.lines(table(s, d, "documents").where("text is not null"))).select("doc_id", "line_no")


def jon12_footers(s: SparkSession, d: str) -> DataFrame:
    """Footer lines per paper and document, as one block with its size."""
    docs = table(s, d, "documents").where("text is not null")
    papers = docs.select("doc_id", "paper_id")
    found = N.footer_lines(D.lines(docs)).join(papers, "doc_id").where("paper_id is not null")
    return found.groupBy("paper_id", "doc_id").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def jon14_definition_markers(s: SparkSession, d: str) -> DataFrame:
    lines = N.footer_lines(D.lines(table(s, d, "documents").where("text is not null")))
    return N.definition_markers(lines)


def jon17_bibliography_mentions(s: SparkSession, d: str) -> DataFrame:
    """Numbers in square brackets in running text, met with the paper's reference list."""
    docs = table(s, d, "documents").where("text is not null and paper_id is not null")
    marks = docs.select("paper_id", "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[a-z.,;)] ?\[([0-9]{1,3})\]"), F.lit(1))).alias("n")).select("paper_id", "doc_id", F.col("n").cast("int").alias("number"))
    none = marks.where("false").select("paper_id", "number")
    return N.bibliography_mentions(marks, none, D.bibliography_entries(docs)).select("paper_id", "doc_id", "number", "n_entries", "status")


def doc8_reference_evidence(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents as they would count in a reference list: numbered, going on, or blank."""
    docs = table(s, d, "documents").where("text is not null")
    kind = F.when(F.col("line").rlike(D.ENTRY), "numbered").when(F.trim("line") == "", "blank").otherwise("continuation")
    return D.lines(docs).groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


def doc11_bibliographies(s: SparkSession, d: str) -> DataFrame:
    """Papers with their numbers of entries, entries that are named in the text, and mentions by status."""
    entries = checkpoint(D.bibliography_entries(table(s, d, "documents").where("text is not null and paper_id is not null")))
    mentions = jon17_bibliography_mentions(s, d)
    own = entries.groupBy("paper_id").agg(F.count("*").alias("n_entries"), F.countDistinct("number").alias("n_numbers"))
    said = mentions.groupBy("paper_id").agg(F.count("*").alias("n_mentions"), *[F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("resolved", "ambiguous", "unresolved")])
    return own.join(said, "paper_id", "full").fillna(0)


def flt2_page_number_templates(s: SparkSession, d: str) -> DataFrame:
    """Lines whose number runs with their document's place in the paper: template, and how far apart the two are."""
    docs = table(s, d, "documents").where("text is not null and paper_id is not null")
    place = docs.groupBy("doc_id", "paper_id").agg(F.count("*").alias("n")).drop("n")
    from pyspark.sql import Window

    place = place.withColumn("page", F.row_number().over(Window.partitionBy("paper_id").orderBy("doc_id")))
    lines = D.lines(docs).where(F.length("line") <= 80)
    tokens = lines.select("doc_id", F.trim("line").alias("line"), F.posexplode(F.regexp_extract_all("line", F.lit(r"([0-9]{1,6})"), F.lit(1))).alias("place_in_line", "token"))
    seen = tokens.join(place, "doc_id").select("paper_id", "page", F.regexp_replace("line", "[0-9]+", "<n>").alias("template"), "place_in_line", (F.col("token").cast("int") - F.col("page")).alias("apart"))
    found = seen.groupBy("paper_id", "template", "place_in_line").agg(F.countDistinct("apart").alias("n_apart"), F.countDistinct("page").alias("n_pages"), F.count("*").alias("n"), F.min("apart").alias("apart"))
    return found.where("n_apart = 1 and n_pages >= 2").select("paper_id", "template", "place_in_line", "n_pages", "apart")


def r11_plausibility(s: SparkSession, d: str) -> DataFrame:
    """The count and percent audit per table: variables judged, and those that don't agree."""
    from tabloom.plans.grid_queries import val7_count_percent_audit

    return val7_count_percent_audit(s, d).groupBy("table_id").agg(F.count("*").alias("n_judged"), F.count_if(~F.col("agrees")).alias("n_implausible"), F.round(F.max(F.abs(F.col("percent_sum") - F.col("expected"))), 3).alias("worst"))


_CHECKS = "checks as (" + _PAPERS["jon6_column_checks"] + "), groups as (" + _PAPERS["jon3_continuation_groups"] + ")"
_RESOLVED = "with " + _CHECKS + """,
own as (select g.*, case when part = 1 or coalesce(c.fits, '') <> 'match' then 1 else 0 end as apart from groups g left join (select distinct table_id, "check" as fits from checks) c using (table_id)),
runs as (select *, sum(apart) over (partition by base_id order by part) as piece from own),
resolved as (select table_id, part, base_id, first_value(table_id) over (partition by base_id, piece order by part) as resolved_id, count(*) over (partition by base_id, piece) as n_fragments from runs)
"""
_FOOT = _LINES + r""", stops as (select *, max((regexp_matches(line, '(?i)\bdoi\b|10\.\d{4,}/'))::integer) over (partition by doc_id order by line_no) as stopped from lines),
foot as (select doc_id, paper_id, line_no, line from stops where stopped = 0 and regexp_matches(line, '^([*†‡§¶#]+ ?|[a-z][).]? |[0-9]{1,2}[).]? )[A-Z]'))
"""
_BRACKETS = r"""marks as (select distinct paper_id, doc_id, cast(n as integer) as number from (select paper_id, doc_id, unnest(regexp_extract_all(text, '[a-z.,;)] ?\[([0-9]{1,3})\]', 1)) as n from documents where text is not null and paper_id is not null)),
ent as (""" + _PAPERS["doc9_bibliography_entries"] + r"""), cnt as (select paper_id, number, count(*) as n_entries from ent where paper_id is not null group by all),
ment as (select m.*, coalesce(n_entries, 0) as n_entries, case when coalesce(n_entries, 0) = 1 then 'resolved' when n_entries > 1 then 'ambiguous' else 'unresolved' end as status from marks m left join cnt using (paper_id, number))"""

SQL: dict[str, str] = {
    "jon1_resolved_tables": _RESOLVED + "select table_id, resolved_id, case when n_fragments = 1 then 'single' when table_id = resolved_id then 'base' else 'continuation' end as role, n_fragments from resolved",
    "jon8_integrated_variables": _RESOLVED + "select resolved_id, v.table_id, variable_id, row_number() over (partition by resolved_id order by part, row_start, variable_id) - 1 as place from (select distinct table_id, variable_id, row_start from def_variable) v join resolved using (table_id)",
    "jon9_boundary_decisions": _RESOLVED + r""", iv as (select base_id as resolved_id, v.table_id, variable_id, row_number() over (partition by base_id order by part, row_start, variable_id) as place from (select distinct table_id, variable_id, row_start from def_variable) v join resolved using (table_id)),
      nm as (select variable_id, min(lower(trim(regexp_replace(variable_label, '\s+', ' ', 'g')))) as label from def_variable group by 1),
      lv as (select variable_id, count(distinct level_id) as n_levels, list(distinct lower(trim(regexp_replace(level_label, '\s+', ' ', 'g')))) as labels from def_level group by 1),
      told as (select iv.*, label, coalesce(n_levels, 0) as n_levels, labels from iv join nm using (variable_id) left join lv using (variable_id)),
      edge as (select *, lag(table_id) over w as pt, lag(label) over w as pl, lag(n_levels) over w as pn, lag(labels) over w as pls from told window w as (partition by resolved_id order by place))
      select resolved_id, table_id, variable_id, case when label = pl then 'repeated_head' when coalesce(list_contains(pls, label), false) then 'duplicate_level' when n_levels = 0 and pn > 0 then 'attach' else 'separate' end as decision from edge where pt <> table_id""",
    "jon10_note_anchors": _C + r""", t as (select table_id, 'cell' as scope, row_idx, col_idx, clean as text from c where not regexp_full_match(clean, '[*†‡§¶#]+') union all select distinct table_id, 'caption', -1, -1, caption from ext_table where caption is not null),
      m as (select table_id, scope, row_idx, col_idx, regexp_extract_all(regexp_replace(text, '[*†‡§¶#]([0-9])', '\1', 'g'), '[*†‡§¶#]') as signs from t)
      select table_id, scope, row_idx, col_idx, unnest(range(len(signs))) as ordinal, unnest(signs) as glyph, 'symbol' as kind from m""",
    "jon11_footer_lines": _FOOT + "select doc_id, cast(line_no as integer) as line_no from foot",
    "jon12_footers": _FOOT + "select paper_id, doc_id, cast(min(line_no) as integer) as first_line, count(*) as n_lines, sum(length(line)) as n_chars from foot where paper_id is not null group by all",
    "jon17_bibliography_mentions": "with " + _BRACKETS + " select paper_id, doc_id, number, n_entries, status from ment",
    "doc8_reference_evidence": _LINES + r""", k as (select l.doc_id, line_no, case when regexp_matches(line, '^(\[ *[0-9]{1,3} *\]|[0-9]{1,3}[.)]) +\S') then 'numbered' when trim(line) = '' then 'blank' else 'continuation' end as kind from lines l)
      select doc_id, kind, count(*) as n_lines, cast(min(line_no) as integer) as first_line from k group by all""",
    "doc11_bibliographies": "with " + _BRACKETS + ", o as (select paper_id, count(*) as n_entries, count(distinct number) as n_numbers from ent where paper_id is not null group by 1), s as (select paper_id, count(*) as n_mentions, count(*) filter (where status = 'resolved') as n_resolved, count(*) filter (where status = 'ambiguous') as n_ambiguous, count(*) filter (where status = 'unresolved') as n_unresolved from ment group by 1)"
    " select paper_id, coalesce(n_entries, 0) as n_entries, coalesce(n_numbers, 0) as n_numbers, coalesce(n_mentions, 0) as n_mentions, coalesce(n_resolved, 0) as n_resolved, coalesce(n_ambiguous, 0) as n_ambiguous, coalesce(n_unresolved, 0) as n_unresolved from o full join s using (paper_id)",
    "flt2_page_number_templates": _LINES + r""", pl as (select doc_id, paper_id, row_number() over (partition by paper_id order by doc_id) as page from (select distinct doc_id, paper_id from documents where text is not null and paper_id is not null)),
      tk as (select doc_id, trim(line) as line, regexp_extract_all(line, '[0-9]{1,6}') as tokens from lines where length(line) <= 80),
      ex as (select doc_id, regexp_replace(line, '[0-9]+', '<n>', 'g') as template, unnest(range(len(tokens))) as place_in_line, unnest(tokens) as token from tk),
      g as (select paper_id, template, place_in_line, count(distinct cast(token as integer) - page) as na, count(distinct page) as n_pages, min(cast(token as integer) - page) as apart from ex join pl using (doc_id) group by 1, 2, 3)
      select paper_id, template, place_in_line, n_pages, apart from g where na = 1 and n_pages >= 2""",
    "r11_plausibility": "with a as (" + _GRID["val7_count_percent_audit"] + ") select table_id, count(*) as n_judged, count(*) filter (where not agrees) as n_implausible, round(max(abs(percent_sum - expected)), 3) as worst from a group by 1",
}
_PARTS = (
    jon1_resolved_tables, jon8_integrated_variables, jon9_boundary_decisions, jon10_note_anchors, jon11_footer_lines, jon12_footers, jon14_definition_markers, jon17_bibliography_mentions, doc8_reference_evidence, doc11_bibliographies, flt2_page_number_templates, r11_plausibility,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _PARTS}
