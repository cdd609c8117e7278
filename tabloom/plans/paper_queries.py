"""Queries on continuations, visuals and documents of papers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.operators import continuation as C
from tabloom.operators import documents as D
from tabloom.operators import visuals as V
from tabloom.plans.grid_queries import _C, _cells, _roles, _rows
from tabloom.operators import grid as G
from tabloom.runtime import table


def _numbered(s: SparkSession, d: str) -> DataFrame:
    return C.numbered_tables(table(s, d, "ext_table"))


def jon5_previous_table(s: SparkSession, d: str) -> DataFrame:
    linked = C.parents(_numbered(s, d))
    return linked.select("paper_id", "table_id", "parent_id", "rule")


def jon6_column_checks(s: SparkSession, d: str) -> DataFrame:
    checks = C.column_checks(C.parents(_numbered(s, d)), C.comparison_labels(_roles(s, d)))
    return checks.select("table_id", "parent_id", "rule", "check", "confidence")


def jon3_continuation_groups(s: SparkSession, d: str) -> DataFrame:
    return C.continuation_groups(_numbered(s, d)).select("paper_id", "table_id", "number", "base_id", "part")


def jon4_merged_rows(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    return C.merged_rows(C.continuation_groups(_numbered(s, d)), rows, G.body_starts(rows))


def txt2_visual_labels(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "visual_ref").select("matched_text").distinct()
    return labels.select("matched_text", T.visual_kind(F.col("matched_text")).alias("kind"), T.visual_number(F.col("matched_text")).alias("number"))


def txt3_resolved_references(s: SparkSession, d: str) -> DataFrame:
    return V.resolve_references(table(s, d, "visual_ref"), table(s, d, "visual"))


def txt4_visual_checks(s: SparkSession, d: str) -> DataFrame:
    return V.reference_checks(table(s, d, "visual"), table(s, d, "visual_ref"))


def agg7_reference_style(s: SparkSession, d: str) -> DataFrame:
    return V.dominant(table(s, d, "visual_ref").select("paper_id", "reference_kind", "reference_id", "reference_label").distinct(), ["paper_id", "reference_kind"], "reference_label")


def doc14_sections(s: SparkSession, d: str) -> DataFrame:
    return D.sections(table(s, d, "documents"))


def txt1_table_mentions(s: SparkSession, d: str) -> DataFrame:
    return D.table_mentions(table(s, d, "documents"))


def doc9_bibliography_entries(s: SparkSession, d: str) -> DataFrame:
    return D.bibliography_entries(table(s, d, "documents"))


def doc12_bibliography_report(s: SparkSession, d: str) -> DataFrame:
    return D.bibliography_report(D.bibliography_entries(table(s, d, "documents")))


def flt3_furniture(s: SparkSession, d: str) -> DataFrame:
    return D.furniture(table(s, d, "documents"))


def flt5_unmasked_lines(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return D.unmasked_lines(docs, D.furniture(docs))


def txt14_term_documents(s: SparkSession, d: str) -> DataFrame:
    tables = table(s, d, "ext_table").select("table_id", "paper_id").distinct()
    terms = table(s, d, "def_variable").join(tables, "table_id").select("paper_id", F.col("variable_label").alias("term"))
    return D.term_documents(table(s, d, "documents"), terms)


_LABEL = T.VISUAL_LABEL.removeprefix("(?i)")
_NUM = f"""
with one as (select paper_id, table_id, min(page_num) as page_num, min(caption) as caption, max(n_cols) as n_cols from ext_table group by all),
numbered as (select *, row_number() over (partition by paper_id order by page_num nulls first, table_id) as idx,
  nullif(upper(regexp_extract(caption, '{C.NUMBER}', 1)), '') as number, coalesce(regexp_matches(caption, '{C.CONTINUED}'), false) as continued from one),
linked as (
  select n.paper_id, n.table_id, n.n_cols, b.table_id as parent_id, b.n_cols as parent_cols, case when b.table_id is null then 'none' else 'explicit' end as rule
  from numbered n left join numbered b on b.paper_id is not distinct from n.paper_id and b.number = n.number
    and b.idx = (select max(x.idx) from numbered x where x.paper_id is not distinct from n.paper_id and x.number = n.number and x.idx < n.idx)
  where n.number is not null and n.continued
  union all
  select n.paper_id, n.table_id, n.n_cols, b.table_id, b.n_cols, 'inferred' from numbered n join numbered b on b.paper_id = n.paper_id and b.page_num = n.page_num - 1
  where n.caption is null and b.idx = (select max(x.idx) from numbered x where x.paper_id = n.paper_id and x.page_num = n.page_num - 1)),
grouped as (
  select *, sum(case when continued then 0 else 1 end) over (partition by paper_id, number order by idx) as run from numbered where number is not null),
based as (select *, first_value(table_id) over (partition by paper_id, number, run order by idx) as base_id, row_number() over (partition by paper_id, number, run order by idx) as part from grouped)
"""
_AND_C = ", " + _C.strip().removeprefix("with ")
_LINES = "with raw as (select doc_id, paper_id, string_split(text, chr(10)) as parts from documents where text is not null), lines as (select doc_id, paper_id, unnest(range(len(parts))) as line_no, unnest(parts) as line from raw)"
_TEMPLATE = f"regexp_replace(trim(regexp_replace(line, '{T.SPACE}+', ' ', 'g')), '[0-9]+', '<n>', 'g')"
_ROLE = "case when heading is null then null " + " ".join("when " + " or ".join(f"contains(lower(heading), '{h}')" for h in hints) + f" then '{role}'" for role, hints in D.SECTION_HINTS) + " else 'other' end"
_ENTRIES = _LINES + f""", marked as (select *, regexp_matches(line, '{D.ENTRY}') as starts, trim(line) = '' as blank from lines),
runs as (select *, sum(case when starts or blank then 1 else 0 end) over (partition by doc_id order by line_no) as entry from marked),
whole as (select doc_id, paper_id, entry, bool_or(starts) as starts, min(line_no) as line_no, count(*) as n_lines, string_agg(line, ' ' order by line_no) as body from runs where not blank group by all),
entries as (select doc_id, paper_id, cast(line_no as integer) as line_no, try_cast(coalesce(nullif(regexp_extract(body, '{D.ENTRY}', 1), ''), nullif(regexp_extract(body, '{D.ENTRY}', 2), '')) as integer) as number, n_lines,
  trim(regexp_replace(regexp_extract(body, '{D.ENTRY}', 3), '{T.SPACE}+', ' ', 'g')) as entry_text from whole where starts)
"""
_FURNITURE = _LINES + f", shown as (select *, {_TEMPLATE} as template from lines), marks as (select paper_id, template, count(distinct doc_id) as n_docs, count(*) as n_lines from shown where template <> '' and paper_id is not null group by all having count(distinct doc_id) >= 3)"

SQL: dict[str, str] = {
    "jon5_previous_table": _NUM + "select paper_id, table_id, parent_id, rule from linked",
    "jon6_column_checks": _NUM + _AND_C + """, labels as (select table_id, string_agg(trim(regexp_replace(match_text, ' *\\(? *n *= *[0-9,]+ *\\)?', '', 'g')), ' | ' order by col_idx) as labels from roles where col_idx > 0 group by table_id),
      checked as (select l.table_id, l.parent_id, l.rule, case when l.parent_id is null then 'no_parent' when o.labels is null and p.labels is null then 'missing_both' when p.labels is null then 'missing_base'
        when o.labels is null then 'missing_continuation' when l.n_cols = l.parent_cols and o.labels = p.labels then 'match' else 'mismatch' end as "check"
        from linked l left join labels o on o.table_id = l.table_id left join labels p on p.table_id = l.parent_id)
      select *, cast(case "check" when 'match' then 0.95 when 'mismatch' then 0.2 else 0 end as double) as confidence from checked""",
    "jon3_continuation_groups": _NUM + "select paper_id, table_id, number, base_id, part from based",
    "jon4_merged_rows": _NUM + _AND_C + """, kept as (select b.base_id, b.part, r.table_id, r.row_idx from rows r join based b using (table_id) left join starts s on s.table_id = r.table_id where b.part = 1 or r.row_idx >= s.body_start)
      select base_id, table_id, row_idx, row_number() over (partition by base_id order by part, row_idx) - 1 as merged_idx from kept""",
    "txt2_visual_labels": f"""with l as (select distinct matched_text, {T.sql_clean('matched_text')} as c from visual_ref)
      select matched_text, case when lower(regexp_extract(c, '(?i){_LABEL}', 1)) = '' then null when lower(regexp_extract(c, '(?i){_LABEL}', 1)) like 'table%' then 'table' when c is null then null else 'figure' end as kind,
      nullif(upper(regexp_extract(c, '(?i){_LABEL}', 2)), '') as number from l""",
    "txt3_resolved_references": """with k as (select paper_id, visual_kind, upper(visual_number) as number, count(distinct visual_id) as n_candidates, min(visual_id) as candidate from visual where visual_number is not null group by all),
      r as (select distinct reference_id, paper_id, reference_kind, upper(reference_number) as number, role_hint from visual_ref)
      select r.reference_id, r.paper_id, coalesce(n_candidates, 0) as n_candidates, case when n_candidates = 1 then candidate end as resolved_id,
      case when n_candidates = 1 then 'resolved' when n_candidates > 1 then 'ambiguous' when role_hint = 'references_like' then 'external_or_bibliographic' else 'unresolved' end as status
      from r left join k on k.paper_id = r.paper_id and k.visual_kind = r.reference_kind and k.number = r.number""",
    "txt4_visual_checks": """with c as (select resolved_visual_id as visual_id, count(distinct reference_id) as n from visual_ref where resolution_status = 'resolved' and resolved_visual_id is not null group by 1),
      v as (select visual_id, bool_or(coalesce(regexp_matches(caption, '(?i)\\b(?:supplementary|supplemental|supplement|appendix)\\b'), false) or coalesce(upper(visual_number) like 'S%', false)) as exempt from visual group by 1)
      select v.visual_id, coalesce(n, 0) as n_references, case when exempt then 'supplementary_exempt' when coalesce(n, 0) > 0 then 'referenced_in_text' else 'no_text_reference' end as status from v left join c using (visual_id)""",
    "agg7_reference_style": """with u as (select distinct paper_id, reference_kind, reference_id, reference_label from visual_ref where reference_label is not null),
      c as (select paper_id, reference_kind, reference_label, count(*) as n from u group by all),
      r as (select *, sum(n) over (partition by paper_id, reference_kind) as total, row_number() over (partition by paper_id, reference_kind order by n desc, reference_label) as rank from c)
      select paper_id, reference_kind, reference_label as top_value, n, cast(total as bigint) as total, case when n / total < 0.7 then 'mixed' else reference_label end as style from r where rank = 1""",
    "doc14_sections": f"with h as (select doc_id, trim(string_split(text, chr(10))[1]) as first from documents where text is not null), g as (select doc_id, case when length(first) <= 40 and regexp_full_match(first, '[A-Za-z][A-Za-z ]*') then first end as heading from h) select doc_id, heading, {_ROLE} as role from g",
    "txt1_table_mentions": _LINES + """, m as (select *, unnest(regexp_extract_all(line, '\\bTable +(S?[0-9]+)', 1)) as number from lines)
      select distinct doc_id, paper_id, cast(line_no as integer) as line_no, number, case when regexp_matches(line, '^Table +S?[0-9]+\\. ') and regexp_extract(line, '^Table +(S?[0-9]+)', 1) = number
      then case when regexp_matches(line, '\\(continued\\) *$') then 'continuation' else 'caption' end else 'prose' end as kind from m""",
    "doc9_bibliography_entries": _ENTRIES + "select *, row_number() over (partition by paper_id, number order by doc_id, line_no) as suffix from entries where number is not null",
    "doc12_bibliography_report": _ENTRIES + "select paper_id, count(*) as n_entries, count(distinct number) as n_numbers, min(number) as min_number, max(number) as max_number, count(*) filter (where n_lines >= 12 or length(entry_text) >= 1800) as n_long, max(number) - min(number) + 1 - count(distinct number) as n_missing from entries where number is not null group by paper_id",
    "flt3_furniture": _FURNITURE + " select * from marks",
    "flt5_unmasked_lines": _FURNITURE + " select doc_id, count(*) as n_lines from shown s where template <> '' and not exists (select 1 from marks m where m.paper_id = s.paper_id and m.template = s.template) group by doc_id",
    "txt14_term_documents": f"""with t as (select distinct x.paper_id, lower({T.sql_label('v.variable_label')}) as term from def_variable v join (select distinct table_id, paper_id from ext_table) x using (table_id)),
      k as (select * from t where length(term) >= 3),
      b as (select doc_id, paper_id, ' ' || lower({T.sql_label('text')}) || ' ' as body from documents where text is not null)
      select k.paper_id, k.term, count(distinct doc_id) as n_docs from k join b on b.paper_id = k.paper_id and contains(b.body, ' ' || k.term || ' ') group by all""",
}
QUERIES = {name: globals()[name] for name in SQL}
