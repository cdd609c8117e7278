"""Queries on contexts, inventories and column definitions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.operators import context as X
from tabloom.operators import continuation as C
from tabloom.operators import documents as D
from tabloom.operators import grid as G
from tabloom.operators import quality as Q
from tabloom.operators import texts as P
from tabloom.plans.grid_queries import _C, _cells, _roles, _rows
from tabloom.plans.note_queries import SQL as _NOTES
from tabloom.plans.note_queries import jon15_note_links
from tabloom.plans.paper_queries import SQL as _PAPERS
from tabloom.plans.paper_queries import _numbered
from tabloom.plans.quality_queries import SQL as _QUALITY
from tabloom.runtime import table


def txt6_sentence_windows(s: SparkSession, d: str) -> DataFrame:
    return X.sentence_windows(table(s, d, "documents"))


def txt6_reference_windows(s: SparkSession, d: str) -> DataFrame:
    return X.reference_windows(table(s, d, "documents"))


def txt10_table_context(s: SparkSession, d: str) -> DataFrame:
    papers = table(s, d, "ext_table").select("table_id", "paper_id").distinct()
    terms = table(s, d, "def_variable").join(papers, "table_id").select("paper_id", "table_id", F.lower(T.label_text(X.canonical_label(F.col("variable_label")))).alias("term")).where("term <> ''")
    return X.table_context(table(s, d, "documents"), terms)


def txt10_table_passages(s: SparkSession, d: str) -> DataFrame:
    """Passages of each table: those that name it, then those with its row, column and grouping terms."""
    tables = table(s, d, "ext_table")
    papers, roles = tables.select("table_id", "paper_id").distinct(), _roles(s, d)
    heads = F.regexp_replace("match_text", r" *\(? *n *= *[0-9,]+ *\)?", "")
    columns = roles.where("col_idx > 0 and role not in ('overall', 'p_value', 'smd')").select("table_id", heads.alias("term"))
    groups = Q.grouping(tables, roles).select("table_id", F.col("grouping_label").alias("term")).distinct()
    labels = table(s, d, "def_variable").select("table_id", X.canonical_label(F.col("variable_label")).alias("term"))
    terms = labels.unionByName(columns).unionByName(groups).join(papers, "table_id").select("paper_id", "table_id", F.lower(T.label_text(F.col("term"))).alias("term"))
    return X.table_passages(table(s, d, "documents"), terms, _numbered(s, d))


def txt11_variable_inventory(s: SparkSession, d: str) -> DataFrame:
    return X.variable_inventory(table(s, d, "def_variable"), table(s, d, "ext_table"), table(s, d, "documents"))


def txt11_variable_candidates(s: SparkSession, d: str) -> DataFrame:
    """Variables of each paper by all their mentions, with basis and scores."""
    variables, tables = table(s, d, "def_variable"), table(s, d, "ext_table")
    classes = P.mention_classes(variables, table(s, d, "def_level"), tables.select("table_id", "paper_id"), X.canonical_label(F.col("variable_label")))
    groupings = Q.grouping(tables, _roles(s, d)).select("table_id", "grouping_label").where("grouping_label is not null").distinct()
    return X.variable_candidates(variables, classes, tables, groupings, table(s, d, "documents"))


def r9_priority_candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates of at least 0.9 priority, per paper and basis."""
    return txt11_variable_candidates(s, d).where("priority_score >= 0.9").groupBy("paper_id", "promotion_basis").agg(F.count("*").alias("n_candidates"))


def txt13_canonical_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "def_variable").select("variable_label", X.canonical_label(F.col("variable_label")).alias("canonical")).distinct()


def ext6_duplicate_regions(s: SparkSession, d: str) -> DataFrame:
    """Per paper the tables with a box, and those that repeat another's region."""
    tables = table(s, d, "ext_table")
    again = X.duplicate_regions(tables, _cells(s, d))
    own = tables.where("positioned_evidence.canonical_bbox is not null").select("paper_id", "table_id").distinct()
    return own.join(again, "table_id", "left").groupBy("paper_id").agg(F.count("*").alias("n_tables"), F.count("kept_id").alias("n_repeated"))


def r10_row_coverage(s: SparkSession, d: str) -> DataFrame:
    rows = _rows(s, d)
    return X.row_coverage_audit(rows, G.body_starts(rows), table(s, d, "def_variable"), table(s, d, "def_level"))


def jon2_schema_decisions(s: SparkSession, d: str) -> DataFrame:
    """Decisions on whether a continuation's header fits its parent's, with the reason."""
    checks = C.column_checks(C.parents(_numbered(s, d)), C.comparison_labels(_roles(s, d))).where("parent_id is not null")
    missing = F.col("own_labels").isNull() | F.col("parent_labels").isNull()
    reason = F.when(missing, "no_header_schema").when(F.col("n_cols") != F.col("parent_cols"), "column_count_differs").when(F.col("own_labels") != F.col("parent_labels"), "labels_differ").otherwise("equal_comparison_labels")
    status = F.when(missing, "schema_missing").when(reason == "equal_comparison_labels", "match").otherwise("rejected")
    return checks.select(F.col("parent_id").alias("base_table_id"), F.col("table_id").alias("continuation_table_id"), status.alias("status"), reason.alias("reason"))


def col9_column_definitions(s: SparkSession, d: str) -> DataFrame:
    roles = _roles(s, d)
    parts = Q.grouping(table(s, d, "ext_table"), roles)
    return roles.join(parts, ["table_id", "col_idx"]).select("table_id", "col_idx", "header", T.slug(F.trim("header")).alias("column_name"), "role", "part", "level_order", "grouping_label", "denominator")


def r7_note_links(s: SparkSession, d: str) -> DataFrame:
    return jon15_note_links(s, d).groupBy("table_id", "glyph", "status").agg(F.count("*").alias("n_markers"))


def chk1_column_schema(s: SparkSession, d: str) -> DataFrame:
    """Per table whether its columns are numbered without gaps, and how many headers repeat or are blank."""
    roles = _roles(s, d)
    return roles.groupBy("table_id").agg(
        ((F.min("col_idx") == 0) & (F.max("col_idx") == F.count("*") - 1)).alias("contiguous"), (F.count("*") - F.countDistinct("header")).alias("n_repeated"), F.count_if(F.col("header") == "").alias("n_blank")
    )


_CANON_SQL = (
    f"trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace({T.sql_clean('variable_label')}, '[*†‡§¶#]+', '', 'g')), '{X.SUMMARY_SUFFIX}', '')), ' *[(\\[][^()\\[\\]]{{1,20}}[)\\]]$', ''), '[ ,;:]+$', ''))"
)
_TERM_SQL = f"lower(trim(regexp_replace({T.sql_clean(_CANON_SQL)}, '[^A-Za-z0-9]+', ' ', 'g')))"
_BODY_SQL = f"' ' || lower({T.sql_label('text')}) || ' '"
_CHECKED, _, _ = _PAPERS["jon6_column_checks"].rpartition("select *, cast(case")
SQL: dict[str, str] = {
    "txt6_sentence_windows": f"""with s as (select doc_id, string_split(regexp_replace({T.sql_clean('text')}, '([.?!]) +', '\\1' || chr(10), 'g'), chr(10)) as s from documents where text is not null),
      p as (select *, list_position(list_transform(s, lambda x: regexp_matches(x, '\\bTable +S?[0-9]+')), true) as at_ from s)
      select doc_id, s[at_] as sentence, array_to_string(s[greatest(at_ - 1, 1):least(at_ + 1, len(s))], ' ') as anchor from p where at_ > 0""",
    "txt10_table_context": f"""with t as (select distinct x.paper_id, v.table_id, {_TERM_SQL} as term from def_variable v join (select distinct table_id, paper_id from ext_table) x using (table_id)), own as (select * from t where term <> ''),
      sz as (select table_id, count(*) as n_terms from own group by 1), b as (select doc_id, paper_id, role_hint, {_BODY_SQL} as body from documents where text is not null and role_hint in ('methods_like', 'results_like')),
      h as (select o.table_id, b.doc_id, b.role_hint, count(*) as n_held from own o join b on b.paper_id = o.paper_id and contains(b.body, ' ' || o.term || ' ') where length(o.term) >= 3 group by all),
      r as (select table_id, doc_id, round(n_held / n_terms + case when role_hint = 'methods_like' then 0.2 else 0.1 end, 4) as score from h join sz using (table_id))
      select table_id, doc_id, score, row_number() over (partition by table_id order by score desc, doc_id) as rank from r qualify rank <= {X.PASSAGES}""",
    "txt11_variable_inventory": f"""with t as (select x.paper_id, {_TERM_SQL} as label, count(distinct v.table_id) as n_tables from def_variable v join (select distinct table_id, paper_id from ext_table) x using (table_id) where variable_label is not null group by all),
      k as (select * from t where label <> ''), b as (select doc_id, paper_id, {_BODY_SQL} as body from documents where text is not null),
      h as (select k.paper_id, k.label, count(distinct doc_id) as n_docs from k join b on b.paper_id = k.paper_id and contains(b.body, ' ' || k.label || ' ') where length(label) >= 3 group by all)
      select k.paper_id, k.label, n_tables, coalesce(n_docs, 0) as n_docs, n_tables >= 2 or coalesce(n_docs, 0) > 0 as promoted from k left join h using (paper_id, label)""",
    "txt13_canonical_labels": f"select distinct variable_label, {_CANON_SQL} as canonical from def_variable",
    "ext6_duplicate_regions": _C + """, g as (select table_id, string_agg(row_idx || chr(1) || col_idx || chr(1) || clean, chr(2) order by row_idx, col_idx) as content from c group by table_id),
      o as (select paper_id, page_num, table_id, min_by(positioned_evidence.canonical_bbox, loaded_at) as b from ext_table where positioned_evidence.canonical_bbox is not null and page_num is not null group by 1, 2, 3),
      s as (select o.*, content, (b.x1 - b.x0) * (b.y1 - b.y0) as size from o join g using (table_id)),
      p as (select a.table_id, min_by(z.table_id, {'s': z.size, 'i': z.table_id}) as kept_id from s a join s z on a.paper_id = z.paper_id and a.page_num = z.page_num and z.content = a.content and (z.size < a.size or (z.size = a.size and z.table_id < a.table_id))
        where (least(a.b.x1, z.b.x1) - greatest(a.b.x0, z.b.x0)) > 0 and (least(a.b.y1, z.b.y1) - greatest(a.b.y0, z.b.y0)) > 0
        and (least(a.b.x1, z.b.x1) - greatest(a.b.x0, z.b.x0)) * (least(a.b.y1, z.b.y1) - greatest(a.b.y0, z.b.y0)) >= 0.8 * least(a.size, z.size) group by 1)
      select paper_id, count(*) as n_tables, count(kept_id) as n_repeated from (select distinct paper_id, table_id from ext_table where positioned_evidence.canonical_bbox is not null) left join p using (table_id) group by 1""",
    "r10_row_coverage": _C + """, b as (select r.table_id, r.row_idx from rows r join starts using (table_id) where row_idx >= body_start), f as (select distinct table_id, row_start as row_idx from def_variable union select distinct table_id, row_idx from def_level)
      select coalesce(b.table_id, f.table_id) as table_id, case when b.table_id is not null and f.table_id is not null then 'both' when b.table_id is not null then 'row_only' else 'definition_only' end as status, count(*) as n_rows
      from b full join f on b.table_id = f.table_id and b.row_idx = f.row_idx group by all""",
    "jon2_schema_decisions": _CHECKED.rstrip().removesuffix(")") + """), full_ as (select l.*, o.labels as own, p.labels as theirs from linked l left join labels o on o.table_id = l.table_id left join labels p on p.table_id = l.parent_id where l.parent_id is not null)
      select parent_id as base_table_id, table_id as continuation_table_id, case when own is null or theirs is null then 'schema_missing' when n_cols = parent_cols and own = theirs then 'match' else 'rejected' end as status,
      case when own is null or theirs is null then 'no_header_schema' when n_cols <> parent_cols then 'column_count_differs' when own <> theirs then 'labels_differ' else 'equal_comparison_labels' end as reason from full_""",
    "col9_column_definitions": "with parts as (" + _QUALITY["col8_grouping"] + "), col as (" + _C + " select table_id, col_idx, header, role, denominator from roles) select col.table_id, col.col_idx, header, case when regexp_replace(regexp_replace(lower(trim(header)), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') = '' then 'row' else regexp_replace(regexp_replace(lower(trim(header)), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') end as column_name, role, part, level_order, grouping_label, denominator from col join parts using (table_id, col_idx)",
    "r7_note_links": "with l as (" + _NOTES["jon15_note_links"] + ") select table_id, glyph, status, count(*) as n_markers from l group by all",
    "chk1_column_schema": _C + "select table_id, min(col_idx) = 0 and max(col_idx) = count(*) - 1 as contiguous, count(*) - count(distinct header) as n_repeated, count(*) filter (where header = '') as n_blank from roles group by 1",
}
QUERIES = {name: globals()[name] for name in SQL} | {f.__name__: f for f in (txt6_reference_windows, txt10_table_passages, txt11_variable_candidates, r9_priority_candidates)}
