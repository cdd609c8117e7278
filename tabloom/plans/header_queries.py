"""Queries on headers, captions, paragraphs, visuals and mentions, and their SQL written from the rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.functions import values as V
from tabloom.operators import grid as G
from tabloom.operators import headers as H
from tabloom.operators import texts as P
from tabloom.plans import value_sql as VQ
from tabloom.plans.grid_queries import _C, _cells, _grid
from tabloom.runtime import checkpoint, table


def nrm9_header_split(s: SparkSession, d: str) -> DataFrame:
    _, views, starts = _grid(s, d)
    return H.header_split(views, starts)


def _schema(s: SparkSession, d: str) -> DataFrame:
    cells, views, starts = _grid(s, d)
    return H.header_schema(cells, H.header_split(views, starts))


def col1_header_schema(s: SparkSession, d: str) -> DataFrame:
    return _schema(s, d)


def col2_header_paths(s: SparkSession, d: str) -> DataFrame:
    return H.header_paths(checkpoint(_schema(s, d)))


def col7_header_levels(s: SparkSession, d: str) -> DataFrame:
    return H.header_levels(_schema(s, d)).select("table_id", "row_idx", "level", "col_start", "col_end")


def r5_header_frame(s: SparkSession, d: str) -> DataFrame:
    """Nodes of header trees per table and kind."""
    return H.header_levels(_schema(s, d)).groupBy("table_id", "kind", "level").agg(F.count("*").alias("n_nodes"), F.sum(F.col("col_end") - F.col("col_start") + 1).alias("n_columns"))


def ext4_caption_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents that are captions of tables, with number and whether they go on from another page."""
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    number, continued = H.caption_parts(F.trim("line"))
    return lines.select("doc_id", "line_no", number.alias("number"), continued.alias("is_continuation")).where("number is not null")


def ext5_page_captions(s: SparkSession, d: str) -> DataFrame:
    """Tables of a page with their own caption or that of the page's caption lines in their place."""
    tables = table(s, d, "ext_table").where("page_num is not null").groupBy("paper_id", "page_num", "table_id").agg(F.min("caption").alias("caption"))
    page = F.concat_ws("#", "paper_id", "page_num")
    own = tables.select(page.alias("page"), F.col("table_id").alias("place"), "table_id", "caption")
    seen = table(s, d, "visual").where("visual_kind = 'table' and caption is not null and page_num is not null").groupBy("paper_id", "page_num", "visual_id").agg(F.min("caption").alias("caption"))
    return H.aligned_captions(own, seen.select(page.alias("page"), F.col("visual_id").alias("place"), "caption"))


def ext22_canonical_boxes(s: SparkSession, d: str) -> DataFrame:
    """Cells of every third page read as text that runs up it, every third as text that runs down."""
    cells = table(s, d, "ext_cell").where("bbox is not null and page_num is not null").select("table_id", "row_idx", "col_idx", "page_num", "bbox").distinct()
    frames = cells.groupBy("table_id").agg(F.struct(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1")).alias("frame"))
    way = F.when(F.col("page_num") % 3 == 1, "vertical_text_up").when(F.col("page_num") % 3 == 2, "vertical_text_down").otherwise("horizontal")
    box = H.canonical_box(F.col("bbox"), way, F.col("frame"))
    turned = cells.join(frames, "table_id").select("table_id", "row_idx", "col_idx", box.alias("box"))
    return turned.select("table_id", "row_idx", "col_idx", *[F.round(f"box.{n}", 4).alias(n) for n in ("x0", "y0", "x1", "y1")]).distinct()


def flt12_trailing_notes(s: SparkSession, d: str) -> DataFrame:
    """Rows at the end of tables, the last two of each read as if they were the whole, that only say a table goes on."""
    return H.trailing_notes(_cells(s, d))


def flt13_prose_grids(s: SparkSession, d: str) -> DataFrame:
    return H.prose_grids(_cells(s, d))


def agg5_text_only_grids(s: SparkSession, d: str) -> DataFrame:
    cells, views, starts = _grid(s, d)
    family = cells.withColumn("family", V.value_family(F.col("clean")))
    tables = table(s, d, "ext_table").groupBy("table_id").agg((F.max(F.length(F.trim("caption"))) > 0).alias("has_signal"))
    return H.text_only_grids(family, views, starts, tables.withColumn("table_family", F.lit("unknown")), table(s, d, "def_variable"))


def chk4_profiles(s: SparkSession, d: str) -> DataFrame:
    """Tables whose profile would lack an id."""
    tables = table(s, d, "ext_table")
    return tables.agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.trim("table_id"), F.lit("")) == "").alias("n_without_id"))


def txt5_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return P.paragraphs(table(s, d, "documents")).select("doc_id", "paragraph_index", F.length("paragraph").alias("n_chars"))


def txt7_table_visuals(s: SparkSession, d: str) -> DataFrame:
    return P.table_visuals(table(s, d, "ext_table"))


def txt8_figure_visuals(s: SparkSession, d: str) -> DataFrame:
    return P.figure_visuals(table(s, d, "documents"))


def txt9_visual_inventory(s: SparkSession, d: str) -> DataFrame:
    return P.visual_inventory(table(s, d, "ext_table"), table(s, d, "documents"))


def txt12_mention_classes(s: SparkSession, d: str) -> DataFrame:
    return P.mention_classes(table(s, d, "def_variable"), table(s, d, "def_level"), table(s, d, "ext_table").select("table_id", "paper_id"), F.col("variable_label"))


def txt15_labels_in_order(s: SparkSession, d: str) -> DataFrame:
    """Variable labels of each table once, in order of their rows."""
    found = P.in_order(table(s, d, "def_variable").select("table_id", "variable_label", "row_start", "variable_id"), ["table_id"], "variable_label", ["row_start", "variable_id"])
    return found.select("table_id", F.array_join("values", "|").alias("labels"))


def jon7_uncaptioned_continuations(s: SparkSession, d: str) -> DataFrame:
    """Tables without a caption and the latest numbered table of their paper on the page before."""
    tables = table(s, d, "ext_table").groupBy("paper_id", "table_id").agg(F.min("caption").alias("caption"), F.min("page_num").alias("page_num"), F.max("n_cols").alias("n_cols"))
    numbered = tables.select("paper_id", T.visual_number(F.col("caption")).alias("number"), F.col("table_id").alias("prior_id"), (F.col("page_num") + 1).alias("page_num")).where("number is not null and page_num is not null")
    open_tables = tables.where("coalesce(trim(caption), '') = '' and n_cols >= 2 and page_num is not null").select("paper_id", "table_id", "page_num")
    latest = open_tables.join(numbered, ["paper_id", "page_num"]).where("prior_id < table_id").groupBy("table_id").agg(F.max(F.struct("prior_id", "number")).alias("prior"))
    return latest.select("table_id", "prior.prior_id", "prior.number")


def jon16_unit_marks(s: SparkSession, d: str) -> DataFrame:
    """Labels that end in a number, read as raised: whether it belongs to a unit or an exponent."""
    labels = table(s, d, "def_variable").select("variable_label").where("variable_label is not null").distinct()
    digit, before = F.regexp_extract("variable_label", r"^(?s)(.*?)([0-9])$", 2), F.regexp_extract("variable_label", r"^(?s)(.*?)([0-9])$", 1)
    return labels.where(digit != "").select("variable_label", P.is_unit_mark(digit, F.lit("superscript"), before).alias("is_unit"))


def val8_parsed_tables(s: SparkSession, d: str) -> DataFrame:
    """Tables with numbers of variables, columns and parsed values, and columns by the five roles."""
    cells, views, starts = _grid(s, d)
    roles = G.column_roles(G.header_labels(cells, starts))
    role = F.when(F.col("role").isin("group", "overall", "p_value", "unknown"), F.col("role")).when(F.col("role") == "comparison_group", "group").when(F.col("role") == "smd", "statistic").otherwise("unknown")
    columns = roles.withColumn("role5", role).groupBy("table_id").agg(F.count("*").alias("n_columns"), *[F.count_if(F.col("role5") == r).alias(f"n_{r}") for r in ("group", "overall", "p_value", "statistic", "unknown")])
    variables = table(s, d, "def_variable").groupBy("table_id").agg(F.countDistinct("variable_id").alias("n_variables"))
    records = G.value_records(G.parsed_cells(cells, starts), table(s, d, "def_variable"), table(s, d, "def_level"), roles).groupBy("table_id").agg(F.count("*").alias("n_values"))
    return columns.join(variables, "table_id", "left").join(records, "table_id", "left").fillna(0, ["n_variables", "n_values"])


def val9_definition_match(s: SparkSession, d: str) -> DataFrame:
    """Tables and definitions that go together one to one: those without a partner on either side."""
    grids, defined = table(s, d, "ext_cell").select("table_id").distinct().withColumn("has_grid", F.lit(1)), table(s, d, "def_variable").select("table_id").distinct().withColumn("has_definition", F.lit(1))
    both = grids.join(defined, "table_id", "full")
    return both.select("table_id", F.coalesce("has_grid", F.lit(0)).alias("has_grid"), F.coalesce("has_definition", F.lit(0)).alias("has_definition")).where("has_grid + has_definition < 2")


def r6_table_inventory(s: SparkSession, d: str) -> DataFrame:
    """Tables of each paper with number, page, size and whether they have evidence and a caption."""
    t = table(s, d, "ext_table").groupBy("paper_id", "table_id").agg(F.min("caption").alias("caption"), F.min("page_num").alias("page_num"), F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.max(F.col("positioned_evidence").isNotNull().cast("int")).alias("has_evidence"))
    return t.select("paper_id", "table_id", T.visual_number(F.col("caption")).alias("number"), "page_num", "n_rows", "n_cols", "has_evidence", F.col("caption").isNotNull().cast("int").alias("has_caption"))


_NRM9 = """, wide as (select r.*, s.body_start, max(n_cols) over (partition by table_id) as w from rows r left join starts s using (table_id)),
hh as (select *, body_start is not null and row_idx < body_start and n_filled > 0 as is_head from wide),
hf as (select *, coalesce(max(n_filled) over (partition by table_id, is_head order by row_idx rows between 1 following and unbounded following) >= greatest(3, w // 2), false) and label <> '' and n_filled <= 2 as leads from hh),
split as (select table_id, row_idx, case when body_start is null then case when n_filled > 0 then 'body' else 'blank' end when row_idx >= body_start then 'body' when not is_head then 'blank'
    when bool_and(leads) over (partition by table_id, is_head order by row_idx) then 'preamble' else 'header' end as role,
    case when body_start is null then 'unclassified' else 'value_anchor' end as source from hf)
"""
_COL1 = _NRM9 + """, filled as (
  select c.table_id, c.row_idx, c.col_idx, c.clean, max(c.col_idx) over (partition by c.table_id) as last_col from c join split using (table_id, row_idx) where role = 'header'),
spans as (select *, coalesce(lead(col_idx) over (partition by table_id, row_idx order by col_idx) - 1, last_col) as until, max(row_idx) over (partition by table_id, col_idx) as low from filled where clean <> ''),
nodes as (select table_id, case when row_idx = low then 'leaf' else 'group' end as kind, row_idx, col_idx as col_start,
  cast(case when row_idx = low then col_idx when col_idx = 0 then 0 else until end as integer) as col_end, clean as label from spans)
"""
_COL7 = _COL1 + ", levels as (select *, dense_rank() over (partition by table_id order by row_idx) as level from nodes)"
_TABLES = r"""with t as (select paper_id, table_id, upper(nullif(regexp_extract(regexp_replace(trim(caption), '\s+', ' ', 'g'), '(?i)\btables?\.? *([sS]?[0-9]+[A-Za-z]?)\b', 1), '')) as number,
  regexp_matches(caption, '(?i)\bfig') as has_figure from ext_table),
tv as (select paper_id, 'table' as visual_kind, number, min(table_id) as source, count(distinct table_id) as n_sources from t where number is not null group by all)"""
_FIGURES = r"""fl as (select paper_id, doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[.;]\s)((?:Fig\.?|Figure)\s*[A-Za-z]?\d+[A-Za-z]?)\b(?:[.:]\s*|\s+(?-i:[A-Z]))', 1)) as label from documents where paper_id is not null and text is not null),
fv as (select paper_id, 'figure' as visual_kind, upper(regexp_extract(label, '([A-Za-z]?\d+[A-Za-z]?)$', 1)) as number, cast(min(doc_id) as varchar) as source, count(distinct doc_id) as n_sources from fl group by all)"""
_VALUE = r"regexp_full_match(clean, '([<>]=?\s*)?[\d.,/%()\-+±\s]+') and regexp_matches(clean, '[0-9]')"

SQL: dict[str, str] = {
    "nrm9_header_split": _C + _NRM9 + "select * from split",
    "col1_header_schema": _C + _COL1 + "select * from nodes",
    "col2_header_paths": _C + _COL1 + """select l.table_id, l.col_start as col_idx, count(g.label) as n_groups, coalesce(string_agg(g.label, ' > ' order by g.row_idx) || ' > ', '') || l.label as path
    from nodes l left join nodes g on g.table_id = l.table_id and g.kind = 'group' and g.row_idx < l.row_idx and l.col_start between g.col_start and g.col_end where l.kind = 'leaf' group by l.table_id, l.col_start, l.label, l.row_idx""",
    "col7_header_levels": _C + _COL7 + "select table_id, row_idx, level, col_start, col_end from levels",
    "r5_header_frame": _C + _COL7 + "select table_id, kind, level, count(*) as n_nodes, sum(col_end - col_start + 1) as n_columns from levels group by all",
    "ext4_caption_lines": r"""with p as (select doc_id, string_split(text, chr(10)) as parts from documents where text is not null),
    l as (select doc_id, unnest(range(len(parts))) as line_no, trim(unnest(parts)) as line from p),
    m as (select doc_id, line_no, regexp_extract(line, '(?i)^\s*table\s*([A-Za-z0-9.]*\d[A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*)\b(?:\s*[:.])?', 1) as number,
      trim(regexp_replace(line, '(?i)^\s*table\s*([A-Za-z0-9.]*\d[A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*)\b(?:\s*[:.])?', '')) as rest from l),
    k as (select *, regexp_matches(rest, '(?i)^(\(\s*continued\s*\)|continued(\s|\b|$))') as is_continuation from m where number <> '')
    select doc_id, cast(line_no as integer) as line_no, number, is_continuation from k where is_continuation or not regexp_matches(rest,
      '(?i)^(displays?|shows?|presents?|describes?|illustrates?|reports?|lists?|contains?|summarizes?|compares?|demonstrates?|highlights?|details?|examines?|provides?|gives?|outlines?|depicts?|indicates?|reveals?)\b')""",
    "ext5_page_captions": """with t as (select paper_id, page_num, table_id, min(caption) as caption from ext_table where page_num is not null group by all),
    r as (select *, row_number() over (partition by paper_id, page_num order by table_id) - 1 as rank, count(*) over (partition by paper_id, page_num) as n from t),
    v as (select paper_id, page_num, visual_id, min(caption) as caption from visual where visual_kind = 'table' and caption is not null and page_num is not null group by all),
    q as (select *, row_number() over (partition by paper_id, page_num order by visual_id) - 1 as at, count(*) over (partition by paper_id, page_num) as k from v)
    select concat_ws('#', r.paper_id, r.page_num) as page, table_id, coalesce(nullif(r.caption, ''), q.caption) as caption
    from r left join (select distinct paper_id, page_num, k from q) z using (paper_id, page_num) left join q on q.paper_id = r.paper_id and q.page_num = r.page_num and q.at = r.rank - greatest(r.n - coalesce(z.k, 0), 0)""",
    "ext22_canonical_boxes": """with c as (select distinct table_id, row_idx, col_idx, page_num, bbox.x0 as a, bbox.y0 as b, bbox.x1 as c, bbox.y1 as d from ext_cell where bbox is not null and page_num is not null),
    f as (select table_id, min(a) as fa, min(b) as fb, max(c) as fc, max(d) as fd from c group by 1)
    select distinct table_id, row_idx, col_idx, round(case page_num % 3 when 1 then fd - d when 2 then b - fb else a end, 4) as x0, round(case page_num % 3 when 1 then a - fa when 2 then fc - c else b end, 4) as y0,
      round(case page_num % 3 when 1 then fd - b when 2 then d - fb else c end, 4) as x1, round(case page_num % 3 when 1 then c - fa when 2 then fc - a else d end, 4) as y1 from c join f using (table_id)""",
    "flt12_trailing_notes": _C + f""", l as (select table_id, row_idx, count(*) filter (where clean <> '') as n_filled, count(*) filter (where col_idx > 0 and {_VALUE}) as n_values, string_agg(clean, ' ' order by col_idx) filter (where clean <> '') as line from c group by all),
    n as (select *, n_filled between 1 and 3 and n_values = 0 and (regexp_matches(line, '(?i)^\\s*(table\\s+[A-Za-z0-9.]*\\d[A-Za-z0-9.]*\\s*)?\\(?\\s*(cont\\.?|continued\\.?)\\s*\\)?\\s*$')
      or regexp_matches(line, '(?i)\\b(cont\\.?|continued|continues?)\\b.*\\b(previous|next)\\s+page\\b') or regexp_matches(line, '(?i)\\b(previous|next)\\s+page\\b.*\\b(cont\\.?|continued|continues?)\\b')) as note from l),
    s as (select *, bool_and(coalesce(note, false)) over (partition by table_id order by row_idx desc) as suffix from n), g as (select *, lag(suffix) over (partition by table_id order by row_idx desc) as below from s)
    select table_id, min(row_idx) as start_row, count(*) as n_removed from g where suffix or (coalesce(below, false) and n_filled = 0) group by table_id""",
    "flt13_prose_grids": _C + f""", p as (select table_id, count(distinct row_idx) as n_rows, max(col_idx) + 1 as n_cols, count(*) filter (where col_idx > 0 and clean <> '') as n_value_cells,
      count(*) filter (where col_idx > 0 and clean <> '' and (len(regexp_extract_all(clean, '[A-Za-z]{{2,}}')) >= 3 or (len(regexp_extract_all(clean, '[A-Za-z]{{2,}}')) >= 2 and regexp_matches(clean, '[.!?;:]')))) as n_prose,
      count(*) filter (where col_idx > 0 and clean <> '' and {_VALUE}) as n_compact from c group by table_id)
    select table_id, n_value_cells, n_prose, n_compact, n_rows >= 4 and n_cols >= 3 and n_value_cells >= 6 and n_prose / n_value_cells >= 0.35 and n_compact / n_value_cells < 0.5 as is_prose from p""",
    "agg5_text_only_grids": _C + f""", f as (select *, {VQ.family('clean')} as family from c),
    b as (select table_id, count(*) filter (where case when s.body_start is null then n_filled > 0 else row_idx >= s.body_start end) as n_body, max(n_cols) as n_cols from rows left join starts s using (table_id) group by table_id),
    k as (select table_id, count(*) as n_cells, count(*) filter (where col_idx > 0) as n_trailing, count(*) filter (where regexp_matches(clean, '[A-Za-z]') and length(clean) >= 3) as n_text, count(*) filter (where family <> 'unknown') as n_values from f where regexp_matches(clean, '[\\p{{L}}\\p{{N}}]') group by table_id),
    g as (select table_id, coalesce(max(length(trim(caption))) > 0, false) as has_signal from ext_table group by table_id)
    select table_id, n_cells, n_text, n_values, coalesce(has_signal, false) and table_id not in (select table_id from def_variable) and n_cols >= 2 and n_body >= 2 and n_cells >= 6 and n_trailing >= greatest(3, n_body) and n_text / n_cells >= 0.8 and n_values <= greatest(1, floor(n_cells * 0.15)) as is_text_only
    from k join b using (table_id) left join g using (table_id)""",
    "chk4_profiles": "select count(*) as n_rows, count(*) filter (where coalesce(trim(table_id), '') = '') as n_without_id from ext_table",
    "txt5_paragraphs": f"""with p as (select doc_id, regexp_split_to_array(text, '\\n\\s*\\n') as parts from documents where text is not null), u as (select doc_id, unnest(range(len(parts))) as part_no, unnest(parts) as raw from p),
    c as (select doc_id, part_no, coalesce({T.sql_clean('raw')}, '') as part from u), m as (select *, regexp_extract(part, '(?i)\\bTable\\s+[A-Za-z]?\\d+[A-Za-z]?\\b.{{0,240}}?\\|') as hit from c), w as (select *, case when hit = '' then 0 else strpos(part, hit) end as place from m),
    e as (select *, place > 0 and not regexp_matches(trim(substr(part, greatest(1, place - 120), least(120, place - 1))), '(?i)(\\b(shown|presented|reported|summari[sz]ed|listed|described|displayed|provided|given|seen)\\s+in\\s*$|\\b(see|refer\\s+to|according\\s+to)\\s*$)')
      and (length(substr(part, place)) - length(replace(substr(part, place), '|', '')) >= 8 or regexp_matches(substr(part, place), '\\|\\s*-{{3,}}\\s*\\|')) as ends from w),
    k as (select doc_id, part_no, case when ends then trim(substr(part, 1, place - 1)) else part end as part from e)
    select doc_id, row_number() over (partition by doc_id order by part_no) - 1 as paragraph_index, length(part) as n_chars from k where part <> '' and length(part) - length(replace(part, '|', '')) < 8 and not regexp_matches(part, '\\|\\s*-{{3,}}\\s*\\|')""",
    "txt12_mention_classes": f"""with hints(parent, key) as (values ('sex', 'male'), ('sex', 'female'), ('gender', 'male'), ('gender', 'female'), ('smoking status', 'never'), ('smoking status', 'former'), ('smoking status', 'current'),
      ('drinking status', 'never'), ('drinking status', 'former'), ('drinking status', 'current'), ('marital status', 'married'), ('marital status', 'living'), ('marital status', 'living with partner'), ('marital status', 'single'), ('marital status', 'divorced'), ('marital status', 'separated'), ('marital status', 'widowed'),
      ('race', 'mexican'), ('race', 'non hispanic'), ('race', 'other'), ('race', 'other multiracial'), ('race', 'white'), ('race', 'black'), ('educational level', 'less'), ('educational level', 'college'), ('educational level', 'high'), ('educational level', 'less than high school'), ('educational level', 'high school'), ('educational level', 'college or above')),
    papers as (select table_id, min(paper_id) as paper_id from ext_table group by 1),
    v as (select distinct variable_id, table_id, coalesce({T.sql_clean('variable_label')}, '') as cleaned, lower({T.sql_label("coalesce(variable_label, '')")}) as key from def_variable),
    o as (select v.*, paper_id from v left join papers using (table_id)), lv as (select distinct table_id, lower({T.sql_label('level_label')}) as key from def_level), lp as (select distinct paper_id, key from lv join papers using (table_id)),
    ex as (select distinct o.paper_id, h.key from o join hints h on h.parent = o.key),
    t as (select *, len(list_filter(string_split(key, ' '), lambda w: w <> '')) as n_words, len(list_filter(string_split(key, ' '), lambda w: w in ('age', 'bmi', 'diabetes', 'drinking', 'educational', 'education', 'gender', 'hypertension', 'marital', 'physical', 'pir', 'race', 'sex', 'smoking', 'status'))) as n_adjusted,
      exists (select 1 from lv where lv.table_id = o.table_id and lv.key = o.key and o.key <> '') or exists (select 1 from lp where lp.paper_id = o.paper_id and lp.key = o.key and o.key <> '') as is_level, exists (select 1 from ex where ex.paper_id = o.paper_id and ex.key = o.key) as is_explained from o)
    select distinct variable_id, case when cleaned = '' then 'artifact' when regexp_matches(cleaned, '(?i)^table\\s+[A-Za-z0-9.]*\\d[A-Za-z0-9.]*.*continued') or regexp_matches(replace(cleaned, '__', '_'), '(?i)^model[\\s_-]*\\d+$') then 'artifact'
      when regexp_matches(cleaned, '(?i)\\breference\\b') and regexp_matches(key, 'yes|no|reference') then 'artifact' when length(cleaned) - length(replace(cleaned, ',', '')) >= 3 and length(cleaned) >= 30 then 'artifact' when n_words >= 5 and n_adjusted >= 4 then 'artifact'
      when is_level then 'level' when regexp_matches(replace(cleaned, ' ', '_'), '(?i)^(q\\d+|quartile[\\s_-]*\\d+|quintile[\\s_-]*\\d+)$') or regexp_matches(key, 'quintile|quartile') then 'level'
      when regexp_full_match(replace(cleaned, ' ', ''), '([<>]=?)?\\d+(\\.\\d+)?(-\\d+(\\.\\d+)?\\+?)?') then 'range_bin' when is_explained then 'level' when length(replace(key, ' ', '')) >= 3 then 'variable' when regexp_matches(cleaned, '\\p{{L}}') then 'unknown' else 'artifact' end as mention_class from t""",
    "txt7_table_visuals": _TABLES + " select * from tv",
    "txt8_figure_visuals": "with " + _FIGURES + " select * from fv",
    "txt9_visual_inventory": _TABLES + ", " + _FIGURES + " select *, paper_id || '-' || visual_kind || '-' || lower(number) as visual_id, n_sources > 1 as is_ambiguous from (select * from tv union all select * from fv)",
    "txt15_labels_in_order": "with f as (select table_id, variable_label, min({'r': row_start, 'v': variable_id}) as first from def_variable where variable_label <> '' group by all) select table_id, string_agg(variable_label, '|' order by first, variable_label) as labels from f group by table_id",
    "jon7_uncaptioned_continuations": r"""with t as (select paper_id, table_id, min(caption) as caption, min(page_num) as page_num, max(n_cols) as n_cols from ext_table group by all),
    k as (select paper_id, table_id as prior_id, page_num, upper(nullif(regexp_extract(caption, '(?i)\b(tables?|figures?|figs?\.?) *([sS]?[0-9]+[A-Za-z]?)\b', 2), '')) as number from t),
    j as (select t.table_id, k.prior_id, k.number, row_number() over (partition by t.table_id order by k.prior_id desc, k.number desc) as r from t join k on k.paper_id = t.paper_id and k.page_num = t.page_num - 1 and k.prior_id < t.table_id
      where coalesce(trim(t.caption), '') = '' and t.n_cols >= 2 and k.number is not null) select table_id, prior_id, number from j where r = 1""",
    "jon16_unit_marks": r"""with l as (select distinct variable_label, regexp_replace(left(variable_label, length(variable_label) - 1), '\s+', '', 'g') as b from def_variable where regexp_matches(variable_label, '[0-9]$'))
    select variable_label, b <> '' and (regexp_matches(b, '(?i)(×|x|\*)?10$') or regexp_matches(b, '^[A-Za-z]$') or regexp_matches(b, '(?i)(^|[^A-Za-z0-9])(m|cm|mm|kg|g|mg|ug|μg|l|dl|ml|mol|mmol|umol|μmol)$')
      or (contains(b, '/') and regexp_matches(b, '[A-Za-zμ][A-Za-zμ0-9.]*$')) or regexp_matches(b, '\d+(\.\d+)?[A-Za-zμ]+$')) as is_unit from l""",
    "val8_parsed_tables": _C + """, k as (select table_id, count(*) as n_columns, count(*) filter (where role in ('group', 'comparison_group')) as n_group, count(*) filter (where role = 'overall') as n_overall, count(*) filter (where role = 'p_value') as n_p_value,
      count(*) filter (where role = 'smd') as n_statistic, count(*) filter (where role = 'unknown') as n_unknown from roles group by table_id),
    v as (select table_id, count(distinct variable_id) as n_variables from def_variable group by 1), n as (select table_id, count(*) as n_values from records group by 1)
    select k.*, coalesce(n_variables, 0) as n_variables, coalesce(n_values, 0) as n_values from k left join v using (table_id) left join n using (table_id)""",
    "val9_definition_match": "select coalesce(g.table_id, v.table_id) as table_id, (g.table_id is not null)::integer as has_grid, (v.table_id is not null)::integer as has_definition from (select distinct table_id from ext_cell) g full join (select distinct table_id from def_variable) v using (table_id) where g.table_id is null or v.table_id is null",
    "r6_table_inventory": r"""with t as (select paper_id, table_id, min(caption) as caption, min(page_num) as page_num, max(n_rows) as n_rows, max(n_cols) as n_cols, max((positioned_evidence is not null)::integer) as has_evidence from ext_table group by all)
    select paper_id, table_id, upper(nullif(regexp_extract(regexp_replace(caption, '\s+', ' ', 'g'), '(?i)\b(tables?|figures?|figs?\.?) *([sS]?[0-9]+[A-Za-z]?)\b', 2), '')) as number, page_num, n_rows, n_cols, has_evidence, (caption is not null)::integer as has_caption from t""",
}
_PARTS = (
    nrm9_header_split, col1_header_schema, col2_header_paths, col7_header_levels, r5_header_frame, ext4_caption_lines, ext5_page_captions, ext22_canonical_boxes, flt12_trailing_notes, flt13_prose_grids, agg5_text_only_grids, chk4_profiles,
    txt5_paragraphs, txt7_table_visuals, txt8_figure_visuals, txt9_visual_inventory, txt12_mention_classes, txt15_labels_in_order, jon7_uncaptioned_continuations, jon16_unit_marks, val8_parsed_tables, val9_definition_match, r6_table_inventory,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _PARTS}
