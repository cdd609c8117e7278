"""Queries on levels, profiles, quality and page geometry, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.functions import values as V
from tabloom.operators import geometry as B
from tabloom.operators import grid as G
from tabloom.operators import quality as Q
from tabloom.plans import value_sql as VQ
from tabloom.plans.grid_queries import _C, _cells, _roles
from tabloom.runtime import checkpoint, table


def _families(s: SparkSession, d: str) -> DataFrame:
    return checkpoint(_cells(s, d).withColumn("family", V.value_family(F.col("clean"))))


def row2_likely_levels(s: SparkSession, d: str) -> DataFrame:
    cells = _families(s, d)
    return Q.likely_levels(cells, G.row_views(cells), _roles(s, d))


def row8_scalar_count_rows(s: SparkSession, d: str) -> DataFrame:
    """Per table its rows and those that are scalar counts."""
    cells = _cells(s, d)
    rows = G.row_views(cells)
    found = Q.scalar_count_rows(cells, rows).withColumn("scalar", F.lit(1))
    return rows.join(found, ["table_id", "row_idx"], "left").groupBy("table_id").agg(F.count("*").alias("n_rows"), F.count("scalar").alias("n_scalar"))


def agg1_table_profiles(s: SparkSession, d: str) -> DataFrame:
    return Q.table_profiles(table(s, d, "ext_table"), _families(s, d), _roles(s, d), table(s, d, "def_level"))


def ext1_candidate_scores(s: SparkSession, d: str) -> DataFrame:
    return Q.candidate_scores(table(s, d, "ext_table"), _cells(s, d))


def agg3_quality_items(s: SparkSession, d: str) -> DataFrame:
    cells = _families(s, d)
    rows = G.row_views(cells)
    return Q.quality_items(cells, rows, _roles(s, d), G.body_starts(rows))


def r8_processing_summary(s: SparkSession, d: str) -> DataFrame:
    """Per paper the number of tables of each family."""
    papers = table(s, d, "ext_table").select("table_id", "paper_id").distinct()
    return agg1_table_profiles(s, d).join(papers, "table_id").groupBy("paper_id", "family").agg(F.countDistinct("table_id").alias("n_tables"))


def chk2_definition_faults(s: SparkSession, d: str) -> DataFrame:
    """Variables and levels checked, and the faults found."""
    variables, levels = table(s, d, "def_variable"), table(s, d, "def_level")
    faults = Q.definition_faults(variables, levels, table(s, d, "ext_cell"))
    counts = variables.select(F.lit("variable").alias("kind"), F.col("variable_id").alias("record_id")).unionByName(levels.select(F.lit("level").alias("kind"), F.col("level_id").alias("record_id")))
    marked = counts.distinct().join(faults, ["kind", "record_id"], "left")
    return marked.groupBy("kind", F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n_records"))


def chk3_value_faults(s: SparkSession, d: str) -> DataFrame:
    """Values checked, and those without a cell, by table."""
    values = table(s, d, "cell_value")
    keys = values.select(F.col("source_table_id").alias("table_id"), "row_idx", "col_idx").distinct()
    faults = Q.value_faults(values, table(s, d, "ext_cell")).withColumn("fault", F.lit(1))
    return keys.join(faults, ["table_id", "row_idx", "col_idx"], "left").groupBy("table_id").agg(F.count("*").alias("n_values"), F.count("fault").alias("n_faults"))


def col8_grouping(s: SparkSession, d: str) -> DataFrame:
    return Q.grouping(table(s, d, "ext_table"), _roles(s, d))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    return B.unique_boxes(table(s, d, "ext_cell"))


def geo4_occupancy(s: SparkSession, d: str) -> DataFrame:
    return B.occupancy(_boxes(s, d))


def geo6_column_bands(s: SparkSession, d: str) -> DataFrame:
    return B.column_bands(B.occupancy(_boxes(s, d)))


def flt14_row_coverage(s: SparkSession, d: str) -> DataFrame:
    return B.row_coverage(_boxes(s, d)).select("table_id", "row_idx", F.round("covered", 3).alias("covered"), F.round("share", 6).alias("share"))


def _regions(s: SparkSession, d: str) -> DataFrame:
    box = F.col("positioned_evidence.canonical_bbox")
    return table(s, d, "ext_table").where(box.isNotNull()).groupBy("table_id").agg(F.struct(F.min(box["x0"]).alias("x0"), F.min(box["y0"]).alias("y0"), F.max(box["x1"]).alias("x1"), F.max(box["y1"]).alias("y1")).alias("region"))


def flt7_overlap_share(s: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(s, d).withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    both = boxes.join(_regions(s, d), "table_id")
    return both.select("table_id", "row_idx", "col_idx", F.round(B.overlap_share(F.col("box"), F.col("region")), 6).alias("share"))


def flt10_inside_region(s: SparkSession, d: str) -> DataFrame:
    """Per table the boxes whose centre lies in the table's region, and the others."""
    boxes = _boxes(s, d).withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    inside = B.center_inside(F.col("box"), F.col("region"))
    return boxes.join(_regions(s, d), "table_id").groupBy("table_id").agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"))


def ext21_rotated_boxes(s: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(s, d).withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    turned = boxes.join(_regions(s, d), "table_id").withColumn("r", B.rotated(F.col("box"), F.col("region"), "clockwise"))
    return turned.select("table_id", "row_idx", "col_idx", *[F.round(F.col(f"r.{k}"), 3).alias(k) for k in ("x0", "y0", "x1", "y1")])


def geo5_median_heights(s: SparkSession, d: str) -> DataFrame:
    heights = table(s, d, "ext_cell").where("bbox is not null").select("extractor_name", "table_id", "row_idx", "col_idx", (F.col("bbox.y1") - F.col("bbox.y0")).alias("h")).distinct()
    return heights.groupBy("extractor_name").agg(F.round(F.percentile("h", 0.5), 6).alias("median_height"), F.count("*").alias("n_boxes"))


def ext15_text_lines(s: SparkSession, d: str) -> DataFrame:
    return B.text_lines(_boxes(s, d))


def syn2_slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "def_variable").where("variable_label is not null").select("variable_label", T.slug(F.col("variable_label")).alias("slug")).distinct()


_FAM = _C + f", f as (select *, {VQ.family('clean')} as family from c), labels as (select *, {T.sql_label('label_raw')} as label_norm from rows)"
_BOX = "with b as (select table_id, row_idx, col_idx, min(bbox.x0) as x0, min(bbox.y0) as y0, max(bbox.x1) as x1, max(bbox.y1) as y1 from ext_cell where bbox is not null and trim(text) <> '' group by all)"
_OCC = _BOX + ", o as (select table_id, bin, count(distinct row_idx) as n_rows from (select table_id, row_idx, unnest(range(cast(floor(x0 / 5) as bigint), cast(floor(x1 / 5) as bigint) + 1)) as bin from b) group by all)"
_REG = _BOX + ", g as (select table_id, min(positioned_evidence.canonical_bbox.x0) as gx0, min(positioned_evidence.canonical_bbox.y0) as gy0, max(positioned_evidence.canonical_bbox.x1) as gx1, max(positioned_evidence.canonical_bbox.y1) as gy1 from ext_table where positioned_evidence.canonical_bbox is not null group by table_id), j as (select * from b join g using (table_id))"
_PROFILE = _FAM + f""", cap as (select table_id, coalesce(min(caption), '') as caption from ext_table group by 1),
hd as (select table_id, string_agg(header, ' ' order by col_idx) as headers, bool_or(role in ('overall', 'group', 'comparison_group')) as has_group, count(*) filter (where role = 'p_value') as n_p_columns from roles group by 1),
bd as (select table_id, count(*) filter (where family in ('count_pct', 'mean_sd', 'median_iqr', 'n_only')) as nd, count(*) filter (where family = 'count_pct') as nc, count(*) filter (where family = 'p_value') as np,
  count(*) filter (where regexp_full_match(clean, '-?[0-9]+(?:\\.[0-9]+)? *,? *[(\\[] *-?[0-9]+(?:\\.[0-9]+)? *(?:,|-) *-?[0-9]+(?:\\.[0-9]+)? *[)\\]]')) as ni from f where col_idx > 0 and clean <> '' group by 1),
sc as (select table_id, cast(case when regexp_matches(caption, '{Q.DESCRIPTIVE}') then 2 else 0 end + case when nd >= 2 then 1 else 0 end + case when nc >= 2 then 1 else 0 end
    + case when table_id in (select table_id from def_level) then 2 else 0 end + case when has_group then 1 else 0 end as integer) as descriptive,
  cast(case when regexp_matches(caption || ' ' || coalesce(headers, ''), '{Q.ESTIMATE}') then 2 else 0 end + case when regexp_matches(headers, '{Q.EFFECT}') then 1 else 0 end + case when regexp_matches(headers, '{Q.MODEL}') then 1 else 0 end
    + case when ni >= 2 then 2 else 0 end + case when n_p_columns >= 1 and np >= 2 then 1 else 0 end as integer) as estimate
  from cap left join hd using (table_id) left join bd using (table_id)),
profiles as (select *, case when estimate >= 4 and estimate > descriptive then 'estimate_results' when descriptive >= 3 and descriptive >= estimate then 'descriptive_characteristics' else 'unknown' end as family from sc)
"""

SQL: dict[str, str] = {
    "row2_likely_levels": _FAM + f""", k as (select f.*, family in ('count_pct', 'n_only') as is_count from f left join roles r on r.table_id = f.table_id and r.col_idx = f.col_idx where f.col_idx > 0 and clean <> '' and coalesce(r.role, '') not in ('p_value', 'smd')),
      w as (select *, row_number() over w as at_, coalesce(sum(is_count::int) over (w rows between unbounded preceding and 1 preceding), 0) as before_, count(*) over p as n, sum(is_count::int) over p as n_counts, lag(family) over w as previous from k
        window w as (partition by table_id, row_idx order by col_idx), p as (partition by table_id, row_idx)),
      ok as (select table_id, row_idx from w group by 1, 2 having bool_and(coalesce(is_count or (family = 'p_value' and before_ >= 1) or (previous = 'n_only' and regexp_full_match(clean, '\\( *[0-9]+(?:\\.[0-9]+)?% *\\)')) or (at_ = 1 and n >= 3 and n_counts - is_count::int >= 2), false)) and max(n_counts) > 0)
      select l.table_id, l.row_idx from labels l join ok using (table_id, row_idx) where label_norm <> '' and len(string_split(label_norm, ' ')) <= 4 and length(label_norm) <= 32 and not contains(label, ',') and not regexp_matches(label, '{Q.SUMMARY}') and n_numeric > 0""",
    "row8_scalar_count_rows": _FAM + """, ok as (select table_id, row_idx from c where col_idx > 0 and clean <> '' group by 1, 2 having bool_and(regexp_full_match(clean, '[0-9]+')))
      select l.table_id, count(*) as n_rows, count(*) filter (where ok.table_id is not null and label_norm <> '' and len(string_split(label_norm, ' ')) <= 2 and length(label_norm) <= 16) as n_scalar from labels l left join ok on ok.table_id = l.table_id and ok.row_idx = l.row_idx group by 1""",
    "agg1_table_profiles": _PROFILE + "select table_id, descriptive, estimate, family, case when family = 'unknown' then least(75, 35 + 5 * greatest(descriptive, estimate)) else least(98, 55 + 8 * greatest(descriptive, estimate) + 3 * abs(descriptive - estimate)) end / 100 as confidence from profiles",
    "r8_processing_summary": _PROFILE + "select paper_id, family, count(distinct table_id) as n_tables from profiles join (select distinct table_id, paper_id from ext_table) using (table_id) group by all",
    "ext1_candidate_scores": _C + r""", one as (select table_id, min(caption) as caption from ext_table group by 1), fc as (select table_id, trim(string_split(trim(text), chr(10))[1]) as first_line from c where row_idx = 0 and col_idx = 0),
      ln as (select table_id, unnest(range(len(string_split(coalesce(nullif(caption, ''), first_line), chr(10))))) as k, trim(unnest(string_split(coalesce(nullif(caption, ''), first_line), chr(10)))) as line from one left join fc using (table_id)),
      nm as (select table_id, k, regexp_extract(line, '(?i)^\s*table\s*([A-Za-z0-9.]*\d[A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*)\b', 1) as number, trim(regexp_replace(line, '(?i)^\s*table\s*([A-Za-z0-9.]*\d[A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*)\b(?:\s*[:.])?', '')) as rest from ln),
      cap as (select table_id, arg_min(number, k) as number from nm where number <> '' and not regexp_matches(rest, '(?i)^(displays?|shows?|presents?|describes?|illustrates?|reports?|lists?|contains?|summarizes?|compares?|demonstrates?|highlights?|details?|examines?|provides?|gives?|outlines?|depicts?|indicates?|reveals?)\b') group by 1),
      r as (select table_id, row_idx, count(*) as n from c group by all), sh as (select table_id, count(*) as n_rows, max(n) as n_cols, min(n) = max(n) as rectangular from r group by 1),
      p as (select table_id, count(*) filter (where clean <> '' and col_idx = 0 and regexp_matches(clean, '[A-Za-z]')) / nullif(count(*) filter (where clean <> '' and col_idx = 0), 0) as ts, count(*) filter (where clean <> '' and col_idx > 0 and regexp_matches(clean, '[0-9]')) / nullif(count(*) filter (where clean <> '' and col_idx > 0), 0) as ns from c group by 1)
      select table_id, round(cast(least(1.0, case when number is not null then 0.4 else 0 end + case when number = '1' then 0.05 else 0 end + case when ts >= 0.6 then 0.25 else 0 end + case when ns >= 0.5 then 0.2 else 0 end
        + case when rectangular then 0.1 else 0 end + case when n_rows >= 2 and n_cols >= 2 then 0.05 else 0 end) as double), 4) as score from one left join cap using (table_id) left join sh using (table_id) left join p using (table_id)""",
    "agg3_quality_items": _FAM + """, b as (select f.* from f join starts using (table_id) where f.row_idx >= body_start and col_idx > 0),
      col as (select b.table_id, b.col_idx, count(*) as n, count(*) filter (where clean <> '') as nf, count(*) filter (where clean <> '' and family in ('count_pct', 'mean_sd', 'median_iqr', 'n_only', 'p_value')) as nk, count(*) filter (where clean <> '' and family = 'p_value') as np from b group by all),
      j as (select col.*, r.role from col left join roles r on r.table_id = col.table_id and r.col_idx = col.col_idx), t as (select table_id, sum(nf) as n, sum(nk) as k from col group by 1 having sum(nf) >= 6)
      select table_id, col_idx, 'warning' as severity, 'mostly_empty_column' as code from j where 1 - nf / n > 0.85
      union all select table_id, col_idx, case when np / nf < 0.3 then 'error' else 'warning' end, case when np / nf < 0.3 then 'invalid_p_value_column' else 'weak_p_value_column' end from j where nf > 0 and role = 'p_value' and np / nf < 0.6
      union all select table_id, col_idx, case when nk / nf >= 0.2 then 'warning' else 'error' end, 'non_numeric_statistical_column' from j where nf > 0 and role in ('overall', 'group', 'comparison_group') and nk / nf < 0.4
      union all select table_id, -1, case when k / n < 0.25 then 'error' else 'warning' end, case when k / n < 0.25 then 'low_value_pattern_recognition' else 'weak_value_pattern_recognition' end from t where k / n < 0.5
      union all select distinct r.table_id, -1, 'warning', 'missing_label_with_values' from rows r join starts using (table_id) where row_idx >= body_start and label = '' and n_trailing > 0""",
    "chk2_definition_faults": """with r as (select distinct table_id, row_idx from ext_cell), v as (select distinct variable_id, table_id, row_start, row_end from def_variable), l as (select distinct level_id, variable_id, table_id, row_idx from def_level)
      , faults as (select distinct * from (select 'variable' as kind, variable_id as record_id, 'no_row' as fault from v where not exists (select 1 from r where r.table_id = v.table_id and r.row_idx = v.row_start)
      union all select 'level', level_id, 'no_row' from l where not exists (select 1 from r where r.table_id = l.table_id and r.row_idx = l.row_idx)
      union all select 'level', level_id, case when v.variable_id is null then 'no_variable' else 'outside_variable' end from l left join v using (variable_id) where v.table_id is null or v.table_id <> l.table_id or l.row_idx < row_start or l.row_idx > row_end)),
      a as (select distinct 'variable' as kind, variable_id as record_id from def_variable union all select distinct 'level', level_id from def_level)
      select a.kind, coalesce(f.fault, 'none') as fault, count(*) as n_records from a left join faults f using (kind, record_id) group by all""",
    "chk3_value_faults": "with k as (select distinct source_table_id as table_id, row_idx, col_idx from cell_value), c as (select distinct table_id, row_idx, col_idx, 1 as hit from ext_cell) select k.table_id, count(*) as n_values, count(*) filter (where hit is null) as n_faults from k left join c using (table_id, row_idx, col_idx) group by 1",
    "col8_grouping": _C + f""", cap as (select table_id, min(caption) as caption from ext_table group by 1),
      p as (select *, case when col_idx = 0 then 'label' when role in ('p_value', 'smd') then 'statistic' else 'data' end as part0 from roles),
      o as (select *, min(case when part0 = 'data' and (role = 'overall' or low in ('overall', 'all', 'total', 'total population', 'full cohort')) then col_idx end) over (partition by table_id) as first_o from p),
      q as (select *, case when part0 <> 'data' then part0 when col_idx = first_o then 'overall' else 'group' end as part from o), f as (select *, min(col_idx) over (partition by table_id, part, low) as first_at from q)
      select table_id, col_idx, part, case when part = 'group' then dense_rank() over (partition by table_id, part order by first_at) end as level_order, nullif(trim(regexp_extract(caption, '{Q.GROUPED_BY}', 1)), '') as grouping_label from f join cap using (table_id)""",
    "geo4_occupancy": _OCC + " select table_id, bin, n_rows from o",
    "geo6_column_bands": _OCC + ", r as (select *, sum(case when bin - prev <= 1 then 0 else 1 end) over (partition by table_id order by bin) as band from (select *, lag(bin) over (partition by table_id order by bin) as prev from o)) select table_id, cast(band as bigint) as band, min(bin) as first_bin, max(bin) as last_bin from r group by table_id, band",
    "flt14_row_coverage": _BOX + """, e as (select *, max(x1) over (partition by table_id, row_idx order by x0, x1 rows between unbounded preceding and 1 preceding) as reach from b), w as (select table_id, max(x1) - min(x0) as width from b group by 1),
      u as (select table_id, row_idx, sum(greatest(0, x1 - greatest(x0, coalesce(reach, x0)))) as covered from e group by all)
      select table_id, row_idx, round(covered, 3) as covered, round(case when width > 0 then covered / width else 0 end, 6) as share from u join w using (table_id)""",
    "flt7_overlap_share": _REG + " select table_id, row_idx, col_idx, round(case when least(x1, gx1) > greatest(x0, gx0) and least(y1, gy1) > greatest(y0, gy0) and (x1 - x0) * (y1 - y0) > 0 then (least(x1, gx1) - greatest(x0, gx0)) * (least(y1, gy1) - greatest(y0, gy0)) / ((x1 - x0) * (y1 - y0)) else 0 end, 6) as share from j",
    "flt10_inside_region": _REG + " select table_id, count(*) filter (where (x0 + x1) / 2 between gx0 and gx1 and (y0 + y1) / 2 between gy0 and gy1) as n_inside, count(*) filter (where not ((x0 + x1) / 2 between gx0 and gx1 and (y0 + y1) / 2 between gy0 and gy1)) as n_outside from j group by 1",
    "ext21_rotated_boxes": _REG + " select table_id, row_idx, col_idx, round(y0 - gy0, 3) as x0, round(gx1 - x1, 3) as y0, round(y1 - gy0, 3) as x1, round(gx1 - x0, 3) as y1 from j",
    "geo5_median_heights": "select extractor_name, round(quantile_cont(h, 0.5), 6) as median_height, count(*) as n_boxes from (select distinct extractor_name, table_id, row_idx, col_idx, bbox.y1 - bbox.y0 as h from ext_cell where bbox is not null) group by 1",
    "syn2_slugs": "with s as (select distinct variable_label, regexp_replace(regexp_replace(lower(variable_label), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from def_variable where variable_label is not null) select variable_label, case when slug = '' then 'row' else slug end as slug from s",
}
QUERIES = {name: globals()[name] for name in [*SQL, "ext15_text_lines"]}
