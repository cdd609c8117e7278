"""Queries of the core problems, each over whole tables: name to (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.nested import boundary_nodes, grid_cells
from tabloom.operators.packed import split_packed
from tabloom.operators.references import find_orphans
from tabloom.operators.units import assign_units, common_values, converted_values, hidden_unit_report, measured_variables, printed_values
from tabloom.plans import context_queries, grid_queries, note_queries, paper_queries, quality_queries, row_queries, header_queries, paper_note_queries
from tabloom.runtime import reference_rows, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "visual_ref").where("resolution_status = 'resolved'")
    return find_orphans(refs, table(spark, d, "visual"))


def p1_orphans_by_paper_month(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "visual_ref").where("resolution_status = 'resolved'").withColumn("month", F.date_format("observed_at", "yyyy-MM"))
    found = find_orphans(refs, table(spark, d, "visual"), keep=("paper_id", "month"))
    return found.groupBy("paper_id", "month", "fault").agg(F.count("*").alias("n_references"))


def level_names(spark: SparkSession, d: str) -> list[str]:
    canon = table(spark, d, "canon_label").where("label_kind = 'level'")
    rows = reference_rows(canon.select(F.explode(F.concat(F.array("canon_text"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")))
    return [r["name"] for r in rows if r["name"] is not None]


def _p3_values(spark: SparkSession, d: str) -> DataFrame:
    names = level_names(spark, d)
    cells = table(spark, d, "ext_cell").select(F.lit("cell").alias("source_kind"), "table_id", "row_idx", "col_idx", "text")
    values = table(spark, d, "cell_value").select(F.lit("value").alias("source_kind"), F.col("source_table_id").alias("table_id"), "row_idx", "col_idx", F.col("raw_value").alias("text"))
    return split_packed(cells.unionByName(values), "text", names, ("source_kind", "table_id", "row_idx", "col_idx"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3_values(spark, d).drop("value").distinct()


def p3_values_per_field(spark: SparkSession, d: str) -> DataFrame:
    values = _p3_values(spark, d).distinct()
    per_field = values.groupBy("source_kind", "table_id", "row_idx", "col_idx").agg(F.countDistinct("pos").alias("n_values"))
    return per_field.groupBy("source_kind", "n_values").agg(F.count("*").alias("n_fields"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    cells = grid_cells(table(spark, d, "ext_table")).select(F.lit("grid_cell").alias("node_kind"), "table_id", "pos1", "pos2")
    nodes = boundary_nodes(table(spark, d, "boundary_raw")).select("node_kind", "table_id", "pos1", "pos2")
    return cells.unionByName(nodes).distinct()


def p4_grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return grid_cells(table(spark, d, "ext_table")).distinct()


def p4_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules tied to their boundary and table."""
    nodes = boundary_nodes(table(spark, d, "boundary_raw")).where("node_kind = 'rule'")
    return nodes.groupBy("table_id", "pos1", "source").agg(F.countDistinct("pos2", "source_index").alias("n_rules"))


def _p6_assigned(spark: SparkSession, d: str) -> DataFrame:
    names = ("def_variable", "ext_cell", "canon_label", "unit_ref")
    return assign_units(*(table(spark, d, n) for n in names))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    uncommon = F.broadcast(table(spark, d, "unit_ref").where("not is_common").select("unit_id"))
    recorded = _p6_assigned(spark, d).where(F.col("source").isin("recorded", "doubtful", "conflict"))
    return recorded.join(uncommon, "unit_id", "left_semi").select("variable_id", "unit_id").distinct()


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """Every measured variable's unit and each of its printed values, with companions, as printed and in the common unit."""
    variables, cells, canon, units = (table(spark, d, n) for n in ("def_variable", "ext_cell", "canon_label", "unit_ref"))
    measured = measured_variables(variables, canon, units)
    assigned = assign_units(variables, cells, canon, units, measured=measured)
    values = converted_values(assigned, printed_values(measured, cells, units), units)
    numbers = [f"{p}{n}" for p in ("", "common_") for n in ("value", "spread", "low", "high")]
    return values.select("variable_id", "col_idx", "pos", "quantity", "unit_id", "source", F.round("probability", 6).alias("probability"), "relation", *numbers)


def p6_medians(spark: SparkSession, d: str) -> DataFrame:
    """Every measured variable's unit, how it was told and its middle value in the common unit."""
    values = common_values(_p6_assigned(spark, d), table(spark, d, "unit_ref"))
    return values.select("variable_id", "quantity", "unit_id", "source", F.round("probability", 6).alias("probability"), "common_value")


def p6_hidden_units(spark: SparkSession, d: str) -> DataFrame:
    """Held-out variables whose recorded unit is hidden: how many the forest is sure of, and right about, by quantity."""
    return hidden_unit_report(*(table(spark, d, n) for n in ("def_variable", "ext_cell", "canon_label", "unit_ref")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_orphans_by_paper_month, p3_found, p3_values_per_field, p4_found, p4_grid_cells, p4_rules, p6_found, p6_values, p6_medians, p6_hidden_units)
}

_P1 = """
with refs as (
  select distinct reference_id, paper_id, resolved_visual_id as id, observed_at
  from visual_ref where resolution_status = 'resolved' and resolved_visual_id is not null),
judged as (
  select r.reference_id, r.paper_id, r.observed_at, count(v.visual_id) as n,
    count(*) filter (where v.recorded_at <= r.observed_at and (v.withdrawn_at is null or v.withdrawn_at > r.observed_at)) as live,
    count(*) filter (where v.recorded_at <= r.observed_at) as recorded
  from refs r left join visual v on v.visual_id = r.id group by all)
"""
SQL: dict[str, str] = {
    "p1_found": _P1
    + "select distinct reference_id, case when n = 0 then 'missing' when recorded = 0 then 'late' else 'withdrawn' end as fault from judged where live = 0",
    "p1_orphans_by_paper_month": _P1
    + """select paper_id, month, fault, count(*) as n_references from (
      select distinct reference_id, paper_id, strftime(observed_at, '%Y-%m') as month,
        case when n = 0 then 'missing' when recorded = 0 then 'late' else 'withdrawn' end as fault from judged where live = 0)
    group by all""",
    "p4_grid_cells": """
with g as (select table_id, positioned_evidence.canonical_grid_cell_bboxes as grid from ext_table),
r as (select table_id, grid, unnest(range(len(grid))) as pos1 from g),
c as (select table_id, pos1, grid[pos1 + 1] as line, unnest(range(len(grid[pos1 + 1]))) as pos2 from r)
select distinct table_id, cast(pos1 as integer) as pos1, cast(pos2 as integer) as pos2,
  line[pos2 + 1].x0 as x0, line[pos2 + 1].y0 as y0, line[pos2 + 1].x1 as x1, line[pos2 + 1].y1 as y1
from c where line[pos2 + 1] is not null""",
}

for _module in (grid_queries, paper_queries, quality_queries, note_queries, context_queries, row_queries, header_queries, paper_note_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
