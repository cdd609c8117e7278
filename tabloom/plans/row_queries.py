"""Queries on the rows of printed tables told apart by the fold, and on the variables they make up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import values as V
from tabloom.operators import grid as G
from tabloom.operators import quality as Q
from tabloom.operators import rows as R
from tabloom.plans.grid_queries import _C
from tabloom.runtime import checkpoint, table


def _features(s: SparkSession, d: str) -> DataFrame:
    cells = checkpoint(G.unique_cells(table(s, d, "ext_cell")).withColumn("family", V.value_family(F.col("clean"))))
    views = checkpoint(G.row_views(cells))
    starts = G.body_starts(views)
    roles = checkpoint(G.column_roles(G.header_labels(cells, starts)))
    return R.row_features(cells, views, starts, roles, Q.likely_levels(cells, views, roles))


def row3_comparator_labels(s: SparkSession, d: str) -> DataFrame:
    """Labels that begin with a comparator, per table."""
    rows = G.row_views(G.unique_cells(table(s, d, "ext_cell")))
    return rows.groupBy("table_id").agg(F.count_if(R.common_level_label(F.col("label"))).alias("n_comparator_labels"))


def row6_row_classes(s: SparkSession, d: str) -> DataFrame:
    """Every body row with its class and how sure that is."""
    return R.classified_rows(_features(s, d)).select("table_id", "row_idx", "row_class", "confidence")


def row10_grouped_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows of variables: heads and levels, with the row their variable starts in."""
    return R.classified_rows(_features(s, d)).where("block_start is not null").select("table_id", "row_idx", "block_start", "variable_kind")


def row17_defined_variables(s: SparkSession, d: str) -> DataFrame:
    features = checkpoint(_features(s, d))
    return R.defined_variables(R.classified_rows(features), features)


def row18_table_definitions(s: SparkSession, d: str) -> DataFrame:
    """Tables with their numbers of variables and levels and the mean confidence of the variables."""
    return row17_defined_variables(s, d).groupBy("table_id").agg(F.count("*").alias("n_variables"), F.sum("n_levels").alias("n_levels"), F.round(F.avg("confidence"), 6).alias("confidence"))


SQL: dict[str, str] = {
    "row3_comparator_labels": _C + "select table_id, count(*) filter (where regexp_matches(trim(label), '^[<>≤≥]')) as n_comparator_labels from rows group by table_id",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (row3_comparator_labels, row6_row_classes, row10_grouped_rows, row17_defined_variables, row18_table_definitions)}
