"""Variables and their levels as blocks of rows, and the display rows of definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_kinds(rows: DataFrame, levels: DataFrame, starts: DataFrame) -> DataFrame:
    """Body rows with kind: header (a label over nothing), level, unknown (no label) or variable."""
    body = rows.join(starts.select("table_id", "body_start"), "table_id").where("row_idx >= body_start")
    marked = body.join(levels.select("table_id", "row_idx", F.lit(True).alias("is_level")), ["table_id", "row_idx"], "left")
    kind = F.when(F.col("label") == "", "unknown").when(F.col("n_trailing") == 0, "header").when(F.col("is_level"), "level").otherwise("variable")
    return marked.select("table_id", "row_idx", "label", kind.alias("kind"))


def variable_blocks(kinds: DataFrame) -> DataFrame:
    """(table_id, row_start, row_end, kind, n_levels): each header or variable row with the levels that follow.

    Unknown rows are passed over; levels below a variable row, or before any, belong to no block's levels.
    """
    w = Window.partitionBy("table_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("kind").isin("header", "variable")
    runs = kinds.withColumn("block", F.sum(starts.cast("int")).over(w)).where("block > 0 and kind <> 'unknown'")
    blocks = runs.groupBy("table_id", "block").agg(
        F.min("row_idx").alias("row_start"), F.max("row_idx").alias("last"), F.min_by("kind", "row_idx").alias("kind"), F.count_if(F.col("kind") == "level").alias("n")
    )
    own = F.col("kind") == "header"
    return blocks.select("table_id", "row_start", F.when(own, F.col("last")).otherwise(F.col("row_start")).alias("row_end"), "kind", F.when(own, F.col("n")).otherwise(0).alias("n_levels"))


def display_rows(variables: DataFrame, levels: DataFrame) -> DataFrame:
    """Definitions as printed rows in order: table_id, body_row_idx, row_type, label, parent_label. Copies count once."""
    v = variables.select("table_id", "variable_id", "variable_label", "variable_type", "row_start").distinct()
    lv = levels.select("table_id", "variable_id", "level_id", "level_label", "row_idx").distinct()
    parents = lv.select("variable_id").distinct().withColumn("has_levels", F.lit(True))
    own = v.join(parents, "variable_id", "left").select(
        "table_id", F.col("row_start").alias("at"), F.col("variable_id").alias("id"),
        F.when(F.col("has_levels"), "categorical_parent").when(F.col("variable_type") == "continuous", "continuous").otherwise("categorical_inline").alias("row_type"),
        F.col("variable_label").alias("label"), F.lit(None).cast("string").alias("parent_label"),
    )
    below = lv.join(v.select("variable_id", F.col("variable_label").alias("parent_label")), "variable_id").select("table_id", F.col("row_idx").alias("at"), F.col("level_id").alias("id"), F.lit("level").alias("row_type"), F.col("level_label").alias("label"), "parent_label")
    order = Window.partitionBy("table_id").orderBy("at", "row_type", "id")
    return own.unionByName(below).withColumn("body_row_idx", F.row_number().over(order) - 1).select("table_id", "body_row_idx", "row_type", "label", "parent_label")
