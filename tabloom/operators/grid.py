"""Printed grids: unique cells, row views, header and body, value parsing, families and quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import alpha_text, clean_text, header_match_text, label_text, value_like
from tabloom.functions.values import value_family, with_components

KEY = ["table_id", "row_idx", "col_idx"]


def unique_cells(cells: DataFrame) -> DataFrame:
    """One row per cell position: copies count once; of differing texts the smallest stands. Adds ``clean``."""
    narrow = cells.select(*KEY, "text", F.col("bbox.x0").alias("x0"), F.coalesce(clean_text(F.col("text")), F.lit("")).alias("clean"))
    # cleaned before the shuffle, which every use of the cells can then share
    return narrow.groupBy(*KEY).agg(F.min("text").alias("text"), F.min("x0").alias("x0"), F.min_by("clean", "text").alias("clean")).fillna({"clean": ""})


def row_views(cells: DataFrame) -> DataFrame:
    """One row per grid row of ``unique_cells``: label forms, counts of filled, numeric and value-like cells, and indent.

    Blank and null cells aren't filled. The indent is the label's distance from the leftmost label, or its leading
    spaces where the table has no boxes, or null.
    """
    first = F.col("col_idx") == 0
    filled = F.col("clean") != ""
    trailing = filled & ~first
    rows = cells.groupBy("table_id", "row_idx").agg(
        F.max(F.when(first, F.col("text"))).alias("label_raw"),
        F.max(F.when(first, F.col("clean"))).alias("label_clean"),
        F.max(F.when(first, F.col("x0"))).alias("label_x0"),
        F.count_if(filled).alias("n_filled"),
        F.count_if(filled & F.col("clean").rlike("[0-9]")).alias("n_numeric"),
        F.count_if(trailing).alias("n_trailing"),
        F.count_if(trailing & value_like(F.col("clean"))).alias("n_value_like"),
        F.countDistinct(F.when(trailing, F.col("clean"))).alias("n_distinct"),
        (F.max("col_idx") + 1).alias("n_cols"),
    )
    left = F.min("label_x0").over(Window.partitionBy("table_id"))
    spaces = F.length(F.regexp_extract("label_raw", "^( +)", 1))
    indent = F.coalesce(F.bround(F.col("label_x0") - left).cast("int"), F.when(spaces > 0, spaces))
    return rows.select(
        "table_id", "row_idx", F.coalesce("label_clean", F.lit("")).alias("label"), label_text("label_raw").alias("label_norm"), alpha_text("label_raw").alias("label_alpha"),
        "n_filled", "n_numeric", "n_trailing", "n_value_like", "n_distinct", "n_cols", indent.alias("indent"),
    )


def body_starts(rows: DataFrame) -> DataFrame:
    """(table_id, anchor_row, body_start): the first labelled row with enough values, and the rows above that belong to it.

    A table without such a row gives none.
    """
    needed = F.when(F.col("n_cols") <= 3, 1).otherwise(F.greatest(F.lit(2), F.floor(F.col("n_trailing") * 0.6)))
    anchor = rows.where((F.col("label") != "") & (F.col("n_trailing") > 0) & (F.col("n_value_like") >= needed)).groupBy("table_id").agg(F.min("row_idx").alias("anchor_row"))
    joins = (F.col("label") != "") & (
        (F.col("n_trailing") == 0) | ((F.col("n_trailing") == 1) & (F.col("n_value_like") > 0))
        | ((F.col("n_trailing") > 1) & (F.col("n_value_like") == 0) & (F.col("n_distinct") <= F.greatest(F.lit(1), F.floor(F.col("n_trailing") / 2))))
    )
    above = rows.join(anchor, "table_id").where(F.col("row_idx") < F.col("anchor_row"))
    stop = above.groupBy("table_id").agg(F.max(F.when(~joins, F.col("row_idx"))).alias("last_header"), F.min("row_idx").alias("first_row"))
    return anchor.join(stop, "table_id", "left").select("table_id", "anchor_row", F.coalesce(F.col("last_header") + 1, "first_row", "anchor_row").cast("int").alias("body_start"))


def header_labels(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """(table_id, col_idx, header, n_cols): the header cells of each column, top to bottom. Columns without one have ''."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("row_idx") < F.col("body_start")) & (F.col("clean") != ""), F.struct("row_idx", "clean")))), lambda x: x["clean"]), " ")
    placed = cells.select(*KEY, "clean").join(starts.select("table_id", "body_start"), "table_id")
    labels = placed.groupBy("table_id", "col_idx").agg(parts.alias("header"))
    return labels.withColumn("n_cols", (F.max("col_idx").over(Window.partitionBy("table_id")) + 1).cast("int"))


def column_roles(headers: DataFrame) -> DataFrame:
    """Adds match_text, role and confidence: p_value, smd, overall, comparison_group, group or unknown, first hit."""
    m, low = F.col("match_text"), F.lower("header")
    last, near = F.col("col_idx") == F.col("n_cols") - 1, F.col("col_idx") >= F.greatest(F.lit(0), F.col("n_cols") - 2)
    is_p = m.rlike("^p(?: *value| +for +trend| *trend)?$") & ~((m == "p") & ~near)
    # The ladder of roles and their confidences.
    rules: list[tuple[Column, str, Column]] = [
        (F.col("header") == "", "unknown", F.lit(0.4)),
        (is_p, "p_value", F.when(last, 0.98).when(near, 0.94).otherwise(0.85)),
        (low.contains("smd"), "smd", F.lit(0.98)),
        (low.contains("overall") | low.isin("all", "total"), "overall", F.lit(0.95)),
        (low.isin("control", "controls"), "comparison_group", F.lit(0.92)),
        (low.isin("case", "cases"), "group", F.lit(0.92)),
        (low.startswith("q") & (F.length(low) <= 3), "group", F.lit(0.8)),
        (low.contains("(") & low.rlike(r"\bn *="), "group", F.lit(0.78)),
    ]
    role, confidence = F.lit("unknown"), F.lit(0.45)
    for test, name, value in reversed(rules):
        role, confidence = F.when(test, name).otherwise(role), F.when(test, value).otherwise(confidence)
    denominator = F.replace(F.regexp_extract("header", r"(?i)\bn *= *([0-9][0-9,]*)", 1), F.lit(","), F.lit("")).try_cast("int")
    return headers.withColumn("match_text", header_match_text(F.col("header"))).withColumn("role", role).withColumn("confidence", confidence).withColumn("denominator", denominator)


def parsed_cells(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """Non-blank body cells beyond the label column with pattern, family and components."""
    body = cells.join(starts.select("table_id", "body_start"), "table_id").where((F.col("row_idx") >= F.col("body_start")) & (F.col("col_idx") > 0) & (F.col("clean") != ""))
    return with_components(body.select(*KEY, "text", "clean"), "text", "clean").withColumn("family", value_family(F.col("clean")))


def component(components: Column, kind: str) -> Column:
    """The first number of a kind among components, or null."""
    return F.try_element_at(F.filter(components, lambda x: x["kind"] == kind), F.lit(1))["value_num"]


def value_records(parsed: DataFrame, variables: DataFrame, levels: DataFrame, roles: DataFrame) -> DataFrame:
    """Parsed cells tied to their variable and level and their column's role: one row per cell of a defined row."""
    own = variables.select("table_id", F.col("row_start").alias("row_idx"), "variable_id", F.lit(None).cast("long").alias("level_id"), "summary_style_hint").distinct()
    of_level = levels.select("table_id", "row_idx", "variable_id", "level_id").distinct().join(variables.select("variable_id", "summary_style_hint").distinct(), "variable_id").select("table_id", "row_idx", "variable_id", "level_id", "summary_style_hint")
    keys = own.unionByName(of_level)
    return parsed.join(keys, ["table_id", "row_idx"]).join(roles.select("table_id", "col_idx", "role", "denominator"), ["table_id", "col_idx"], "left")


def count_percent_audit(records: DataFrame, tolerance_all: float = 2.0, tolerance_group: float = 3.0) -> DataFrame:
    """Per variable and column with all levels parsed: the sum of percents, what is expected, and whether it agrees.

    The first column that isn't a statistic is compared with 100 if it is an overall column; the others with their
    share of its denominator. Without an overall column, or a denominator, nothing is expected and verdict is null.
    """
    levels = records.where("level_id is not null and summary_style_hint = 'count_pct' and coalesce(role, 'unknown') not in ('p_value', 'smd')")
    sums = levels.withColumn("percent", component(F.col("components"), "percent")).groupBy("table_id", "variable_id", "col_idx", "role", "denominator").agg(
        F.sum("percent").alias("percent_sum"), F.count("percent").alias("n_parsed"), F.countDistinct("row_idx").alias("n_levels"), F.count("*").alias("n_cells")
    )
    whole = sums.where("n_parsed = n_levels and n_cells = n_levels")
    overall = records.where("role = 'overall' and col_idx = 1").groupBy("table_id").agg(F.max("denominator").alias("overall_n"))
    expected = F.when((F.col("role") == "overall") & (F.col("col_idx") == 1), 100.0).otherwise(F.col("denominator") / F.nullif(F.col("overall_n"), F.lit(0)) * 100.0)
    near = F.when((F.col("role") == "overall") & (F.col("col_idx") == 1), tolerance_all).otherwise(tolerance_group)
    return whole.join(overall, "table_id", "left").withColumn("expected", expected).withColumn("agrees", F.abs(F.col("percent_sum") - F.col("expected")) <= near).select("table_id", "variable_id", "col_idx", "role", "percent_sum", "expected", "agrees")
