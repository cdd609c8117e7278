"""Levels, profiles, candidate scores, referential checks and quality items of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.headers import caption_parts

# Words that tell descriptive tables, estimates, models and effect measures.
DESCRIPTIVE = r"(?i)\b(?:baseline|characteristics?|clinical characteristics|demographic)\b"
ESTIMATE = r"(?i)\b(?:hazard ratio|odds ratio|relative risk|risk ratio|association|regression|multivariable|cox|logistic|linear)\b"
MODEL = r"(?i)\b(?:adjusted|unadjusted|model *[0-9]+)\b"
EFFECT = r"(?i)\b(?:hazard ratio|odds ratio|relative risk|risk ratio|95% *ci|confidence interval|hr\b|or\b|rr\b)\b"
SUMMARY = r"(?i)\b(?:mean|sd|median|iqr|range|min|max)\b"
GROUPED_BY = r"(?i)\b(?:stratified +)?by +(.+?)(?:[.;]|$)"
#: An estimate with its interval and note marks.
ESTIMATE_INTERVAL = r"(?i)^-?[0-9]+(?:\.[0-9]+)? *,? *[(\[] *-?[0-9]+(?:\.[0-9]+)? *[,-] *-?[0-9]+(?:\.[0-9]+)? *[)\]] *(?:[*†‡§¶#{}|]+|[a-z])*$"
RECOGNISED = ["count_pct", "mean_sd", "median_iqr", "n_only", "p_value"]


def likely_levels(cells: DataFrame, rows: DataFrame, roles: DataFrame) -> DataFrame:
    """(table_id, row_idx) of rows that read as levels: a short label over counts.

    ``cells`` carry ``family``. Statistic columns don't count. Every other filled cell is a count, a p value after a
    count, the percent that goes with a count before it, or a first cell before two counts.
    """
    stats = roles.where("role in ('p_value', 'smd')").select("table_id", "col_idx")
    kept = cells.where("col_idx > 0 and clean <> ''").join(stats, ["table_id", "col_idx"], "left_anti")
    w = Window.partitionBy("table_id", "row_idx").orderBy("col_idx")
    counts = F.col("family").isin("count_pct", "n_only")
    seen = kept.withColumn("is_count", counts).withColumn("at", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum(counts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy("table_id", "row_idx")
    seen = seen.withColumn("n", F.count("*").over(whole)).withColumn("n_counts", F.sum(counts.cast("int")).over(whole)).withColumn("previous", F.lag("family").over(w))
    rest = F.col("n_counts") - F.col("is_count").cast("int")
    good = (
        F.col("is_count")
        | ((F.col("family") == "p_value") & (F.col("before") >= 1))
        | ((F.col("previous") == "n_only") & F.col("clean").rlike(r"^\( *[0-9]+(?:\.[0-9]+)?% *\)$"))
        | ((F.col("at") == 1) & (F.col("n") >= 3) & (rest >= 2))
    )
    all_good = seen.withColumn("good", F.coalesce(good, F.lit(False))).groupBy("table_id", "row_idx").agg(F.bool_and("good").alias("good"), F.max("n_counts").alias("n_counts")).where("good and n_counts > 0")
    named = rows.where((F.col("label_norm") != "") & (F.size(F.split("label_norm", " ")) <= 4) & (F.length("label_norm") <= 32) & ~F.col("label").contains(",") & ~F.col("label").rlike(SUMMARY) & (F.col("n_numeric") > 0))
    return named.join(all_good, ["table_id", "row_idx"], "left_semi").select("table_id", "row_idx")


def scalar_count_rows(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """(table_id, row_idx) of rows with a label of at most two words and sixteen letters over whole numbers only."""
    whole = cells.where("col_idx > 0 and clean <> ''").groupBy("table_id", "row_idx").agg(F.bool_and(F.col("clean").rlike("^[0-9]+$")).alias("whole")).where("whole")
    short = rows.where((F.col("label_norm") != "") & (F.size(F.split("label_norm", " ")) <= 2) & (F.length("label_norm") <= 16))
    return short.join(whole, ["table_id", "row_idx"], "left_semi").select("table_id", "row_idx")


def table_profiles(tables: DataFrame, cells: DataFrame, roles: DataFrame, levels: DataFrame) -> DataFrame:
    """Per table the descriptive and estimate scores, the family, and its confidence. ``cells`` carry ``family``.

    Points and confidences are fixed values, the latter in hundredths so that sums are exact.
    """
    caption = tables.groupBy("table_id").agg(F.coalesce(F.min("caption"), F.lit("")).alias("caption"))
    heads = roles.groupBy("table_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "header"))), lambda x: x["header"]), " ").alias("headers"),
        F.bool_or(F.col("role").isin("overall", "group", "comparison_group")).alias("has_group"), F.count_if(F.col("role") == "p_value").alias("n_p_columns"),
    )
    body = cells.where("col_idx > 0 and clean <> ''").groupBy("table_id").agg(
        F.count_if(F.col("family").isin("count_pct", "mean_sd", "median_iqr", "n_only")).alias("n_descriptive"), F.count_if(F.col("family") == "count_pct").alias("n_count_pct"), F.count_if(F.col("family") == "p_value").alias("n_p"),
        F.count_if(F.col("clean").rlike(ESTIMATE_INTERVAL)).alias("n_intervals"),
    )
    with_levels = levels.select("table_id").distinct().withColumn("has_levels", F.lit(True))
    t = caption.join(heads, "table_id", "left").join(body, "table_id", "left").join(with_levels, "table_id", "left").fillna({"headers": "", "n_p_columns": 0, "n_descriptive": 0, "n_count_pct": 0, "n_p": 0, "n_intervals": 0}).fillna({"has_group": False, "has_levels": False})
    one = lambda test, points: F.when(test, points).otherwise(0)
    context = F.concat_ws(" ", "caption", "headers")
    descriptive = one(F.col("caption").rlike(DESCRIPTIVE), 2) + one(F.col("n_descriptive") >= 2, 1) + one(F.col("n_count_pct") >= 2, 1) + one(F.col("has_levels"), 2) + one(F.col("has_group"), 1)
    estimate = one(context.rlike(ESTIMATE), 2) + one(F.col("headers").rlike(EFFECT), 1) + one(F.col("headers").rlike(MODEL), 1) + one(F.col("n_intervals") >= 2, 2) + one((F.col("n_p_columns") >= 1) & (F.col("n_p") >= 2), 1)
    t = t.withColumn("descriptive", descriptive).withColumn("estimate", estimate)
    d, e = F.col("descriptive"), F.col("estimate")
    family = F.when((e >= 4) & (e > d), "estimate_results").when((d >= 3) & (d >= e), "descriptive_characteristics").otherwise("unknown")
    points = F.when(family == "unknown", F.least(F.lit(75), 35 + 5 * F.greatest(d, e))).otherwise(F.least(F.lit(98), 55 + 8 * F.greatest(d, e) + 3 * F.abs(d - e)))
    return t.select("table_id", "descriptive", "estimate", family.alias("family"), (points / 100).alias("confidence"))


# What each sign adds to the likelihood that a grid is a table.
CAPTION, TABLE_ONE, TEXT_STUB, NUMBERS, RECTANGLE, SHAPE = 0.4, 0.05, 0.25, 0.2, 0.1, 0.05


def candidate_scores(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Per table how much it looks like one, from 0 to 1: caption, Table 1, text stub, numeric body, rectangular, shape.

    Without a caption of its own the first line of the first cell may be one.
    """
    first = cells.where("row_idx = 0 and col_idx = 0").select("table_id", F.trim(F.element_at(F.split(F.trim("text"), "\n"), 1)).alias("first_line"))
    caption = tables.groupBy("table_id").agg(F.min("caption").alias("caption")).join(first, "table_id", "left")
    line = F.coalesce(F.nullif(F.col("caption"), F.lit("")), F.col("first_line"))
    lines = F.transform(F.split(line, "\n"), lambda x: caption_parts(F.trim(x))[0])
    number = F.get(F.array_compact(lines), F.lit(0))
    rows = cells.groupBy("table_id", "row_idx").agg(F.count("*").alias("n_cells"))
    shape = rows.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.max("n_cells").alias("n_cols"), (F.min("n_cells") == F.max("n_cells")).alias("rectangular"))
    filled = F.col("clean") != ""
    stub, body = filled & (F.col("col_idx") == 0), filled & (F.col("col_idx") > 0)
    shares = cells.groupBy("table_id").agg(
        (F.count_if(stub & F.col("clean").rlike("[A-Za-z]")) / F.nullif(F.count_if(stub), F.lit(0))).alias("text_share"), (F.count_if(body & F.col("clean").rlike("[0-9]")) / F.nullif(F.count_if(body), F.lit(0))).alias("number_share")
    )
    t = caption.withColumn("number", number).join(shape, "table_id", "left").join(shares, "table_id", "left")
    one = lambda test, worth: F.when(test, worth).otherwise(0.0)
    score = (
        one(F.col("number").isNotNull(), CAPTION) + one(F.col("number") == "1", TABLE_ONE) + one(F.col("text_share") >= 0.6, TEXT_STUB) + one(F.col("number_share") >= 0.5, NUMBERS)
        + one(F.col("rectangular"), RECTANGLE) + one((F.col("n_rows") >= 2) & (F.col("n_cols") >= 2), SHAPE)
    )
    return t.select("table_id", F.round(F.least(F.lit(1.0), score), 4).alias("score"))


def quality_items(cells: DataFrame, rows: DataFrame, roles: DataFrame, starts: DataFrame) -> DataFrame:
    """(table_id, col_idx, severity, code): what is doubtful about a table's columns (col_idx -1: about the table).

    ``cells`` carry ``family``; only body cells beyond the label column count.
    """
    body = cells.join(starts.select("table_id", "body_start"), "table_id").where("row_idx >= body_start and col_idx > 0")
    known = F.col("family").isin(RECOGNISED)
    columns = body.groupBy("table_id", "col_idx").agg(F.count("*").alias("n"), F.count_if(F.col("clean") != "").alias("n_filled"), F.count_if((F.col("clean") != "") & known).alias("n_known"), F.count_if((F.col("clean") != "") & (F.col("family") == "p_value")).alias("n_p"))
    judged = columns.join(roles.select("table_id", "col_idx", "role"), ["table_id", "col_idx"], "left")
    item = lambda severity, code: F.struct(severity.alias("severity") if not isinstance(severity, str) else F.lit(severity).alias("severity"), F.lit(code).alias("code"))
    p_share, known_share = F.col("n_p") / F.nullif(F.col("n_filled"), F.lit(0)), F.col("n_known") / F.nullif(F.col("n_filled"), F.lit(0))
    found = F.array_compact(
        F.array(
            F.when(1 - F.col("n_filled") / F.col("n") > 0.85, item("warning", "mostly_empty_column")),
            F.when((F.col("n_filled") > 0) & (F.col("role") == "p_value") & (p_share < 0.3), item("error", "invalid_p_value_column")),
            F.when((F.col("n_filled") > 0) & (F.col("role") == "p_value") & (p_share >= 0.3) & (p_share < 0.6), item("warning", "weak_p_value_column")),
            F.when((F.col("n_filled") > 0) & F.col("role").isin("overall", "group", "comparison_group") & (known_share < 0.4), item(F.when(known_share >= 0.2, "warning").otherwise("error"), "non_numeric_statistical_column")),
        )
    )
    of_columns = judged.select("table_id", "col_idx", F.explode(found).alias("i")).select("table_id", "col_idx", "i.severity", "i.code")
    totals = columns.groupBy("table_id").agg(F.sum("n_filled").alias("n"), F.sum("n_known").alias("known")).where("n >= 6")
    share = F.col("known") / F.col("n")
    of_tables = totals.where(share < 0.5).select("table_id", F.lit(-1).alias("col_idx"), F.when(share < 0.25, "error").otherwise("warning").alias("severity"), F.when(share < 0.25, "low_value_pattern_recognition").otherwise("weak_value_pattern_recognition").alias("code"))
    unlabelled = rows.join(starts, "table_id").where("row_idx >= body_start and label = '' and n_trailing > 0").select("table_id", F.lit(-1).alias("col_idx"), F.lit("warning").alias("severity"), F.lit("missing_label_with_values").alias("code"))
    return of_columns.unionByName(of_tables).unionByName(unlabelled.distinct())


def definition_faults(variables: DataFrame, levels: DataFrame, cells: DataFrame) -> DataFrame:
    """(kind, record_id, fault): variables and levels whose rows aren't in their table, or lie outside their variable."""
    rows = cells.select("table_id", "row_idx").distinct()
    starts = variables.select("variable_id", "table_id", F.col("row_start").alias("row_idx")).distinct().join(rows, ["table_id", "row_idx"], "left_anti").select(F.lit("variable").alias("kind"), F.col("variable_id").alias("record_id"), F.lit("no_row").alias("fault"))
    gone = levels.select("level_id", "table_id", "row_idx").distinct().join(rows, ["table_id", "row_idx"], "left_anti").select(F.lit("level").alias("kind"), F.col("level_id").alias("record_id"), F.lit("no_row").alias("fault"))
    own = variables.select("variable_id", F.col("table_id").alias("own_table"), "row_start", "row_end").distinct()
    outside = levels.select("level_id", "variable_id", "table_id", "row_idx").distinct().join(own, "variable_id", "left")
    wrong = outside.where("own_table is null or own_table <> table_id or row_idx < row_start or row_idx > row_end").select(F.lit("level").alias("kind"), F.col("level_id").alias("record_id"), F.when(F.col("own_table").isNull(), "no_variable").otherwise("outside_variable").alias("fault"))
    return starts.unionByName(gone).unionByName(wrong).distinct()


def value_faults(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Parsed values without a cell at their place."""
    keys = values.select(F.col("source_table_id").alias("table_id"), "row_idx", "col_idx").distinct()
    return keys.join(cells.select("table_id", "row_idx", "col_idx").distinct(), ["table_id", "row_idx", "col_idx"], "left_anti")


def grouping(tables: DataFrame, roles: DataFrame) -> DataFrame:
    """Per column its part of the layout (label, statistic, overall, group), the group's order, and what the caption groups by."""
    caption = tables.groupBy("table_id").agg(F.min("caption").alias("caption"))
    by = F.nullif(F.trim(F.regexp_extract("caption", GROUPED_BY, 1)), F.lit(""))
    low = F.lower("header")
    part = F.when(F.col("col_idx") == 0, "label").when(F.col("role").isin("p_value", "smd"), "statistic").otherwise("data")
    marked = roles.withColumn("part", part).withColumn("wide", (F.col("part") == "data") & ((F.col("role") == "overall") | low.isin("overall", "all", "total", "total population", "full cohort")))
    first = F.min(F.when(F.col("wide"), F.col("col_idx"))).over(Window.partitionBy("table_id"))
    parts = marked.withColumn("part", F.when(F.col("part") != "data", F.col("part")).when(F.col("col_idx") == first, "overall").otherwise("group"))
    seen = parts.withColumn("first_at", F.min("col_idx").over(Window.partitionBy("table_id", "part", F.lower("header"))))
    order = F.dense_rank().over(Window.partitionBy("table_id", "part").orderBy("first_at"))
    return seen.withColumn("level_order", F.when(F.col("part") == "group", order)).join(caption, "table_id").select("table_id", "col_idx", "part", "level_order", by.alias("grouping_label"))
