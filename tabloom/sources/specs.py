"""Table specifications: reading, display rows, expected records and HTML, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.text import slug

SCHEMA = """
document_title string, subtitle string, paragraphs array<string>, table_caption string, columns array<string>,
rows array<struct<type: string, label: string, values: array<string>, levels: array<struct<label: string, values: array<string>>>>>,
footnotes array<string>,
layout struct<indent_levels: boolean, horizontal_rules: boolean, parent_rows_with_values: boolean, wrapped_labels: boolean>
"""
ROW_TYPES = ["continuous", "categorical", "categorical_inline", "section_header"]


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """One row per specification file. Raises at run time for a specification without title, caption or columns, or with an unknown row type."""
    specs = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("spec", F.input_file_name())
    whole = F.col("document_title").isNotNull() & F.col("table_caption").isNotNull() & (F.size("columns") > 0)
    known = F.forall(F.coalesce("rows", F.array().cast(specs.schema["rows"].dataType)), lambda r: r["type"].isin(ROW_TYPES))
    return specs.where(F.assert_true(F.coalesce(whole & known, F.lit(False)), "not a table specification").isNull())


def display_rows(specs: DataFrame) -> DataFrame:
    """spec, body_row_idx, row_type, label, values, variable_name, level_label, parent_label, indent_level."""
    rows = specs.select("spec", "layout", F.posexplode("rows").alias("at", "r"))
    empty = F.array().cast("array<string>")
    layout = lambda name, default: F.coalesce(F.col(f"layout.{name}"), F.lit(default))
    kind = F.when(F.col("r.type") == "categorical", "categorical_parent").otherwise(F.col("r.type"))
    shown = F.when(F.col("r.type") == "section_header", empty).when((F.col("r.type") == "categorical") & ~layout("parent_rows_with_values", False), empty).otherwise(F.coalesce("r.values", empty))
    nothing = F.lit(None).cast("string")
    own = rows.select("spec", "at", F.lit(-1).alias("sub"), kind.alias("row_type"), F.col("r.label").alias("label"), shown.alias("values"), slug(F.trim("r.label")).alias("variable_name"), nothing.alias("level_label"), nothing.alias("parent_label"), F.lit(0).alias("indent_level"))
    levels = rows.where("r.type = 'categorical'").select("spec", "at", "layout", "r.label", F.posexplode("r.levels").alias("sub", "l"))
    below = levels.select("spec", "at", "sub", F.lit("level").alias("row_type"), F.col("l.label").alias("label"), F.coalesce("l.values", empty).alias("values"), slug(F.trim("label")).alias("variable_name"), F.col("l.label").alias("level_label"), F.col("label").alias("parent_label"), F.when(layout("indent_levels", True), 1).otherwise(0).alias("indent_level"))
    from pyspark.sql import Window

    return own.unionByName(below).withColumn("body_row_idx", F.row_number().over(Window.partitionBy("spec").orderBy("at", "sub")) - 1).drop("at", "sub")


def value_records(specs: DataFrame) -> DataFrame:
    """Expected records: spec, body_row_idx, table_row_idx, col_idx, column_name, variable_name, level_label, raw_value. The header is row 0."""
    cells = display_rows(specs).select("spec", "body_row_idx", "variable_name", "level_label", F.posexplode("values").alias("pos", "raw_value"))
    names = specs.select("spec", F.posexplode("columns").alias("col_idx", "column_name"))
    placed = cells.withColumn("col_idx", F.col("pos") + 1).withColumn("table_row_idx", F.col("body_row_idx") + 1).drop("pos")
    return placed.join(names, ["spec", "col_idx"], "left")


def to_html(specs: DataFrame) -> DataFrame:
    """(spec, html): each specification as one table in a page; text is escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), esc(c), F.lit(f"</{name}>"))
    rows = display_rows(specs).join(specs.select("spec", F.size("columns").alias("n")), "spec")
    padded = F.slice(F.concat("values", F.array_repeat(F.lit(""), F.greatest(F.col("n"), F.lit(1)))), F.lit(1), F.col("n") - 1)
    line = F.concat(F.lit("<tr class=\""), F.col("row_type"), F.lit("\">"), tag("td", F.col("label")), F.array_join(F.transform(padded, lambda v: tag("td", v)), ""), F.lit("</tr>"))
    body = rows.select("spec", "body_row_idx", line.alias("line")).groupBy("spec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("body_row_idx", "line"))), lambda x: x["line"]), "").alias("body"))
    head = F.array_join(F.transform("columns", lambda c: tag("th", c)), "")
    notes = F.array_join(F.transform(F.coalesce("footnotes", F.array().cast("array<string>")), lambda n: tag("li", n)), "")
    paragraphs = F.array_join(F.transform(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda p: tag("p", p)), "")
    html = F.concat(F.lit("<!doctype html><html><body>"), tag("h1", F.col("document_title")), paragraphs, tag("caption", F.col("table_caption")), F.lit("<table><thead><tr>"), head, F.lit("</tr></thead><tbody>"), F.coalesce("body", F.lit("")), F.lit("</tbody></table><ul>"), notes, F.lit("</ul></body></html>"))
    return specs.join(body, "spec", "left").select("spec", html.alias("html"))
