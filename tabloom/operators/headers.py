"""Header and body of a printed grid, header trees, captions, and grids that hold no table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Identifier of a table, verbs that make a line that begins with it prose, and notes on continuation.
TABLE_ID = r"[A-Za-z0-9.]*\d[A-Za-z0-9]*(?:\.[A-Za-z0-9]+)*"
PROSE_VERBS = (
    "display displays show shows present presents describe describes illustrate illustrates report reports list lists contain contains "
    "summarize summarizes compare compares demonstrate demonstrates highlight highlights detail details examine examines provide provides "
    "give gives outline outlines depict depicts indicate indicates reveal reveals"
)
CAPTION_LINE = rf"(?i)^\s*table\s*({TABLE_ID})\b(?:\s*[:.])?"
CONTINUED = r"(?i)^(?:\(\s*continued\s*\)|continued(?:\s|\b|$))"
PAGE_NOTE = rf"(?i)(?:^\s*(?:table\s+{TABLE_ID}\s*)?\(?\s*(?:cont\.?|continued\.?)\s*\)?\s*$|\b(?:cont\.?|continued|continues?)\b.*\b(?:previous|next)\s+page\b|\b(?:previous|next)\s+page\b.*\b(?:cont\.?|continued|continues?)\b)"
VALUE_TEXT = r"^(?:[<>]=?\s*)?[\d.,/%()\-+±\s]+$"


def header_split(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """(table_id, row_idx, role, source): header, preamble, body or blank for each row of the grid.

    Above the body, filled rows are header rows; the first of them are preamble while they hold a label, at most two
    filled cells, and a fuller row follows. A table without a row of values is all body, ``unclassified``.
    """
    own = Window.partitionBy("table_id")
    split = rows.join(starts.select("table_id", "body_start"), "table_id", "left").withColumn("width", F.max("n_cols").over(own))
    split = split.withColumn("is_head", F.col("body_start").isNotNull() & (F.col("row_idx") < F.col("body_start")) & (F.col("n_filled") > 0))
    order = Window.partitionBy("table_id", "is_head").orderBy("row_idx")
    fuller = F.max("n_filled").over(order.rowsBetween(1, Window.unboundedFollowing)) >= F.greatest(F.lit(3), F.floor(F.col("width") / 2))
    led = split.withColumn("leads", F.coalesce((F.col("label") != "") & (F.col("n_filled") <= 2) & fuller, F.lit(False)))
    led = led.withColumn("so_far", F.min(F.col("leads").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    role = (
        F.when(F.col("body_start").isNull(), F.when(F.col("n_filled") > 0, "body").otherwise("blank"))
        .when(F.col("row_idx") >= F.col("body_start"), "body").when(~F.col("is_head"), "blank").when(F.col("so_far"), "preamble").otherwise("header")
    )
    source = F.when(F.col("body_start").isNull(), "unclassified").otherwise("value_anchor")
    return led.select("table_id", "row_idx", role.alias("role"), source.alias("source"))


def header_schema(cells: DataFrame, split: DataFrame) -> DataFrame:
    """(table_id, kind, row_idx, col_start, col_end, label): the leaves and groups of each table's header.

    The lowest filled cell over a column is its leaf; a filled cell further up is a group over the columns up to the next
    filled cell of its row, or only its own column in column 0. Tables without a header row have no rows.
    """
    heads = cells.join(split.where("role = 'header'").select("table_id", "row_idx"), ["table_id", "row_idx"])
    width = Window.partitionBy("table_id")
    filled = heads.withColumn("last_col", F.max("col_idx").over(width)).where("clean <> ''")
    after = F.lead("col_idx").over(Window.partitionBy("table_id", "row_idx").orderBy("col_idx"))
    end = F.when(F.col("col_idx") == 0, F.lit(0)).otherwise(F.coalesce(after - 1, F.col("last_col")))
    low = F.max("row_idx").over(Window.partitionBy("table_id", "col_idx"))
    spans = filled.withColumn("col_end", end).withColumn("is_leaf", F.col("row_idx") == low)
    return spans.select("table_id", F.when(F.col("is_leaf"), "leaf").otherwise("group").alias("kind"), "row_idx", F.col("col_idx").alias("col_start"), F.when(F.col("is_leaf"), F.col("col_idx")).otherwise(F.col("col_end")).cast("int").alias("col_end"), F.col("clean").alias("label"))


def header_paths(schema: DataFrame) -> DataFrame:
    """(table_id, col_idx, n_groups, path): each leaf with the groups over it from the top down, joined by `` > ``."""
    leaves = schema.where("kind = 'leaf'").select("table_id", F.col("row_idx").alias("leaf_row"), F.col("col_start").alias("col_idx"), F.col("label").alias("leaf"))
    covers = schema.where("kind = 'group'").select("table_id", "row_idx", F.explode(F.sequence("col_start", "col_end")).alias("col_idx"), "label")
    over = covers.join(leaves.select("table_id", "col_idx", "leaf_row"), ["table_id", "col_idx"]).where("row_idx < leaf_row")
    groups = over.groupBy("table_id", "col_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "label"))).alias("groups"))
    joined = leaves.join(groups, ["table_id", "col_idx"], "left")
    path = F.concat(F.transform(F.coalesce("groups", F.array().cast("array<struct<row_idx:int,label:string>>")), lambda g: g["label"]), F.array("leaf"))
    return joined.select("table_id", "col_idx", (F.size(path) - 1).alias("n_groups"), F.array_join(path, " > ").alias("path"))


def header_levels(schema: DataFrame) -> DataFrame:
    """Adds level: the place of a header row among those of its table, from the top."""
    return schema.withColumn("level", F.dense_rank().over(Window.partitionBy("table_id").orderBy("row_idx")))


def caption_parts(line: Column) -> tuple[Column, Column]:
    """(number, is_continuation) of a line that begins like a caption; both null for prose and other lines."""
    number = F.nullif(F.regexp_extract(line, CAPTION_LINE, 1), F.lit(""))
    rest = F.trim(F.regexp_replace(line, CAPTION_LINE, ""))
    continued = rest.rlike(CONTINUED)
    prose = ~continued & rest.rlike(rf"(?i)^(?:{'|'.join(PROSE_VERBS.split())})\b")
    kept = line.isNotNull() & (number != "") & ~prose
    return F.when(kept, number), F.when(kept, continued)


def aligned_captions(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """(page, table_id, caption): a table's own caption, else that of its page's caption lines which stands in its place.

    ``tables``: page, place, table_id, caption; ``captions``: page, place, caption. With fewer lines than tables the last
    tables get them; without any a table has no caption.
    """
    sizes = tables.groupBy("page").agg(F.count("*").alias("n_tables"))
    lines = captions.withColumn("at", F.row_number().over(Window.partitionBy("page").orderBy("place")) - 1)
    counts = lines.groupBy("page").agg(F.count("*").alias("n_lines"))
    ranked = tables.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("place")) - 1).join(sizes, "page").join(counts, "page", "left")
    placed = ranked.withColumn("at", F.col("rank") - F.greatest(F.col("n_tables") - F.coalesce("n_lines", F.lit(0)), F.lit(0)))
    return placed.join(lines.select("page", "at", F.col("caption").alias("line")), ["page", "at"], "left").select("page", "table_id", F.coalesce(F.nullif("caption", F.lit("")), "line").alias("caption"))


def _value_cell(clean: Column) -> Column:
    return clean.rlike(VALUE_TEXT) & clean.rlike("[0-9]")


def trailing_notes(cells: DataFrame) -> DataFrame:
    """(table_id, start_row, n_removed): rows at a table's end that only say it goes on on another page, with one blank row above."""
    rows = cells.groupBy("table_id", "row_idx").agg(
        F.count_if(F.col("clean") != "").alias("n_filled"), F.count_if((F.col("col_idx") > 0) & _value_cell(F.col("clean"))).alias("n_values"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("clean") != "", F.struct("col_idx", "clean")))), lambda x: x["clean"]), " ").alias("line"),
    )
    note = (F.col("n_filled") > 0) & (F.col("n_filled") <= 3) & (F.col("n_values") == 0) & F.col("line").rlike(PAGE_NOTE)
    up = Window.partitionBy("table_id").orderBy(F.desc("row_idx"))
    marked = rows.withColumn("note", note).withColumn("is_suffix", F.min(F.col("note").cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    below = F.lag("is_suffix").over(up)
    gone = marked.withColumn("gone", F.col("is_suffix") | (F.coalesce(below, F.lit(False)) & (F.col("n_filled") == 0))).where("gone")
    return gone.groupBy("table_id").agg(F.min("row_idx").alias("start_row"), F.count("*").alias("n_removed"))


def prose_grids(cells: DataFrame) -> DataFrame:
    """(table_id, n_value_cells, n_prose, n_compact, is_prose): grids whose value cells read as running text."""
    value = (F.col("col_idx") > 0) & (F.col("clean") != "")
    words = F.size(F.regexp_extract_all("clean", F.lit("([A-Za-z]{2,})"), F.lit(1)))
    prose = (words >= 3) | ((words >= 2) & F.col("clean").rlike("[.!?;:]"))
    seen = cells.groupBy("table_id").agg(
        F.countDistinct("row_idx").alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"), F.count_if(value).alias("n_value_cells"), F.count_if(value & prose).alias("n_prose"), F.count_if(value & _value_cell(F.col("clean"))).alias("n_compact")
    )
    n = F.col("n_value_cells")
    is_prose = (F.col("n_rows") >= 4) & (F.col("n_cols") >= 3) & (n >= 6) & (F.col("n_prose") >= 0.35 * n) & (F.col("n_compact") < 0.5 * n)
    return seen.select("table_id", "n_value_cells", "n_prose", "n_compact", is_prose.alias("is_prose"))


def text_only_grids(cells: DataFrame, rows: DataFrame, starts: DataFrame, profiles: DataFrame, variables: DataFrame) -> DataFrame:
    """(table_id, n_cells, n_text, n_values, is_text_only): captioned grids of words without variables or a known family.

    ``cells`` carry ``family``; ``profiles``: table_id, has_signal, table_family. Rows of the whole grid are looked at.
    """
    body = rows.join(starts.select("table_id", "body_start"), "table_id", "left").groupBy("table_id").agg(F.count_if((F.col("row_idx") >= F.coalesce("body_start", F.lit(0))) & (F.col("body_start").isNotNull() | (F.col("n_filled") > 0))).alias("n_body"))
    shown = cells.where(F.col("clean").rlike(r"[\p{L}\p{N}]")).groupBy("table_id").agg(
        F.count("*").alias("n_cells"), F.count_if(F.col("col_idx") > 0).alias("n_trailing"), F.count_if(F.col("clean").rlike("[A-Za-z]") & (F.length("clean") >= 3)).alias("n_text"), F.count_if(F.col("family") != "unknown").alias("n_values")
    )
    width = rows.groupBy("table_id").agg(F.max("n_cols").alias("n_cols"))
    defined = variables.select("table_id").distinct().withColumn("has_variables", F.lit(True))
    joined = shown.join(body, "table_id").join(width, "table_id").join(profiles, "table_id", "left").join(defined, "table_id", "left")
    open_case = F.coalesce(F.col("has_signal"), F.lit(False)) & (F.coalesce("table_family", F.lit("unknown")) == "unknown") & F.col("has_variables").isNull()
    size = (F.col("n_cols") >= 2) & (F.col("n_body") >= 2) & (F.col("n_cells") >= 6) & (F.col("n_trailing") >= F.greatest(F.lit(3), F.col("n_body")))
    words = (F.col("n_text") >= 0.8 * F.col("n_cells")) & (F.col("n_values") <= F.greatest(F.lit(1), F.floor(F.col("n_cells") * 0.15)))
    return joined.select("table_id", "n_cells", "n_text", "n_values", (open_case & size & words).alias("is_text_only"))


def canonical_box(box: Column, orientation: Column, frame: Column) -> Column:
    """A box in the frame of its upright text: turned where the text runs up or down the page, else as it is."""
    turned = lambda *sides: F.struct(*[s.alias(n) for s, n in zip(sides, ("x0", "y0", "x1", "y1"))])
    up = turned(frame["y1"] - box["y1"], box["x0"] - frame["x0"], frame["y1"] - box["y0"], box["x1"] - frame["x0"])
    down = turned(box["y0"] - frame["y0"], frame["x1"] - box["x1"], box["y1"] - frame["y0"], frame["x1"] - box["x0"])
    return F.when(orientation == "vertical_text_up", up).when(orientation == "vertical_text_down", down).otherwise(box)
