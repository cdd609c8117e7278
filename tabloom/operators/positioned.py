"""Positioned items of pages, read as tidy tables: words spelled from characters, rules, masks, space widths and character bands.

Columns: paper_id, page_num, x0, y0, x1, y1 and, by kind, text, char_index, block, line, font, size. Items meet regions of
their own page only, by an equality on paper and page; a page's items are as many as fit on one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["paper_id", "page_num"]
#: How far a character may stand out of its word, how far rules of one line lie apart, the gap that parts them, and the share of a width that a full rule covers.
LOOSE, SAME_RULE, GAP, FULL = 0.5, 3.0, 3.0, 0.8


def chars_from_symbols(chars: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """Characters of symbol fonts as the signs they show. ``symbols``: character to sign."""
    symbolic = F.lower(F.coalesce("font", F.lit(""))).rlike("symbol|dingbat")
    return chars.withColumn("text", F.when(symbolic, F.translate("text", "".join(symbols), "".join(symbols.values()))).otherwise(F.col("text")))


def spelled_words(words: DataFrame, chars: DataFrame) -> DataFrame:
    """Words with ``text`` spelled anew from the characters in their box, of the source line that fits best; else as they were.

    The best line spells the word exactly, else is nearest in length, else longest. ``words`` carry word_id.
    """
    c = chars.select(*PAGE, *[F.col(k).alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")], F.col("text").alias("c_text"), "char_index", F.col("block").alias("c_block"), F.col("line").alias("c_line"))
    inside = (F.col("c_x0") >= F.col("x0") - LOOSE) & (F.col("c_x1") <= F.col("x1") + LOOSE) & (F.col("c_y0") >= F.col("y0") - LOOSE) & (F.col("c_y1") <= F.col("y1") + LOOSE)
    met = words.select(*PAGE, "word_id", "x0", "y0", "x1", "y1", F.trim("text").alias("own")).join(c, PAGE).where(inside)
    spelled = met.groupBy(*PAGE, "word_id", "own", "c_block", "c_line").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_index", "c_text"))), lambda x: x["c_text"]), "")).alias("spelled")).where("spelled <> ''")
    rank = F.struct(F.col("c_block").isNotNull().alias("placed"), (F.col("spelled") == F.col("own")).alias("same"), (-F.abs(F.length("spelled") - F.length("own"))).alias("near"), F.length("spelled").alias("size"), "spelled")
    best = spelled.groupBy(*PAGE, "word_id").agg(F.max(rank).alias("best")).select(*PAGE, "word_id", F.col("best.spelled").alias("spelled"))
    return words.join(best, [*PAGE, "word_id"], "left").withColumn("text", F.coalesce("spelled", "text")).drop("spelled")


def line_records(words: DataFrame, id_prefix: str = "line") -> DataFrame:
    """Lines of a page from its words: line_id, text with single blanks, and the box around them, in reading order of block and line."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    lines = words.groupBy(*PAGE, "block", "line").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block", "line"))
    return lines.withColumn("line_id", F.concat_ws(":", F.lit(id_prefix), "page_num", place)).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


def rule_segments(drawings: DataFrame, thin: float = 1.5) -> DataFrame:
    """Horizontal rules among drawn boxes: those at most ``thin`` high and wider than high, with their middle ``y``."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    left, right = F.least("x0", "x1"), F.greatest("x0", "x1")
    return drawings.withColumn("y", (low + high) / 2).withColumn("left", left).withColumn("right", right).where((high - low <= thin) & (right - left > high - low))


def horizontal_rules(rules: DataFrame, regions: DataFrame, full_width: bool = False) -> DataFrame:
    """(region_id, y): rules across a region: segments near one height, whose running mean moves with each, that cover FULL of its width.

    ``rules``: those of rule_segments; ``regions``: region_id, paper_id, page_num, x0, y0, x1, y1. With ``full_width`` one
    unbroken piece has to reach near both edges.
    """
    r = regions.select("region_id", *PAGE, *[F.col(k).alias(f"r_{k}") for k in ("x0", "y0", "x1", "y1")])
    near = rules.select(*PAGE, "y", "left", "right").join(r, PAGE).where("y between r_y0 - 12 and r_y1 + 12").withColumn("left", F.greatest("left", "r_x0")).withColumn("right", F.least("right", "r_x1")).where("left < right")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = float(frame["r_x0"].iloc[0]), float(frame["r_x1"].iloc[0])
        width = max(1.0, high - low)
        groups: list[tuple[float, list[tuple[float, float]]]] = []
        for y, a, b in sorted(zip(frame["y"], frame["left"], frame["right"])):
            if groups and abs(y - groups[-1][0]) <= SAME_RULE:
                groups[-1] = ((groups[-1][0] + y) / 2, [*groups[-1][1], (a, b)])
            else:
                groups.append((y, [(a, b)]))
        kept = []
        for y, spans in groups:
            pieces: list[list[float]] = []
            for a, b in sorted(spans):
                if pieces and a <= pieces[-1][1] + (0.51 if full_width else GAP):
                    pieces[-1][1] = max(pieces[-1][1], b)
                else:
                    pieces.append([a, b])
            edge = max(8.0, width * 0.08)
            whole = any(b - a >= FULL * width and a <= low + edge and b >= high - edge for a, b in pieces)
            if whole if full_width else sum(b - a for a, b in pieces) >= FULL * width:
                kept.append(y)
        return pd.DataFrame({"region_id": frame["region_id"].iloc[:1].repeat(len(kept)).to_numpy(), "y": kept}).astype({"y": float})

    return near.groupBy("region_id").applyInPandas(fold, f"region_id {regions.schema['region_id'].dataType.simpleString()}, y double")


def recurring_rules(rules: DataFrame, pages: int = 3, share: float = 0.8) -> DataFrame:
    """(paper_id, left, right, y, n_pages): rules at one place on at least ``pages`` pages and ``share`` of the paper's."""
    n = rules.groupBy("paper_id").agg(F.countDistinct("page_num").alias("of"))
    spots = rules.groupBy("paper_id", F.round("left", 0).alias("left"), F.round("right", 0).alias("right"), F.round("y", 0).alias("y")).agg(F.countDistinct("page_num").alias("n_pages"))
    return spots.join(n, "paper_id").where((F.col("n_pages") >= pages) & (F.col("n_pages") >= share * F.col("of"))).drop("of")


def outside_regions(items: DataFrame, regions: DataFrame, how: str = "center") -> DataFrame:
    """Items that no region of their page takes: by their ``center``, wholly ``inside``, or any ``overlap`` in height."""
    r = regions.select(*[F.col(k).alias(f"r_{k}") for k in (*PAGE, "x0", "y0", "x1", "y1")])
    low, high, left, right = F.least("y0", "y1"), F.greatest("y0", "y1"), F.least("x0", "x1"), F.greatest("x0", "x1")
    same = (F.col("paper_id") == F.col("r_paper_id")) & (F.col("page_num") == F.col("r_page_num"))
    test = {
        "center": ((left + right) / 2).between(F.col("r_x0"), F.col("r_x1")) & ((low + high) / 2).between(F.col("r_y0"), F.col("r_y1")),
        "inside": (left >= F.col("r_x0")) & (right <= F.col("r_x1")) & (low >= F.col("r_y0")) & (high <= F.col("r_y1")),
        "overlap": F.least(high, F.col("r_y1")) > F.greatest(low, F.col("r_y0")),
    }[how]
    return items.join(r, same & test, "left_anti")


def outside_bibliography(items: DataFrame, entry_lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Characters or words that belong to no reference list: by block and line where they have them, then by their centre."""
    keyed = items.join(entry_lines.select(*PAGE, "block", "line").distinct(), [*PAGE, "block", "line"], "left_anti") if "block" in items.columns else items
    return outside_regions(keyed, regions, "center")


def space_widths(chars: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(font, size, n, width): how wide blanks are in each font and size, the middle of those seen.

    ``lines``: paper_id, page_num, block, line, is_vertical; a blank of a vertical line is as wide as it is high.
    """
    blanks = chars.where(F.col("text").rlike(r"^\s+$") & F.col("font").isNotNull() & F.col("size").isNotNull())
    if lines is not None:
        blanks = blanks.join(lines.select(*PAGE, "block", "line", "is_vertical"), [*PAGE, "block", "line"], "left")
        width = F.when(F.coalesce("is_vertical", F.lit(False)), F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0"))
    else:
        width = F.col("x1") - F.col("x0")
    return blanks.withColumn("w", width).where("w > 0").groupBy("font", F.round("size", 3).alias("size")).agg(F.count("*").alias("n"), F.percentile("w", F.lit(0.5)).alias("width"))


def character_bands(chars: DataFrame, widths: DataFrame, factor: float = 2.0) -> DataFrame:
    """(region_id, band, x0, x1): columns of printed characters, parted where no row prints and the gap is wider than ``factor`` blanks.

    ``chars`` carry region_id; ``widths`` are those of space_widths. A style without blanks counts as a quarter of its size.
    """
    printed = chars.where(~F.col("text").rlike(r"^\s*$")).withColumn("size", F.round("size", 3)).join(widths.select("font", "size", "width"), ["font", "size"], "left").withColumn("width", F.coalesce("width", F.col("size") / 4, F.lit(0.0)))
    w = Window.partitionBy("region_id").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parted = printed.withColumn("starts", F.when(reach.isNull() | (F.col("x0") - reach > factor * F.col("width")), 1).otherwise(0))
    bands = parted.withColumn("band", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return bands.groupBy("region_id", "band").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def rebuilt_cells(chars: DataFrame, bands: DataFrame, rows: DataFrame) -> DataFrame:
    """(region_id, row_idx, col_idx, text): characters put together again by the row and the band that their centre lies in.

    ``rows``: region_id, row_idx, y0, y1. Characters outside all rows or bands are left out.
    """
    b = bands.select(F.col("region_id").alias("b_region"), (F.col("band") - 1).cast("int").alias("col_idx"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    r = rows.select(F.col("region_id").alias("r_region"), "row_idx", F.col("y0").alias("r0"), F.col("y1").alias("r1"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    placed = chars.join(b, (F.col("region_id") == F.col("b_region")) & x.between(F.col("b0"), F.col("b1"))).join(r, (F.col("region_id") == F.col("r_region")) & (y >= F.col("r0")) & (y < F.col("r1")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "char_index", "text"))), lambda c: c["text"]), "")
    return placed.groupBy("region_id", "row_idx", "col_idx").agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))
