"""Boxes on pages: overlap, containment, rotation, occupancy, column bands, coverage and text lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_share(box: Column, other: Column) -> Column:
    """The part of ``box`` that ``other`` covers; 0 if either has no area, null if either is null."""
    width = F.least(box["x1"], other["x1"]) - F.greatest(box["x0"], other["x0"])
    height = F.least(box["y1"], other["y1"]) - F.greatest(box["y0"], other["y0"])
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    share = F.when((width > 0) & (height > 0) & (area > 0), width * height / area).otherwise(0.0)
    return F.when(box.isNotNull() & other.isNotNull(), share)


def center_inside(box: Column, region: Column) -> Column:
    """Whether the centre of a box lies in a region, its edges included."""
    x, y = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    return x.between(region["x0"], region["x1"]) & y.between(region["y0"], region["y1"])


def rotated(box: Column, frame: Column, direction: Column | str) -> Column:
    """The box in the upright frame of a page region turned clockwise or counterclockwise; otherwise as it is."""
    way = F.lit(direction) if isinstance(direction, str) else direction
    make = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    clockwise = make(box["y0"] - frame["y0"], frame["x1"] - box["x1"], box["y1"] - frame["y0"], frame["x1"] - box["x0"])
    counter = make(frame["y1"] - box["y1"], box["x0"] - frame["x0"], frame["y1"] - box["y0"], box["x1"] - frame["x0"])
    return F.when(way == "clockwise", clockwise).when(way == "counterclockwise", counter).otherwise(make(box["x0"], box["y0"], box["x1"], box["y1"]))


def unique_boxes(cells: DataFrame) -> DataFrame:
    """One box per cell position with text; copies count once, positions without box don't."""
    return cells.where("bbox is not null and trim(text) <> ''").groupBy("table_id", "row_idx", "col_idx").agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))


def occupancy(boxes: DataFrame, bin_width: int = 5) -> DataFrame:
    """(table_id, bin, n_rows): how many rows print something in each strip of ``bin_width``."""
    bins = boxes.withColumn("bin", F.explode(F.sequence(F.floor(F.col("x0") / bin_width), F.floor(F.col("x1") / bin_width))))
    return bins.groupBy("table_id", "bin").agg(F.countDistinct("row_idx").alias("n_rows"))


def column_bands(occupied: DataFrame) -> DataFrame:
    """(table_id, band, first_bin, last_bin): runs of neighbouring occupied strips, left to right."""
    w = Window.partitionBy("table_id").orderBy("bin")
    runs = occupied.withColumn("band", F.sum(F.when(F.col("bin") - F.lag("bin").over(w) <= 1, 0).otherwise(1)).over(w))
    return runs.groupBy("table_id", "band").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))


def row_coverage(boxes: DataFrame) -> DataFrame:
    """(table_id, row_idx, covered, share): length of the union of a row's boxes, and its share of the table's width."""
    union = F.aggregate(
        F.array_sort(F.collect_list(F.struct("x0", "x1"))),
        F.struct(F.lit(0.0).alias("length"), F.lit(float("-inf")).alias("end")),
        lambda s, x: F.struct((s["length"] + F.greatest(F.lit(0.0), x["x1"] - F.greatest(x["x0"], s["end"]))).alias("length"), F.greatest(s["end"], x["x1"]).alias("end")),
        lambda s: s["length"],
    )
    rows = boxes.groupBy("table_id", "row_idx").agg(union.alias("covered"))
    width = boxes.groupBy("table_id").agg((F.max("x1") - F.min("x0")).alias("width"))
    return rows.join(width, "table_id").select("table_id", "row_idx", "covered", F.when(F.col("width") > 0, F.col("covered") / F.col("width")).otherwise(0.0).alias("share"))


def text_lines(boxes: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(table_id, row_idx, col_idx, line): boxes from top to bottom, a new line where one lies further than ``tolerance``
    from the first box of the line. The anchor moves with the line, so each table is folded in order; a table is one page's."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y0", "x0", "row_idx", "col_idx"], kind="stable")
        line, anchor, out = -1, -np.inf, []
        for y in frame["y0"]:
            if y - anchor > tolerance:
                line, anchor = line + 1, y
            out.append(line)
        return frame[["table_id", "row_idx", "col_idx"]].assign(line=out)

    return boxes.groupBy("table_id").applyInPandas(fold, "table_id string, row_idx int, col_idx int, line int")


def connected_boxes(boxes: Iterator[tuple[float, float, float, float]], tolerance: float = 2.0) -> list[int]:
    """For boxes or rule segments of one page: the number of each one's group of touching neighbours, in order of appearance."""
    items = list(boxes)
    parent = list(range(len(items)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(items)), key=lambda i: items[i][0])
    active: list[int] = []
    for i in order:
        x0, y0, x1, y1 = items[i]
        active = [j for j in active if items[j][2] + tolerance >= x0]
        for j in active:
            if items[j][1] <= y1 + tolerance and y0 <= items[j][3] + tolerance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        active.append(i)
    names: dict[int, int] = {}
    return [names.setdefault(find(i), len(names)) for i in range(len(items))]
