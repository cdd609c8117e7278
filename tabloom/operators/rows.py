"""Rows of a printed table told apart by an ordered fold, and the variables that they make up.

What a row shows by itself is aggregated from its cells by expressions. What it means depends on the rows before it, so
each table's rows, as many as a printed page holds, are folded in order: the rows ahead are summed up in one pass from
below, then a ladder of tests is walked down row by row with the open variable carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import label_text

# What a label or a cell says about its row.
PARENT_CUE = r"(?i)(?:n\s*\(%\)|no\.\s*\(%\)|\bpercent\b|\bcategory\b|\blevel\b)"
SUMMARY_CUE = r"(?i)(?:\bmean\b|\bsd\b|\bmedian\b|\biqr\b|mean\s*[±+-]\s*sd|mean\s*\(\s*sd\s*\))"
INDICATOR = r"(?i)(?:=|[._]cat\b|\bindicator\b)"
COUNT_LABEL = r"(?i)^(?:n|number|no\.?)$"
SEX_LABEL = r"(?i)\b(?:male|female)\b"
NOT_REPORTED = r"(?i)^(?:N/?A|NR|not reported)$"
DECIMAL_SUMMARY = r"^\s*[<>]?\d+\.\d+\s*(?:\(\s*[<>]?\d+(?:\.\d+)?(?:\s*[,/-]\s*[<>]?\d+(?:\.\d+)?)?\s*\))?\s*$"
INTERVAL = r"^-?\d+(?:\.\d+)?\s*[\(\[]\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*[\)\]]$"
COUNT_PERCENT_LABEL = r"(?i)\bn\s*\(\s*%\s*\)"
THRESHOLD = r"^\s*(<=|>=|<|>|≤|≥)\s*(.+?)\s*$"
ONE_ROW_COUNT = r"(?i)(?:n|no\.?)\s*\(\s*%\s*\)"
SUMMARY_SUFFIX = r"(?i)(?:\s*,?\s*)?(?:\[\s*)?(?:n\s*\(%\)|no\.\s*\(%\)|mean\s*[±+-]?\s*\(?sd\)?|median\s*\(?iqr\)?|mean\s*\(\s*sd\s*\))(?:\s*\])?$"
BINARY_PAIRS = [["female", "male"], ["no", "yes"], ["case", "control"], ["absent", "present"], ["negative", "positive"]]


def common_level_label(label: Column) -> Column:
    """Whether a label begins with a comparator, as levels of a threshold do."""
    return F.trim(label).rlike("^[<>≤≥]")


def row_features(cells: DataFrame, rows: DataFrame, starts: DataFrame, roles: DataFrame, levels: DataFrame) -> DataFrame:
    """One row per body row: its label and what its cells show. ``cells`` carry ``family``; ``levels``: rows that read as levels."""
    statistic = roles.select("table_id", "col_idx", F.col("role").isin("p_value", "smd").alias("is_stat"))
    body = cells.join(starts.select("table_id", "body_start"), "table_id").where("row_idx >= body_start").join(statistic, ["table_id", "col_idx"], "left").withColumn("is_stat", F.coalesce("is_stat", F.lit(False)))
    clean, family = F.col("clean"), F.col("family")
    value, data = (F.col("col_idx") > 0) & (clean != ""), (F.col("col_idx") > 0) & (clean != "") & ~F.col("is_stat")
    letters, digits = clean.rlike(r"\p{L}"), clean.rlike("[0-9]")
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("col_idx", "clean")))), lambda x: x["clean"]), " ")
    seen = body.groupBy("table_id", "row_idx").agg(
        F.count_if(value).alias("n_values"), F.count_if(data).alias("n_data"), F.count_if(value & F.col("is_stat")).alias("n_stat"),
        F.count_if((F.col("col_idx") > 0) & ~F.col("is_stat")).alias("n_data_cols"), F.count_if(value & digits).alias("n_digits"), F.count_if(value & letters).alias("n_letters"),
        F.count_if(value & (clean.contains("±") | family.isin("mean_sd", "median_iqr") | clean.rlike(DECIMAL_SUMMARY))).alias("n_summary"),
        F.count_if(data & family.isin("count_pct", "n_only")).alias("n_counts"), F.count_if(data & (family == "p_value")).alias("n_p"), F.count_if(data & clean.rlike(INTERVAL)).alias("n_intervals"),
        F.count_if(value & clean.rlike("^[0-9]+$")).alias("n_whole"), F.count_if(value & clean.rlike("^[0-9][0-9,]*$")).alias("n_grouped"),
        F.count_if(data & ((digits & ~letters) | clean.rlike(NOT_REPORTED))).alias("n_bare"),
        F.count_if(value & family.isin("count_pct", "n_only")).alias("n_any_counts"), F.count_if(value & (family == "p_value")).alias("n_any_p"),
        joined(value).alias("values"), joined((F.col("col_idx") < 3) & (clean != "")).alias("lead"),
        F.array_sort(F.collect_list(F.when(value & ~family.isin("unknown", "p_value"), F.struct("col_idx", "family")))).alias("families"),
    )
    label = F.col("label")
    marked = seen.join(rows.select("table_id", "row_idx", "label", "label_norm", "indent"), ["table_id", "row_idx"]).join(levels.select("table_id", "row_idx", F.lit(True).alias("level_like")), ["table_id", "row_idx"], "left")
    return marked.select(
        *[c for c in seen.columns if c not in ("values", "lead", "families")], "label", "label_norm", "indent", F.coalesce("level_like", F.lit(False)).alias("level_like"),
        F.col("lead").rlike(PARENT_CUE).alias("parent_cue"), label.rlike(SUMMARY_CUE).alias("summary_cue"), F.col("values").rlike(SUMMARY_CUE).alias("values_cue"), F.col("values").contains("(").alias("bracket"),
        label.rlike(INDICATOR).alias("indicator"), F.trim("label_norm").rlike(COUNT_LABEL).alias("count_label"), (label.rlike(SEX_LABEL) & label.rlike("[%=]")).alias("sex_share"),
        common_level_label(F.col("label_norm")).alias("comparator"), label.rlike("[,()]").alias("punctuated"), F.size(F.filter(F.split("label_norm", r"\s+"), lambda w: w != "")).alias("n_words"), F.length("label_norm").alias("n_chars"),
        label.rlike(COUNT_PERCENT_LABEL).alias("count_percent"), F.regexp_extract("label", THRESHOLD, 1).alias("operator"), F.replace(F.lower(F.regexp_extract("label", THRESHOLD, 2)), F.lit(" "), F.lit("")).alias("threshold"),
        F.get("families", F.lit(0))["family"].alias("first_family"),
    )


@dataclass
class _Ahead:
    """What follows a row: levels in the first run ahead, further indented levels, and indented numeric rows."""

    children: list[int]
    indented: list[int]
    matrix: list[int]


def _deeper(row: dict, other: dict | None) -> bool:
    return other is not None and row["indent"] == row["indent"] and other["indent"] == other["indent"] and row["indent"] > other["indent"]


def _numeric_below(row: dict, parent: dict | None) -> bool:
    """A short plain label, further in than its parent, over mostly bare numbers."""
    plain = row["label_norm"] and not row["summary_cue"] and not row["punctuated"] and row["n_words"] <= 5 and row["n_chars"] <= 48
    return bool(plain and _deeper(row, parent) and row["n_data"] >= 2 and row["n_bare"] >= max(2, int(row["n_data"] * 0.6)))


def _ahead(rows: list[dict], by_indent: bool) -> _Ahead:
    n = len(rows)
    run, first_run, matrix, indented = [0] * (n + 1), [0] * (n + 1), [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        row = rows[i]
        stops = row["n_values"] == 0 or row["parent_cue"] or row["summary_cue"]
        run[i] = run[i + 1] + 1 if row["level_like"] else 0
        first_run[i] = run[i] if row["level_like"] else 0 if stops else first_run[i + 1]
    if by_indent:
        for i, row in enumerate(rows):
            below = [other for other in rows[i + 1 :] if _deeper(other, row)]
            indented[i] = sum(other["level_like"] for other in below)
            started = False
            for other in rows[i + 1 :]:
                fits = _numeric_below(other, row)
                if started and not fits:
                    break
                if _deeper(other, row) and not fits:
                    continue
                matrix[i] += fits
                started = started or fits
    return _Ahead(first_run[1:], indented, matrix)


def _scalar_count(row: dict, children: int, continuous: bool) -> bool:
    short = row["n_words"] <= 2 and row["n_chars"] <= 16 and not row["comparator"]
    return bool(short and row["n_values"] and not children and not row["parent_cue"] and not continuous and row["n_whole"] == row["n_values"])


def fold_rows(rows: list[dict]) -> list[tuple[str, float]]:
    """(class, confidence) of a table's rows in order; the first test that holds decides."""
    indents = [r["indent"] for r in rows if r["indent"] == r["indent"]]
    by_indent = len(indents) >= 3 and len(set(indents)) >= 2 and sum(x - min(indents) >= 2 for x in indents) >= 2
    ahead = _ahead(rows, by_indent)
    out: list[tuple[str, float]] = []
    parent, n_levels, needs_indent = None, 0, False
    for i, row in enumerate(rows):
        before = out[-1][0] if out else None
        following, open_block = rows[i + 1] if i + 1 < len(rows) else None, before in ("variable_header", "level_row")
        n, data, children = row["n_values"], row["n_data"], ahead.children[i]
        only_stat, mixed = bool(row["n_stat"]) and not data, bool(data and row["n_stat"])
        continuous = row["summary_cue"] or row["n_summary"] >= 2
        cue = row["summary_cue"] or row["values_cue"] or bool(n) and row["n_summary"] >= max(1, n // 2 + 1)
        sparse, deeper = n <= 1, by_indent and _deeper(row, parent)
        counting = bool(n) and row["count_label"] and row["n_grouped"] >= max(1, n - 1) and children <= 1 and not row["parent_cue"] and not continuous
        sex = bool(n) and row["sex_share"] and not children and not open_block and not continuous
        binary = (
            data >= 2 and row["n_counts"] >= 2 and row["n_counts"] + row["n_p"] == data and (not row["parent_cue"] or row["indicator"]) and not continuous and not cue and not counting
            and (not row["comparator"] or not open_block and parent is None and not children)
            and (parent is None or row["indicator"] or by_indent and n_levels >= 1 and needs_indent and not deeper)
        )
        interval = data >= 2 and data == row["n_data_cols"] and row["n_intervals"] == data and mixed and not row["parent_cue"] and not row["comparator"]
        scalar = _scalar_count(row, children, continuous)
        indented_counts = deeper and needs_indent and data >= 2 and row["n_counts"] >= data - 1 and not row["parent_cue"] and not continuous and not only_stat
        level = (
            bool(n) and not row["parent_cue"] and not continuous and (not mixed or open_block) and not only_stat and (row["level_like"] or indented_counts)
            and not binary and not scalar and not (sparse and children >= 2 and row["n_digits"] > 0)
        )
        # symbols alone, such as dashes, don't make a parent into a row of data
        no_data = bool(n) and not row["n_digits"] and not row["n_counts"] and not continuous and not row["n_letters"]
        parent_like = not n or row["n_digits"] > 0 or no_data
        header = (
            row["parent_cue"] or sparse and children >= 1 and parent_like or not continuous and children >= 2 and parent_like
            or sparse and ahead.indented[i] >= 2 or sparse and ahead.matrix[i] >= 2
        )
        next_level = following is not None and following["level_like"]
        previous_row = rows[i - 1] if i else None
        tests = (
            (binary, "binary_variable_row", 0.9),
            (interval, "continuous_variable_row", 0.9),
            (open_block and level and not (by_indent and needs_indent and parent is not None and not deeper), "level_row", 0.94 if by_indent and _deeper(row, previous_row) else 0.92 if row["comparator"] else 0.78),
            (open_block and by_indent and bool(n) and _numeric_below(row, parent), "level_row", 0.86),
            (continuous and bool(n), "continuous_variable_row", 0.92),
            (counting, "continuous_variable_row", 0.84),
            (sex, "continuous_variable_row", 0.82),
            (row["comparator"] and row["level_like"] and not only_stat and not mixed, "level_row", 0.9),
            (header, "variable_header", 0.9 if row["parent_cue"] and children >= 2 else 0.88 if ahead.indented[i] >= 2 or ahead.matrix[i] >= 2 else 0.84),
            (bool(n) and (continuous or children < 2) and not row["parent_cue"] and cue and (row["n_digits"] >= max(2, n // 2 + 1) or n == 1 and row["bracket"]) and not row["comparator"], "continuous_variable_row", 0.88),
            (scalar, "continuous_variable_row", 0.8),
            (not n and next_level, "variable_header", 0.86),
            (not n and row["n_words"] <= 5 and not row["comparator"], "section_header", 0.72),
            (bool(n) and 0 < row["n_digits"] <= 2 and next_level, "variable_header", 0.78),
            (before == "variable_header" and bool(n) and row["n_digits"] > 0 and row["n_words"] <= 4 and not only_stat, "level_row", 0.7),
            (True, "unknown", 0.45),
        )
        found = next((kind, confidence) for test, kind, confidence in tests if test)
        out.append(found)
        if found[0] == "variable_header":
            parent, n_levels, needs_indent = row, 0, False
        elif found[0] == "level_row":
            n_levels += 1
            needs_indent = needs_indent or deeper
        else:
            parent, n_levels, needs_indent = None, 0, False
    return out


def _levels_below(classes: list[str], at: int) -> list[int]:
    out = []
    for k in range(at + 1, len(classes)):
        if classes[k] == "level_row":
            out.append(k)
        elif classes[k] != "unknown":
            break
    return out


def fold_blocks(rows: list[dict], classes: list[str]) -> list[tuple[int, int, str, str, list[int]]]:
    """(start, end, label, kind, level places) of a table's variables, from its rows and their classes."""
    indents = [r["indent"] for r in rows if r["indent"] == r["indent"]]
    by_indent = len(indents) >= 3 and len(set(indents)) >= 2 and sum(x - min(indents) >= 2 for x in indents) >= 2
    kinds = list(classes)
    for i, row in enumerate(rows):  # a variable with one value over levels is their parent
        if kinds[i] == "continuous_variable_row" and row["n_values"] <= 1:
            below = _levels_below(kinds, i)
            if len(below) >= 2 and (row["n_values"] <= 1 or by_indent and any(_deeper(rows[k], row) for k in below)):
                kinds[i] = "variable_header"
    out: list[tuple[int, int, str, str, list[int]]] = []
    taken: set[int] = set()
    loose = ("binary_variable_row", "level_row", "unknown")
    for i, row in enumerate(rows):
        if i in taken:
            continue
        if kinds[i] in loose and row["operator"]:  # both sides of one threshold are a variable
            side = []
            for k in range(i, len(rows)):
                if k in taken or kinds[k] not in loose or not rows[k]["operator"] or rows[k]["threshold"] != row["threshold"]:
                    break
                side.append(k)
            if len(side) >= 2 and len({rows[k]["operator"] in ("<", "<=", "≤") for k in side}) == 2:
                base = out[-1][2].split(",")[0].strip() if out and out[-1][3] == "continuous" else ""
                out.append((i, side[-1], f"{base} category" if base else "Threshold category", "binary", side))
                taken.update(side)
                continue
        if kinds[i] in ("continuous_variable_row", "binary_variable_row"):
            out.append((i, i, row["label"], "binary" if kinds[i].startswith("binary") else "continuous", []))
        elif kinds[i] == "variable_header":
            below = []
            if row["count_percent"]:  # counts below "n (%)" are its levels without more
                for k in range(i + 1, len(rows)):
                    other, known = rows[k], rows[k]["n_values"] - rows[k]["n_any_p"]
                    if other["count_percent"] or not (other["n_any_counts"] >= 2 and other["n_any_counts"] >= known - 1):
                        break
                    below.append(k)
            below = below or _levels_below(kinds, i)
            taken.update(below)
            out.append((i, below[-1] if below else i, row["label"], "categorical" if below else "unknown", below))
    return out


def classified_rows(features: DataFrame) -> DataFrame:
    """(table_id, row_idx, label, row_class, confidence, block_start, variable_kind): body rows with their class and variable.

    block_start is the first row of the variable that a row belongs to, as its head or as a level, or null. Tables
    without a body give no rows. ``features`` are those of row_features.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_idx", ignore_index=True)
        rows = frame.to_dict("records")
        for r in rows:
            r["indent"] = float("nan") if r["indent"] is None else r["indent"]
        told = fold_rows(rows)
        start: list[int | None] = [None] * len(rows)
        kind: list[str | None] = [None] * len(rows)
        label = frame["label"].tolist()
        for low, _, name, of, below in fold_blocks(rows, [c for c, _ in told]):
            for k in (low, *below):
                start[k], kind[k] = int(frame["row_idx"][low]), of
            if rows[low]["operator"] and below:
                label[low] = name
        return pd.DataFrame({"table_id": frame["table_id"], "row_idx": frame["row_idx"], "label": label, "row_class": [c for c, _ in told], "confidence": [c for _, c in told], "block_start": pd.array(start, dtype="Int32"), "variable_kind": kind})

    return features.groupBy("table_id").applyInPandas(fold, "table_id string, row_idx int, label string, row_class string, confidence double, block_start int, variable_kind string")


def defined_variables(classified: DataFrame, features: DataFrame) -> DataFrame:
    """One row per variable: table_id, row_start, row_end, variable_name, variable_label, variable_type, units_hint, summary_style_hint, n_levels, confidence."""
    keyed = classified.where("block_start is not null").join(features.select("table_id", "row_idx", "label_norm", "n_data", "n_any_counts", "n_values", "n_any_p", "first_family", F.col("label").alias("printed")), ["table_id", "row_idx"])
    head = F.col("row_idx") == F.col("block_start")
    # the levels of a threshold variable include its first row
    own_level = head & (F.col("printed") != F.col("label"))
    is_level = ~head | own_level
    known = F.col("n_values") - F.col("n_any_p")
    blocks = keyed.groupBy("table_id", F.col("block_start").alias("row_start")).agg(
        F.max("row_idx").alias("row_end"), F.max(F.when(head, F.col("label"))).alias("variable_label"), F.max("variable_kind").alias("kind"), F.count_if(is_level).alias("n_levels"),
        F.bool_and(F.when(is_level & (known > 0), F.col("n_any_counts") == known)).alias("only_counts"), F.bool_or(is_level & (F.col("first_family") == "count_pct")).alias("has_percent"),
        F.max(F.when(head, F.col("first_family"))).alias("own_family"), F.bool_or(head & F.col("printed").rlike(ONE_ROW_COUNT)).alias("count_percent"),
        F.array_sort(F.collect_set(F.when(is_level & (F.col("label_norm") != ""), F.lower("label_norm")))).alias("names"),
    )
    label = F.trim("variable_label")
    comma = F.trim(F.regexp_extract(label, r".*,(.*)$", 1))
    bracket = F.trim(F.regexp_extract(label, r"\(([^()]+)\)", 1))
    units = F.when((comma != "") & ~F.lower(comma).contains("n (%)") & (F.length(comma) <= 20), comma).when((bracket != "") & ~F.lower(bracket).isin("sd", "iqr", "%") & (F.length(bracket) <= 20), bracket)
    style = F.when(F.col("n_levels") > 0, F.when(F.col("only_counts"), F.when(F.col("has_percent"), "count_pct").otherwise("n_only"))).otherwise(F.col("own_family"))
    pair = F.array_contains(F.array(*[F.array(*[F.lit(w) for w in p]) for p in BINARY_PAIRS]), F.col("names"))
    kind = (
        F.when((F.col("n_levels") == 0) & (style == "count_pct") & F.col("count_percent"), "binary").when(F.col("kind").isin("continuous", "binary"), F.col("kind"))
        .when(F.col("n_levels") > 0, F.when(pair, "binary").otherwise("categorical")).otherwise("unknown")
    )
    name = F.coalesce(F.nullif(label_text(F.regexp_replace(F.regexp_replace(label, SUMMARY_SUFFIX, ""), r"\([^()]+\)", "")), F.lit("")), label_text(label))
    typed = blocks.withColumn("summary_style_hint", style).withColumn("variable_type", kind)
    confidence = F.when(F.col("variable_type") == "continuous", 0.9).when(F.col("variable_type") == "binary", 0.95).when(F.col("variable_type") == "categorical", 0.92).otherwise(0.55)
    return typed.select("table_id", "row_start", "row_end", name.alias("variable_name"), "variable_label", "variable_type", units.alias("units_hint"), "summary_style_hint", "n_levels", confidence.alias("confidence"))
