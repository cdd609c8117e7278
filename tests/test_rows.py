import pytest
from pyspark.sql import functions as F

from tabloom.functions import values as V
from tabloom.operators import grid as G
from tabloom.operators import quality as Q
from tabloom.operators import rows as R

HEAD = ["Characteristic", "Overall (N = 100)", "Drug (n = 50)", "P value"]
TABLES = {
    # every body row: label, cells, class, variable it belongs to (its row) or None
    "plain": [
        ("Age, years", ["51.2 (9.1)", "50.8 (9.9)", "0.41"], "continuous_variable_row", 1),
        ("Sex", ["", "", "0.30"], "variable_header", 2),
        ("Male", ["40 (40.0)", "22 (44.0)", ""], "level_row", 2),
        ("Female", ["60 (60.0)", "28 (56.0)", ""], "level_row", 2),
        ("Hypertension", ["31 (31.0)", "15 (30.0)", "0.82"], "level_row", 2),
        ("Laboratory values", ["", "", ""], "section_header", None),
        ("LDL", ["3.1 ± 0.4", "3.0 ± 0.5", "0.9"], "continuous_variable_row", 7),
        ("Diabetes mellitus, yes", ["12 (12.0)", "7 (14.0)", "0.5"], "binary_variable_row", 8),
    ],
    # a bare count further down reads as a level ahead, so that the title over it opens a variable
    "count": [
        ("Laboratory values", ["", "", ""], "variable_header", 1),
        ("LDL", ["3.1 ± 0.4", "3.0 ± 0.5", "0.9"], "continuous_variable_row", 2),
        ("n", ["100", "50", ""], "continuous_variable_row", 3),
    ],
    "percent": [
        ("Smoking, n (%)", ["", "", ""], "variable_header", 1),
        ("Never", ["40 (40.0)", "22 (44.0)", ""], "level_row", 1),
        ("Current", ["60 (60.0)", "28 (56.0)", ""], "level_row", 1),
    ],
}


def features(spark, tables):
    cells = [(t, r, c, x) for t, rows in tables.items() for r, row in enumerate(rows) for c, x in enumerate(row)]
    df = spark.createDataFrame([(*x, None, "clash") for x in cells], "table_id string, row_idx int, col_idx int, text string, bbox struct<x0: double>, label string")
    unique = G.unique_cells(df).withColumn("family", V.value_family(F.col("clean")))
    views = G.row_views(unique)
    starts = G.body_starts(views)
    roles = G.column_roles(G.header_labels(unique, starts))
    return R.row_features(unique, views, starts, roles, Q.likely_levels(unique, views, roles))


def test_classes_and_variables(spark):
    f = features(spark, {t: [HEAD, *[[label, *cells] for label, cells, _, _ in rows]] for t, rows in TABLES.items()})
    got = {(r["table_id"], r["row_idx"]): (r["row_class"], r["block_start"]) for r in R.classified_rows(f).collect()}
    assert got == {(t, k): (c, b) for t, rows in TABLES.items() for k, (_, _, c, b) in enumerate(rows, 1)}
    defined = {(r["table_id"], r["row_start"]): (r["variable_name"], r["variable_type"], r["units_hint"], r["summary_style_hint"], r["n_levels"]) for r in R.defined_variables(R.classified_rows(f), f).collect()}
    assert defined["plain", 1] == ("Age years", "continuous", "years", "mean_sd", 0)
    assert defined["plain", 8] == ("Diabetes mellitus yes", "binary", "yes", "count_pct", 0)
    assert defined["percent", 1][:2] == ("Smoking", "categorical") and defined["percent", 1][3:] == ("count_pct", 2)


def row(label, n=0, **more):
    base = dict.fromkeys(["n_values", "n_data", "n_stat", "n_data_cols", "n_digits", "n_letters", "n_summary", "n_counts", "n_p", "n_intervals", "n_whole", "n_grouped", "n_bare", "n_any_counts", "n_any_p"], 0)
    base |= {"label": label, "label_norm": label, "indent": float("nan"), "n_words": len(label.split()), "n_chars": len(label), "operator": "", "threshold": "", "first_family": None}
    base |= dict.fromkeys(["level_like", "parent_cue", "summary_cue", "values_cue", "bracket", "indicator", "count_label", "sex_share", "comparator", "punctuated", "count_percent"], False)
    return base | {"n_values": n, "n_data": n, "n_digits": n, "n_data_cols": n} | more


def test_both_sides_of_a_threshold_are_one_variable():
    counts = {"n_counts": 2, "n_any_counts": 2, "level_like": True, "comparator": True}
    rows = [row("CRP, mg/L", 2, n_summary=2), row("<5", 2, operator="<", threshold="5", **counts), row("≥5", 2, operator="≥", threshold="5", **counts), row("", 0)]
    classes = [c for c, _ in R.fold_rows(rows)]
    assert R.fold_blocks(rows, classes)[:2] == [(0, 0, "CRP, mg/L", "continuous", []), (1, 2, "CRP category", "binary", [1, 2])]


def test_indented_numbers_are_levels():
    rows = [row("Region", 0, indent=0.0), row("North", 3, indent=4.0, n_bare=3), row("South", 3, indent=4.0, n_bare=3), row("East", 3, indent=4.0, n_bare=3)]
    assert [c for c, _ in R.fold_rows(rows)] == ["variable_header", "level_row", "level_row", "level_row"]
    assert [c for c, _ in R.fold_rows([])] == [] and R.fold_blocks([], []) == []


def test_empty(spark):
    f = features(spark, {"t": [["", ""], ["", ""]]})
    assert R.classified_rows(f).count() == 0 and R.defined_variables(R.classified_rows(f), f).count() == 0


@pytest.mark.parametrize(("label", "is_level"), [("<65", True), (" ≥ 65", True), ("Age <65", False), ("", False)])
def test_comparator_labels(spark, label, is_level):
    assert spark.createDataFrame([(label,)], "l string").select(R.common_level_label(F.col("l"))).first()[0] is is_level
