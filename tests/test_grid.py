import pytest
from pyspark.sql import functions as F

from tabloom.functions import text as T
from tabloom.functions import values as V
from tabloom.operators import blocks as K
from tabloom.operators import geometry as B
from tabloom.operators import grid as G

GRAMMAR = [
    ("12 (3.4)", "count_parenthesized_percent", [12.0, 3.4]),
    ("53.2 (12.1)", "numeric_parenthesized_uncertainty", [53.2, 12.1]),
    ("53.2 (12.1%)", "count_parenthesized_percent", [53.2, 12.1]),
    ("5 (2, 9)", "median_iqr", [5.0, 2.0, 9.0]),
    ("5 [2, 9]", "median_iqr", [5.0, 2.0, 9.0]),
    ("5.1 ± 2", "numeric_plusminus_uncertainty", [5.1, 2.0]),
    ("5.1 +/- 2", "numeric_plusminus_uncertainty", [5.1, 2.0]),
    ("5.1 6 2", "numeric_spaced_six_uncertainty", [5.1, 2.0]),
    ("5.1 - 2", "numeric_dash_uncertainty", [5.1, 2.0]),
    ("<0.001", "p_value", [0.001]),
    ("p = .03", "p_value", [0.03]),
    ("1.00", "p_value", [1.0]),
    ("1,234", "integer", [1234.0]),
    ("-3.5", "numeric_scalar", [-3.5]),
    ("–", "missing", [None]),
    ("N/A", "missing", [None]),
    ("not estimable", "missing", [None]),
    ("12*", "integer", [12.0]),
    ("12 a", "integer", [12.0]),
    ("12 months", "integer", [12.0]),
    ("5 (2,900)", "count_parenthesized_percent", [5.0, 2900.0]),
    ("1.2 (0.9-1.4)", "free_text", [None]),
    ("5.1–2", "free_text", [None]),
    ("12%", "free_text", [None]),
    ("<65", "free_text", [None]),
    ("Reference", "free_text", [None]),
]


def test_value_grammar(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in GRAMMAR] + [(None,), ("12" + "*" * 40 + "!",), ("7 " * 20_000,)], "text string").withColumn("clean", T.clean_text(F.col("text")))
    out = {r["text"]: r for r in V.with_components(df, "text", "clean").collect()}
    for text, pattern, numbers in GRAMMAR:
        assert out[text]["pattern"] == pattern, text
        assert [c["value_num"] for c in out[text]["components"]] == numbers, text
    assert out[None]["pattern"] is None and out[None]["components"] is None


def test_confidence_and_relation_of_parts(spark):
    cases = [("<0.001", None, [("p_value", "<", 0.98)]), ("0.03", None, [("p_value", "=", 0.85)]), ("p<0.03", None, [("p_value", "<", 0.85)]), ("61.4 (9.8)", None, [("estimate", "=", 0.9), ("unknown", "=", 0.75)]), ("61.4 (9.8)", "Mean-SD", [("mean", "=", 0.9), ("sd", "=", 0.9)]),
             ("61.4 - 9.8", "mean_se", [("estimate", "=", 0.88), ("se", "=", 0.88)]), ("31 (8.8 %)", None, [("count", "=", 0.96), ("percent", "=", 0.96)])]
    df = spark.createDataFrame([(t, t, s) for t, s, _ in cases], "text string, clean string, style string")
    out = V.with_components(df, "text", "clean", "style").collect()
    assert [[(c["kind"], c["relation"], c["confidence"]) for c in r["components"]] for r in out] == [c for _, _, c in cases]
    assert [c["raw_fragment"] for c in out[-1]["components"]] == ["31", "8.8 %"]


def test_style_hint_names_the_parts(spark):
    df = spark.createDataFrame([("53.2 (12.1)", "53.2 (12.1)", s) for s in ("mean_sd", "estimate_se", None)], "text string, clean string, style string")
    kinds = {r["style"]: [c["kind"] for c in r["components"]] for r in V.with_components(df, "text", "clean", "style").collect()}
    assert kinds == {"mean_sd": ["mean", "sd"], "estimate_se": ["estimate", "se"], None: ["estimate", "unknown"]}


def test_clean_text(spark):
    pairs = [("� 65", "<=65"), ("(� 5)", "(<=5)"), ("x�5", "x�5"), ("&lt;5 &ge; 6", "<5 >= 6"), ("18–39", "18-39"), ("a   b\n", "a b"), ("≥65 ＜7", ">=65 <7"), ("", ""), (None, None)]
    df = spark.createDataFrame(pairs, "text string, want string")
    for r in df.select("want", T.clean_text(F.col("text")).alias("got")).collect():
        assert r["got"] == r["want"]


CELLS = "table_id string, row_idx int, col_idx int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, clean string, label string"


def grid(spark, rows, table="t"):
    box = lambda r, c: (10.0 * c + (5.0 if c == 0 and r > 2 else 0.0), 10.0 * r, 10.0 * c + 8, 10.0 * r + 8)
    return spark.createDataFrame([(table, r, c, x, box(r, c), "clash", "clash") for r, row in enumerate(rows) for c, x in enumerate(row)], CELLS)


def test_grid_to_blocks(spark):
    rows = [["Characteristic", "Overall (n = 100)", "Cases", "p"], ["Age", "53.2 (12.1)", "52.0 (11.0)", "<0.001"], ["Sex", "", None, " "], ["Male", "60 (60.0)", "30 (55.0)", "0.02"], ["Female", "40 (40.0)", "25 (45.0)", ""]]
    cells = grid(spark, rows + [])
    cells = cells.unionByName(cells)
    unique = G.unique_cells(cells)
    assert unique.count() == 20
    views = G.row_views(unique)
    starts = G.body_starts(views)
    assert [tuple(r) for r in starts.collect()] == [("t", 1, 1)]
    roles = G.column_roles(G.header_labels(unique, starts))
    assert {r["col_idx"]: (r["role"], r["denominator"]) for r in roles.collect()} == {0: ("unknown", None), 1: ("overall", 100), 2: ("group", None), 3: ("p_value", None)}
    from tabloom.operators.quality import likely_levels

    with_family = unique.withColumn("family", V.value_family(F.col("clean")))
    blocks = K.variable_blocks(K.row_kinds(views, likely_levels(with_family, views, roles), starts))
    assert sorted(tuple(r) for r in blocks.collect()) == [("t", 1, 1, "variable", 0), ("t", 2, 4, "header", 2)]
    assert {r["row_idx"]: r["indent"] for r in views.collect()}[3] == 5


def test_empty_grid(spark):
    none = G.unique_cells(grid(spark, [["a"]]).limit(0))
    views = G.row_views(none)
    assert views.count() == 0 and G.body_starts(views).count() == 0
    blank = G.unique_cells(grid(spark, [[None, ""], ["", None]]))
    assert G.body_starts(G.row_views(blank)).count() == 0


def test_lines_follow_the_first_box(spark):
    ys = [0.0, 2.5, 3.5, 6.0, 6.4, 20.0]
    df = spark.createDataFrame([("t", 0, k, 0.0, y, 1.0, y + 1) for k, y in enumerate(ys)], "table_id string, row_idx int, col_idx int, x0 double, y0 double, x1 double, y1 double")
    assert [r["line"] for r in B.text_lines(df).orderBy("col_idx").collect()] == [0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize(("boxes", "groups"), [([(0, 0, 1, 1), (2, 0, 3, 1), (50, 0, 51, 1), (3, 2, 4, 3)], [0, 0, 1, 0]), ([], [])])
def test_connected_boxes(boxes, groups):
    assert B.connected_boxes(boxes) == groups
