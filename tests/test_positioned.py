import pytest

from tabloom.operators import positioned as P

BOX = "x0 double, y0 double, x1 double, y1 double"
CHAR = f"paper_id string, page_num int, {BOX}, text string, char_index int, block int, line int, font string, size double, region_id string, clash string"


def chars(spark, spec, **more):
    """One character of width 5 per letter; rows of (text, x, y, block, line)."""
    rows, k = [], 0
    for text, x, y, block, line in spec:
        for n, c in enumerate(text):
            rows.append(("p", 1, x + 5.0 * n, float(y), x + 5.0 * n + 5, y + 8.0, c, k, block, line, "Serif", 9.0, "r", "c"))
            k += 1
    return spark.createDataFrame(rows, CHAR)


def test_words_are_spelled_from_their_characters(spark):
    c = chars(spark, [("age", 0, 0, 1, 1), ("xy", 0, 1, 1, 2)])
    words = spark.createDataFrame([("p", 1, 0.0, 0.0, 15.0, 8.0, "agc", 1), ("p", 1, 100.0, 0.0, 120.0, 8.0, "far", 2), ("q", 1, 0.0, 0.0, 15.0, 8.0, "other", 3)], f"paper_id string, page_num int, {BOX}, text string, word_id int")
    assert {r["word_id"]: r["text"] for r in P.spelled_words(words, c).collect()} == {1: "age", 2: "far", 3: "other"}
    lines = P.line_records(words.selectExpr("*", "1 as block", "1 as line"))
    assert {(r["paper_id"], r["text"], r["x1"]) for r in lines.collect()} == {("p", "agc far", 120.0), ("q", "other", 15.0)}


def test_symbols(spark):
    df = spark.createDataFrame([("m", "Symbol"), ("m", "Serif"), ("m", None)], "text string, font string")
    assert [r["text"] for r in P.chars_from_symbols(df, {"m": "μ"}).collect()] == ["μ", "m", "m"]


DRAWN = [(0, 10, 100, 10), (0, 50, 30, 51), (32, 50.5, 60, 50.5), (64, 50, 100, 50), (0, 90, 50, 90), (0, 0, 1, 100), (100, 12, 0, 12)]


@pytest.mark.parametrize(("full", "ys"), [(False, [11.0, 50.25]), (True, [11.0])])
def test_rules_across_a_region(spark, full, ys):
    rules = P.rule_segments(spark.createDataFrame([("p", 1, *map(float, d)) for d in DRAWN], f"paper_id string, page_num int, {BOX}"))
    assert rules.count() == 6
    regions = spark.createDataFrame([("r", "p", 1, 0.0, 5.0, 100.0, 95.0), ("s", "p", 2, 0.0, 5.0, 100.0, 95.0)], f"region_id string, paper_id string, page_num int, {BOX}")
    found = sorted((r["region_id"], r["y"]) for r in P.horizontal_rules(rules, regions, full).collect())
    assert [r for r, _ in found] == ["r"] * len(ys) and [y for _, y in found] == pytest.approx(ys, abs=0.3)


def test_recurring_rules(spark):
    rows = [("p", n, 0.0, 20.0, 100.0, 20.0) for n in range(1, 6)] + [("p", 1, 0.0, 40.0, 100.0, 40.0)]
    rules = P.rule_segments(spark.createDataFrame(rows, f"paper_id string, page_num int, {BOX}"))
    assert [(r["y"], r["n_pages"]) for r in P.recurring_rules(rules).collect()] == [(20.0, 5)]


def test_masks(spark):
    items = spark.createDataFrame([("p", 1, 0.0, 0.0, 10.0, 10.0, 1, 1), ("p", 1, 8.0, 8.0, 30.0, 30.0, 1, 2), ("p", 2, 0.0, 0.0, 10.0, 10.0, 1, 1), ("p", 1, 0.0, 90.0, 10.0, 99.0, 2, 1)], f"paper_id string, page_num int, {BOX}, block int, line int")
    regions = spark.createDataFrame([("p", 1, 0.0, 0.0, 20.0, 20.0)], f"paper_id string, page_num int, {BOX}")
    left = lambda how: sorted((r["page_num"], r["y0"]) for r in P.outside_regions(items, regions, how).collect())
    assert left("center") == [(1, 90.0), (2, 0.0)] and left("inside") == [(1, 8.0), (1, 90.0), (2, 0.0)] and left("overlap") == [(1, 90.0), (2, 0.0)]
    entry = spark.createDataFrame([("p", 1, 2, 1)], "paper_id string, page_num int, block int, line int")
    assert [(r["page_num"]) for r in P.outside_bibliography(items, entry, regions).collect()] == [2]


def test_bands_and_cells(spark):
    c = chars(spark, [("Age yr", 0, 0, 1, 1), ("51", 60, 0, 1, 1), ("Sex", 0, 10, 1, 2), ("40 %", 60, 10, 1, 2)])
    widths = P.space_widths(c)
    assert [(r["font"], r["size"], r["n"], r["width"]) for r in widths.collect()] == [("Serif", 9.0, 2, 5.0)]
    bands = P.character_bands(c, widths)
    assert sorted((r["x0"], r["x1"]) for r in bands.collect()) == [(0.0, 30.0), (60.0, 80.0)]
    rows = spark.createDataFrame([("r", 0, 0.0, 9.0), ("r", 1, 9.0, 20.0)], "region_id string, row_idx int, y0 double, y1 double")
    assert {(r["row_idx"], r["col_idx"]): r["text"] for r in P.rebuilt_cells(c, bands, rows).collect()} == {(0, 0): "Age yr", (0, 1): "51", (1, 0): "Sex", (1, 1): "40 %"}
    up = c.selectExpr("paper_id", "page_num", "block", "line", "line = 1 as is_vertical").distinct()
    assert {r["width"] for r in P.space_widths(c, up).collect()} == {6.5}
    assert P.character_bands(c.limit(0), widths).count() == 0
