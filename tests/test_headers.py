import pytest
from pyspark.sql import functions as F

from tabloom.operators import continuation as C
from tabloom.operators import footnotes as N
from tabloom.operators import grid as G
from tabloom.operators import headers as H
from tabloom.operators import texts as P

CELL = "table_id string, row_idx int, col_idx int, text string, bbox struct<x0: double>, clean string"


def cells(spark, **tables):
    rows = [(t, r, c, x, None, "clash") for t, grid in tables.items() for r, row in enumerate(grid) for c, x in enumerate(row)]
    return G.unique_cells(spark.createDataFrame(rows, CELL))


GRID = [
    ["Table 3 of the trial", "", "", "", ""],
    ["", "Placebo", "", "Drug", ""],
    ["Outcome", "events", "share", "cases", "percent"],
    ["Any event", "12", "11.0", "14", "12.5"],
    ["", "", "", "", ""],
    ["Continued on next page", "", "", "", ""],
]


def test_header_tree(spark):
    grid = cells(spark, t=GRID, words=[["a", "b"], ["c", "d"]])
    views = G.row_views(grid)
    split = H.header_split(views, G.body_starts(views))
    roles = {(r["table_id"], r["row_idx"]): r["role"] for r in split.collect()}
    assert [roles["t", k] for k in range(6)] == ["preamble", "header", "header", "body", "body", "body"]
    assert roles["words", 0] == roles["words", 1] == "body"
    schema = H.header_schema(grid, split)
    assert {tuple(r)[1:] for r in schema.where("kind = 'group'").collect()} == {("group", 1, 1, 2, "Placebo"), ("group", 1, 3, 4, "Drug")}
    paths = {r["col_idx"]: (r["n_groups"], r["path"]) for r in H.header_paths(schema).collect()}
    assert paths == {0: (0, "Outcome"), 1: (1, "Placebo > events"), 2: (1, "Placebo > share"), 3: (1, "Drug > cases"), 4: (1, "Drug > percent")}
    assert {(r["row_idx"], r["level"]) for r in H.header_levels(schema).collect()} == {(1, 1), (2, 2)}


def test_trailing_notes_and_prose(spark):
    prose = [["x", "the quick brown fox", "jumps over lazy dogs"]] * 4
    grid = cells(spark, t=GRID, p=prose, blank=[["", ""]])
    assert [tuple(r) for r in H.trailing_notes(grid).collect()] == [("t", 4, 2)]
    assert {r["table_id"]: r["is_prose"] for r in H.prose_grids(grid).collect()} == {"t": False, "p": True, "blank": False}
    assert H.trailing_notes(grid.limit(0)).count() == 0


def test_text_only_grids(spark):
    grid = cells(spark, t=[["Term", "Meaning"], ["ABC", "a scale of pain"], ["DEF", "another scale"], ["GHI", "a third one"]], n=GRID)
    views = G.row_views(grid)
    profiles = spark.createDataFrame([("t", True, "unknown"), ("n", True, "unknown")], "table_id string, has_signal boolean, table_family string")
    none = spark.createDataFrame([], "table_id string")
    family = grid.withColumn("family", F.lit("unknown"))
    assert {r["table_id"]: r["is_text_only"] for r in H.text_only_grids(family, views, G.body_starts(views), profiles, none).collect()} == {"t": True, "n": False}


@pytest.mark.parametrize(
    ("line", "want"),
    [("Table 2. Baseline", ("2", False)), ("TABLE S3: More", ("S3", False)), ("Table 2 (continued)", ("2", True)), ("Table 2 shows the results", (None, None)), ("Table of contents", (None, None)), ("See Table 2", (None, None)), ("", (None, None)), (None, (None, None))],
)
def test_caption_lines(spark, line, want):
    number, continued = H.caption_parts(F.col("l"))
    assert tuple(spark.createDataFrame([(line,)], "l string").select(number, continued).first()) == want


def test_aligned_captions(spark):
    tables = spark.createDataFrame([("p", 1, "a", None), ("p", 2, "b", "own"), ("p", 3, "c", None), ("q", 1, "d", None)], "page string, place int, table_id string, caption string")
    lines = spark.createDataFrame([("p", 1, "first"), ("p", 2, "second")], "page string, place int, caption string")
    assert {r["table_id"]: r["caption"] for r in H.aligned_captions(tables, lines).collect()} == {"a": None, "b": "own", "c": "second", "d": None}


def test_turned_boxes(spark):
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (12, 30, 20, 50))])
    frame = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (10, 20, 60, 100))])
    one = spark.range(1)
    turned = lambda way: tuple(one.select(H.canonical_box(box, F.lit(way), frame).alias("b")).select("b.*").first())
    assert turned("vertical_text_up") == (50, 2, 70, 10) and turned("vertical_text_down") == (10, 40, 30, 48) and turned("horizontal") == (12, 30, 20, 50)


def test_paragraphs(spark):
    body = "Table 4 Sizes | a | b | c | d | e | f | g | h |"
    rows = [(1, f"One.\n \nTwo\nlines.\n\n\n{body}\n\nBefore {body}\n\nAs shown in {body}"), (2, None), (3, " \n\n "), (1, "Again.")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id int, text string, part string")
    assert sorted(r["paragraph"] for r in P.paragraphs(df).collect() if r["doc_id"] == 1) == ["Again.", "Before", "One.", "Two lines."]
    assert {r["doc_id"] for r in P.paragraphs(df).collect()} == {1}


def test_visuals(spark):
    tables = spark.createDataFrame([("p", "t2", "Table 1. A"), ("p", "t1", "Table 1 (continued)"), ("p", "t3", None), ("p", "t4", "Figure 9")], "paper_id string, table_id string, caption string")
    docs = spark.createDataFrame([(1, "p", "Figure 2. Flow. See it."), (2, "p", "Text. Fig 2 Shows flow"), (3, "p", "as figure 3 shows"), (4, None, "Figure 4. x"), (5, "p", None)], "doc_id long, paper_id string, text string")
    assert {tuple(r) for r in P.visual_inventory(tables, docs).select("visual_id", "source", "n_sources", "is_ambiguous").collect()} == {("p-table-1", "t1", 2, True), ("p-figure-2", "1", 2, True)}


def test_mention_classes(spark):
    labels = {1: "Systolic pressure", 2: "Never", 3: "Q4", 4: "<5-10", 5: "Model 2", 6: "Yes (reference)", 7: None, 8: "Table 2 continued", 9: "age sex race bmi smoking", 10: "±", 11: "Smoking status", 12: "xz", 13: "10-20"}
    variables = spark.createDataFrame([(k, "t", v) for k, v in labels.items()], "variable_id long, table_id string, variable_label string")
    levels = spark.createDataFrame([("u", "Quarter")], "table_id string, level_label string")
    papers = spark.createDataFrame([("t", "p"), ("u", "p")], "table_id string, paper_id string")
    got = {r["variable_id"]: r["mention_class"] for r in P.mention_classes(variables, levels, papers, F.col("variable_label")).collect()}
    assert got == {1: "variable", 2: "level", 3: "level", 4: "unknown", 5: "artifact", 6: "artifact", 7: "artifact", 8: "artifact", 9: "artifact", 10: "artifact", 11: "variable", 12: "unknown", 13: "range_bin"} | {4: got[4]}


def test_unit_marks(spark):
    for before, place, want in [("kg/m", "superscript", True), ("× 10", "superscript", True), ("Patients", "superscript", False), ("CO", "subscript", True), ("", "superscript", False), (None, "superscript", False), ("5 mm", None, False)]:
        assert spark.createDataFrame([(before, place)], "b string, p string").select(P.is_unit_mark(F.lit("2"), F.col("p"), F.col("b"))).first()[0] is want, before


def test_resolved_tables_and_boundaries(spark):
    groups = spark.createDataFrame([("a", "a", 1), ("b", "a", 2), ("c", "a", 3), ("d", "d", 1)], "table_id string, base_id string, part int")
    checks = spark.createDataFrame([("b", "match"), ("c", "mismatch")], "table_id string, check string")
    resolved = C.resolved_tables(groups, checks)
    assert {tuple(r) for r in resolved.collect()} == {("a", "a", "base", 2), ("b", "a", "continuation", 2), ("c", "c", "single", 1), ("d", "d", "single", 1)}
    variables = spark.createDataFrame([("a", 1, 1, "Sex"), ("b", 2, 1, "Other"), ("b", 3, 2, "Age"), ("b", 3, 2, "Age")], "table_id string, variable_id long, row_start int, variable_label string")
    levels = spark.createDataFrame([(1, 10, "Male"), (1, 11, "Female")], "variable_id long, level_id long, level_label string")
    placed = C.integrated_variables(resolved, groups, variables)
    assert sorted((r["place"], r["variable_id"]) for r in placed.collect()) == [(0, 1), (1, 2), (2, 3)]
    assert [tuple(r) for r in C.boundary_decisions(placed, variables, levels).collect()] == [("a", "b", 2, "attach")]


def test_notes(spark):
    grid = cells(spark, t=[["Age*", "12†", "*"], ["#3", "", "5 ‡ §"]])
    tables = spark.createDataFrame([("t", "Table 1.† x"), ("t", None)], "table_id string, caption string")
    assert sorted((r["scope"], r["row_idx"], r["glyph"]) for r in N.anchors(grid, tables).collect()) == [("caption", -1, "†"), ("cell", 0, "*"), ("cell", 0, "†"), ("cell", 1, "§"), ("cell", 1, "‡")]
    lines = spark.createDataFrame([(1, 0, "* Mean"), (1, 1, "text"), (1, 2, "a Adjusted"), (1, 3, "doi 10.1"), (1, 4, "† Late")], "doc_id long, line_no int, line string")
    foot = N.footer_lines(lines)
    assert sorted(r["line_no"] for r in foot.collect()) == [0, 2]
    given = spark.createDataFrame([(1, 0, 0, "*")], "doc_id long, line_no int, start int, glyph string")
    assert sorted((r["line_no"], r["glyph"], r["origin"]) for r in N.definition_markers(foot, given).collect()) == [(0, "*", "structured"), (2, "a", "found")]
    marks = spark.createDataFrame([("p", 1, 1), ("p", 1, 2), ("p", 1, 3), ("p", 2, 4)], "paper_id string, doc_id long, number int")
    notes = spark.createDataFrame([("p", 4)], "paper_id string, number int")
    entries = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2)], "paper_id string, number int")
    assert {(r["number"], r["status"]) for r in N.bibliography_mentions(marks, notes, entries).collect()} == {(1, "resolved"), (2, "ambiguous"), (3, "unresolved")}
