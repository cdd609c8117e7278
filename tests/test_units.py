import numpy as np

from tabloom.functions.forest import CalibratedForest
from tabloom.functions.units import cell_unit, readings
from tabloom.operators.units import assign_units, common_values, converted_values, measured_variables, printed_values, read_values


def test_spellings():
    for text, unit in [("mg per dL", "mg/dL"), ("mg%", "mg/dL"), ("(mmol L-1)", "mmol/L"), ("in grams", "g"), ("per 10 years", "decades"), ("[KG]", "kg"), ("millimetres of mercury", "mmHg"), ("cm of water", "cmH2O"), ("°C", "C"), ("per cent", "%"), ("IFCC mmol/mol", "mmol/mol"), ("yrs.", "years")]:
        assert unit in readings(text), text
    assert readings("mean (SD)") == () and readings("n/a") == () and readings("") == ()
    assert cell_unit("172.8 mg dL-1 (34.0)") == "mg dL-1" and cell_unit("36.8 (0.4)") is None and cell_unit("") is None


def test_forest_is_calibrated_on_held_out_rows():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1500)
    x = np.column_stack([rng.normal(y * 2.0, 1.0), rng.normal(size=1500)])
    forest = CalibratedForest.fit(x[:1000], y[:1000] + 10, np.arange(1000))
    p = forest.predict(x[1000:])[:, 1]
    assert forest.classes.tolist() == [10, 11] and ((p > 0.5) == (y[1000:] == 1)).mean() > 0.8
    assert abs(p.mean() - y[1000:].mean()) < 0.06


VAR = "variable_id long, table_id string, variable_label string, variable_type string, row_start int, units_hint string, summary_style_hint string, quantity string, unit_id int"
CELL = "table_id string, row_idx int, col_idx int, text string, extractor_name string"
CANON = [(1, "variable", "Body weight", ["Weight"], "weight"), (2, "variable", "Sex", None, None), (3, "level", "Male", [], None)]
UNITS = [(8, "weight", "kg", 1.0, 0.0, True), (9, "weight", "lb", 0.45359237, 0.0, False), (10, "weight", "g", 0.001, 0.0, False)]


def tables(spark, variables, cells):
    return (
        spark.createDataFrame([(*v, "clash", 1) for v in variables], VAR),
        spark.createDataFrame(cells, CELL),
        spark.createDataFrame(CANON, "canon_id int, label_kind string, canon_text string, aliases array<string>, quantity string"),
        spark.createDataFrame(UNITS, "unit_id int, quantity string, symbol string, factor double, shift double, is_common boolean"),
    )


def test_recorded_conflicting_and_predicted(spark):
    variables, cells = [], []
    for n in range(200):
        pounds = n % 2
        variables.append((n, f"p-p1-t{n}", "Body weight, lbs" if pounds else "Body weight (kg)", "continuous", 1, None, "mean_sd"))
        cells.append((f"p-p1-t{n}", 1, 1, f"{170 + n % 20 if pounds else 70 + n % 10}.0 (9.5)", "e"))
    more = [(900, "Weight", "pounds", "80 (9)"), (901, "Weight", None, "175 lb (9)"), (902, "Weight", None, "175 (9)"), (903, "Weight [kg]", "lb", "71 (9)"), (904, "Sex", "lb", "5"), (905, None, "lb", "5"), (906, " ", "lb", "5"), (907, "Weight", None, None), (908, "Weight", "pounds", "178 (9)")]
    for n, label, hint, text in more:
        variables.append((n, f"q-p1-t{n}", label, None, 1, hint, None))
        cells.append((f"q-p1-t{n}", 1, 1, text, None))
    variables += variables[-4:-1]
    args = tables(spark, variables, cells)
    out = {r["variable_id"]: r for r in common_values(assign_units(*args), args[3]).collect()}
    assert (out[900]["unit_id"], out[900]["source"]) == (9, "doubtful")  # printed like kilograms
    assert (out[908]["unit_id"], out[908]["source"]) == (9, "recorded")
    assert (out[901]["unit_id"], out[901]["source"]) == (9, "recorded")
    assert abs(out[901]["common_value"] - 175 * 0.45359237) < 1e-9
    assert (out[902]["unit_id"], out[902]["source"]) == (9, "predicted")
    assert (out[903]["unit_id"], out[903]["source"]) == (8, "conflict")
    assert out[907]["source"] == "review" and out[907]["unit_id"] is None
    assert not {904, 905, 906} & set(out)
    held = [r for n, r in out.items() if n < 200]
    assert len(held) == 200 and all(r["unit_id"] == (9 if r["variable_id"] % 2 else 8) for r in held)


def test_empty_tables(spark):
    args = tables(spark, [(1, "t", "Sex", None, 1, None, None)], [("t", 1, 1, "x", None)])
    assert assign_units(*args).count() == 0
    assert assign_units(args[0].limit(0), args[1].limit(0), *args[2:]).count() == 0


def test_readings_of_cells():
    for text, want in [
        ("80 (9)", [(80, 9, None, None)]), ("5.1 (2.0, 7.7)", [(5.1, None, 2, 7.7)]), ("5.1 [2.0-7.7]", [(5.1, None, 2, 7.7)]), ("5.1 (2.0–7.7)", [(5.1, None, 2, 7.7)]), ("1,374 6 581", [(1374, 581, None, None)]),
        ("0.08 - 0.02", [(0.08, 0.02, None, None)]), ("0.08-0.02", [(0.08, 0.02, None, None)]), ("172.8 mg dL-1 (34.0)", [(172.8, 34, None, None)]), ("12 cmH2O (3)", [(12, 3, None, None)]), ("−2.5 ± 1.1", [(-2.5, 1.1, None, None)]),
        ('"53.6 (9.5)","51.5 (9.4)"', [(53.6, 9.5, None, None), (51.5, 9.4, None, None)]), ("5.6 10-y units (1.3)", [(5.6, 1.3, None, None)]), ("p = 0.06", []), ("36.8", [(36.8, None, None, None)]), ("N/A", []), ("", []),
    ]:
        assert [v[:4] for v in read_values(text)] == want, text
    assert read_values("<0.5")[0][4] == "<" and read_values("12 (3.4%)")[0][6]


def test_every_printed_value_is_converted(spark):
    variables = [(1, "t", "Weight", None, 1, "lb", None), (2, "t", "Weight", None, 2, "kg", None), (3, "t", "Temperature", None, 3, "F", None)]
    cells = [("t", 0, 1, "A", "e"), ("t", 0, 2, "B", "e"), ("t", 0, 3, "ｐ\u00a0v\u200dalue", "e"), ("t", 1, 1, "180 (20)", "e"), ("t", 1, 2, "160 (120, 200)", "e"), ("t", 1, 3, "0.02", "e"), ("t", 2, 1, "80 (9); 70 (8)", "e"), ("t", 2, 2, "12 (3.4%)", "e"), ("t", 3, 1, "98.6 (1.8)", "e"), ("t", 3, 2, "98.6 [96.8, 100.4]", "e"), ("t", 3, 2, "98.6 [96.8, 100.4]", "f")]
    v, c, canon, units = tables(spark, variables, cells)
    canon = canon.unionByName(spark.createDataFrame([(9, "variable", "Temperature", None, "temperature")], canon.schema))
    units = units.unionByName(spark.createDataFrame([(40, "temperature", "F", 5 / 9, -160 / 9, False), (39, "temperature", "C", 1.0, 0.0, True)], units.schema))
    measured = measured_variables(v, canon, units)
    out = converted_values(assign_units(v, c, canon, units, measured=measured), printed_values(measured, c, units), units).collect()
    got = {(r["variable_id"], r["col_idx"], r["pos"]): tuple(None if x is None else round(x, 3) for x in (r["common_value"], r["common_spread"], r["common_low"], r["common_high"])) for r in out}
    assert len(out) == len(got) and got == {
        (1, 1, 0): (81.647, 9.072, None, None), (1, 2, 0): (72.575, None, 54.431, 90.718), (2, 1, 0): (80.0, 9.0, None, None), (2, 1, 1): (70.0, 8.0, None, None),
        (3, 1, 0): (37.0, 1.0, None, None), (3, 2, 0): (37.0, None, 36.0, 38.0),
    }
