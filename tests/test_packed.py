import pytest

from tabloom.functions.fold import bare
from tabloom.operators.packed import split_packed, split_values

NAMES = ["Male", "Female", "Active, irregular", "Active, regular", "Sedentary", "18–39 years", "≥65 years", "Employed part-time"]
KNOWN = frozenset(bare(n) for n in NAMES)


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("12 (3.4); 15 (2.2)", ["12 (3.4)", "15 (2.2)"]),
        ("1,234 (5.6 %), 15 (2.2 %)", ["1,234 (5.6 %)", "15 (2.2 %)"]),
        ("12 (3.4)/15 (2.2) // 9 (1)", ["12 (3.4)", "15 (2.2)", "9 (1)"]),
        ("12 (3.4)\n15 (2.2)", ["12 (3.4)", "15 (2.2)"]),
        ("12\n(3.4); 15\n(2.2)", ["12 (3.4)", "15 (2.2)"]),
        ("5.1 ± 2.0 | 6.0 ± 1.1", ["5.1 ± 2.0", "6.0 ± 1.1"]),
        ("5.1 (2.0, 7.7)\t6.0 (1.1, 9.0)", ["5.1 (2.0, 7.7)", "6.0 (1.1, 9.0)"]),
        ('"12 (3.4)";"15 (2.2)";', ["12 (3.4)", "15 (2.2)"]),
        ('"Sedentary", "Active, irregular"', ["Sedentary", "Active, irregular"]),
        ("Sedentary ; Active, irregular ; Active, regular", ["Sedentary", "Active, irregular", "Active, regular"]),
        ("18–39 years · ≥65 years", ["18–39 years", "≥65 years"]),
        ("17.2 kilopascals (1.9)   17.3 kilopascals (2.6)", ["17.2 kilopascals (1.9)", "17.3 kilopascals (2.6)"]),
        ("１２ （３．４）； １５ （２．２）", ["12 (3.4)", "15 (2.2)"]),
        ("0.41; 0.32", ["0.41", "0.32"]),
        (";;12 (3.4);;", []),
        ("1132\n(55.0)", []),
        ("Active, regular", []),
        ("Male", []),
        ("Employed\npart-time", []),
        ("5.1 mg/dL (2.0)", []),
        ("N/A", []),
        ("5.6 +/- 1.2", []),
        ('"12 (3.4); 15 (2.2)"', []),
        ("120/80", []),
        ("Group A (N = 2,285)", []),
        ("", []),
        ("   ", []),
    ],
)
def test_values(text, values):
    assert split_values(text, KNOWN) == values


def test_rows_keep_position_and_repeats(spark):
    rows = [("a", "12 (3.4); 15 (2.2)", "x"), ("a", "12 (3.4); 15 (2.2)", "x"), ("b", None, "x"), ("c", "", "x"), ("d", "7 (1)", None), ("e", "; ".join(["5 (1)"] * 20_000), "x")]
    df = spark.createDataFrame(rows, "k string, text string, packed_text string")
    out = split_packed(df, "text", NAMES, ["k"]).collect()
    assert sorted((r["k"], r["pos"], r["value"]) for r in out if r["k"] == "a") == [("a", 0, "12 (3.4)")] * 2 + [("a", 1, "15 (2.2)")] * 2
    assert sorted(r["pos"] for r in out if r["k"] == "e") == list(range(20_000))
    assert {r["k"] for r in out} == {"a", "e"}
    assert split_packed(df.limit(0), "text", [], ["k"]).count() == 0


def test_lookalike_delimiters_reach_the_split(spark):
    rows = [("w", "１２ （３．４）； １５ （２．２）"), ("n", "12 (3.4)\u00a0\u00a015 (2.2)"), ("q", '"12 (3.4)； 15 (2.2)"'), ("s", "12 (3.4)")]
    out = split_packed(spark.createDataFrame(rows, "k string, text string"), "text", NAMES, ["k"]).collect()
    assert sorted((r["k"], r["pos"], r["value"]) for r in out) == [(k, p, v) for k in "nw" for p, v in enumerate(["12 (3.4)", "15 (2.2)"])]
