import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabloom.llm.canonical_text import Transducer, build_mapping, canonical_text

T = Transducer()


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("Ｍale", "Male"), ("５．６ ＋／－ １．２", "5.6 +/- 1.2"), ("p < 0.001", "p < 0.001"), ("Se​x﻿", "Sex"), ("P‐value", "P-value"),
        ("Café-au-lait", "Café-au-lait"), ("Сhаrасtеrіѕtіс", "Characteristic"), ("DΟSΕ", "DOSE"), ("Grοup Α (Ν = 5)", "Group A (N = 5)"), ("Stage Ⅲ", "Stage III"), ("ﬁbrillation", "fibrillation"),
        ("e\u0302\u0301", "ế"), ("ê\u0301", "ế"), ("ơ\u0323", "ợ"), ("o\u0323\u031b", "ợ"), ("한", "한"), ("Å", "Å"), ("и\u0306", "й"), ("Сре\u0308дний", "Срёдний"), ("е\u0308", "ë"), ("ｅ\u0302\u0301", "ế"),
        ("ТС", "TC"), ("β‐blocker", "β-blocker"), ("Βeta-blockers", "Beta-blockers"), ("с̧", "ç"),
    ],
)
def test_forms(text, plain):
    assert T.apply(text) == plain


@pytest.mark.parametrize("text", ["", "a  b\nc", "α-tocopherol", "Β-BLOCKER THERAPY", "β-blocker", "Guillain–Barré", "≥65 years ± 2 × 10² † ‡ § °C µg", "Средний возраст", "Ménière", "№ 5"])
def test_plain_text_stays(text):
    assert T.apply(text) == text


def test_mapping_has_no_conflict():
    mapping = build_mapping()
    assert not any(c in mapping for target in mapping.values() for c in target)


@given(st.text(max_size=40))
def test_applying_twice_changes_nothing_more(text):
    once = T.apply(T.apply(text))
    assert T.apply(once) == once


def test_rows(spark):
    rows = [(1, "Ｍale"), (1, "Ｍale"), (2, None), (3, ""), (4, "plain ≥5"), (5, "Ｘ" * 100_000)]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "k int, t string, canonical string, changed boolean")
    out = canonical_text(df, "t", ["k"]).collect()
    assert sorted((r["k"], r["changed"]) for r in out) == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, True)]
    assert {r["k"]: r["canonical"] for r in out}[5] == "X" * 100_000 and {r["k"]: r["canonical"] for r in out}[2] is None
    assert canonical_text(df.limit(0), "t", ["k"]).count() == 0
