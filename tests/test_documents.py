import re

import random

from pyspark.sql import functions as F

from tabloom.operators import documents as D
from tabloom.operators.context import reference_windows, table_context, table_passages
from tabloom.operators.footnotes import definitions, link_notes

DOC = "doc_id long, paper_id string, text string, role_hint string, line string, term string"


def docs(spark, rows):
    return spark.createDataFrame([(i, p, t, "results_like", "clash", "clash") for i, p, t in rows], DOC)


def test_terms_against_brute_force(spark):
    rng = random.Random(1)
    words = ["age", "sex", "bmi", "total", "a", "b2"]
    texts = [(k, f"p{k % 2}", rng.choice([", ", " ", "\n", " – "]).join(rng.choice(words).title() for _ in range(rng.randrange(0, 12)))) for k in range(80)]
    texts += [(90, None, "age"), (91, "p0", None), (92, "p1", ""), (93, "p1", "&lt;age&gt; sex" * 5000)]
    terms = [(f"p{p}", " ".join(t)) for p in (0, 1) for t in [["age"], ["age", "sex"], ["total", "a", "b2"], ["zzz"], ["a"]]] + [("p0", "age"), ("p0", "a b c d e f g h")]
    got = {tuple(r) for r in D.term_hits(docs(spark, texts), spark.createDataFrame(terms, "paper_id string, term string")).select("paper_id", "doc_id", "term").collect()}
    plain = lambda t: " " + " ".join(re.findall("[A-Za-z0-9]+", t.replace("&lt;", " ").replace("&gt;", " "))).lower() + " "
    want = {(p, i, term) for i, p, t in texts if t is not None for q, term in terms if q == p and 3 <= len(term) and f" {term} " in plain(t)}
    assert got == want and len(want) > 40


def test_long_terms_are_found(spark):
    long, longer = "age at the time of first diagnosis years", " ".join(f"w{k}" for k in range(40))
    d = docs(spark, [(1, "p", f"We took Age at the time of first diagnosis, years; {longer}."), (2, "p", "age at the time of first"), (3, "q", longer)])
    terms = spark.createDataFrame([("p", long), ("p", longer), ("p", "age")], "paper_id string, term string")
    assert {(r["doc_id"], r["term"]) for r in D.term_hits(d, terms).collect()} == {(1, long), (1, longer), (1, "age"), (2, "age")}


def test_context_keeps_the_best_passages(spark):
    rows = [(k, "p", "age sex") for k in range(12)] + [(50, "p", "age sex bmi"), (51, "q", "age sex bmi")]
    terms = spark.createDataFrame([("p", "t", x) for x in ("age", "sex", "bmi")], "paper_id string, table_id string, term string")
    out = table_context(docs(spark, rows), terms).orderBy("rank").collect()
    assert [r["doc_id"] for r in out] == [50, *range(7)] and out[0]["score"] == 1.1


def test_passages_that_name_the_table_come_first(spark):
    rows = [(1, "p", "age sex", "results_like"), (2, "p", "see tables 4 and 2", "other"), (3, "p", "age only", "discussion_like"), (4, "q", "Table 2", "other"), (5, "p", "age sex", "results_like"), (6, "p", "bmi", "methods_like"), (7, "p", "Table 22", "other"), (8, "p", "Table 2 by age and sex", "results_like")]
    d = spark.createDataFrame([(i, p, t, r, "clash", "clash") for i, p, t, r in rows], DOC)
    terms = spark.createDataFrame([("p", "t", x) for x in ("age", "sex", "bmi")], "paper_id string, table_id string, term string")
    numbers = spark.createDataFrame([("p", "t", "2"), ("p", "u", None)], "paper_id string, table_id string, number string")
    out = table_passages(d, terms, numbers).orderBy("rank").collect()
    assert [(r["doc_id"], r["match_type"], r["score"]) for r in out] == [(2, "table_reference", 1.0), (8, "table_reference", 1.0), (1, "results_term_match", 0.7667), (6, "methods_term_match", 0.5333)]


def test_every_reference_has_its_window(spark):
    text = "Results\nOne. See Table 2. Two. As in Fig. 3, fell. Three.\n\nTables 1, S4 and 5 agree.\n\nTable 9 | a | b | c |\n|---|---|---|\n| 1 | 2 | 3 |"
    out = reference_windows(docs(spark, [(1, "p", text), (2, "p", None), (3, "p", "Table 2\u00a0and table 2."), (4, None, "none")]))
    rows = {(r["doc_id"], r["paragraph_index"], r["reference_index"]): r for r in out.collect()}
    assert {k: (r["reference_kind"], r["reference_number"]) for k, r in rows.items()} == {
        (1, 0, 0): ("table", "2"), (1, 0, 1): ("figure", "3"), (1, 1, 0): ("table", "1"), (1, 1, 1): ("table", "S4"), (1, 1, 2): ("table", "5"), (3, 0, 0): ("table", "2"), (3, 0, 1): ("table", "2"),
    }
    assert rows[1, 0, 0]["anchor_text"] == "One. See Table 2. Two." and rows[1, 0, 1]["anchor_text"] == "Two. As in Fig. 3, fell." and rows[1, 1, 2]["anchor_text"] == "Tables 1, S4 and 5 agree."
    assert all(r["anchor_text"][r["start_char"] : r["end_char"]] == r["matched_text"] for r in rows.values())


def test_bibliography(spark):
    text = "References\n1. Able A. One.\n  goes on\n[2] Baker B. Two.\n\nnot an entry\n4. Charlie."
    out = D.bibliography_entries(docs(spark, [(1, "p", text), (2, "p", "1. Again."), (3, None, None), (4, "p", "")]))
    rows = {(r["doc_id"], r["number"]): (r["entry_text"], r["n_lines"], r["suffix"]) for r in out.collect()}
    assert rows == {(1, 1): ("Able A. One. goes on", 2, 1), (1, 2): ("Baker B. Two.", 1, 1), (1, 4): ("Charlie.", 1, 1), (2, 1): ("Again.", 1, 2)}
    assert D.bibliography_report(out).select("min_number", "max_number", "n_missing").collect() == [(1, 4, 1)]


def test_furniture_and_mask(spark):
    rows = [(k, "p", f"Page {k} of 9\nown {chr(97 + k)} text") for k in range(4)] + [(9, "q", "Page 1 of 9"), (10, "p", None)]
    d = docs(spark, rows)
    marks = D.furniture(d)
    assert [(r["template"], r["n_docs"]) for r in marks.collect()] == [("Page <n> of <n>", 4)]
    left = {r["doc_id"]: r["n_lines"] for r in D.unmasked_lines(d, marks).collect()}
    assert left == {0: 1, 1: 1, 2: 1, 3: 1, 9: 1}


def test_sections_and_mentions(spark):
    d = docs(spark, [(1, "p", "Results\nTable 1. Counts (continued)\nsee Table 2 and Table S3"), (2, "p", "A long first sentence, with a comma."), (3, "p", None)])
    assert {r["doc_id"]: r["role"] for r in D.sections(d).collect()} == {1: "results_like", 2: None}
    assert {(r["number"], r["kind"]) for r in D.table_mentions(d).collect()} == {("1", "continuation"), ("2", "prose"), ("S3", "prose")}


def test_note_links(spark):
    d = docs(spark, [(1, "p", "* one; † two\nno † here"), (2, "p", "† other"), (3, None, "* three")])
    marks = spark.createDataFrame([("t", 1, 0, 0, g) for g in "*†‡"] + [("u", 1, 0, 0, "*")], "table_id string, row_idx int, col_idx int, ordinal int, glyph string")
    tables = spark.createDataFrame([("t", "p"), ("t", "p")], "table_id string, paper_id string")
    out = {(r["table_id"], r["glyph"]): r["status"] for r in link_notes(marks, definitions(d), tables).collect()}
    assert out == {("t", "*"): "resolved", ("t", "†"): "ambiguous", ("t", "‡"): "unresolved", ("u", "*"): "unresolved"}


def test_empty(spark):
    none = docs(spark, [(1, "p", "x")]).limit(0)
    for df in (D.lines(none), D.sections(none), D.table_mentions(none), D.bibliography_entries(none), D.furniture(none), definitions(none)):
        assert df.count() == 0
    assert D.term_hits(none, none.select("paper_id", F.col("text").alias("term"))).count() == 0
