"""Note marks in cells, their definitions in the text, and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signs that mark notes, and a definition: a sign, a blank and text up to the next sign or semicolon.
SIGNS = "[*†‡§¶#]"
DEFINITION = rf"{SIGNS} [^*†‡§¶#;]+"


#: The beginning of a definition: a sign, or a single letter or small number and a blank or bracket, before a capital or a word.
DEFINITION_START = rf"^(?:{SIGNS}+ ?|[a-z][).]? |[0-9]{{1,2}}[).]? )[A-Z]"


def glyph_kind(glyph: Column) -> Column:
    """symbol, letter, number or other."""
    return F.when(glyph.rlike(f"^{SIGNS}+$"), "symbol").when(glyph.rlike("^[0-9]+$"), "number").when(glyph.rlike("^[A-Za-z]$"), "letter").otherwise("other")


def cell_markers(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, col_idx, ordinal, glyph): note signs of unique cells, in order of appearance."""
    return cells.select("table_id", "row_idx", "col_idx", F.posexplode(F.regexp_extract_all("clean", F.lit(f"({SIGNS})"), F.lit(1))).alias("ordinal", "glyph"))


def definitions(docs: DataFrame) -> DataFrame:
    """(paper_id, doc_id, glyph, definition): note definitions in lines that begin with a sign."""
    lines = docs.where("paper_id is not null").select("paper_id", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(f"^{SIGNS} "))
    parts = lines.select("paper_id", "doc_id", F.explode(F.regexp_extract_all("line", F.lit(f"({DEFINITION})"), F.lit(1))).alias("part"))
    return parts.select("paper_id", "doc_id", F.substring("part", 1, 1).alias("glyph"), F.trim(F.expr("substring(part, 3)")).alias("definition")).distinct()


def link_notes(markers: DataFrame, defined: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds n_definitions, status and confidence to the markers: definitions of the same sign in the paper.

    Definitions are counted per paper and sign before the join, which has one row per marker. A marker of a table
    without a paper is unresolved.
    """
    counts = defined.groupBy("paper_id", "glyph").agg(F.countDistinct("definition").alias("n_definitions"))
    papers = tables.groupBy("table_id").agg(F.min("paper_id").alias("paper_id"))
    linked = markers.join(papers, "table_id", "left").join(counts, ["paper_id", "glyph"], "left").withColumn("n_definitions", F.coalesce("n_definitions", F.lit(0)))
    n = F.col("n_definitions")
    return linked.withColumn("status", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")).withColumn("confidence", F.when(n == 0, 0.0).otherwise(0.5))


def anchors(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """(table_id, scope, row_idx, col_idx, ordinal, glyph): note signs in cells and captions. A caption's place is -1.

    A sign that stands alone in its cell is a bar or a blank's filling, not a note; ``#`` before a digit numbers something.
    """
    sign = rf"({SIGNS})(?![0-9])"
    shown = cells.where(~F.col("clean").rlike(rf"^{SIGNS}+$")).select("table_id", F.lit("cell").alias("scope"), "row_idx", "col_idx", F.col("clean").alias("text"))
    captions = tables.where("caption is not null").select("table_id", F.lit("caption").alias("scope"), F.lit(-1).alias("row_idx"), F.lit(-1).alias("col_idx"), F.col("caption").alias("text")).distinct()
    both = shown.unionByName(captions)
    return both.select("table_id", "scope", "row_idx", "col_idx", F.posexplode(F.regexp_extract_all("text", F.lit(sign), F.lit(1))).alias("ordinal", "glyph"))


def footer_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): lines that begin like a note's definition, up to the first line of the document that names a DOI."""
    stop = F.max(F.col("line").rlike(r"(?i)\bdoi\b|10\.\d{4,}/").cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("stopped", stop).where(F.col("line").rlike(DEFINITION_START) & (F.col("stopped") == 0)).select("doc_id", "line_no", "line")


def definition_markers(lines: DataFrame, structured: DataFrame | None = None) -> DataFrame:
    """(doc_id, line_no, start, glyph, origin): marks of definitions in footer lines; found ones give way to overlapping structured ones.

    ``structured``: doc_id, line_no, start, glyph, known from the page. start counts characters from 0.
    """
    found = lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(rf"(?:^|; ?)({SIGNS}+|[a-z](?=[).]? [A-Z])|[0-9]{{1,2}}(?=[).]? [A-Z]))"), F.lit(1))).alias("glyph"), "line")
    placed = found.select("doc_id", "line_no", (F.expr("locate(glyph, line)") - 1).alias("start"), "glyph").distinct()
    own = placed.withColumn("origin", F.lit("found"))
    if structured is None:
        return own
    given = structured.select("doc_id", "line_no", "start", "glyph", F.lit("structured").alias("origin"))
    over = given.select("doc_id", "line_no", F.col("start").alias("low"), (F.col("start") + F.length("glyph")).alias("high"))
    clash = (own["doc_id"] == over["doc_id"]) & (own["line_no"] == over["line_no"]) & (own["start"] < over["high"]) & (own["start"] + F.length(own["glyph"]) > over["low"])
    return given.unionByName(own.join(over, clash, "left_anti"))


def bibliography_mentions(marks: DataFrame, notes: DataFrame, entries: DataFrame) -> DataFrame:
    """(paper_id, doc_id, number, n_entries, status): number marks without a note of their own, met with the paper's reference list.

    ``marks``: paper_id, doc_id, number; ``notes``: paper_id, number that a note defines; ``entries``: paper_id, number, doc_id, line_no.
    """
    open_marks = marks.distinct().join(notes.select("paper_id", "number").distinct(), ["paper_id", "number"], "left_anti")
    counts = entries.groupBy("paper_id", "number").agg(F.count("*").alias("n_entries"))
    out = open_marks.join(counts, ["paper_id", "number"], "left").withColumn("n_entries", F.coalesce("n_entries", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n_entries") == 1, "resolved").when(F.col("n_entries") > 1, "ambiguous").otherwise("unresolved"))
