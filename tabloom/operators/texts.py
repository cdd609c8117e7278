"""Paragraphs, visuals named by captions, and what kind of thing a label names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import clean_text, label_text, visual_kind, visual_number

# A figure's caption, a table's caption within the text, cues of a mention, and printed table bodies.
FIGURE_CAPTION = r"(?i)(?:^|[.;]\s)((?:Fig\.?|Figure)\s*[A-Za-z]?\d+[A-Za-z]?)\b(?:[.:]\s*|\s+(?-i:[A-Z]))"
TABLE_START = r"(?i)\bTable\s+[A-Za-z]?\d+[A-Za-z]?\b.{0,240}?\|"
CUE = r"(?i)(?:\b(?:shown|presented|reported|summari[sz]ed|listed|described|displayed|provided|given|seen)\s+in\s*$|\b(?:see|refer\s+to|according\s+to)\s*$)"
# Words of adjustment lists, and levels that a parent variable of that name explains.
ADJUSTED_FOR = ["age", "bmi", "diabetes", "drinking", "educational", "education", "gender", "hypertension", "marital", "physical", "pir", "race", "sex", "smoking", "status"]
LEVELS_OF = {
    "sex": ["male", "female"],
    "gender": ["male", "female"],
    "smoking status": ["never", "former", "current"],
    "drinking status": ["never", "former", "current"],
    "marital status": ["married", "living", "living with partner", "single", "divorced", "separated", "widowed"],
    "race": ["mexican", "non hispanic", "other", "other multiracial", "white", "black"],
    "educational level": ["less", "college", "high", "less than high school", "high school", "college or above"],
}


def _is_table_text(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"\|")) >= 8) | text.rlike(r"\|\s*-{3,}\s*\|")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph_index, paragraph): cleaned parts between blank lines, without printed tables; from 0 in order.

    A paragraph that runs into a printed table ends before the table's label, unless a cue makes that label a mention.
    Null and blank texts have none; repeated documents each have theirs.
    """
    parts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\n\s*\n")).alias("at", "part"))
    clean = F.coalesce(clean_text(F.col("part")), F.lit(""))
    cut = parts.select("id", "at", clean.alias("part")).withColumn("place", F.regexp_instr("part", F.lit(TABLE_START)))
    tail, before = F.expr("substring(part, place)"), F.expr("substring(part, greatest(1, place - 120), least(120, place - 1))")
    ends = (F.col("place") > 0) & ~F.trim(before).rlike(CUE) & _is_table_text(tail)
    kept = cut.withColumn("part", F.when(ends, F.trim(F.expr("substring(part, 1, place - 1)"))).otherwise(F.col("part"))).where(F.col("part") != "").where(~_is_table_text(F.col("part")))
    return kept.select(F.col("id").alias(id_col), (F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1).alias("paragraph_index"), F.col("part").alias("paragraph"))


def table_visuals(tables: DataFrame) -> DataFrame:
    """(paper_id, visual_kind, number, source, n_sources): tables whose caption names a number, one per paper and number.

    source is the smallest table_id; a number that several tables carry is one visual.
    """
    named = tables.select("paper_id", "table_id", visual_kind(F.col("caption")).alias("visual_kind"), visual_number(F.col("caption")).alias("number")).where("visual_kind = 'table' and number is not null")
    return named.groupBy("paper_id", "visual_kind", "number").agg(F.min("table_id").alias("source"), F.countDistinct("table_id").alias("n_sources"))


def figure_visuals(docs: DataFrame) -> DataFrame:
    """(paper_id, visual_kind, number, source, n_sources): figures captioned in a paper's documents; source is the first document."""
    said = docs.where("paper_id is not null and text is not null").select("paper_id", "doc_id", F.explode(F.regexp_extract_all("text", F.lit(FIGURE_CAPTION), F.lit(1))).alias("label"))
    named = said.select("paper_id", "doc_id", F.lit("figure").alias("visual_kind"), F.upper(F.regexp_extract("label", r"([A-Za-z]?\d+[A-Za-z]?)$", 1)).alias("number"))
    return named.groupBy("paper_id", "visual_kind", "number").agg(F.min("doc_id").cast("string").alias("source"), F.countDistinct("doc_id").alias("n_sources"))


def visual_inventory(tables: DataFrame, docs: DataFrame) -> DataFrame:
    """Tables and figures of each paper with an identity: visual_id, and whether its label is ambiguous."""
    both = table_visuals(tables).unionByName(figure_visuals(docs))
    return both.withColumn("visual_id", F.concat_ws("-", "paper_id", "visual_kind", F.lower("number"))).withColumn("is_ambiguous", F.col("n_sources") > 1)


def mention_classes(variables: DataFrame, levels: DataFrame, papers: DataFrame, canonical: Column) -> DataFrame:
    """(variable_id, mention_class): artifact, level, range_bin, variable or unknown, the first that holds.

    A label is a level where its table or paper defines a level of that name, or a parent variable that explains it.
    ``canonical``: expression of the label's canonical form. Null labels are artifacts.
    """
    raw = F.coalesce(clean_text(F.col("variable_label")), F.lit(""))
    own = variables.select("variable_id", "table_id", "variable_label", raw.alias("cleaned"), F.lower(label_text(raw)).alias("key"), F.lower(label_text(F.coalesce(canonical, F.lit("")))).alias("name")).distinct()
    of = papers.groupBy("table_id").agg(F.min("paper_id").alias("paper_id"))
    named = levels.select("table_id", F.lower(label_text("level_label")).alias("key")).where("key <> ''").distinct()
    in_table = named.withColumn("in_table", F.lit(True))
    in_paper = named.join(of, "table_id").select("paper_id", "key").distinct().withColumn("in_paper", F.lit(True))
    parent_of = F.explode(F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(v).alias("key")) for p, vs in LEVELS_OF.items() for v in vs]))
    parents = own.join(of, "table_id", "left").where(F.col("key").isin(list(LEVELS_OF))).select("paper_id", F.col("key").alias("parent")).distinct()
    explained = parents.join(F.broadcast(parents.sparkSession.range(1).select(parent_of.alias("p")).select("p.*")), "parent").select("paper_id", "key").distinct().withColumn("is_explained", F.lit(True))
    marked = own.join(of, "table_id", "left").join(in_table, ["table_id", "key"], "left").join(in_paper, ["paper_id", "key"], "left").join(explained, ["paper_id", "key"], "left")
    cleaned, key = F.col("cleaned"), F.col("key")
    words = F.filter(F.split("key", " "), lambda w: w != "")
    listed = (F.size(words) >= 5) & (F.size(F.filter(words, lambda w: w.isin(ADJUSTED_FOR))) >= 4)
    compact = F.replace(cleaned, F.lit(" "), F.lit(""))
    kind = (
        F.when(cleaned == "", "artifact")
        .when(cleaned.rlike(r"(?i)^table\s+[A-Za-z0-9.]*\d[A-Za-z0-9.]*.*continued") | F.replace(cleaned, F.lit("__"), F.lit("_")).rlike(r"(?i)^model[\s_-]*\d+$"), "artifact")
        .when(cleaned.rlike(r"(?i)\breference\b") & key.rlike("yes|no|reference"), "artifact")
        .when((F.regexp_count(cleaned, F.lit(",")) >= 3) & (F.length(cleaned) >= 30), "artifact")
        .when(listed, "artifact")
        .when(F.col("in_table") | F.col("in_paper"), "level")
        .when(F.replace(cleaned, F.lit(" "), F.lit("_")).rlike(r"(?i)^(?:q\d+|quartile[\s_-]*\d+|quintile[\s_-]*\d+)$") | key.rlike("quintile|quartile"), "level")
        .when(compact.rlike(r"^(?:(?:[<>]=?)?\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?\+?)?)$"), "range_bin")
        .when(F.col("is_explained"), "level")
        .when(F.length(F.replace("name", F.lit(" "), F.lit(""))) >= 3, "variable")
        .when(cleaned.rlike(r"\p{L}"), "unknown")
        .otherwise("artifact")
    )
    return marked.select("variable_id", kind.alias("mention_class")).distinct()


def in_order(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """``keys`` and values: the distinct values of each key in the order in which they first appear; null and empty ones left out."""
    firsts = values.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("first"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda x: x[value]).alias("values"))


def is_unit_mark(glyph: Column, place: Column, before: Column) -> Column:
    """Whether a raised or lowered number belongs to a unit, an exponent or a formula rather than to a note. ``before``: the text it is attached to."""
    compact = F.regexp_replace(before, r"\s+", "")
    unit = (
        compact.rlike("(?i)(?:×|x|\\*)?10$") | ((place == "superscript") & compact.rlike("^[A-Za-z]$")) | compact.rlike("(?i)(?:^|[^A-Za-z0-9])(?:m|cm|mm|kg|g|mg|ug|μg|l|dl|ml|mol|mmol|umol|μmol)$")
        | (compact.contains("/") & compact.rlike("[A-Za-zμ][A-Za-zμ0-9.]*$")) | compact.rlike(r"\d+(?:\.\d+)?[A-Za-zμ]+$") | ((place == "subscript") & compact.rlike("[A-Z]{1,4}$"))
    )
    return F.coalesce(glyph.rlike("^[0-9]+$") & place.isin("superscript", "subscript") & (compact != "") & unit, F.lit(False))
