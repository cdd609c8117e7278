"""Queries of the text problems, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.canonical_text import canonical_text
from tabloom.llm.components import connected_groups
from tabloom.llm.encoding import restore_encoding
from tabloom.llm.leakage import find_leaks
from tabloom.llm.linking import link_values
from tabloom.llm.packing import CAPACITY, pack
from tabloom.runtime import checkpoint, table


def _p2_links(spark: SparkSession, d: str) -> DataFrame:
    variables = table(spark, d, "def_variable").select(F.lit("variable").alias("record_kind"), F.col("variable_id").alias("record_id"), F.col("variable_label").alias("label"))
    levels = table(spark, d, "def_level").select(F.lit("level").alias("record_kind"), F.col("level_id").alias("record_id"), F.col("level_label").alias("label"))
    return link_values(variables.unionByName(levels), "record_kind", "label", table(spark, d, "canon_label"), ("record_kind", "record_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2_links(spark, d).select("record_kind", "record_id", "canon_id").distinct()


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values without an entry, as typed, with their rows and nearest score."""
    return _p2_links(spark, d).where("canon_id = 0").groupBy("record_kind", "value").agg(F.count("*").alias("n_rows"), F.round(F.max("score"), 6).alias("score"))


def _p5_texts(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "ext_cell").select(F.lit("cell").alias("record_kind"), "table_id", "row_idx", "col_idx", "text")
    levels = table(spark, d, "def_level").select(F.lit("level").alias("record_kind"), "table_id", "row_idx", F.lit(-1).alias("col_idx"), F.col("level_label").alias("text"))
    return canonical_text(cells.unionByName(levels), "text", ("record_kind", "table_id", "row_idx", "col_idx"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5_texts(spark, d).where("changed").select("record_kind", "table_id", "row_idx", "col_idx").distinct()


def p5_merged_texts(spark: SparkSession, d: str) -> DataFrame:
    """Plain texts that occur in several spellings, with how many."""
    spellings = _p5_texts(spark, d).where("text is not null").groupBy("record_kind", "canonical", "text").agg(F.count("*").alias("n"))
    return spellings.groupBy("record_kind", "canonical").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_rows")).where("n_spellings > 1")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    matches = table(spark, d, "col_decision").where("status = 'match'")
    return connected_groups(matches, "base_table_id", "continuation_table_id").select(F.col("record").alias("table_id"), "group_id")


def p7_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("group_id").agg(F.count("*").alias("n_tables"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents")).where(F.col("n_tokens") > CAPACITY).select("doc_id").distinct()


def p8_assignment(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers, the fewest that could do, unused share of their room, overfull ones, documents whose tokens aren't placed once."""
    pieces = checkpoint(p8_assignment(spark, d))
    boxes = pieces.where("container_id is not null").groupBy("container_id").agg(F.sum("piece_tokens").alias("held"))
    whole = pieces.groupBy("doc_id", "n_tokens").agg(F.sum("piece_tokens").alias("placed"), F.count("*").alias("n"), F.max("n_pieces").alias("n_pieces"))
    sums = boxes.agg(F.count("*").alias("n_containers"), F.sum("held").alias("n_tokens"), F.count_if(F.col("held") > CAPACITY).alias("n_overfull"))
    faults = whole.agg(F.count_if((F.col("placed") != F.col("n_tokens")) | (F.col("n") != F.col("n_pieces"))).alias("n_misplaced"))
    least = F.ceil(F.col("n_tokens") / CAPACITY)
    return sums.join(F.broadcast(faults)).select("n_containers", least.alias("fewest"), F.round(1 - F.col("n_tokens") / (F.col("n_containers") * CAPACITY), 6).alias("unused_share"), "n_overfull", "n_misplaced")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id").distinct()


def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, the documents that hold them and the largest share held."""
    leaks = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max(F.col("covered_words") / F.col("item_words")).alias("largest_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return restore_encoding(table(spark, d, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return restore_encoding(table(spark, d, "documents")).select("doc_id", "restored", "n_tokens", "n_lost", F.array_join("channels", ", ").alias("channels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_unmatched, p5_found, p5_merged_texts, p7_found, p7_group_sizes, p8_found, p8_assignment, p8_fill, p9_found, p9_leaked_items, p10_found, p10_restored)
}

_P7 = """
with recursive e as (
  select distinct base_table_id as a, continuation_table_id as b from col_decision
  where status = 'match' and base_table_id <> continuation_table_id),
u as (select a, b from e union select b, a from e),
reach(a, b) as (select a, b from u union select reach.a, u.b from reach join u on reach.b = u.a),
groups as (select a as table_id, least(a, min(b)) as group_id from reach group by a)
"""
SQL: dict[str, str] = {
    "p7_found": _P7 + "select table_id, group_id from groups",
    "p7_group_sizes": _P7 + "select group_id, count(*) as n_tables from groups group by group_id",
}
