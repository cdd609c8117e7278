"""References to tables and figures: resolution by key, checks of each visual, and dominant styles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_references(references: DataFrame, visuals: DataFrame) -> DataFrame:
    """One row per reference: candidates of the same paper, kind and number, the id if there is one, and a status.

    Candidates are counted once per id, so that the join has one row per key; the status of references in
    reference lists without candidate is external_or_bibliographic.
    """
    keys = visuals.where("visual_number is not null").groupBy("paper_id", "visual_kind", F.upper("visual_number").alias("number")).agg(F.countDistinct("visual_id").alias("n_candidates"), F.min("visual_id").alias("candidate"))
    refs = references.select("reference_id", "paper_id", F.col("reference_kind").alias("visual_kind"), F.upper("reference_number").alias("number"), "role_hint").distinct()
    found = refs.join(keys, ["paper_id", "visual_kind", "number"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    status = F.when(F.col("n_candidates") == 1, "resolved").when(F.col("n_candidates") > 1, "ambiguous").when(F.col("role_hint") == "references_like", "external_or_bibliographic").otherwise("unresolved")
    return found.select("reference_id", "paper_id", "n_candidates", F.when(F.col("n_candidates") == 1, F.col("candidate")).alias("resolved_id"), status.alias("status"))


def reference_checks(visuals: DataFrame, references: DataFrame) -> DataFrame:
    """One row per visual id: referenced_in_text, no_text_reference or supplementary_exempt, and how many references."""
    counts = references.where("resolution_status = 'resolved' and resolved_visual_id is not null").groupBy(F.col("resolved_visual_id").alias("visual_id")).agg(F.countDistinct("reference_id").alias("n_references"))
    exempt = F.coalesce(F.col("caption").rlike(r"(?i)\b(?:supplementary|supplemental|supplement|appendix)\b"), F.lit(False)) | F.coalesce(F.upper("visual_number").startswith("S"), F.lit(False))
    one = visuals.withColumn("exempt", exempt).groupBy("visual_id").agg(F.max("exempt").alias("exempt"))
    status = F.when(F.col("exempt"), "supplementary_exempt").when(F.coalesce("n_references", F.lit(0)) > 0, "referenced_in_text").otherwise("no_text_reference")
    return one.join(counts, "visual_id", "left").select("visual_id", F.coalesce("n_references", F.lit(0)).alias("n_references"), status.alias("status"))


def dominant(df: DataFrame, keys: list[str], value: str, share: float = 0.7) -> DataFrame:
    """Per key the most frequent value (ties: the smallest), its share, and the style: the value, or mixed below ``share``."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*keys)
    ranked = counts.withColumn("total", F.sum("n").over(total)).withColumn("rank", F.row_number().over(total.orderBy(F.desc("n"), value)))
    top = ranked.where("rank = 1").withColumn("top_share", F.col("n") / F.col("total"))
    return top.select(*keys, F.col(value).alias("top_value"), "n", "total", F.when(F.col("top_share") < share, "mixed").otherwise(F.col(value)).alias("style"))
