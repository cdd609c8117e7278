"""Tables that go on over pages: numbering, as-of parents, header checks, groups and merged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"(?i)\btable +(s?[0-9]+)"
CONTINUED = r"(?i)\bcontinued\b"


def numbered_tables(tables: DataFrame) -> DataFrame:
    """One row per table in page order of its paper: idx, number, continued. Copies count once; null captions have no number."""
    one = tables.groupBy("paper_id", "table_id").agg(F.min("page_num").alias("page_num"), F.min("caption").alias("caption"), F.max("n_cols").alias("n_cols"))
    order = Window.partitionBy("paper_id").orderBy("page_num", "table_id")
    return one.withColumn("idx", F.row_number().over(order)).withColumn("number", F.nullif(F.upper(F.regexp_extract("caption", NUMBER, 1)), F.lit(""))).withColumn("continued", F.coalesce(F.col("caption").rlike(CONTINUED), F.lit(False)))


def parents(numbered: DataFrame) -> DataFrame:
    """Continuation tables with their as-of parent: the last table before with the same number, or for one without a
    caption the last table of the page before. rule: explicit, inferred or none."""
    same = Window.partitionBy("paper_id", "number").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    explicit = numbered.where("number is not null").withColumn("parent_idx", F.max("idx").over(same)).where("continued")
    pages = numbered.groupBy("paper_id", "page_num").agg(F.max("idx").alias("parent_idx")).withColumn("page_num", F.col("page_num") + 1)
    inferred = numbered.where("caption is null").join(pages, ["paper_id", "page_num"]).select(*numbered.columns, "parent_idx")
    both = explicit.select(*numbered.columns, "parent_idx", F.when(F.col("parent_idx").isNull(), "none").otherwise("explicit").alias("rule")).unionByName(inferred.withColumn("rule", F.lit("inferred")))
    base = numbered.select("paper_id", F.col("idx").alias("parent_idx"), F.col("table_id").alias("parent_id"), F.col("n_cols").alias("parent_cols"))
    return both.join(base, ["paper_id", "parent_idx"], "left")


def comparison_labels(roles: DataFrame) -> DataFrame:
    """(table_id, labels): the header labels beyond the first column in order, sizes taken off."""
    label = F.trim(F.regexp_replace("match_text", r" *\(? *n *= *[0-9,]+ *\)?", ""))
    return roles.where("col_idx > 0").groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", label.alias("label")))), lambda x: x["label"]), " | ").alias("labels"))


def column_checks(linked: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds check and confidence: whether a continuation's columns agree with its parent's."""
    own, theirs = labels.withColumnRenamed("labels", "own_labels"), labels.select(F.col("table_id").alias("parent_id"), F.col("labels").alias("parent_labels"))
    both = linked.join(own, "table_id", "left").join(theirs, "parent_id", "left")
    check = (
        F.when(F.col("parent_id").isNull(), "no_parent")
        .when(F.col("own_labels").isNull() & F.col("parent_labels").isNull(), "missing_both")
        .when(F.col("parent_labels").isNull(), "missing_base")
        .when(F.col("own_labels").isNull(), "missing_continuation")
        .when((F.col("n_cols") == F.col("parent_cols")) & (F.col("own_labels") == F.col("parent_labels")), "match")
        .otherwise("mismatch")
    )
    confidence = F.when(F.col("check") == "match", 0.95).when(F.col("check") == "mismatch", 0.2).otherwise(0.0)
    return both.withColumn("check", check).withColumn("confidence", confidence)


def continuation_groups(numbered: DataFrame) -> DataFrame:
    """Adds base_id: the table that begins the run of tables of one number in which each but the first is continued."""
    w = Window.partitionBy("paper_id", "number").orderBy("idx")
    starts = numbered.where("number is not null").withColumn("run", F.sum(F.when(F.col("continued"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("paper_id", "number", "run").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return starts.withColumn("base_id", F.first("table_id").over(whole)).withColumn("part", F.row_number().over(Window.partitionBy("paper_id", "number", "run").orderBy("idx")))


def merged_rows(groups: DataFrame, rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of each group in one numbering: all of the base table, then the body rows of the others."""
    own = rows.select("table_id", "row_idx").join(groups.select("table_id", "base_id", "part"), "table_id").join(starts.select("table_id", "body_start"), "table_id", "left")
    kept = own.where((F.col("part") == 1) | (F.col("row_idx") >= F.col("body_start")))
    return kept.select("base_id", "table_id", "row_idx", (F.row_number().over(Window.partitionBy("base_id").orderBy("part", "row_idx")) - 1).alias("merged_idx"))


def resolved_tables(groups: DataFrame, checks: DataFrame) -> DataFrame:
    """(table_id, resolved_id, role, n_fragments): tables of a number joined with those whose columns agreed with their parent's.

    ``groups`` are those of continuation_groups; ``checks``: table_id, check. A continuation whose check isn't ``match``
    stands alone from there on. role: base, continuation or single.
    """
    own = groups.join(checks.select("table_id", F.col("check").alias("fits")).distinct(), "table_id", "left")
    apart = (F.col("part") == 1) | ~F.coalesce(F.col("fits") == "match", F.lit(False))
    order = Window.partitionBy("base_id").orderBy("part")
    runs = own.withColumn("piece", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("base_id", "piece")
    out = runs.withColumn("resolved_id", F.first("table_id").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_fragments", F.count("*").over(whole))
    role = F.when(F.col("n_fragments") == 1, "single").when(F.col("table_id") == F.col("resolved_id"), "base").otherwise("continuation")
    return out.select("table_id", "resolved_id", role.alias("role"), "n_fragments")


def integrated_variables(resolved: DataFrame, groups: DataFrame, variables: DataFrame) -> DataFrame:
    """(resolved_id, table_id, variable_id, row_start, place): the variables of a table's fragments in one order. Copies count once."""
    parts = resolved.join(groups.select("table_id", "part"), "table_id")
    own = variables.select("table_id", "variable_id", "row_start").distinct().join(parts.select("table_id", "resolved_id", "part"), "table_id")
    return own.select("resolved_id", "table_id", "variable_id", "row_start", "part", (F.row_number().over(Window.partitionBy("resolved_id").orderBy("part", "row_start", "variable_id")) - 1).alias("place"))


def boundary_decisions(integrated: DataFrame, variables: DataFrame, levels: DataFrame) -> DataFrame:
    """(resolved_id, table_id, variable_id, decision): what the first variable of a continuation is to the last one before it.

    ``repeated_head``: it has the same label; ``attach``: it has no levels of its own while that one has, and isn't one of
    them already; ``duplicate_level``: that one has a level of this label; else ``separate``.
    """
    label = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    named = variables.groupBy("variable_id").agg(F.min(label(F.col("variable_label"))).alias("label"))
    counts = levels.groupBy("variable_id").agg(F.countDistinct("level_id").alias("n_levels"), F.collect_set(label(F.col("level_label"))).alias("level_labels"))
    told = integrated.join(named, "variable_id").join(counts, "variable_id", "left").withColumn("n_levels", F.coalesce("n_levels", F.lit(0)))
    order = Window.partitionBy("resolved_id").orderBy("place")
    before = {n: F.lag(n).over(order) for n in ("table_id", "label", "n_levels", "level_labels")}
    edge = told.select("*", *[c.alias(f"prior_{n}") for n, c in before.items()]).where("prior_table_id is not null and prior_table_id <> table_id")
    decision = (
        F.when(F.col("label") == F.col("prior_label"), "repeated_head").when(F.coalesce(F.array_contains("prior_level_labels", F.col("label")), F.lit(False)), "duplicate_level")
        .when((F.col("n_levels") == 0) & (F.col("prior_n_levels") > 0), "attach").otherwise("separate")
    )
    return edge.select("resolved_id", "table_id", "variable_id", decision.alias("decision"))
