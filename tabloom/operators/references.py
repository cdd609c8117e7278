"""References to records that do not exist, or not at the time they were used.

Parent ids are split into a prefix and a trailing integer. Within blocks of the integer range the parents'
integers are compressed into runs of consecutive keys; a referenced key is matched to the run that starts
at or before it and is missing if it lies beyond that run's end. What exists is then swept over time:
recordings and withdrawals are summed by id and day, so that an id holding a third of all rows is spread
over its days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one block: a run list never holds more than half as many runs. Keys over which the missing ids are spread.
BLOCK, SALT = 1024, 16
_ID = r"(?s)^(.*?)(0|[1-9][0-9]{0,17})$"


def key_parts(identifier: Column) -> tuple[Column, Column, Column]:
    """Prefix, integer key and block of an id; an id without trailing digits has key -1."""
    digits = F.regexp_extract(identifier, _ID, 2)
    has = digits != ""
    key = F.when(has, digits.cast("long")).otherwise(F.lit(-1).cast("long"))
    return F.when(has, F.regexp_extract(identifier, _ID, 1)).otherwise(identifier), key, F.floor(key / BLOCK).cast("long")


def parent_runs(parents: DataFrame, id_col: str) -> DataFrame:
    """(prefix, block, runs): the ids of ``parents`` as runs of consecutive integers, ascending."""
    prefix, key, block = key_parts(F.col(id_col))
    keys = (
        parents.where(F.col(id_col).isNotNull())
        .select(prefix.alias("prefix"), block.alias("block"), key.alias("key"))
        .groupBy("prefix", "block")
        .agg(F.array_sort(F.collect_set("key")).alias("keys"))
    )
    starts = F.filter("keys", lambda k, i: (i == 0) | (F.element_at("keys", F.greatest(i, F.lit(1))) != k - 1))
    ends = F.filter("keys", lambda k, i: (i == F.size("keys") - 1) | (F.element_at("keys", F.least(i + 2, F.size("keys"))) != k + 1))
    return keys.select("prefix", "block", F.arrays_zip(starts.alias("start"), ends.alias("end")).alias("runs"))


def missing_ids(references: DataFrame, ref_col: str, parents: DataFrame, id_col: str) -> DataFrame:
    """Distinct referenced ids (column ``ref_id``) that no parent row has."""
    prefix, key, block = key_parts(F.col("ref_id"))
    wanted = (
        references.where(F.col(ref_col).isNotNull())
        .select(F.col(ref_col).alias("ref_id"))
        .distinct()
        .select("ref_id", prefix.alias("prefix"), key.alias("key"), block.alias("block"))
    )
    return (
        wanted.join(parent_runs(parents, id_col), ["prefix", "block"], "left")
        .where(F.coalesce(F.try_element_at(F.filter("runs", lambda r: r["start"] <= F.col("key")), F.lit(-1))["end"] < F.col("key"), F.lit(True)))
        .select("ref_id")
    )


def _state_at(references: DataFrame, parents: DataFrame) -> DataFrame:
    """For (ref_row, ref_id, at): parents of the id recorded by then, and parents live then."""
    live = F.col("from").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("from")))
    events = parents.where(F.col("from").isNotNull()).select(
        "ref_id",
        F.explode(
            F.array(
                F.struct(F.col("from").alias("ts"), F.lit(1).alias("recorded"), F.when(live, 1).otherwise(0).alias("live")),
                F.struct(F.col("until").alias("ts"), F.lit(0).alias("recorded"), F.when(live, -1).otherwise(0).alias("live")),
            )
        ).alias("e"),
    )
    nothing = F.lit(None).cast("string")
    rows = (
        events.where(F.col("e.ts").isNotNull())
        .select("ref_id", F.col("e.ts").alias("ts"), F.col("e.recorded").alias("recorded"), F.col("e.live").alias("live"), F.lit(False).alias("asks"), nothing.alias("ref_row"))
        .unionByName(references.select("ref_id", F.col("at").alias("ts"), F.lit(0).alias("recorded"), F.lit(0).alias("live"), F.lit(True).alias("asks"), "ref_row"))
        .withColumn("day", F.to_date("ts"))
    )
    days = rows.groupBy("ref_id", "day").agg(F.sum("recorded").alias("day_recorded"), F.sum("live").alias("day_live"))
    before = Window.partitionBy("ref_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(
        "ref_id",
        "day",
        F.coalesce(F.sum("day_recorded").over(before), F.lit(0)).alias("old_recorded"),
        F.coalesce(F.sum("day_live").over(before), F.lit(0)).alias("old_live"),
    )
    within = Window.partitionBy("ref_id", "day").orderBy("ts", "asks").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("recorded", F.sum("recorded").over(within)).withColumn("live", F.sum("live").over(within)).where("asks")
    return swept.join(carried, ["ref_id", "day"]).select(
        "ref_row", "ref_id", (F.col("recorded") + F.col("old_recorded")).alias("recorded"), (F.col("live") + F.col("old_live")).alias("live")
    )


def find_orphans(
    references: DataFrame,
    parents: DataFrame,
    *,
    row_col: str = "reference_id",
    ref_col: str = "resolved_visual_id",
    at_col: str = "observed_at",
    id_col: str = "visual_id",
    from_col: str = "recorded_at",
    until_col: str = "withdrawn_at",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per reference whose parent isn't live at the reference's time: ``row_col``, ``keep``, ``fault``.

    fault: ``missing`` if no parent row has the id, ``late`` if all its rows were recorded after, else ``withdrawn``.
    Exact copies count once. A null id refers to nothing and gives no row. A reference without a time can't find its
    parent live: ``missing`` or ``withdrawn``. A parent without a recording time counts as not recorded yet; one
    withdrawn before it was recorded was never live. Empty tables give no rows; other columns are ignored.
    """
    refs = references.where(F.col(ref_col).isNotNull()).select(
        F.col(row_col).cast("string").alias("ref_row"), F.col(ref_col).alias("ref_id"), F.col(at_col).alias("at"), *[F.col(k) for k in keep]
    )
    refs = refs.distinct()
    shown = parents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("ref_id"), F.col(from_col).alias("from"), F.col(until_col).alias("until")).distinct()
    # one id may hold a third of all references: they are spread, and each missing id, of which there is one, goes to all parts
    missing = missing_ids(refs, "ref_id", shown, "ref_id").withColumn("is_missing", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    marked = refs.withColumn("salt", F.pmod(F.xxhash64("ref_row"), F.lit(SALT)).cast("int")).join(missing, ["ref_id", "salt"], "left").drop("salt")
    absent = marked.where("is_missing").select("ref_row", *keep, F.lit("missing").alias("fault"))
    present = marked.where("is_missing is null").drop("is_missing")
    untimed = present.where("at is null").select("ref_row", *keep, F.lit("withdrawn").alias("fault"))
    packed = present.where("at is not null").select(F.to_json(F.struct("ref_row", *keep), {"ignoreNullFields": "false"}).alias("ref_row"), "ref_id", "at") if keep else present.where("at is not null")
    swept = _state_at(packed, shown).where("live <= 0").withColumn("fault", F.when(F.col("recorded") == 0, "late").otherwise("withdrawn"))
    if keep:
        schema = refs.select("ref_row", *keep).schema
        swept = swept.select(F.from_json("ref_row", schema).alias("r"), "fault").select("r.*", "fault")
    else:
        swept = swept.select("ref_row", "fault")
    kind = references.schema[row_col].dataType
    return absent.unionByName(untimed).unionByName(swept).distinct().withColumn("ref_row", F.col("ref_row").cast(kind)).withColumnRenamed("ref_row", row_col)
