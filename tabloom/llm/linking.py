"""Freely typed values mapped to a canonical list.

Values are deduplicated before anything else, normalised to name variants, and looked up in a character n-gram inverted
index; they are scored by weighted cosine and accepted above a threshold and a margin, in the band below it after an exact
check. The distinct values' results go back to the rows by a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.fold import bare
from tabloom.functions.labels import variants
from tabloom.functions.ngrams import ACCEPTED, LEAD, NgramIndex
from tabloom.functions.units import is_unit
from tabloom.runtime import reference_rows

#: Kinds whose values may end in a unit.
WITH_UNITS = ("variable",)


def link_values(df: DataFrame, kind_col: str, value_col: str, canon: DataFrame, keep: Sequence[str] = (), threshold: float = ACCEPTED, margin: float = LEAD) -> DataFrame:
    """Rows ``keep``, kind, value, canon_id, score, margin: one per row of ``df``, repeats included.

    canon (canon_id, label_kind, canon_text, aliases) is a reference list of fixed size; its rows are checked before each
    task gets them (ValueError beyond REFERENCE_ROWS). canon_id is 0 where nothing reaches the threshold, where two
    entries lie within the margin, where the value is null or blank, and where its kind has no entries.
    """
    entries = [(r["canon_id"], r["label_kind"], [r["canon_text"], *(r["aliases"] or [])]) for r in reference_rows(canon.select("canon_id", "label_kind", "canon_text", "aliases"))]
    named = [(kind, i, bare(n)) for i, kind, names in entries for n in names if n and kind is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {kind: NgramIndex([(i, n) for k, i, n in named if k == kind]) for kind in {k for k, _, _ in named}}
        for batch in batches:
            kind, value = batch.column("link_kind"), batch.column("link_value")
            found = [
                index[k].best(*variants(v, is_unit if k in WITH_UNITS else None), threshold, margin) if k in index and v.strip() else (0, 0.0, 0.0)
                for k, v in zip(kind.to_pylist(), value.to_pylist())
            ]
            columns = [pa.array([x[n] for x in found], t) for n, t in enumerate((pa.int32(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([kind, value, *columns], names=["link_kind", "link_value", "canon_id", "score", "margin"])

    rows = df.select(*[F.col(k).alias(f"keep_{n}") for n, k in enumerate(keep)], F.col(kind_col).alias("link_kind"), F.col(value_col).alias("link_value"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.where("link_kind is not null and link_value is not null").select("link_kind", "link_value").distinct().repartition(tasks, "link_value", "link_kind")
    found = distinct.mapInArrow(run, "link_kind string, link_value string, canon_id int, score double, margin double").withColumnRenamed("link_value", "join_value").withColumnRenamed("link_kind", "join_kind")
    # rows without a value go to any task; a value of very many rows is split by the adaptive join
    spread = F.concat(F.lit("\x00"), F.xxhash64(*[f"keep_{n}" for n in range(len(keep))] or [F.lit(0)]).cast("string"))
    keyed = rows.withColumn("join_value", F.coalesce("link_value", spread)).withColumn("join_kind", F.coalesce("link_kind", spread))
    joined = keyed.join(found.hint("merge"), ["join_value", "join_kind"], "left")
    return joined.select(
        *[F.col(f"keep_{n}").alias(k) for n, k in enumerate(keep)], F.col("link_kind").alias("kind"), F.col("link_value").alias("value"),
        F.coalesce("canon_id", F.lit(0)).alias("canon_id"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
    )
