"""Session helpers: tables by folder, shared checkpoints, size-checked driver lists."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a reference list that may be held by every task.
REFERENCE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; make one only where it is unset and the session is one machine.

    Raises ValueError on a cluster that names none: its executors can't read a folder of one machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and not (context.master.startswith("local[") or context.master == "local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tabloom-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable copy that every executor can read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reference_rows(df: DataFrame, limit: int = REFERENCE_ROWS) -> list:
    """Rows of a reference list whose size is checked before it goes to the driver.

    Raises ValueError beyond ``limit``: a list that grows with the data must be joined instead.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"reference list has more than {limit} rows; join it instead of broadcasting it")
    return rows


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per context, unless they start where they find it themselves."""
    root, context = Path(__file__).resolve().parent.parent, spark.sparkContext
    near = context.master.startswith("local") and (str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root)
    if near or getattr(context, "_tabloom_sent", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tabloom-code-"), "tabloom"), "zip", root, "tabloom")
    context.addPyFile(archive)
    context._tabloom_sent = True
