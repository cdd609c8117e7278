"""Artifacts of papers on storage: one table per artifact, partitioned by paper; JSON in and out; readers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_reader(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    _READERS[name] = reader


def reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """The reader of that name. Raises ValueError for any other."""
    if name not in _READERS:
        raise ValueError(f"no reader is called {name!r}; there are {sorted(_READERS)}")
    return _READERS[name]


register_reader("parquet", lambda spark, path: spark.read.parquet(path))
register_reader("json", lambda spark, path: spark.read.json(path))


def write_artifact(df: DataFrame, root: str, name: str, key: str = "paper_id") -> None:
    """Replace the artifact; papers are directories, so that one paper is read without the others."""
    df.write.mode("overwrite").partitionBy(key).parquet(f"{root}/{name}")


def read_artifact(spark: SparkSession, root: str, name: str, paper: str | None = None, key: str = "paper_id") -> DataFrame | None:
    """The artifact, of one paper if asked; None if it was never written."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    except AnalysisException:
        return None
    return df if paper is None else df.where(df[key] == paper)


def write_json(df: DataFrame, path: str) -> None:
    """Lines of JSON with null fields kept, so that null and empty lists stay apart."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
