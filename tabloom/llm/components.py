"""Groups of records linked directly or through others, from pairs.

Each partition of edges, as it is read, is reduced to a spanning forest by union-find. Forests are then merged level by
level through fewer partitions, each of bounded size. Between levels every record that partitions gave different roots
passes its smallest root to the others and roots that are children take their own root, so that the groups are also
complete where the forests never fit one partition: merging ends when each record has one root that is no record's child.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.runtime import checkpoint

#: Edges that one task may hold, partitions of a level that are merged into one of the next, and keys over which a shared root is spread.
EDGES_PER_TASK, FAN_IN, SALT = 2_000_000, 8, 16


#: Edges after which a task reduces what it holds to a forest.
REDUCE_EVERY = 500_000


def union_find(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Smallest member of each item's group, for items 0..size-1: roots are hooked to smaller roots, then paths are halved."""
    parent = np.arange(size)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _stars(edges: pd.DataFrame) -> pd.DataFrame:
    """Each node with the smallest of its group."""
    codes, names = pd.factorize(pd.concat([edges["node"], edges["root"]]), sort=True)
    n = len(edges)
    root = union_find(codes[:n], codes[n:], len(names))
    child = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"node": np.asarray(names)[child], "root": np.asarray(names)[root[child]]})


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The partition's edges (node, root) as stars. Only the forest so far and the edges since are held."""
    held: list[pd.DataFrame] = []
    rows, room = 0, REDUCE_EVERY
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= room:
            held = [_stars(pd.concat(held))]
            rows = len(held[0])
            room = REDUCE_EVERY + 2 * rows
    if rows:
        yield _stars(pd.concat(held))


def _passed_on(stars: DataFrame) -> DataFrame:
    """Stars whose nodes have several roots: the smallest root takes the node and the other roots. Adds ``several``."""
    roots = stars.groupBy("node").agg(F.collect_set("root").alias("roots"))  # at most one root per partition
    least = roots.select("node", F.array_min("roots").alias("root"), "roots", (F.size("roots") > 1).alias("several"))
    others = least.where("several").select(F.explode(F.array_remove("roots", F.col("root"))).alias("node"), "root", F.lit(True).alias("several"))
    return least.select("node", "root", "several").unionByName(others)


def _jumped(stars: DataFrame) -> DataFrame:
    """Stars whose root is another's node take that one's root. A root that many share is spread over SALT keys."""
    salts = F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALT)]))
    up = stars.groupBy("node").agg(F.min("root").alias("higher")).withColumnRenamed("node", "root")
    up = up.join(stars.select("root").distinct(), "root", "left_semi").withColumn("salt", salts)
    own = stars.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)))
    return own.join(up, ["root", "salt"], "left").select("node", F.coalesce("higher", "root").alias("root"), (F.col("several") | F.col("higher").isNotNull()).alias("several"))


def _spread(stars: DataFrame, tasks: int, turn: int, edges_per_task: int) -> DataFrame:
    """By edge, so that a group of many edges is spread, in turn with by root, so that one group's edges meet; a root of very many is spread, too."""
    if turn % 2 == 0:
        return stars.repartition(tasks, F.xxhash64("node", "root"))
    heavy = stars.groupBy("root").count().where(F.col("count") > edges_per_task).withColumnRenamed("count", "edges")
    salt = F.when(F.col("edges").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.ceil(F.col("edges") / edges_per_task) + 1))
    return stars.join(heavy, "root", "left").withColumn("salt", salt).repartition(tasks, "root", "salt").select("node", "root")


def connected_groups(pairs: DataFrame, left_col: str, right_col: str, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """One row per linked record: ``record``, ``group_id``, the smallest record of its group in byte order.

    Repeated pairs, either order and chains of any length are one; a record paired only with itself or with null is
    linked to nothing and gives no row. An empty table gives no rows. Only pair columns are read. ``edges_per_task``
    bounds a partition of a level; the groups don't depend on it.
    """
    kind = pairs.schema[left_col].dataType.simpleString()
    a, b = F.col(left_col), F.col(right_col)
    edges = pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
    schema = f"node {kind}, root {kind}"
    stars = checkpoint(edges.mapInPandas(_forest, schema))
    turn, width = 0, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        tasks = max(1, width, -(-stars.count() // edges_per_task))
        forests = _spread(stars, tasks, turn, edges_per_task).mapInPandas(_forest, schema)
        if tasks == 1:  # the top of the merging
            stars = checkpoint(forests)
            break
        merged = checkpoint(_passed_on(forests).groupBy("node", "root").agg(F.max("several").alias("several")))
        stars = checkpoint(_jumped(merged).groupBy("node", "root").agg(F.max("several").alias("several")))
        if not stars.where("several").head(1):
            break
        stars, turn, width = stars.select("node", "root"), turn + 1, width // FAN_IN
    forest = stars.select("node", "root")
    own = forest.select(F.col("root").alias("record"), F.col("root").alias("group_id")).distinct()
    return forest.select(F.col("node").alias("record"), F.col("root").alias("group_id")).unionByName(own)
