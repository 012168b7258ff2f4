"""Connected components of a table of links, in rounds of joins.

Each round connects every node's larger neighbours to its smallest (large star), then its smaller
neighbours likewise (small star). Links only ever become shorter; when a round changes nothing,
each component is a star around its smallest node. Every round is written to the shared folder,
which cuts the lineage; the round before is then deleted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowtusk.plans.storage import delete_path, new_path


def _written(links: DataFrame, folders: list[str]) -> tuple[DataFrame, dict]:
    """The stored links, and their count and hash sum: tables that agree in these are the same."""
    folder, seen = new_path(links.sparkSession, "links"), Observation()
    observed = links.observe(seen, F.count(F.lit(1)).alias("count"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    observed.write.parquet(folder)
    folders.append(folder)
    return links.sparkSession.read.schema(links.schema).parquet(folder), seen.get


def _star(links: DataFrame, large: bool) -> DataFrame:
    """`links` has a > b. Connect a node's larger (or smaller) neighbours, and itself, to the smallest."""
    if large:
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node's link to its own smallest neighbour stays.
        own = least.filter("m < a").select("a", F.col("m").alias("b"))
        return moved.unionByName(own).filter("a > b")
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """The smallest node reachable from each linked node: node, component.

    Nodes without links are not in the result; a component's smallest node is, as its own.
    Repeated links, links in both directions, of a node to itself or with null are allowed.
    Runs jobs.
    """
    ordered = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") > F.col("b"))).distinct()
    folders: list[str] = []
    current, state = _written(ordered, folders)
    for _ in range(max_rounds):
        if not state["count"]:
            break
        current, after = _written(_star(_star(current, True), False), folders)
        delete_path(current.sparkSession, folders.pop(0))
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def connected(adjacent: np.ndarray) -> np.ndarray:
    """The first row that each row of a symmetric link matrix is connected to."""
    roots = np.arange(len(adjacent))
    while True:
        least = np.minimum(roots, np.where(adjacent, roots[None], len(roots)).min(axis=1, initial=len(roots)))
        least = least[least]
        if (least == roots).all():
            return roots
        roots = least
