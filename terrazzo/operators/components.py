"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import ready, stage


#: So many edges (16 bytes each) are few enough for one task; more go through rounds of stars.
LOCAL_EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node reachable within these edges, for each node that isn't its own."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _thin(edges: DataFrame) -> DataFrame:
    """Within each task, only a star for each component: no more edges than nodes leave it."""

    def run(batches):
        part: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part.append((a, b))
            held += len(a)
            if held > 2 * LOCAL_EDGES:
                part = [forest(*(np.concatenate(x) for x in zip(*part)))]
                held = len(part[0][0])
                if held > LOCAL_EDGES:  # too many nodes for one table: pass it on
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in part[0]], ["u", "v"])
                    part, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(np.concatenate(x) for x in zip(*part)))], ["u", "v"])

    ready(edges.sparkSession)
    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v) that isn't the smallest of its component.

    Up to LOCAL_EDGES edges are solved by one task, more by rounds of stars, each written
    to the shared folder. No edges: no rows.
    """
    edges = stage(_thin(edges.where("u <> v")), "edges")
    if edges.count() <= LOCAL_EDGES:
        return stage(_thin(edges.coalesce(1)), "roots").toDF("node", "root")
    while True:
        both = edges.union(edges.select("v", "u"))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage(large, "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = stage(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = down.join(low, "u").select("v", F.col("m").alias("to")).where("v <> to").union(low.select("u", "m"))
        new = stage(small.toDF("u", "v").distinct(), "edges")
        # Done when every node points at one node, which points nowhere.
        pointing = new.groupBy("u").count().where("count > 1").limit(1).count()
        inner = new.join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = new
        if not pointing and not inner:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
