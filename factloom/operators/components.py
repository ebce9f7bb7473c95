"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import map_arrow, materialize


def label_arrays(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component), by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


class Stars:
    """Edges as they come, of which only stars with the same components stay: memory follows the nodes, not the edges."""

    def __init__(self, chunk: int = 1_000_000):
        self.chunk, self.rows, self.most = chunk, 0, chunk
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i in range(0, len(a), self.chunk):
            self.parts.append((a[i : i + self.chunk], b[i : i + self.chunk]))
            self.rows += len(self.parts[-1][0])
            if self.rows > self.most:
                self.labels()

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, smallest node of its component) of all edges so far."""
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.parts) if self.parts else ((), ())))
        self.parts.clear()
        self.parts.append(label_arrays(a, b))
        self.rows = len(self.parts[0][0])
        self.most = max(self.chunk, 2 * self.rows)
        return self.parts[0]

    def batches(self, names: list[str]):
        node, component = self.labels()
        for i in range(0, len(node), 100_000):
            yield pa.record_batch([pa.array(node[i : i + 100_000]), pa.array(component[i : i + 100_000])], names=names)


def _labelled(batches):
    stars = Stars()
    for batch in batches:
        stars.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)))
    yield from stars.batches(["node", "component"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", one_task: int = 5_000_000) -> DataFrame:
    """(node, component): every node of ``edges`` with the smallest node of its component.

    Edges with a null end are ignored, loops and repeats allowed.  Up to
    ``one_task`` edges are labelled in one executor task, whose memory follows the
    nodes.  Of more, each task first keeps stars with the same components; if these
    are too many still, large-star / small-star rounds run in Spark, each written
    to the shared folder, so the lineage stays short.  All give the same result.
    """
    pairs = edges.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a is not null and b is not null")
    pairs = materialize(pairs, "edges")
    within = pairs.count() <= one_task
    if not within:
        pairs = materialize(map_arrow(pairs, _labelled, "node long, component long").toDF("a", "b"), "edges")
        within = pairs.count() <= one_task
    if within:
        return map_arrow(pairs.repartition(1), _labelled, "node long, component long")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    e = pairs.where("a <> b")
    seen = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        e = down.join(low, "a").select(F.col("b").alias("x"), "m").union(low.select("a", "m"))
        e = materialize(e.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return nodes.join(e, nodes["node"] == e["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
        seen = now
