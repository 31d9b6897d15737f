"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.memory import released
from quadrat.runtime import materialize

#: Edges that one local contraction holds at a time.
LOCAL_EDGES = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node reachable) of the graph with edges a-b; the centres get no row."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        # Hook the roots of each edge's ends, then jump pointers until they are flat.
        lx, ly = label[x], label[y]
        low = np.minimum(lx, ly)
        before = label.copy()
        np.minimum.at(label, lx, low)
        np.minimum.at(label, ly, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        a, b = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.record_batch({"u": pa.array(a, pa.int64()), "v": pa.array(b, pa.int64())})

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
        if count >= LOCAL_EDGES:
            yield flush()
            held, count = [], 0
    if held:
        yield flush()


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(released(_contract), "u long, v long")


def _joined_min(edges: DataFrame, reduced: DataFrame) -> DataFrame:
    """edges (u, v) with m, the smallest neighbour of u in reduced or u itself."""
    low = reduced.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").select("u", "v", F.least("m", "u").alias("m"))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, tag: str, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) of each node that has an edge in edges (u long, v long).

    component_id is the smallest node reachable. Self-links, repeated edges and an empty edge
    list are allowed; rows with a null end are ignored. Rounds of stars go on until the edges
    that are left fit one local contraction, which ends it. Each round is written to the shared
    folder, groups are reduced before they are joined, and nothing is collected but two
    numbers a round.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u is not null and v is not null and u <> v")
    edges = materialize(_contracted(edges), f"{tag}-edges")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    for _ in range(max_rounds):
        if before[0] < LOCAL_EDGES:
            return materialize(_contracted(edges.coalesce(1)), f"{tag}-stars").select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        # Large star: what is above a node hangs on the smallest node around it.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined_min(both, both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(_contracted(large), f"{tag}-large")
        # Small star: what is below a node, and the node itself, hangs on the smallest of them.
        star = _joined_min(large, large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = materialize(small, f"{tag}-small")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
