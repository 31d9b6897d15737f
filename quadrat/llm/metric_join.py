"""Embedding near-dedup by an exact metric range join.

Pivots partition the unit vectors of a label into cells, each vector's home being its nearest
pivot. If u and v are within r, u at home in cell i and v in cell j, the triangle inequality
gives d(v, i) <= d(u, i) + r <= d(u, j) + r <= d(v, j) + 2r: so a vector also visits each cell
whose pivot is at most 2r farther than its own. Cells are joined independently. Equal vectors
are one before that; a crowded cell is cut into blocks of its homes that each meet all
visitors.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.components import components, forest
from quadrat.llm.memory import released
from quadrat.llm.neighbours import fit_pivots, taking_part
from quadrat.runtime import materialize, ship

#: Vectors of a label for each of its cells, about, and how many cells a label has at most: cells grow beyond 4 million vectors.
CELL = 1024
MAX_CELLS = 4096
#: Homes of a block.
BLOCK = 2048
#: Visitors that are compared at a time.
STEP = 1024
#: Seed of the second half of a vector's hash.
KEY = 29
#: What rounding may add to a distance.
SLACK = 1e-9


def cells(x: np.ndarray, pivots: np.ndarray, counts: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, cell, is_home of all cells in which rows of unit vectors x take part.

    Row i uses the first counts[i] pivots.
    """
    distance = np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))
    distance[np.arange(len(pivots))[None, :] >= counts[:, None]] = np.inf
    home = distance.argmin(1)
    row, cell = np.nonzero(distance <= distance[np.arange(len(x)), home][:, None] + 2 * radius + SLACK)
    return row, cell, cell == home[row]


def _join(threshold: float, length: int):
    def flush(own, links, a, b) -> Iterator[pa.RecordBatch]:
        u, v = forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
        none = pa.nulls(len(own), pa.int64())
        yield pa.record_batch({"u": pa.array(own), "v": none, "n": pa.array(links)})
        yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.nulls(len(u), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by label, cell, block and role: homes of a block, then all members of the cell."""
        key, held, own, ids, links, a, b, home, norm = None, [], *[np.zeros(0, np.int64)] * 2, None, [], [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            label, cell, block, role, gid, rep, count = (batch.column(i).to_numpy() for i in range(7))
            x = batch.column(7).flatten().to_numpy().reshape(-1, length)
            cut = np.flatnonzero((np.diff(label) != 0) | (np.diff(cell) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0)) + 1
            for s, e in itertools.pairwise([0, *cut.tolist(), batch.num_rows]):
                if (k := (label[s], cell[s], block[s])) != key:
                    if links is not None:
                        yield from flush(own, links, a, b)
                    key, held, links, a, b = k, [], None, [], []
                if role[s] == 0:
                    held.append((gid[s:e], rep[s:e], x[s:e]))
                    continue
                if links is None:
                    if not held:
                        continue
                    own, ids, home = (np.concatenate([h[i] for h in held]) for i in range(3))
                    norm, links, held = np.sqrt((home * home).sum(1)), np.zeros(len(ids), np.int64), []
                for at in range(s, e, STEP):
                    to = min(at + STEP, e)
                    y = x[at:to]
                    cosine = (home @ y.T) / (norm[:, None] * np.sqrt((y * y).sum(1))[None, :])
                    hit = (cosine >= threshold) & (own[:, None] != gid[at:to][None, :])
                    links += hit @ count[at:to]
                    i, j = np.nonzero(hit)
                    if len(i):
                        # Each member hangs on its first home, its other homes on that one.
                        order = np.lexsort((i, j))
                        i, j = i[order], j[order]
                        first = np.concatenate([[True], j[1:] != j[:-1]])
                        lead = i[first][np.cumsum(first) - 1]
                        pairs = np.unique(np.stack([i, lead], 1)[~first], axis=0)
                        a += [ids[i[first]], ids[pairs[:, 0]]]
                        b += [rep[at:to][j[first]], ids[pairs[:, 1]]]
        if links is not None:
            yield from flush(own, links, a, b)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors.

    Rows link if their labels are equal and not null and their cosine, in double precision, is
    threshold or more. n_links counts the other rows linked directly; copies of a vector are
    counted, not listed. component_id is the smallest vec_id reachable, kept whether that is
    the row itself. Rows without label, and those that neighbours.taking_part() leaves out, link
    with nothing. A repeated vec_id is one vertex whose rows are counted each, also if they link to one another. Vectors of
    different lengths don't link. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    radius = float(np.sqrt(max(2 - 2 * threshold, 0)))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    v = F.transform("embedding", lambda y: y.cast("double"))
    rows = every.select("vec_id", F.col("label").cast("long").alias("label"), v.alias("v"))
    # Equal vectors are told by 128 bits of hash, so that arrays needn't be sorted or joined.
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(KEY), "v")})
    groups = keyed.filter("vec_id is not null and label is not null").filter(taking_part("v"))
    groups = groups.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id()), "metric-groups")
    pivots = fit_pivots(groups.select(F.col("rep").alias("vec_id"), "v"), MAX_CELLS)
    length = pivots.shape[1]
    pivots = np.ldexp(pivots, -np.frexp(np.abs(pivots).max(1, keepdims=True, initial=0))[1])
    unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    joined = groups.filter(F.size("v") == length)
    labels = materialize(joined.groupBy("label").agg(F.least(F.ceil(F.count("*") / cell), F.lit(max(1, len(unit)))).cast("int").alias("cells")), "metric-labels")
    placed = joined.join(labels, "label").select("label", "gid", "rep", "n", "cells", "v")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(5).flatten().to_numpy().reshape(-1, length)
            # Scaled by a power of two, which changes no cosine, so that very large or small components have a norm.
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
            y = x / np.sqrt((x * x).sum(1, keepdims=True))
            row, where, is_home = cells(y, unit, batch.column(4).to_numpy(), radius)
            flat = pa.array(x[row].ravel())
            scaled = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, length, dtype=np.int32)), flat)
            yield pa.record_batch({"label": batch.column(0).take(pa.array(row)), "cell": pa.array(where.astype(np.int32)), "home": pa.array(is_home), "gid": batch.column(1).take(pa.array(row)), "rep": batch.column(2).take(pa.array(row)), "n": batch.column(3).take(pa.array(row)), "v": scaled})

    dealt = placed.mapInArrow(released(deal), "label long, cell int, home boolean, gid long, rep long, n long, v array<double>")
    dealt = materialize(dealt, "metric-cells")
    crowd = dealt.filter("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.join(crowd, ["label", "cell"])
    homes = dealt.filter("home").select("label", "cell", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "gid", "rep", "n", "v")
    members = dealt.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "gid", "rep", "n", "v")
    ordered = homes.unionByName(members).repartition("label", "cell", "block").sortWithinPartitions("label", "cell", "block", "role")
    found = materialize(ordered.mapInArrow(released(_join(threshold, length)), "u long, v long, n long"), "metric-found")
    links = found.filter("n is not null").groupBy("u").agg(F.sum("n").alias("linked")).select(F.col("u").alias("lu"), "linked")
    parts = components(found.filter("v is not null").select("u", "v"), "metric")
    named = groups.select("label", "k1", "k2", "gid", "rep", "n")
    classes = named.join(links, named.gid == links.lu, "left").join(parts, F.col("rep") == parts.id, "left")
    classes = classes.select("label", "k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component"))
    # Rows that take no part may have the hashes of none: they get no key.
    mine = keyed.withColumn("k1", F.when(taking_part("v") & F.col("vec_id").isNotNull(), F.col("k1"))).select("vec_id", "label", "k1", "k2")
    out = mine.join(materialize(classes, "metric-classes"), ["label", "k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN CAST(embedding AS DOUBLE[]) IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN CAST(embedding AS DOUBLE[]) IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
parts AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON id = vec_id LEFT JOIN counted ON a = vec_id
"""
