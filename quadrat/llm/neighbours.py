"""Approximate nearest neighbours by a permutation index.

A vector is represented by its `prefix` nearest pivots in order, and posted in the inverted
file of each of them with its place in that order. A query goes through the inverted files of
its own nearest pivots and adds up how much nearer each vector they hold is by Spearman's
footrule than one that shares no pivot; the candidates with the smallest footrule distance
are reranked by their true inner product. Pivots are fitted on a bounded sample; every vector
is indexed.

The index is cut into shards of bounded size by a hash of vec_id. A query visits each shard,
in blocks, and the shards' best are merged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.memory import released
from quadrat.runtime import materialize, ship

PIVOTS = 256
PREFIX = 64
#: Vectors of an index shard.
SHARD = 8192
#: Share of a shard's vectors that are reranked for a query, and how many at least for each neighbour asked for.
RERANK = 0.2
RERANK_LEAST = 4
BLOCK = 64
SEED = 11


def taking_part(v: str) -> Column:
    """Whether an array of doubles is neither null nor empty nor zero, and all of it is finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and v (array of doubles) of the rows that have an id and take part.

    Rows with a repeated vec_id are kept as they are.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null").filter(taking_part("v"))


def fit_pivots(rows: DataFrame, pivots: int = PIVOTS, seed: int = SEED) -> np.ndarray:
    """Pivots: the vectors with the smallest seeded hashes, at most `pivots`, of the commonest length."""
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return np.zeros((0, 1))
    picked = rows.filter(F.size("v") == size["n"]).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(pivots).select("v").collect()
    return np.array([r["v"] for r in picked], np.float64)


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The indices of each row's nearest pivots, nearest first, ties to the smaller index."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


class Shard:
    """Inverted files of one part of the vectors: for each pivot who has it, and at which place."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.pivots = ids[order], np.ascontiguousarray(x[order]), pivots
        self.prefix = min(prefix, len(pivots))
        # Twice the most that a product added up in two orders differs by, for |q| = 1.
        self.slack = 4 * x.shape[1] * np.finfo(np.float64).eps * np.sqrt((self.x * self.x).sum(1).max(initial=0.0))
        perm = permutations(self.x, pivots, self.prefix)
        flat = perm.ravel()
        by = np.argsort(flat, kind="stable")
        cut = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        who, place = (by // self.prefix).astype(np.int32), (by % self.prefix).astype(np.int32)
        self.files = [(who[a:b], place[a:b]) for a, b in itertools.pairwise(cut)]

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, rerank: float, least: int):
        n = len(self.ids)
        take = min(n, max(int(n * rerank), least * k, k + 1))
        out_q, out_v, out_s = [], [], []
        for i, perm in enumerate(permutations(q, self.pivots, self.prefix).tolist()):
            # The footrule distance is a constant of both less twice this gain.
            gain = np.zeros(n, np.int32)
            for at, pivot in enumerate(perm):
                who, place = self.files[pivot]
                gain[who] += self.prefix - np.maximum(place, at)
            # All that tie with the last: copies stay together.
            near = np.flatnonzero(gain >= np.partition(gain, n - take)[n - take])
            near = near[self.ids[near] != query_ids[i]]
            score = self.x[near] @ q[i]
            if len(near) > k:
                kth = np.partition(score, len(near) - k)[len(near) - k]
                near = near[score >= kth - self.slack * np.sqrt(q[i] @ q[i])]
            # Added up in order, so that a score doesn't depend on the machine.
            score = np.cumsum(self.x[near] * q[i], axis=1)[:, -1]
            best = np.lexsort((self.ids[near], -score))[:k]
            out_q.append(np.full(len(best), query_ids[i]))
            out_v.append(self.ids[near][best])
            out_s.append(score[best])
        return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, shard: int = SHARD, rerank: float = RERANK, least: int = RERANK_LEAST) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors of largest inner product found for each query.

    vectors and queries need vec_id and embedding. score is the inner product of the vectors
    as they are, in double precision; ties go to the smaller vec_id; a query's own vec_id is no
    candidate. Rows that usable() leaves out, and those of another length than most, take no
    part; a repeated vec_id may be found as often as it occurs. Fewer candidates than k: all of
    them. No usable rows: an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, vec_id long, score double"
    rows = materialize(usable(vectors), "ann-vectors")
    fitted = fit_pivots(rows, pivots)
    length = fitted.shape[1]
    rows = rows.filter(F.size("v") == length)
    asked = usable(queries).filter(F.size("v") == length)
    shards = max(1, -(-rows.count() // shard))
    home = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("role"), "vec_id", "v")
    visit = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("role"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and role: the vectors of a shard, then its queries."""
        key, index, held = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, roles, ids = (batch.column(i).to_numpy() for i in range(3))
            x = batch.column(3).flatten().to_numpy().reshape(-1, length)
            cut = np.flatnonzero((np.diff(parts) != 0) | (np.diff(roles) != 0)) + 1
            for s, e in itertools.pairwise([0, *cut.tolist(), batch.num_rows]):
                if parts[s] != key:
                    key, index, held = parts[s], None, []
                if roles[s] == 0:
                    held.append((ids[s:e], x[s:e]))
                    continue
                if index is None and held:
                    index, held = Shard(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), fitted, prefix), []
                for at in range(s, e if index is not None else s, BLOCK):
                    got = index.search(ids[at : min(at + BLOCK, e)], x[at : min(at + BLOCK, e)], k, rerank, least)
                    yield pa.record_batch(list(map(pa.array, got)), ["query_id", "vec_id", "score"])

    dealt = home.unionByName(visit).repartitionById(shards, "shard").sortWithinPartitions("shard", "role")
    found = materialize(dealt.mapInArrow(released(run), schema), "ann-found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

