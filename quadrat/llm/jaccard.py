"""Near copies by SimHash, verified by exact Jaccard similarity of word shingles; prefix filtering finds the rest.

Fingerprints of the same shingles are compared first (simhash.py), and the pairs within a radius
verified on the whole sets. Similar sets may have fingerprints that differ in any number of bits,
so what these pairs leave apart is looked for by prefix filtering, and nothing is lost by the radius.

Sets that overlap by four fifths share one of the first fifth of their shingles in any order
that is the same for all sets, so pairs are looked for only among sets that share one, and each
is verified on the whole sets. The order is rarest first, by a bounded sample of documents; it
decides the work and not the result. Equal sets are one set first.

Of the sets that share a shingle and that SimHash has left apart, each is first paired with the
first one before it that it may be similar to; only sets that these pairs, verified, leave apart are compared with all others,
so a dense group gives a few pairs for each member.
Pairs are left out only where bounds hold: of sizes, of places in the order, and of parities of
the shingles in classes (two sets differ by at least as many shingles as parities). There are 512
classes where postings meet; pairs that are left are held against the parities in at least as
many classes as two sets have shingles, so that few but similar pairs need their whole sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.components import components
from quadrat.llm.memory import released
from quadrat.llm.simhash import fingerprint, fingerprint_pairs
from quadrat.runtime import materialize, ship

SEED = 43
#: Documents of about this number, and the commonest shingles among them, set the order.
SAMPLE = 4096
COMMON = 65536
#: Shingles, and pairs, of an Arrow batch that is handed on.
CHUNK = 1 << 17
#: Similar are sets with overlap / union >= NUM / DEN.
NUM, DEN = 4, 5
#: Classes of shingles whose parities are compared.
BITS = 512
#: Sets of a token that others are compared with first.
LEADERS = 64


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes (signed) of a UTF-8 text's word shingles; a shorter text is one."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    return np.unique(hashes.view(np.int64))


def classes(n: int) -> int:
    """Classes for the wide parities of n shingles: a power of two, 2n at least."""
    return max(BITS, 1 << (2 * n - 1).bit_length())


def parities(found: np.ndarray, count: int) -> bytes:
    """A bit for each class (the hash's low bits): whether it has an odd number of shingles."""
    return np.packbits((np.bincount(found & (count - 1), minlength=count) & 1).astype(bool)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """How many parities differ; the longer ones are first folded to as many classes as the shorter have."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0) ^ x).sum())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of rows (u, v, nu, nv, wu, wv) whose wide parities leave that the sets are similar."""
    for batch in batches:
        m = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        differ = np.fromiter((apart(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5), strict=True)), np.int64, len(m))
        yield pa.record_batch(batch.columns[:2], ["u", "v"]).filter(pa.array((m - differ) * (NUM + DEN) >= 2 * m * NUM))


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample, sorted, and in how many of its documents each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.record_batch({"token": pa.array(shingle_set(x.as_py(), width))})

    step = max(1, docs.count() // SAMPLE)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select(F.col("text").cast("binary"))
    counts = picked.mapInArrow(released(run), "token long").groupBy("token").agg(F.count("*").alias("n")).filter("n > 2")
    rows = sorted((r["token"], r["n"]) for r in counts.orderBy(F.desc("n"), "token").limit(COMMON).collect())
    return np.array([t for t, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def shingle_sets(docs: DataFrame, width: int = 5, whole: bool = False) -> DataFrame:
    """(doc_id, sig, fp, n, bits, wide, tokens) of each row's set: its hash, SimHash, size, parities and shingles.

    fp is of the whole text, a shingle's repeats included, and null with whole. tokens is the whole set, or only the rarest shingles that a similar set must share one of.
    """
    ship(docs.sparkSession)
    common, often = (np.zeros(0, np.int64),) * 2 if whole else _common(docs, width)

    def ordered(found: np.ndarray) -> np.ndarray:
        if not len(common) or not len(found):
            return found
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        return found[np.argsort(np.where(common[at] == found, often[at], 0), kind="stable")]

    def first(found: np.ndarray) -> np.ndarray:
        return found if whole else ordered(found)[: len(found) + NUM * len(found) // -DEN + 1 if len(found) else 0]

    def batch_of(ids: list, sets: list[np.ndarray], prints: list) -> pa.RecordBatch:
        firsts = [first(s) for s in sets]
        ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
        sigs = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
        bits = [parities(s, BITS) for s in sets]
        wide = [None if whole else parities(s, classes(len(s))) for s in sets]
        return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "sig": pa.array(sigs), "fp": pa.array(prints, pa.uint64()).view(pa.int64()), "n": pa.array(list(map(len, sets)), pa.int32()), "bits": pa.array(bits, pa.binary()), "wide": pa.array(wide, pa.binary()), "tokens": tokens})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, prints, held = [], [], [], 0
        for batch in batches:
            for i, x in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                sets.append(shingle_set(x.as_py(), width))
                prints.append(None if whole else fingerprint(x.as_py(), width))
                held += len(sets[-1])
                if held >= CHUNK or len(sets) >= 4096:
                    yield batch_of(ids, sets, prints)
                    ids, sets, prints, held = [], [], [], 0
        if sets:
            yield batch_of(ids, sets, prints)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(released(run), "doc_id long, sig long, fp long, n int, bits binary, wide binary, tokens array<long>")


def _pairs(batches: Iterator[pa.RecordBatch], stars: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v), u < v, of a token's sets that have different labels and may be similar.

    Rows are token, sig, place, n, label, bits, sorted by token. stars: a set that may be
    similar to one before it, of those that no pair has led away from, is paired with the first
    of them only; LEADERS are tried. Otherwise all pairs.
    """

    def pairs(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig, place, n, label, bits = (np.concatenate([r[k] for r in rows]) for k in range(5))
        n = n.astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if (label == label[0]).all():
            return
        # The same sets lead under all tokens, so that groups of different tokens meet.
        left = np.argsort(sig, kind="stable")
        while len(left) > 1 and not (stars and len(found) >= LEADERS):
            i, left = left[0], left[1:]
            # At the first common shingle of similar sets so many are left in both.
            most = np.minimum(n[i] - place[i], n[left] - place[left])
            m = n[i] + n[left]
            may = (label[left] != label[i]) & (most * (NUM + DEN) >= m * NUM)
            at = np.flatnonzero(may)
            differ = np.bitwise_count(bits[i] ^ bits[left[at]]).sum(1, dtype=np.int64)
            at = at[(m[at] - differ) * (NUM + DEN) >= 2 * m[at] * NUM]
            j = left[at]
            found.append((np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])))
            if stars:
                rest = np.ones(len(left), bool)
                rest[at] = False
                left = left[rest]
        if any(len(u) for u, _ in found):
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})

    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        token, *cols = (c.to_numpy() for c in batch.columns[:-1])
        cols.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(len(token), -1))
        cut = [0, *(np.flatnonzero(np.diff(token)) + 1).tolist(), len(token)]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if token[s] != key:
                if held:
                    yield from pairs(held)
                key, held = token[s], []
            held.append([c[s:e] for c in cols])
    if held:
        yield from pairs(held)


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, tag: str) -> DataFrame:
    """The pairs (u, v) of sigs whose whole sets are similar, as (u, v) of their reps."""
    one = reps.select(F.col("sig").alias("u"), F.col("n").alias("nu"), F.col("wide").alias("wu"))
    other = reps.select(F.col("sig").alias("v"), F.col("n").alias("nv"), F.col("wide").alias("wv"))
    both = pairs.join(one, "u").join(other, "v").select("u", "v", "nu", "nv", "wu", "wv")
    pairs = materialize(both.mapInArrow(released(_near), "u long, v long"), f"{tag}-near")
    asked = pairs.select(F.col("u").alias("sig")).unionByName(pairs.select(F.col("v").alias("sig"))).distinct()
    asked = materialize(reps.select("sig", "rep").join(asked, "sig"), f"{tag}-asked")
    texts = docs.join(asked.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = shingle_sets(texts, width, whole=True).select("sig", "doc_id", "n", "tokens")
    sets = materialize(sets.join(asked, "sig").filter("doc_id = rep").select("sig", "rep", "n", "tokens"), f"{tag}-sets")
    a = sets.select(F.col("sig").alias("u"), F.col("rep").alias("ru"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    b = sets.select(F.col("sig").alias("v"), F.col("rep").alias("rv"), F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    similar = F.size(F.array_intersect("tu", "tv")) * (NUM + DEN) >= (F.col("nu") + F.col("nv")) * NUM
    return materialize(pairs.join(a, "u").join(b, "v").filter(similar).select(F.col("ru").alias("u"), F.col("rv").alias("v")), tag)


def jaccard_dedup(docs: DataFrame, width: int = 5, radius: int = 12) -> DataFrame:
    """The rows of docs but those linked, also over others, to one with a smaller doc_id.

    Linked are texts whose sets of `width`-word shingles (a shorter text is one shingle, words
    as bytes in lower case) have a Jaccard similarity of at least NUM / DEN, texts without words
    among each other, and rows with the same doc_id. Rows without doc_id stay. All columns stay
    as they are. Texts whose SimHashes differ in radius bits or fewer are verified first; the
    radius decides the work and not the result.
    """
    given = docs.select("doc_id", "text").filter("doc_id is not null")
    rows = materialize(shingle_sets(given, width), "jaccard-sets")
    same = [F.first(c).alias(c) for c in ("n", "bits", "wide", "tokens")]
    reps = materialize(rows.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), *same), "jaccard-reps")
    token = Window.partitionBy("token")
    places = reps.select("sig", F.posexplode("tokens").alias("place", "token"))
    posted = places.withColumn("sets", F.count("*").over(token)).filter("sets > 1")
    posted = materialize(posted.select("token", "sig", "place"), "jaccard-posted")

    def linked(label: DataFrame, dealt: DataFrame, stars: bool) -> DataFrame:
        """Similar pairs among sets with different labels (sig, n, label, bits), by their reps."""
        tag = "jaccard-stars" if stars else "jaccard-rest"
        dealt = dealt.join(label, "sig").select("token", "sig", "place", "n", "label", "bits")
        found = dealt.repartition("token").sortWithinPartitions("token").mapInArrow(released(functools.partial(_pairs, stars=stars)), "u long, v long")
        return _verified(materialize(found.distinct(), f"{tag}-pairs"), given, reps, width, tag)

    found = fingerprint_pairs(reps.select(F.col("sig").alias("id"), "fp", "n"), radius, (NUM, DEN))
    near = _verified(materialize(found.distinct(), "jaccard-simhash-pairs"), given, reps, width, "jaccard-simhash")
    for stars in (True, False):
        found = components(near, "jaccard")
        label = reps.join(found, reps.rep == found.id, "left").select("sig", "n", F.coalesce("component_id", "rep").alias("label"), "bits")
        near = near.unionByName(linked(label, posted, stars))
    found = components(near, "jaccard-all")
    classes = materialize(reps.join(found, reps.rep == found.id, "left").select("sig", F.coalesce("component_id", "rep").alias("component_id")), "jaccard-classes")
    gone = rows.select("doc_id", "sig").join(classes, "sig").filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
