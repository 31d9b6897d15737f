"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

Fingerprints fall into tiles by the population counts of their four 16-bit parts. Two
fingerprints that differ in r bits have counts whose differences sum to r at most, so tile
pairs farther apart are skipped, and the others are compared whole with exclusive-or and bit
counts. There are at most 17**4 tiles; a crowded tile is cut into blocks that are compared
pairwise, so no task grows with a tile. Exact copies are one fingerprint before that.

At a radius of many bits such tiles skip hardly any pair. fingerprint_pairs is for that: its tiles
are made of the fingerprints' bit counts and of the sizes of what they stand for.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.components import components, forest
from quadrat.llm.memory import released
from quadrat.runtime import materialize, ship

SEED = 42
PARTS = 4
#: Fingerprints of one tile that are compared in one task with each other.
BLOCK = 8192
#: Edge of the square of pairs that numpy compares at a time.
SQUARE = 1024
#: The same two where fingerprints are compared at a wide radius.
WIDE_BLOCK = 1 << 16
WIDE_SQUARE = 256
#: Shingles that are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of a UTF-8 text's word shingles as an unsigned number; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    for at in range(0, n, CHUNK):
        s, e = starts[at : min(at + CHUNK, n)].tolist(), ends[at + width - 1 : min(at + CHUNK, n) + width - 1].tolist()
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(s, e, strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row's whole text as a signed long with the same bits.

    A null or blank text has fingerprint zero. Rows are kept as they are, also those with a
    null or a repeated doc_id.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.array([fingerprint(x.as_py(), width) for x in texts], np.uint64)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64), pa.int64())})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(released(run), "doc_id long, fp long")


def _near(radius: int) -> list[tuple[int, ...]]:
    """Steps between tiles within the radius, one of each pair of opposite ones."""
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=PARTS) if 0 < sum(map(abs, s)) <= radius]
    return [s for s in steps if next(x for x in s if x) > 0]


def links_between(home: np.ndarray, probe: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) that connect what the links between home and probe connect.

    Both count in one numbering: home first, then probe (with same: probe is home). Each probe
    is joined to its first partner, its other partners to that one, so a dense group gives a
    few pairs for each member and not all.
    """
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for at in range(0, len(probe), SQUARE):
        p = probe[at : at + SQUARE]
        first = np.full(len(p), -1, np.int64)
        for ht in range(0, at + len(p) if same else len(home), SQUARE):
            h = home[ht : ht + SQUARE]
            hit = np.bitwise_count(h[:, None] ^ p[None, :]) <= radius
            if same:
                hit &= (np.arange(ht, ht + len(h))[:, None]) < (np.arange(at, at + len(p))[None, :])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            i += ht
            order = np.argsort(j, kind="stable")
            js, where = np.unique(j[order], return_index=True)
            fresh = first[js] < 0
            first[js[fresh]] = i[order][where[fresh]]
            pairs = np.unique(np.stack([i, first[j]], 1)[i != first[j]], axis=0)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
        got = np.nonzero(first >= 0)[0]
        a.append(first[got])
        b.append(got + at + (0 if same else len(home)))
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def _compare(radius: int):
    def emit(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            u, v = forest(ids[a], ids[b])
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile, block and role: the homes of a block, then those that visit it."""
        key, homes, ids, open_ = None, [], [], True
        home = rep = np.zeros(0, np.int64)
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = np.nonzero(np.any([np.diff(c) != 0 for c in cols[:3]], axis=0))[0] + 1 if batch.num_rows else []
            for s, e in itertools.pairwise([0, *cut, batch.num_rows]) if batch.num_rows else ():
                if (k := (cols[0][s], cols[1][s])) != key:
                    if key is not None and open_:
                        yield from emit(*_selves(homes, ids, radius))
                    key, homes, ids, open_ = k, [], [], True
                fp, who = cols[3][s:e].view(np.uint64), cols[4][s:e]
                if cols[2][s] == 0:
                    homes.append(fp)
                    ids.append(who)
                    continue
                if open_:
                    yield from emit(*_selves(homes, ids, radius))
                    home, rep, open_ = np.concatenate([np.zeros(0, np.uint64), *homes]), np.concatenate([np.zeros(0, np.int64), *ids]), False
                yield from emit(np.concatenate([rep, who]), *links_between(home, fp, radius, False))
        if key is not None and open_:
            yield from emit(*_selves(homes, ids, radius))

    return run


def _selves(homes: list, ids: list, radius: int):
    home = np.concatenate([np.zeros(0, np.uint64), *homes])
    return np.concatenate([np.zeros(0, np.int64), *ids]), *links_between(home, home, radius, True)


def _tile(part: list[Column]) -> Column:
    code = part[0]
    for p in part[1:]:
        code = code * 17 + p
    return code.cast("int")


def fingerprint_links(groups: DataFrame, radius: int) -> DataFrame:
    """(u, v): rows that connect the reps of groups (fp long, rep long) within radius bits.

    They connect exactly what all links connect, without listing all pairs of a dense group.
    """
    part = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(PARTS)]
    placed = groups.select("fp", "rep", *[p.alias(f"p{k}") for k, p in enumerate(part)])
    placed = placed.withColumn("tile", _tile([F.col(f"p{k}") for k in range(PARTS)]))
    # At most 17**4 rows, whatever the input.
    tiles = materialize(placed.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "simhash-tiles")
    placed = placed.join(F.broadcast(tiles), "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    own = placed.select("tile", "block", F.lit(0).alias("role"), "fp", "rep")
    inside = placed.filter("blocks > 1").select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", "fp", "rep")
    inside = inside.filter("other > block").select("tile", F.col("other").alias("block"), F.lit(1).alias("role"), "fp", "rep")
    steps = F.array(*[F.array(*map(F.lit, s)) for s in _near(radius)])
    moved = placed.select("fp", "rep", *[f"p{k}" for k in range(PARTS)], F.explode(steps).alias("s"))
    to = [F.col(f"p{k}") + F.col("s")[k] for k in range(PARTS)]
    valid = to[0].between(0, 16)
    for t in to[1:]:
        valid &= t.between(0, 16)
    moved = moved.filter(valid).select("fp", "rep", _tile(to).alias("tile")).join(F.broadcast(tiles), "tile")
    moved = moved.select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "fp", "rep")
    rows = own.unionByName(inside).unionByName(moved)
    return rows.repartition("tile", "block").sortWithinPartitions("tile", "block", "role").mapInArrow(released(_compare(radius)), "u long, v long")


def nearest_and_first(homes: list[tuple[np.ndarray, ...]], probe: tuple[np.ndarray, ...], radius: int, ratio: tuple[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each of probe with the first and with the nearest that homes have of it, by id.

    homes is a list of squares, each and probe (fp, n, id, met). Only those count that differ in
    radius bits or fewer and whose sizes n have the ratio num / den at least. With same, probe is
    the last of homes, and its rows look only at those before them. met marks homes that are in
    a pair; others get their nearest of probe, so every row with a partner is in a pair.
    """
    num, den = ratio
    fp, n, who, _ = probe
    least = np.full(len(fp), radius + 1, np.int64)
    first, near = (np.full(len(fp), -1, np.int64) for _ in range(2))
    ids = np.concatenate([h[2] for h in homes]) if homes else who
    more: list[tuple[np.ndarray, np.ndarray]] = []
    start = 0
    for k, (hfp, hn, hid, met) in enumerate(homes):
        at, start = start, start + len(hfp)
        if hn.max() * den < n.min() * num or n.max() * den < hn.min() * num:
            continue
        differ = np.bitwise_count(hfp[:, None] ^ fp[None, :])
        hit = differ <= radius
        if same and k == len(homes) - 1:
            hit &= np.arange(len(hfp))[:, None] < np.arange(len(fp))[None, :]
        if not len(got := np.flatnonzero(hit.any(0))):
            continue
        low, high = np.minimum(hn[:, None], n[None, got]), np.maximum(hn[:, None], n[None, got])
        differ = np.where(hit[:, got] & (low * den >= high * num), differ[:, got], radius + 1)
        i = differ.argmin(0)
        bits = differ[i, np.arange(len(got))]
        fresh = (first[got] < 0) & (bits <= radius)
        hit = differ <= radius
        one = hit.argmax(0)[fresh]
        first[got[fresh]] = at + one
        met[one] = True
        if same and k == len(homes) - 1:
            met |= first >= 0
        alone = np.flatnonzero(hit.any(1) & ~met)
        more.append((hid[alone], who[got[differ[alone].argmin(1)]]))
        met[alone] = True
        better = bits < least[got]
        least[got[better]], near[got[better]] = bits[better], at + i[better]
    linked = np.flatnonzero(first >= 0)
    if same:
        homes[-1][3][linked] = True
    other = linked[near[linked] != first[linked]]
    u = [ids[first[linked]], ids[near[other]], *(x for x, _ in more)]
    return np.concatenate(u), np.concatenate([who[linked], who[other], *(x for _, x in more)])


def _wide(radius: int, ratio: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile, block and role: the homes of a block, then those that visit it."""
        key, homes = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, block, role, n, fp, who = (c.to_numpy() for c in batch.columns)
            fp, n = fp.view(np.uint64), n.astype(np.int64)
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in (tile, block, role)], axis=0)) + 1
            for s, e in itertools.pairwise([0, *cut, batch.num_rows]):
                if (tile[s], block[s]) != key:
                    key, homes = (tile[s], block[s]), []
                for at in range(s, e, WIDE_SQUARE):
                    probe = tuple(c[at : min(at + WIDE_SQUARE, e)] for c in (fp, n, who))
                    probe += (np.zeros(len(probe[0]), bool),)
                    if role[s] == 0:
                        homes.append(probe)
                    u, v = nearest_and_first(homes, probe, radius, ratio, bool(role[s] == 0))
                    if len(u):
                        yield pa.record_batch({"u": pa.array(np.minimum(u, v)), "v": pa.array(np.maximum(u, v))})

    return run


def fingerprint_pairs(groups: DataFrame, radius: int, ratio: tuple[int, int]) -> DataFrame:
    """(u, v), u < v: ids of groups (id long, fp long, n int) within radius bits, each a true pair.

    n is the size of what a fingerprint stands for; only sizes with the ratio num / den at least
    are paired. Tiles are made of the logarithm of n and of the bit count, in steps such that all
    partners are in a tile or beside it; a crowded tile is cut into blocks. Of its partners in a
    block each row gets the first and the nearest, so a dense group gives a few pairs for each
    member, and every row that has a partner is in a pair. Pairs may come more than once.
    """
    wide = 65  # bit counts, and so tiles of a size
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(ratio[1] / ratio[0]) + 1e-9))
    code = lambda by, bits: ((F.col("band") + by) * (wide + 2) + F.col("count") + bits).cast("int")
    placed = groups.filter("n > 0").select("id", "fp", F.col("n").cast("int").alias("n"), band.alias("band"), (F.floor(F.bit_count("fp") / (radius + 1)) + 1).alias("count"))
    placed = placed.withColumn("tile", code(0, 0))
    tiles = materialize(placed.groupBy("tile").agg(F.ceil(F.count("*") / WIDE_BLOCK).cast("int").alias("blocks")), "simhash-wide-tiles")
    placed = placed.join(F.broadcast(tiles), "tile").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    own = placed.select("tile", "block", F.lit(0).alias("role"), "n", "fp", "id")
    inside = placed.filter("blocks > 1").select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block", "n", "fp", "id")
    inside = inside.filter("other > block").select("tile", F.col("other").alias("block"), F.lit(1).alias("role"), "n", "fp", "id")
    beside = F.explode(F.array(*[code(*step) for step in ((0, 1), (1, -1), (1, 0), (1, 1))])).alias("tile")
    moved = placed.select(beside, "n", "fp", "id").join(F.broadcast(tiles), "tile")
    moved = moved.select("tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "n", "fp", "id")
    rows = own.unionByName(inside).unionByName(moved)
    return rows.repartition("tile", "block").sortWithinPartitions("tile", "block", "role", "n").mapInArrow(released(_wide(radius, ratio)), "u long, v long")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every row of docs.

    docs needs doc_id and text; other columns are ignored. Texts without words have
    fingerprint zero and link like any other. component_id is the smallest doc_id reachable by
    links of radius bits or fewer, itself included. Rows with a repeated doc_id have each their
    own fingerprint; where it is the smallest of its fingerprint's rows, that doc_id is one
    vertex. Rows with a null doc_id get their group's id. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, width), "simhash-prints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-groups")
    named = groups.filter("rep is not null")
    # A repeated doc_id may be the smallest of several fingerprints: those are linked as one document.
    found = components(fingerprint_links(named, radius), "simhash")
    classes = materialize(groups.join(found, groups.rep == found.id, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id")), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, and those without doc_id.

    All columns stay as they are. Rows with the same doc_id stay or go together.
    """
    gone = simhash_components(docs.select("doc_id", "text"), width, radius).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
