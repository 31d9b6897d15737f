"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A suffix is ordered by its first `width` bytes only, most significant digits first; suffixes
whose group has no second document drop out on the way, and groups that are equal at full
depth are exactly the repeated windows. The passes:

1. Documents are packed into blocks of some megabytes that are files in the shared folder.
2. First digit. Each window of `width` bytes has an anchor: its `gram`-byte string with the
   smallest hash. Equal windows have equal anchors at equal places, so suffixes are dealt by
   anchor instead of by their first bytes, and only anchors are sent: 8 bytes for about every
   14 bytes of text. Anchors that no other document has end here.
3. Further digits. For the remaining anchors, the bytes around them are sent, once for each
   block and distinct string. The strings are radix-sorted outwards from the anchor, to the
   right and to the left, 8 bytes a pass; a window is a pair of a left and a right class.
4. A block gets back one bit for each string and window: a smaller document has it.

Requests are dealt by anchor hash over parts of bounded size, and answers go back by block;
text is read from the block files and never shuffled. A passage that a third of all documents
share is one string for each block. An anchor with many different strings (a common line in
unlike texts) is hot: its windows are sent each on its own, once for each block, and dealt by
all their bytes, so that only equal windows need to meet.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.files import open_file, write_file
from quadrat.llm.memory import release, released
from quadrat.runtime import fresh_path, materialize, ship

WIDTH = 50
GRAM = 24
BLOCK_BYTES = 4_000_000
#: Bytes of text for each part that anchors are dealt to.
PART_BYTES = 12_000_000
#: Text bytes that are hashed at a time.
CHUNK = 1 << 20
#: A block tells of an anchor's different strings if they are more than COUNTED; an anchor of more
#: than HOT such strings in all is hot. So a part has at most COUNTED strings of an anchor for
#: each block, and HOT more. Results don't depend on either.
COUNTED = 16
HOT = 2048
NONE = np.zeros(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each string of gram bytes (a multiple of 8) in text."""
    n = len(text) - gram + 1
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    words = np.ndarray((len(text),), "<u8", padded, strides=(1,))
    out = words[:n].copy()
    for at in range(8, gram, 8):
        _mix(out)
        out ^= words[at : at + n]
    return _mix(out)


def _slide(x: np.ndarray, width: int, low) -> np.ndarray:
    """low(x[i : i + width]) for each i, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = low(out[:-step], out[step:])
        have += step
    return out


def anchors(text: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, place, first, last of the anchors of a document.

    The windows that begin at first to last (inclusive) have their leftmost smallest hash at
    place, and each window of the document is in exactly one of these ranges.
    """
    inner = width - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    starts = len(text) - width + 1
    for at in range(0, max(starts, 0), CHUNK):
        n = min(CHUNK, starts - at)
        hashes = gram_hashes(text[at : at + n + width - 1], gram)
        low = _slide(hashes, inner, np.minimum)
        cut = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1, [n]])
        runs = low[cut[:-1]]
        # Places that are the smallest of a window, in order, are those of the runs in order,
        # unless a hash occurs twice within a window.
        edge = np.zeros(inner - 1, np.uint64)
        place = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), inner, np.maximum) == hashes)
        if len(place) != len(runs) or (hashes[place] != runs).any() or (place - cut[:-1] >= inner).any() or (cut[1:] - 1 > place).any():
            place, cut = _places(hashes, low, inner)
            runs = low[cut[:-1]]
        found.append((runs, place + at, cut[:-1] + at, cut[1:] - 1 + at))
    if not found:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _places(hashes: np.ndarray, low: np.ndarray, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for text that repeats a hash within a window, looking at each window."""
    place = np.full(len(low), -1, np.int64)
    for step in range(inner - 1, -1, -1):
        hit = hashes[step : step + len(low)] == low
        place[hit] = np.flatnonzero(hit) + step
    cut = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(low)]])
    return place[cut[:-1]], cut


# --- Blocks -----------------------------------------------------------------------------


def write_blocks(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pack docs into block files with all their columns; rows (block, bytes, rows)."""

    def flush(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        name = f"{folder}/{uuid.uuid4().hex}.arrow"
        table = pa.Table.from_batches(held)

        def write(out: pa.NativeFile) -> None:
            with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)

        write_file(name, write)
        return pa.record_batch({"block": [name], "bytes": pa.array([size], pa.int64()), "rows": pa.array([table.num_rows], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
            at = 0
            while at < batch.num_rows:
                base = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, base + block_bytes - size, side="right")))
                held.append(batch.slice(at, end - at))
                size += int(sizes[end - 1]) - base
                at = end
                if size >= block_bytes or at < batch.num_rows:
                    yield flush(held, size)
                    held, size = [], 0
        if held:
            yield flush(held, size)

    return docs.mapInArrow(released(run), "block string, bytes long, rows long")


def read_block(name: str) -> pa.Table:
    with open_file(name) as source:
        return pa.ipc.open_file(source).read_all()


def _among(h: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each of h is one of some."""
    if not len(some):
        return np.zeros(len(h), bool)
    some = np.sort(some)
    return some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h


def _hash_of(raw: np.ndarray) -> np.ndarray:
    """The anchors' hashes, which strings begin with."""
    return raw[:, :8].copy().view(">u8").ravel().astype(np.uint64)


class Block:
    """A block's documents in ascending doc_id order, as one run of bytes, and their anchors."""

    def __init__(self, name: str, width: int, gram: int):
        self.table = read_block(name)
        self.ids = self.table["doc_id"].to_numpy()
        texts = self.table["text"].to_pylist()
        self.texts = [t or b"" for t in texts]
        found = []
        for row, text in enumerate(self.texts):
            if len(text) >= width:
                h, place, first, last = anchors(np.frombuffer(text, np.uint8), width, gram)
                found.append((h, place, first, last, np.full(len(h), row)))
        empty = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
        self.hash, self.place, self.first, self.last, self.row = (np.concatenate(x) for x in zip(empty, *found, strict=True))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted hashes of the block, and for each whether two of its documents have it."""
        order = np.lexsort((self.ids[self.row], self.hash))
        h, doc = self.hash[order], self.ids[self.row][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        many = np.zeros(len(h), bool)
        many[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        starts = np.flatnonzero(new)
        return h[starts], np.logical_or.reduceat(many, starts) if len(starts) else np.zeros(0, bool)

    def crowded(self, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes with more than COUNTED different strings in the block, and how many they have."""
        h, n = np.unique(self.hash, return_counts=True)
        if len(h) and n.max() > COUNTED:
            h, n = np.unique(_hash_of(self.strings(h[n > COUNTED], NONE, width, gram)[0]), return_counts=True)
        return h[n > COUNTED], n[n > COUNTED]

    def strings(self, kept: np.ndarray, hot: np.ndarray, width: int, gram: int):
        """Of the anchors with a kept hash: bytes around, windows, and the smallest document.

        Gives for each distinct (hash, windows, string): these as bytes, the document, and whether
        the hash is hot; and four arrays with an entry for each anchor, or for each window of one
        with a hot hash: the anchor, the least and most bytes before it at which windows begin,
        and the index among the distinct ones.
        """
        side, span = width - gram, 2 * width - gram
        body = np.frombuffer(b"".join(self.texts), np.uint8)
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.texts), np.int64, len(self.texts)))])
        padded = np.concatenate([np.zeros(side, np.uint8), body, np.zeros(span, np.uint8)])
        # From side bytes before the anchor to width bytes behind its begin.
        view = np.lib.stride_tricks.sliding_window_view(padded, span)
        least, most = self.place - self.last, self.place - self.first
        single = _among(self.hash, hot)
        mine = np.flatnonzero(_among(self.hash, kept) & ~single)
        asked = [(mine, least[mine], most[mine])]
        for back in range(side + 1) if single.any() else ():
            mine = np.flatnonzero(single & (least <= back) & (back <= most))
            asked.append((mine, np.full(len(mine), back), np.full(len(mine), back)))
        raws, docs, classes, n = [], [], [], 0
        columns = np.arange(span)
        for mine, high, low in asked:
            text = view[begin[self.row[mine]] + self.place[mine]]
            # Bytes that none of the windows reaches are blanked: they don't tell strings apart.
            text = np.where((columns[None, :] >= side - low[:, None]) & (columns[None, :] < side - high[:, None] + width), text, 0).astype(np.uint8)
            key = np.concatenate([self.hash[mine].astype(">u8").view(np.uint8).reshape(-1, 8), high.astype(np.uint8)[:, None], low.astype(np.uint8)[:, None], text], 1)
            packed = np.ascontiguousarray(key).view(np.dtype((np.void, key.shape[1]))).ravel()
            order = np.argsort(packed, kind="stable")
            ordered = packed[order]
            new = np.ones(len(order), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            starts = np.flatnonzero(new)
            cls = np.empty(len(order), np.int64)
            cls[order] = np.cumsum(new) - 1 + n
            n += len(starts)
            classes.append(cls)
            docs.append(np.minimum.reduceat(self.ids[self.row[mine]][order], starts) if len(starts) else np.zeros(0, np.int64))
            raws.append(ordered[starts].view(np.uint8).reshape(len(starts), span + 10))
        entries = *(np.concatenate(x) for x in zip(*asked, strict=True)), np.concatenate(classes)
        return np.concatenate(raws), np.concatenate(docs), np.arange(n) >= len(raws[0]), entries


# --- Dealing ----------------------------------------------------------------------------


def _parts_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _string_parts(raw: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of each string: by its anchor's hash, or by all its bytes if that is hot."""
    h = _hash_of(raw)
    if hot.any():
        rows = np.flatnonzero(hot)
        words = np.zeros((len(rows), -(-raw.shape[1] // 8) * 8), np.uint8)
        words[:, : raw.shape[1]] = raw[rows]
        mixed = np.zeros(len(rows), np.uint64)
        for word in words.view("<u8").T:
            mixed ^= word
            _mix(mixed)
        h[rows] = mixed
    return _parts_of(h, parts)


def _by_part(part: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The parts that occur, ascending, and for each the rows that it has, in order."""
    order = np.argsort(part, kind="stable")
    used, starts = np.unique(part[order], return_index=True)
    return used, np.split(order, starts[1:]) if len(used) else []


def _anchor_requests(parts: int, width: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["block"]:
                block = Block(name, width, gram)
                h, many = block.distinct()
                crowded, often = block.crowded(width, gram)
                strings = np.zeros(len(h), np.uint64)
                strings[np.searchsorted(h, crowded)] = often
                del block
                used, rows = _by_part(_parts_of(h, parts))
                some = [r[strings[r] > 0] for r in rows]
                release()
                yield pd.DataFrame({"part": used.astype(np.int32), "block": name, "hashes": [h[r].tobytes() for r in rows], "many": [np.packbits(many[r]).tobytes() for r in rows], "crowded": [np.stack([h[r], strings[r]], 1).tobytes() for r in some]})

    return run


def _answer_anchors(hot: int):
    """Of each block's anchors, those that two documents have: here, or one here and one there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(h)).astype(bool) for m, h in zip(pdf["many"], lists, strict=True)]
        strings = [np.zeros(len(h), np.uint64) for h in lists]
        for n, h, x in zip(strings, lists, pdf["crowded"], strict=True):
            told = np.frombuffer(x, np.uint64).reshape(-1, 2)
            n[np.searchsorted(h, told[:, 0])] = told[:, 1]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        ranked, flags = every[order], np.concatenate(many)[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        shared = np.logical_or.reduceat(flags, starts) | (np.diff(np.append(starts, len(ranked))) > 1)
        crowd = shared & (np.add.reduceat(np.concatenate(strings)[order], starts) > hot)
        keep, single = np.empty(len(every), bool), np.empty(len(every), bool)
        keep[order], single[order] = shared[np.cumsum(new) - 1], crowd[np.cumsum(new) - 1]
        at, kept, singles = 0, [], []
        for h in lists:
            kept.append(h[keep[at : at + len(h)]].tobytes())
            singles.append(h[single[at : at + len(h)]].tobytes())
            at += len(h)
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "answer": kept, "hot": singles})[[bool(k) for k in kept]]

    return run


def _kept(pdf: pd.DataFrame, column: str = "answer") -> np.ndarray:
    return np.concatenate([NONE, *[np.frombuffer(x, np.uint64) for x in pdf[column]]])


def _string_requests(parts: int, width: int, gram: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["block"].iloc[0]
        raw, doc, hot, _ = Block(name, width, gram).strings(_kept(pdf), _kept(pdf, "hot"), width, gram)
        used, pick = _by_part(_string_parts(raw, hot, parts))
        pack = lambda x: pa.compress(x, "zstd", asbytes=True)
        release()
        return pd.DataFrame({"part": used.astype(np.int32), "block": name, "rows": [len(x) for x in pick], "strings": [pack(raw[x].T.tobytes()) for x in pick], "docs": [doc[x].tobytes() for x in pick]})

    return run


def _classes(text: np.ndarray, start: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Radix sort of rows that are already grouped by start, 8 bytes a pass.

    Gives order and, between neighbours in that order, how many bytes they share (0 where the
    groups differ). Groups with a single document aren't sorted further.
    """
    n, depth = text.shape
    wide = np.zeros((n, -(-depth // 8) * 8), np.uint8)
    wide[:, :depth] = text
    digits = wide.view(">u8").astype(np.uint64)
    order = np.argsort(start, kind="stable")
    ranked = start[order]
    edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    group = np.repeat(edge, np.diff(np.append(edge, n)))  # the position of its first row
    for d in range(digits.shape[1]):
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(edge, n))
        id_of = docs[order]
        live_group = (size > 1) & (np.minimum.reduceat(id_of, edge) != np.maximum.reduceat(id_of, edge))
        live = np.flatnonzero(np.repeat(live_group, size))
        if not len(live):
            break
        sub = order[live]
        by = np.lexsort((digits[sub, d], group[live]))
        order[live] = sub = sub[by]
        key = digits[sub, d]
        part = group[live]  # unchanged: positions of a group stay together
        step = np.concatenate([[False], (part[1:] == part[:-1]) & (key[1:] != key[:-1])])
        fresh = np.where(np.concatenate([[True], part[1:] != part[:-1]]) | step, live, 0)
        group[live] = np.maximum.accumulate(fresh)
    same = np.zeros(n, np.int64)
    if n > 1:
        a, b = text[order[:-1]], text[order[1:]]
        first = (a != b).argmax(1)
        first[(a == b).all(1)] = depth
        first[start[order[:-1]] != start[order[1:]]] = 0
        same[1:] = first
    return order, same


def _answer_strings(width: int, gram: int):
    side, span = width - gram, 2 * width - gram

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        raws = [np.frombuffer(pa.decompress(s, n * (span + 10), "zstd"), np.uint8).reshape(span + 10, n).T for s, n in zip(pdf["strings"], pdf["rows"], strict=True)]
        raw = np.concatenate(raws)
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["docs"]])
        _, start = np.unique(raw[:, :8].copy().view(">u8").ravel(), return_inverse=True)
        high, low = raw[:, 8].astype(np.int64), raw[:, 9].astype(np.int64)
        text = raw[:, 10:]
        right, shared_right = _classes(text[:, side:], start, docs)
        left, shared_left = _classes(text[:, :side][:, ::-1], start, docs)
        answer = np.zeros(len(raw), np.uint32)
        rank, cls, key, who = np.empty(len(raw), np.int64), None, None, None
        for back in range(side + 1):
            # Windows that begin `back` bytes before the anchor.
            mine = (high <= back) & (back <= low)
            if not mine.any():
                continue
            cls = np.empty(len(raw), np.int64)
            cls[right] = np.cumsum(shared_right < width - back)
            rank[left] = np.cumsum(shared_left < max(back, 1)) if back else np.cumsum(np.concatenate([[0], start[left][1:] != start[left][:-1]]))
            rows = np.flatnonzero(mine)
            key = cls[rows] * (len(raw) + 1) + rank[rows]
            by = np.argsort(key, kind="stable")
            key, who = key[by], docs[rows][by]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            least = np.repeat(np.minimum.reduceat(who, edge), np.diff(np.append(edge, len(key))))
            hit = rows[by][least < who]
            answer[hit] |= np.uint32(1 << back)
        cut = np.concatenate([[0], np.cumsum(pdf["rows"])])
        del raws, raw, text, key, who, cls, rank, right, left, shared_right, shared_left
        release()
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "answer": [answer[cut[i] : cut[i + 1]].tobytes() for i in range(len(pdf))]})

    return run


def _resolve(block: Block, kept: np.ndarray, hot: np.ndarray, answers: dict[int, np.ndarray], parts: int, width: int, gram: int) -> list[np.ndarray]:
    """For each document the windows' begins whose string a smaller document has."""
    raw, doc, single, (mine, front, back, cls) = block.strings(kept, hot, width, gram)
    bits = np.zeros(len(raw), np.uint32)
    for p, at in zip(*_by_part(_string_parts(raw, single, parts)), strict=True):
        bits[at] = answers[int(p)]
    # A document that isn't the string's smallest in its block has a smaller one beside it.
    beaten = block.ids[block.row[mine]] > doc[cls]
    got = np.where(beaten, np.uint32(0xFFFFFFFF), bits[cls])
    rows, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    some = np.flatnonzero(got)
    mine, got, back, front = mine[some], got[some], back[some], front[some]
    for step in range(width - gram + 1):
        hit = mine[(step >= front) & (step <= back) & (got >> np.uint32(step) & np.uint32(1)).astype(bool)]
        rows.append(block.row[hit])
        begins.append(block.place[hit] - step)
    rows, begins = np.concatenate(rows), np.concatenate(begins)
    order = np.lexsort((begins, rows))
    rows, begins = rows[order], begins[order]
    cut = np.searchsorted(rows, np.arange(len(block.texts) + 1))
    return [begins[cut[i] : cut[i + 1]] for i in range(len(block.texts))]


def spans(begins: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows with these sorted begins cover."""
    if not len(begins):
        return []
    gap = np.flatnonzero(np.diff(begins) > width)
    return list(zip(begins[np.concatenate([[0], gap + 1])].tolist(), (begins[np.concatenate([gap, [len(begins) - 1]])] + width).tolist(), strict=True))


def removed_spans(docs: DataFrame, finish, schema: str, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, hot: int = HOT) -> DataFrame:
    """finish(table, texts, spans) -> record batch, for each block of docs, with its removed spans.

    docs needs doc_id (long) and text (string or binary); rows without a doc_id lose nothing
    and take nothing from others. Documents with the same doc_id are one document here: they
    don't repeat each other.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *names)
    blocks = materialize(write_blocks(plain.filter("doc_id is not null"), fresh_path(spark, "repeats-blocks"), block_bytes), "repeats-list")
    total = blocks.agg(F.sum("bytes"), F.count("*")).first()
    parts = max(1, -(-(total[0] or 0) // part_bytes))
    n_blocks = max(1, total[1])
    listed = blocks.select("block").repartition(n_blocks)
    asked = listed.mapInPandas(_anchor_requests(parts, width, gram), "part int, block string, hashes binary, many binary, crowded binary")
    kept = materialize(asked.groupBy("part").applyInPandas(_answer_anchors(hot), "block string, part int, answer binary, hot binary"), "repeats-anchors")
    strings = kept.groupBy("block").applyInPandas(_string_requests(parts, width, gram), "part int, block string, rows int, strings binary, docs binary")
    found = materialize(strings.groupBy("part").applyInPandas(_answer_strings(width, gram), "block string, part int, answer binary"), "repeats-windows")
    every = listed.select("block", F.lit(-1).alias("kind"), F.lit(-1).alias("part"), F.lit(b"").alias("answer"), F.lit(b"").alias("hot"))
    every = every.unionByName(kept.select("block", F.lit(0).alias("kind"), "part", "answer", "hot")).unionByName(found.select("block", F.lit(1).alias("kind"), "part", "answer", F.lit(b"").alias("hot")))

    def last(table: pa.Table) -> pa.Table:
        pdf = table.to_pandas()
        block = Block(pdf["block"].iloc[0], width, gram)
        windows = pdf[pdf["kind"] == 1]
        answers = {int(p): np.frombuffer(a, np.uint32) for p, a in zip(windows["part"], windows["answer"], strict=True)}
        anchored = pdf[pdf["kind"] == 0]
        gone = [spans(b, width) for b in _resolve(block, _kept(anchored), _kept(anchored, "hot"), answers, parts, width, gram)]
        table, texts = block.table, block.texts
        del block, pdf, windows, anchored, answers
        release()
        return finish(table, texts, gone)

    done = every.groupBy("block").applyInArrow(last, schema)
    apart = plain.filter("doc_id is null")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                yield from finish(pa.Table.from_batches([batch]), texts, [[] for _ in texts]).to_batches()

    return done.unionByName(apart.mapInArrow(released(alone), schema))


def cut(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    if not gone:
        return text
    at, out = 0, []
    for s, e in gone:
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def repeat_digests(docs: DataFrame, width: int = WIDTH, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    Each byte goes that is covered by a string of `width` bytes that also begins in a document
    with a smaller doc_id. A null text is an empty one. Rows with a repeated doc_id are judged
    each by its own text against smaller ids; rows without doc_id keep all. An empty table
    gives an empty result.
    """

    def finish(table: pa.Table, texts: list[bytes], gone: list[list[tuple[int, int]]]) -> pa.Table:
        return pa.table({
            "doc_id": table["doc_id"],
            "n_bytes": pa.array(map(len, texts), pa.int64()),
            "n_removed": pa.array([sum(e - s for s, e in g) for g in gone], pa.int64()),
            "n_spans": pa.array(map(len, gone), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(cut(t, g)).hexdigest() for t, g in zip(texts, gone, strict=True)], pa.string()),
        })

    return removed_spans(docs.select("doc_id", "text"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", width, **sizes)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated bytes cut out of text; all rows and other columns stay as they are.

    A character that is cut in two goes whole. A null text stays null.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns

    def finish(table: pa.Table, texts: list[bytes], gone: list[list[tuple[int, int]]]) -> pa.Table:
        kept = [None if was is None else cut(t, g).decode(errors="ignore") for t, g, was in zip(texts, gone, table["text"].to_pylist(), strict=True)]
        return pa.table({n: pa.array(kept, pa.string()) if n == "text" else table[n] for n in names})

    return removed_spans(docs, finish, schema, width)


#: Bytes that the SQL cuts windows from at a time.
PIECE = 256

#: The same rows, where no doc_id repeats, by all windows of all texts as hexadecimal digits, so of bytes and not of letters.
SQL = f"""
WITH given AS (SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS h FROM documents),
pieces AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2 * ({PIECE} + {WIDTH - 1})) AS piece FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - {WIDTH - 1}, 0), {PIECE})) AS base FROM given)),
windows AS (SELECT doc_id, base + i AS p, substr(piece, 2 * i + 1, {2 * WIDTH}) AS w FROM (SELECT doc_id, base, piece, unnest(range(0, least(len(piece) // 2 - {WIDTH - 1}, {PIECE}))) AS i FROM pieces)),
seen AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, p FROM windows JOIN seen USING (w) WHERE doc_id > first_id),
begun AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {WIDTH} THEN 0 ELSE 1 END AS fresh FROM gone),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM begun),
spans AS (SELECT doc_id, run, min(p) AS s, max(p) + {WIDTH} AS e FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
kept AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last_end, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS k FROM cuts JOIN given USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE k || substr(h, 2 * last_end + 1) END)) AS kept_sha256
FROM given LEFT JOIN kept USING (doc_id)
"""
