"""Byte-level BPE encoding and decoding from a file of merge ranks.

A pre-token is merged with a rank queue: each merge rank has a bucket of linked-list
positions, a hierarchical bitmap marks the ranks whose bucket isn't empty, and find-first-set
on its words gives the next rank. Entries that an earlier merge made stale are skipped when
they come up. Each merge costs a few word operations, so that pre-tokens of any length are
encoded in time that is nearly linear in their length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import string
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.memory import released
from quadrat.llm.tokens import ENTRY_BYTES, LETTERS, spans
from quadrat.runtime import ship

#: Bytes that the kept pieces and their ids take, about; a fuller cache starts anew.
CACHE_BYTES = 32_000_000
#: Characters of text that are encoded at a time, whole texts at least; each time makes a hash table of what is kept.
BATCH = 4_000_000
#: Bytes of pre-tokens that are merged in one queue, whole pre-tokens at least.
MERGED = 500_000
#: The pattern by which letters, and punctuation behind them, are a pre-token each.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TAILED = f"^(?P<core> ?[{LETTERS}]+)(?P<tail>[{re.escape(string.punctuation)}]*)$"
_SPACE = r"\t-\r \x85\xa0  -     　"
_ODD = f" (?:[{_SPACE}\\x1c-\\x1f]|\\z)"
_CUT = re.compile(r" (?=[^\s])")


def joined(values: pa.Array, starts: np.ndarray) -> pa.Array:
    """The concatenated values from each start to the next, in the same buffer."""
    _, offsets, raw = values.buffers()
    offsets = np.frombuffer(offsets, np.int64)[values.offset + starts] if len(values) else np.zeros(len(starts), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offsets), raw or pa.py_buffer(b"")])


class RankQueue:
    """Buckets of positions by rank; pop() gives the smallest rank and all its positions.

    A word of 64 ranks (or of 64 words, a level up) has the bits of those that aren't empty.
    """

    def __init__(self, ranks: int):
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = -(-max(ranks, 1) // 64)
            self.levels.append([0] * ranks)
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        edges = [0, *cut.tolist(), len(ranks)]
        buckets, levels = self.buckets, self.levels
        for at, rank in enumerate(ranks[edges[:-1]].tolist()):
            part = positions[edges[at] : edges[at + 1]]
            if rank in buckets:
                buckets[rank].append(part)
                continue
            buckets[rank] = [part]
            for level in levels:
                rank, bit = rank >> 6, 1 << (rank & 63)
                word = level[rank]
                level[rank] = word | bit
                if word:
                    break

    def pop(self) -> tuple[int, list[np.ndarray]]:
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            at, bit = at >> 6, at & 63
            level[at] &= ~(1 << bit)
            if level[at]:
                break
        return rank, self.buckets.pop(rank)


class Bpe:
    """ranks: id by byte string; pattern: what cuts a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # The pattern's white space is Unicode's, without the separators \x1c to \x1f.
        inside = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.pieces = regex.compile(inside).findall
        self.size = max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        # The rank of a pair by its two ids is that of the joined bytes, however they are cut.
        keys, values, get = array("q"), array("i"), ranks.get
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if (left := get(t[:i])) is not None and (right := get(t[i:])) is not None:
                    keys.append(left << 32 | right)
                    values.append(r)
        order = np.argsort(np.frombuffer(keys, np.int64), kind="stable")
        self.keys = np.frombuffer(keys, np.int64)[order]
        self.values = np.append(np.frombuffer(values, np.int32)[order], -1).astype(np.int64)
        parts: list[bytes] = [b""] * self.size
        for t, r in ranks.items():
            parts[r] = t
        self.parts = pa.array(parts, pa.large_binary())
        self.by_words = pattern == WORDS
        self.forget()

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != keys] = -1
        return self.values[at]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers.

        All pieces share one queue and one linked list with a barrier after each piece. The
        positions of a rank are merged together, since no merge of theirs touches another but
        where they overlap; there the left one goes first. Should a merge give a pair of a
        smaller rank, its piece is merged anew, alone and position by position.
        """
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths + 1) - 1
        raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ids = self.bytes[raw]
        ids[ends] = 1 << 31
        if ids.min() < 0:
            raise ValueError("the ranks lack a byte")
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        due = np.full(n, -1, np.int64)
        due[:-1] = self._pair(ids[:-1], ids[1:])
        alive = np.ones(n, bool)
        apart: set[int] = set()
        queue = RankQueue(self.size)
        start = np.flatnonzero(due >= 0)
        queue.push(due[start], start)
        while queue.buckets:
            rank, bucket = queue.pop()
            pos = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            pos = pos[due[pos] == rank]  # the others are stale
            if not len(pos):
                continue
            j = after[pos]
            if (due[j] == rank).any():
                kept, taken = [], -1
                for p, q in zip(pos.tolist(), j.tolist(), strict=True):
                    if p != taken:
                        kept.append(p)
                        taken = q
                pos = np.array(kept)
                j = after[pos]
            k = after[j]
            after[pos] = k
            before[k] = pos
            alive[j] = False
            due[j] = -1
            ids[pos] = rank
            h = before[pos]
            where = np.concatenate([pos, h])
            made = self._pair(ids[where], ids[np.concatenate([k, pos])])
            fresh = made >= 0
            fresh[len(pos) :] &= made[len(pos) :] != due[h]
            due[where] = made
            if fresh.any():
                made, where = made[fresh], where[fresh]
                if made.min() < rank:
                    apart.update(np.searchsorted(ends, where[made < rank]).tolist())
                queue.push(made, where)
        tokens = ids[alive].astype("<u4")
        upto = np.cumsum(alive)[ends]
        blob = tokens.tobytes()
        out, s = [], 0
        for e in (upto * 4).tolist():
            out.append(blob[s : e - 4])
            s = e
        for i in apart:
            out[i] = self.merge_alone(pieces[i])
        return out

    def merge_alone(self, piece: bytes) -> bytes:
        """The ids of one pre-token, one merge at a time."""
        ids = [int(self.bytes[x]) for x in piece]
        n = len(ids)
        after, before, due = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        pair = lambda i, j: int(self._pair(np.array([ids[i]]), np.array([ids[j]]))[0])
        queue: list[tuple[int, int]] = []
        for i in range(n - 1):
            due[i] = pair(i, i + 1)
            if due[i] >= 0:
                queue.append((due[i], i))
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if due[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], due[j], due[i] = rank, -1, -1
            if k < n:
                before[k] = i
                due[i] = pair(i, k)
                if due[i] >= 0:
                    heapq.heappush(queue, (due[i], i))
            if (h := before[i]) >= 0 and (r := pair(h, i)) != due[h]:
                due[h] = r
                if r >= 0:
                    heapq.heappush(queue, (r, h))
        out, i = array("I"), 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out.tobytes()

    def forget(self) -> None:
        self.kept, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _learn(self, pieces: pa.Array) -> None:
        """Keep the ids of pre-tokens that aren't kept yet."""
        raw = pieces.cast(pa.large_binary()).to_pylist()
        ids = [None if (r := self.ranks.get(b)) is None else r.to_bytes(4, "little") for b in raw]
        rest = [i for i, x in enumerate(ids) if x is None]
        for at, to in spans([len(raw[i]) for i in rest], MERGED):
            for i, x in zip(rest[at:to], self.merge([raw[i] for i in rest[at:to]]), strict=True):
                ids[i] = x
        self.kept = pa.concat_arrays([self.kept, pieces])
        self.ids = pa.concat_arrays([self.ids, pa.array(ids, pa.large_binary())])

    def _of_pieces(self, pieces: pa.Array) -> pa.Array:
        """The ids of pre-tokens."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        places = pc.index_in(distinct, value_set=self.kept)
        if places.null_count:
            fresh, known = distinct.filter(places.is_null()), len(self.kept)
            self._learn(fresh)
            places = pc.replace_with_mask(places, places.is_null(), pa.array(np.arange(known, known + len(fresh)), pa.int32()))
        return self.ids.take(places.take(coded.indices))

    def _of_words(self, words: pa.Array) -> pa.Array:
        """The ids of words with the space before them, if any."""
        cores, tails = pa.nulls(len(words), words.type), pa.nulls(len(words), words.type)
        if self.by_words:
            parts = pc.extract_regex(words, _TAILED)
            cores, tails = pc.struct_field(parts, "core"), pc.struct_field(parts, "tail")
        other = cores.is_null()
        cut = list(map(self.pieces, words.filter(other).to_pylist()))
        starts = np.cumsum([0, *map(len, cut)])
        cores, tails = cores.drop_null(), tails.drop_null()
        n = len(cores)
        ids = self._of_pieces(pa.concat_arrays([cores, tails, pa.array(chain.from_iterable(cut), words.type)]))
        whole = pa.concat_arrays([pc.binary_join_element_wise(ids[:n], ids[n : 2 * n], pa.scalar(b"", pa.large_binary())), joined(ids[2 * n :], starts)])
        return whole.take(pa.array(np.argsort(np.argsort(other.to_numpy(zero_copy_only=False), kind="stable"))))

    def _words(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, pa.Array]:
        """Different words, the place among them of each word of texts, where texts begin, their order.

        A space before what isn't white space always begins a pre-token: cut there. The first
        word of a text has no space before it.
        """
        odd = pc.match_substring_regex(texts, _ODD)
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        cut = list(map(_CUT.split, texts.filter(odd).to_pylist()))
        words = pa.concat_arrays([split.flatten(), pa.array(chain.from_iterable(cut), pa.large_string())])
        starts = np.cumsum([0, *np.diff(split.offsets.to_numpy()).tolist(), *map(len, cut)])
        del split, cut
        first = np.zeros(len(words), bool)
        first[starts[:-1]] = True
        heads, rest = words.filter(pa.array(first)).dictionary_encode(), words.filter(pa.array(~first)).dictionary_encode()
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), rest.dictionary, pa.scalar(" ", pa.large_string()))
        places = np.empty(len(words), np.int32)
        places[~first] = rest.indices.to_numpy()
        places[first] = heads.indices.to_numpy() + len(spaced)
        order = np.argsort(np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable"))
        return pa.concat_arrays([spaced, heads.dictionary]), pa.array(places), starts, pa.array(order)

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """The ids of whole texts, none null, as little-endian unsigned 32-bit integers.

        Each different word is looked up once. Letters with punctuation behind them are two
        pre-tokens, so that letters are kept once whatever stands behind them; other words are
        cut by the pattern. Pre-tokens that aren't kept are merged together.
        """
        if self.kept.nbytes + self.ids.nbytes + ENTRY_BYTES * len(self.ids) > CACHE_BYTES:
            self.forget()
        words, places, starts, order = self._words(texts.cast(pa.large_string()))
        return joined(self._of_words(words).take(places), starts).take(order)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as in encode_array."""
        return self.encode_array(pa.array(texts, pa.large_string())).to_pylist()

    def decode_array(self, ids: pa.Array) -> pa.Array:
        """The bytes that ids stand for."""
        _, offsets, raw = ids.buffers()
        starts = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4 if len(ids) else np.zeros(1, np.int64)
        flat = np.frombuffer(raw or b"", "<u4")[starts[0] : starts[-1]]
        return joined(self.parts.take(pa.array(flat)), starts - starts[0])

    def decode(self, ids: bytes) -> bytes:
        return self.decode_array(pa.array([ids], pa.large_binary()))[0].as_py()

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        """Slices of batches (doc_id, text) of about BATCH characters, with their ids.

        What is kept goes in the end, so that a worker's memory is free for other tasks.
        """
        try:
            for batch in batches:
                texts = pc.fill_null(batch.column(1), "")
                for at, to in spans(pc.utf8_length(texts).to_numpy(), BATCH):
                    yield batch.slice(at, to - at), self.encode_array(texts.slice(at, to - at))
        finally:
            self.forget()


_loaded: dict[tuple[str, str], Bpe] = {}


def loaded(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe.load(path, pattern)
    return _loaded[path, pattern]


def counts(ids: pa.Array) -> pa.Array:
    return pa.array(pc.binary_length(ids).to_numpy() // 4, pa.int64())


def digests(values: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in values], pa.string())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row of docs, encoded whole and decoded again.

    docs needs doc_id and text; other columns are ignored. ids are little-endian unsigned
    32-bit integers, decoded the bytes that they stand for. A null text is an empty one: no
    ids. Rows stay as they are, also with null or repeated doc_id.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for part, ids in bpe.batches(batches):
            yield pa.record_batch({
                "doc_id": part.column(0),
                "n_tokens": counts(ids),
                "ids": ids.cast(pa.binary()),
                "decoded": bpe.decode_array(ids).cast(pa.binary()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids binary, decoded binary")


def encoding_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents with digests in place of bytes.

    The digests are taken beside the encoder, so that ids needn't pass to the JVM for them.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for part, ids in bpe.batches(batches):
            yield pa.record_batch({
                "doc_id": part.column(0),
                "n_tokens": counts(ids),
                "ids_sha256": digests(ids),
                "decoded_sha256": digests(bpe.decode_array(ids)),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
