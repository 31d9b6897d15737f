"""The three data codecs: slots of 8 bytes, plain, in bytecode, or in bytecode under zlib."""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import numpy as np

from quadrat.sources import sav_format as sf
from quadrat.sources.dictionary import SavDictionary
from quadrat.sources.sav_format import SavError
from quadrat.sources.storage import open_input

#: Bytes of a stream that are read at a time: few at first, as a span may be short.
FIRST_CHUNK = 256 << 10
CHUNK = 8 << 20
#: Compressed blocks that are inflated at a time.
AHEAD = 4
#: A file is cut into more spans than this only where they would be larger than LARGE_SPAN.
MOST_SPANS = 256
LARGE_SPAN = 64 << 20
#: The most that a control word takes together with its raw words.
GROUP_BYTES = 72


@dataclass(frozen=True)
class Span:
    """Rows of a file that are decoded on their own.

    For bytecode, `at` is where a control word begins in the stream, and `skip` how many
    values come before the first row from there on. rows None: to the end. until: a place in
    the stream behind the last row, if it is known.
    """

    first_row: int
    rows: int | None
    at: int
    skip: int = 0
    until: int | None = None


def stream(d: SavDictionary, at: int = 0, until: int | None = None) -> Iterator[bytes]:
    """The bytecode stream from a place on, to a place or the end, in pieces."""
    step = FIRST_CHUNK
    with open_input(d.path) as source:
        if d.compression == "bytecode":
            source.seek(d.data_start + at)
            left = source.size() if until is None else until - at
            while chunk := source.read(min(step, left)):
                yield chunk
                left, step = left - len(chunk), min(2 * step, CHUNK)
            return
        blocks = _zlib_blocks(d, source)
        first = max(0, int(np.searchsorted(blocks[:, 0], at, side="right")) - 1)
        last = len(blocks) if until is None else int(np.searchsorted(blocks[:, 0], until))
        wanted = iter(blocks[first:last].tolist())

        def packed_block(place: int, size: int) -> bytes:
            source.seek(place)
            return source.read(size)

        # A few blocks are inflated ahead: that doesn't hold Python's lock.
        with ThreadPoolExecutor(AHEAD) as pool:
            ahead = deque((b, pool.submit(zlib.decompress, packed_block(b[1], b[3]))) for b in islice(wanted, AHEAD))
            held, size = [], 0
            while ahead:
                (start, _, full, _), inflated = ahead.popleft()
                raw = inflated.result()
                if len(raw) != full:
                    raise SavError(f"a block of {full} bytes inflates to {len(raw)}")
                ahead.extend((b, pool.submit(zlib.decompress, packed_block(b[1], b[3]))) for b in islice(wanted, 1))
                held.append(raw[max(0, at - start) : None if until is None else max(0, until - start)])
                size += len(held[-1])
                if size >= step or not ahead:
                    yield b"".join(held)
                    held, size, step = [], 0, min(2 * step, CHUNK)


_BLOCK = [("full_at", "i8"), ("at", "i8"), ("full", "i4"), ("packed", "i4")]


def _zlib_blocks(d: SavDictionary, source) -> np.ndarray:
    """(place in the stream, place in the file, size, packed size) of each block, as a row."""
    source.seek(d.data_start)
    head = source.read(24)
    if len(head) < 24:
        raise SavError("the file ends before its compressed data")
    _, trailer, size = struct.unpack(d.order + "3q", head)
    source.seek(trailer)
    body = source.read(size)
    if len(body) < 24:
        raise SavError("the file has no list of compressed blocks")
    count = struct.unpack(d.order + "i", body[20:24])[0]
    if count < 0 or len(body) < 24 + 24 * count:
        raise SavError(f"the list of {count} compressed blocks is cut short")
    found = np.frombuffer(body, np.dtype(_BLOCK).newbyteorder(d.order), count, 24)
    full = found["full"].astype(np.int64)
    return np.stack([np.cumsum(full) - full, found["at"].astype(np.int64), full, found["packed"].astype(np.int64)], 1)


_RAW_CODES = np.uint64(int.from_bytes(bytes([sf.OP_RAW]) * 8, "little"))
_LOW_BITS = np.uint64(0x7F7F7F7F7F7F7F7F)


def zero_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each number are zero: their top bits are what is left."""
    return np.bitwise_count(~(((x & _LOW_BITS) + _LOW_BITS) | x | _LOW_BITS))


def raw_counts(words: np.ndarray) -> np.ndarray:
    """How many of the eight codes of each word (as numbers of 64 bits) stand for a raw word."""
    return zero_bytes(words ^ _RAW_CODES)


#: Control words without raw words, one behind the other, as in the blank rest of wide strings.
_ALONE = re.compile(b"\1*")


def _control_words(words: np.ndarray) -> tuple[np.ndarray, int]:
    """Indices of the control words whose raw words are all there, and where the next one is."""
    steps = (raw_counts(words.view("<u8").ravel()) + 1).astype(np.uint8).tobytes()
    at, n, last, marks, alone = 0, len(steps), 0, bytearray(len(steps)), _ALONE.match
    while at < n:
        last = at
        marks[at] = 1
        step = steps[at]
        if step == 1 and (end := alone(steps, at).end()) - at > 1:
            marks[at:end] = steps[at:end]
            at = end
        else:
            at += step
    if at > n:
        marks[last], at = 0, last
    return np.flatnonzero(np.frombuffer(marks, bool)), at


def _groups(pieces: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(words, indices of control words, stream place of the first word, whether it's the rest)."""
    left, place = b"", 0
    for piece in pieces:
        raw = left + piece
        words = np.frombuffer(raw, np.uint8, len(raw) // 8 * 8).reshape(-1, 8)
        controls, end = _control_words(words)
        if len(controls):
            yield words[:end], controls, place, False
        left, place = raw[end * 8 :], place + end * 8
    if len(left) >= 8:
        yield np.frombuffer(left, np.uint8, len(left) // 8 * 8).reshape(-1, 8), np.zeros(1, np.int64), place, True


def _coded(pieces: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of a stream's values, and the raw words of those that have one."""
    for words, controls, _, rest in _groups(pieces):
        flat = words.view("<u8").ravel()
        codes = flat[controls].view(np.uint8)
        ends = np.flatnonzero(codes == sf.OP_END)
        over = len(ends) > 0
        codes = codes[: ends[0]] if over else codes
        skips = codes == sf.OP_SKIP
        codes = codes[~skips] if skips.any() else codes
        raw = np.ones(len(flat), bool)
        raw[controls] = False
        data = flat[raw]
        wanted = int(np.count_nonzero(codes == sf.OP_RAW))
        if wanted > len(data):
            # What is whole before the missing value is given; then the file is reported.
            whole = np.flatnonzero(codes == sf.OP_RAW)[len(data)]
            yield codes[:whole], data
            raise SavError("the file ends within its compressed data")
        yield codes, data[:wanted]
        if over or rest:
            return


def _table(bias: float, order: str) -> np.ndarray:
    """The slot that each code stands for, as raw slots of the file are."""
    table = np.empty(256, np.uint64)
    table[:] = np.frombuffer((np.arange(256, dtype=np.float64) - bias).tobytes(), np.uint64)
    if order == ">":
        table = table.byteswap()
    table[sf.OP_BLANK] = int.from_bytes(b" " * 8, "little")
    table[sf.OP_SYSMIS] = np.array(sf.SYSMIS, np.uint64).byteswap() if order == ">" else sf.SYSMIS
    return table


def _fill(table: np.ndarray, codes: np.ndarray, wanted: np.ndarray, data: np.ndarray) -> np.ndarray:
    out = table[codes]
    out[wanted] = data
    return out


def _pick(table: np.ndarray, codes: np.ndarray, wanted: np.ndarray, data: np.ndarray, slots: int, picked: np.ndarray) -> np.ndarray:
    """The picked slots of whole rows; the values of others are counted, not made."""
    nth = np.cumsum(wanted, dtype=np.int32).reshape(-1, slots)[:, picked]
    mine = wanted.reshape(-1, slots)[:, picked]
    out = table[codes.reshape(-1, slots)[:, picked]]
    out[mine] = data[nth[mine] - 1]
    return out


def decode_bytecode(pieces: Iterator[bytes], bias: float, order: str) -> Iterator[np.ndarray]:
    """The values of a stream, as slots in the machine's byte order."""
    table = _table(bias, order)
    for codes, data in _coded(pieces):
        yield _fill(table, codes, codes == sf.OP_RAW, data)


def plan(d: SavDictionary, limit: int | None, target_bytes: int) -> list[Span]:
    """Cut a file's rows (at most limit) into spans of about target_bytes of data.

    Plain rows are cut by arithmetic. A compressed file that is larger than target_bytes is
    walked once, by its control words only, to find where the rows of a span begin. Where
    spans of target_bytes would be more than MOST_SPANS, they are larger, up to LARGE_SPAN.
    """
    row_bytes = d.slots * 8
    least = lambda size: max(target_bytes, min(LARGE_SPAN, -(-(size if limit is None else min(size, limit * row_bytes)) // MOST_SPANS)))
    if d.compression == "none":
        with open_input(d.path) as source:
            rows = max(0, source.size() - d.data_start) // row_bytes
        rows = rows if limit is None else min(rows, limit)
        step = max(1, least(rows * row_bytes) // row_bytes)
        return [Span(r, min(step, rows - r), d.data_start + r * row_bytes) for r in range(0, rows, step)]
    if limit == 0:
        return []
    with open_input(d.path) as source:
        size = source.size() - d.data_start
        if size <= target_bytes or (limit is not None and limit * row_bytes <= target_bytes):
            return [Span(0, limit, 0)]
        target_bytes = least(int(_zlib_blocks(d, source)[:, 2].sum()) if d.compression == "zlib" else size)
    starts, values, next_row = [], 0, 0
    for words, controls, place, _ in _groups(stream(d)):
        codes = words.view("<u8").ravel()[controls]
        ended = np.flatnonzero(codes.view(np.uint8) == sf.OP_END) // 8
        if len(ended):
            codes = codes[: ended[0] + 1]
        # Codes for skipping are zero.
        upto = values + np.cumsum(8 - zero_bytes(codes).astype(np.int64))
        at = place + controls[: len(codes)] * 8
        while next_row * d.slots < upto[-1] and (limit is None or next_row < limit):
            k = int(np.searchsorted(upto, next_row * d.slots, side="right"))
            before = int(upto[k - 1]) if k else values
            if starts and at[k] - starts[-1].at < target_bytes:
                # The first row that begins a target beyond the last start.
                k = int(np.searchsorted(at, starts[-1].at + target_bytes))
                if k >= len(at):
                    break
                next_row = -(-int(upto[k - 1] if k else values) // d.slots)
                continue
            starts.append(Span(next_row, None, int(at[k]), next_row * d.slots - before))
            next_row += 1
        next_row = max(next_row, -(-int(upto[-1]) // d.slots))
        values = int(upto[-1])
        if len(ended) or (limit is not None and next_row >= limit):
            break
    out = []
    for k, s in enumerate(starts):
        end = starts[k + 1].first_row if k + 1 < len(starts) else limit
        until = starts[k + 1].at + GROUP_BYTES if k + 1 < len(starts) else None
        out.append(Span(s.first_row, None if end is None else end - s.first_row, s.at, s.skip, until))
    return out


def read_slots(d: SavDictionary, span: Span, batch_rows: int, picked: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Matrices (batch_rows, slots) of a span's rows, the last one shorter; a row that isn't whole is dropped.

    picked: the only slots wanted, in ascending order. A plain file's rows come whole anyway.
    """
    if d.compression == "none":
        with open_input(d.path) as source:
            source.seek(span.at)
            left = span.rows
            while left:
                raw = source.read(min(left, batch_rows) * d.slots * 8)
                rows = len(raw) // (d.slots * 8)
                if not rows:
                    return
                yield np.frombuffer(raw, "<u8", rows * d.slots).reshape(rows, d.slots)
                left -= rows
        return
    table = _table(d.bias, d.order)
    left, skip = span.rows, span.skip
    held, held_data, cut_short = np.zeros(0, np.uint8), np.zeros(0, np.uint64), None
    coded = _coded(stream(d, span.at, span.until))
    while left is None or left:
        try:
            codes, data = next(coded, (None, None))
        except SavError as e:
            # What is whole before the fault is given, then it is reported.
            codes, data, cut_short = None, None, e
        over = codes is None
        if over:
            codes, data = held[:0], held_data[:0]
        if skip:
            cut = min(skip, len(codes))
            data = data[np.count_nonzero(codes[:cut] == sf.OP_RAW) :]
            codes, skip = codes[cut:], skip - cut
        if len(held):
            codes, data = np.concatenate([held, codes]), np.concatenate([held_data, data])
        rows = len(codes) // d.slots if left is None else min(len(codes) // d.slots, left)
        if not over and rows != left:
            rows -= rows % batch_rows
        used = 0
        for at in range(0, rows, batch_rows):
            n = min(batch_rows, rows - at)
            part = codes[at * d.slots : (at + n) * d.slots]
            wanted = part == sf.OP_RAW
            mine = data[used : used + int(np.count_nonzero(wanted))]
            used += len(mine)
            yield _fill(table, part, wanted, mine).reshape(n, d.slots) if picked is None else _pick(table, part, wanted, mine, d.slots, picked)
        held, held_data = codes[rows * d.slots :], data[used:]
        if left is not None:
            left -= rows
        if over:
            if cut_short and (left is None or left):
                raise cut_short
            return
