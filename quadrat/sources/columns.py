"""Slots to Arrow columns."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quadrat.sources import charset as cs
from quadrat.sources import sav_format as sf
from quadrat.sources.dictionary import SavDictionary, Variable, slot_count

ARROW = {"double": pa.float64(), "date": pa.date32(), "timestamp": pa.timestamp("us"), "duration": pa.duration("us"), "string": pa.string()}


def whole(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Towards zero, to the nearest of low and high beyond them, 0 for NaN."""
    x = np.where(np.isnan(x), 0.0, x)
    out = np.empty(len(x), np.int64)
    inside = (x > low) & (x < high)
    out[inside] = np.trunc(x[inside]).astype(np.int64)
    out[x <= low] = low
    out[x >= high] = high
    return out


def numeric(slots: np.ndarray, kind: str, order: str) -> pa.Array:
    """A numeric variable's column from its slots; system-missing is null, NaN isn't."""
    slots = np.ascontiguousarray(slots)
    if order == ">":
        slots = slots.byteswap()
    missing = slots == np.uint64(sf.SYSMIS)
    missing = missing if missing.any() else None
    x = slots.view(np.float64)
    if kind == "double":
        return pa.array(x, ARROW[kind], mask=missing, from_pandas=False)
    if missing is not None:
        x = np.where(missing, 0.0, x)
    with np.errstate(over="ignore", invalid="ignore"):
        if kind == "date":
            days = whole(x / 86400 - sf.EPOCH_DAYS, -(1 << 31), (1 << 31) - 1).astype(np.int32)
            return pa.array(days, pa.int32(), mask=missing).cast(pa.date32())
        micros = whole((x - sf.EPOCH_SECONDS) * 1e6 if kind == "timestamp" else x * 1e6, -(1 << 63), (1 << 63) - 1)
    return pa.array(micros, pa.int64(), mask=missing).cast(ARROW[kind])


def byte_slices(v: Variable) -> list[tuple[int, int]]:
    """(first byte in the row, bytes) of the pieces of a string variable."""
    if v.width <= sf.SEGMENT_BYTES:
        return [(v.slot * 8, v.width)]
    out, left, slot = [], v.width, v.slot
    while left > 0:
        out.append((slot * 8, min(left, sf.SEGMENT_BYTES)))
        left -= sf.SEGMENT_BYTES
        slot += sf.SEGMENT_SLOTS
    return out


def string(rows: np.ndarray, v: Variable, charset: str) -> pa.Array:
    """A string variable's column from the rows' bytes: padding cut off, never null."""
    pieces = [rows[:, at : at + n] for at, n in byte_slices(v)]
    raw = np.ascontiguousarray(pieces[0] if len(pieces) == 1 else np.concatenate(pieces, 1))
    n, width = raw.shape
    plain = cs.extends_ascii(charset) and (raw.max(initial=0) < 128)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(raw)])
    binary = fixed.cast(pa.binary())
    text = pa.StringArray.from_buffers(n, binary.buffers()[1], binary.buffers()[2])
    text = pc.ascii_rtrim(text, " \0")
    if plain:
        return text
    bare = pa.Array.from_buffers(pa.binary(), n, text.buffers(), offset=text.offset)
    if charset == "UTF-8":
        try:
            return bare.cast(pa.string())
        except pa.ArrowInvalid:
            pass
    coded = bare.dictionary_encode()
    decoded = pa.array([cs.decode(b, charset) for b in coded.dictionary.to_pylist()], pa.string())
    return decoded.take(coded.indices)


def packed(columns: list[Variable], slots: int) -> tuple[list[Variable], np.ndarray | None]:
    """The variables as they lie in rows of only their own slots, and these slots; None if that is all."""
    sizes = {v.slot: slot_count(v.width) for v in columns}
    starts = sorted(sizes)
    picked = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, s + sizes[s]) for s in starts)])
    if len(picked) >= slots:
        return columns, None
    place = dict(zip(starts, np.cumsum([0, *(sizes[s] for s in starts)]).tolist(), strict=False))
    return [replace(v, slot=place[v.slot]) for v in columns], picked


def to_batch(slots: np.ndarray, d: SavDictionary, columns: list[Variable]) -> list[pa.Array]:
    rows = np.ascontiguousarray(slots).view(np.uint8).reshape(len(slots), -1)
    return [string(rows, v, d.charset) if v.kind == "string" else numeric(slots[:, v.slot], v.kind, d.order) for v in columns]
