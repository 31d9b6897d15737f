"""Writes system files for tests, benchmarks and the registered queries. Not part of the library."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import Any

import numpy as np

SYSMIS = 0xFFEFFFFFFFFFFFFF
CODES = {"none": 0, "bytecode": 1, "zlib": 2}
FORMATS = {"A": 1, "F": 5, "DATE": 20, "TIME": 21, "DATETIME": 22, "ADATE": 23, "DTIME": 25, "WKDAY": 26, "MONTH": 27, "MOYR": 28, "EDATE": 38, "YMDHMS": 41}


@dataclass
class Column:
    """values: numbers (None, NaN as they are; None or masked is system-missing), or str/bytes if width."""

    name: str
    values: Any
    width: int = 0
    format: tuple[str, int, int] | None = None
    label: str | None = None
    labels: dict = field(default_factory=dict)
    missing: tuple[int, list] = (0, [])
    measure: int = 0
    display: int = 8
    align: int = 1
    short: str | None = None


def numbers(values) -> np.ndarray:
    """Doubles as slots; None is system-missing."""
    if isinstance(values, np.ma.MaskedArray):
        raw = values.filled(0).astype("<f8").view("<u8")
        raw[np.ma.getmaskarray(values)] = SYSMIS
        return raw
    if isinstance(values, np.ndarray) and values.dtype.kind in "iuf":
        return values.astype("<f8").view("<u8")
    raw = np.array([np.nan if v is None else float(v) for v in values], "<f8").view("<u8").copy()
    raw[np.array([v is None for v in values], bool)] = SYSMIS
    return raw


def _raw(v: Any, charset: str) -> bytes:
    return v if isinstance(v, bytes) else (v or "").encode(charset)


def segments(width: int) -> list[int]:
    """Declared widths of the records of a string."""
    if width <= 255:
        return [width]
    n = -(-width // 252)
    return [255] * (n - 1) + [width - 252 * (n - 1)]


def string_slots(values, width: int, charset: str) -> np.ndarray:
    """(rows, slots) of a string column, all segments."""
    parts = []
    data = [_raw(v, charset) for v in values]
    at = 0
    pieces = segments(width)
    for k, w in enumerate(pieces):
        size = 256 if len(pieces) > 1 and k < len(pieces) - 1 else -(-w // 8) * 8
        useful = 255 if len(pieces) > 1 else w
        body = b"".join(d[at : at + min(useful, size)].ljust(size, b" ") for d in data)
        parts.append(np.frombuffer(body, "<u8").reshape(len(data), size // 8))
        at += useful
    return np.concatenate(parts, 1)


def bytecode(slots: np.ndarray, bias: float, stored: np.ndarray) -> bytes:
    """Control words of eight codes, each followed by its raw words; padded with code 0.

    stored: slots in the file's byte order.
    """
    values = slots.ravel()
    x = values.view("<f8")
    with np.errstate(invalid="ignore"):
        whole = (x >= 1 - bias) & (x <= 251 - bias) & (x == np.floor(x)) & ~((x == 0) & np.signbit(x))
    codes = np.full(len(values), 253, np.uint8)
    codes[whole] = (x[whole] + bias).astype(np.uint8)
    codes[values == int.from_bytes(b" " * 8, "little")] = 254
    codes[values == SYSMIS] = 255
    padded = np.zeros(-(-len(codes) // 8) * 8, np.uint8)
    padded[: len(codes)] = codes
    groups = padded.reshape(-1, 8)
    counts = (groups == 253).sum(1)
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.zeros(starts[-1], "<u8")
    out[starts[:-1]] = groups.view("<u8").ravel()
    spots = np.ones(len(out), bool)
    spots[starts[:-1]] = False
    out[spots] = stored.ravel()[codes == 253]
    return out.tobytes()


def slot_places(columns: list[Column]) -> tuple[dict[str, int], int]:
    """The first slot of each column, and the slots of a row."""
    place, at = {}, 0
    for c in columns:
        place[c.name] = at
        pieces = segments(c.width) if c.width else [0]
        at += 32 * (len(pieces) - 1) + max(1, -(-pieces[-1] // 8))
    return place, at


def slot_matrix(columns: list[Column], charset: str) -> np.ndarray:
    """The columns' rows as slots in the machine's byte order."""
    return np.ascontiguousarray(np.concatenate([string_slots(c.values, c.width, charset) if c.width else numbers(c.values)[:, None] for c in columns], 1))


def head(
    columns: list[Column],
    compression: str,
    rows: int,
    *,
    charset: str = "utf-8",
    charset_name: str | None = "UTF-8",
    code_page: int | None = 65001,
    order: str = "<",
    bias: float = 100.0,
    label: str = "",
    notes: tuple[str, ...] = (),
    mr_sets: str = "",
    weight: str | None = None,
    long_labels: dict[str, dict[str, str]] | None = None,
    long_missing: dict[str, list[str]] | None = None,
    display: str | None = "triples",
    long_names: bool = True,
    stamp: tuple[str, str] = ("01 Jan 24", "14:30:00"),
) -> bytes:
    """All of a file that comes before its data; the columns' values aren't looked at."""
    pack = lambda layout, *x: struct.pack(order + layout, *x)
    place, slots = slot_places(columns)
    records, names, lengths, shown, label_records = [], [], [], [], []
    for k, c in enumerate(columns):
        short = (c.short or f"V{k + 1}").upper()
        names.append(f"{short}={c.name}")
        if c.width > 255:
            lengths.append(f"{short}={c.width}")
        form = c.format or (("A", min(c.width, 255), 0) if c.width else ("F", 8, 2))
        packed = FORMATS[form[0]] << 16 | form[1] << 8 | form[2]
        for s, w in enumerate(segments(c.width) if c.width else [0]):
            first = s == 0
            text = c.label.encode(charset) if c.label and first else b""
            n, values = c.missing if first else (0, [])
            body = pack("6i", 2, w, bool(text), n, packed, packed) + (short if first else f"{short[:5]}Z{s:X}"[:8]).encode().ljust(8)
            if text:
                body += pack("i", len(text)) + text.ljust(-(-len(text) // 4) * 4)
            body += b"".join(v.encode(charset).ljust(8) if isinstance(v, str) else pack("d", v) for v in values)
            records.append(body)
            shown += [c.measure, c.display, c.align]
            used = max(1, 32 if c.width > 255 and s < len(segments(c.width)) - 1 else -(-w // 8))
            records += [pack("6i", 2, -1, 0, 0, packed, packed) + b" " * 8] * (used - 1)
        if c.labels:
            body = pack("2i", 3, len(c.labels))
            for value, text in c.labels.items():
                raw = text.encode(charset)
                body += value.encode(charset).ljust(8) if isinstance(value, str) else pack("d", value)
                body += (bytes([len(raw)]) + raw).ljust(-(-(len(raw) + 1) // 8) * 8)
            label_records.append(body + pack("3i", 4, 1, place[c.name] + 1))
    info = lambda subtype, size, raw: pack("4i", 7, subtype, size, len(raw) // size) + raw
    parts = records + label_records
    if notes:
        parts.append(pack("2i", 6, len(notes)) + b"".join(n.encode(charset).ljust(80)[:80] for n in notes))
    if code_page is not None:
        parts.append(info(3, 4, pack("8i", 1, 0, 0, 0, 1, 1, 2, code_page)))
    parts.append(info(4, 8, struct.pack(order + "Q", SYSMIS) + pack("2d", 1.7e308, -1.7e308)))
    if mr_sets:
        parts.append(info(7, 1, mr_sets.encode(charset)))
    if display == "triples":
        parts.append(info(11, 4, pack(f"{len(shown)}i", *shown)))
    elif display == "pairs":
        both = [x for i, x in enumerate(shown) if i % 3 != 1]
        parts.append(info(11, 4, pack(f"{len(both)}i", *both)))
    if long_names:
        parts.append(info(13, 1, "\t".join(names).encode(charset)))
    if lengths:
        parts.append(info(14, 1, "".join(f"{x}\0\t" for x in lengths).encode()))
    if charset_name is not None:
        parts.append(info(20, 1, charset_name.encode()))
    counted = lambda raw: pack("i", len(raw)) + raw
    if long_labels:
        parts.append(info(21, 1, b"".join(counted(v.encode(charset)) + pack("i", len(found)) + b"".join(counted(a.encode(charset)) + counted(b.encode(charset)) for a, b in found.items()) for v, found in long_labels.items())))
    if long_missing:
        parts.append(info(22, 1, b"".join(counted(v.encode(charset)) + bytes([len(found)]) + pack("i", 8) + b"".join(x.encode(charset).ljust(8)[:8] for x in found) for v, found in long_missing.items())))
    parts.append(info(99, 1, b"unknown records are skipped"))
    parts.append(pack("2i", 999, 0))

    first = (b"$FL3" if compression == "zlib" else b"$FL2") + b"@(#) SPSS DATA FILE quadrat".ljust(60)
    first += pack("5id", 2, slots, CODES[compression], place[weight] + 1 if weight else 0, rows, bias)
    first += stamp[0].encode().ljust(9) + stamp[1].encode().ljust(8) + label.encode(charset).ljust(64) + b"\0" * 3
    return first + b"".join(parts)


def zlib_frame(start: int, sizes: list[tuple[int, int]], block: int, order: str = "<", bias: float = 100.0) -> tuple[bytes, bytes]:
    """What comes before and after the zlib blocks, of these sizes full and packed, of a file whose data starts at start."""
    pack = lambda layout, *x: struct.pack(order + layout, *x)
    parts, full, packed = [pack("2q2i", -int(bias), 0, block, len(sizes))], start, start + 24
    for c, z in sizes:
        parts.append(pack("2q2i", full, packed, c, z))
        full, packed = full + c, packed + z
    return pack("3q", start, packed, 24 + 24 * len(sizes)), b"".join(parts)


def write_sav(path: str, columns: list[Column], compression: str = "none", *, charset: str = "utf-8", order: str = "<", bias: float = 100.0, ncases: int | None = None, block: int = 1 << 18, tail: bytes = b"", **how) -> None:
    """A whole file of columns in memory; how as of head()."""
    rows = len(columns[0].values)
    place, size = slot_places(columns)
    slots = slot_matrix(columns, charset) if rows else np.zeros((0, size), "<u8")
    stored = slots
    if order == ">":
        numeric = [place[c.name] for c in columns if not c.width]
        stored = slots.copy()
        stored[:, numeric] = slots[:, numeric].byteswap()
    with open(path, "wb") as out:
        out.write(head(columns, compression, rows if ncases is None else ncases, charset=charset, order=order, bias=bias, **how))
        if compression == "none":
            out.write(stored.tobytes())
        elif compression == "bytecode":
            out.write(bytecode(slots, bias, stored))
        else:
            raw = bytecode(slots, bias, stored)
            chunks = [raw[i : i + block] for i in range(0, len(raw), block)]
            zipped = [zlib.compress(c, 1) for c in chunks]
            before, after = zlib_frame(out.tell(), [(len(c), len(z)) for c, z in zip(chunks, zipped, strict=True)], block, order, bias)
            out.write(before + b"".join(zipped) + after)
        out.write(tail)
