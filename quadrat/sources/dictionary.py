"""The dictionary of a system file: records as they come, then what they mean together."""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from quadrat.metadata import SpssMetadata
from quadrat.sources import charset as cs
from quadrat.sources import sav_format as sf
from quadrat.sources.sav_format import Format, InvalidVariable, SavError
from quadrat.sources.storage import open_input

SPARK_TYPES = {"double": T.DoubleType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "duration": T.DayTimeIntervalType(), "string": T.StringType()}
TYPE_NAMES = {"double": "f64", "date": "Date32", "timestamp": "Timestamp[us]", "duration": "Duration[us]", "string": "String"}
PADDING = b" \0"


@dataclass(frozen=True)
class Variable:
    """A visible column: where its slots begin, and how they are read."""

    name: str
    slot: int
    kind: str  # double, date, timestamp, duration or string
    width: int = 0  # bytes of a string
    metadata: str = "{}"

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, SPARK_TYPES[self.kind], True, json.loads(self.metadata))


@dataclass(frozen=True)
class FloatInfo:
    """What a file says of its special numbers: system-missing, and the ends of open ranges."""

    sysmis: float
    highest: float
    lowest: float


@dataclass(frozen=True)
class SavDictionary:
    """All that is needed to read a file's data, and its metadata."""

    path: str
    order: str  # < or >
    compression: str
    bias: float
    slots: int
    data_start: int
    charset: str
    variables: tuple[Variable, ...]
    metadata: SpssMetadata
    float_info: FloatInfo | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([v.field for v in self.variables])

    def pick(self, names: list[str]) -> list[Variable]:
        known = {v.name: v for v in self.variables}
        for name in names:
            if name not in known:
                raise InvalidVariable(f"column not found: {name}")
        return [known[n] for n in names]


class _Cursor:
    def __init__(self, source: Any, order: str = "<"):
        self.source, self.order = source, order

    def take(self, n: int) -> bytes:
        if n < 0:
            raise SavError(f"a record has the length {n}")
        raw = self.source.read(n)
        if len(raw) < n:
            raise SavError("the file ends within its dictionary")
        return raw

    def unpack(self, layout: str) -> tuple:
        return struct.unpack(self.order + layout, self.take(struct.calcsize(self.order + layout)))

    def int(self) -> int:
        return self.unpack("i")[0]


@dataclass
class _Raw:
    """The records of a file, before they are brought together."""

    order: str = "<"
    variables: list[_Slot] = field(default_factory=list)
    label_sets: list[tuple[list[tuple[bytes, bytes]], list[int]]] = field(default_factory=list)
    notes: list[bytes] = field(default_factory=list)
    info: dict[int, bytes] = field(default_factory=dict)


@dataclass
class _Slot:
    """A type 2 record: the beginning of a variable, or the continuation of one."""

    raw_type: int
    short: bytes
    label: bytes | None
    missing: tuple[int, list[bytes]]
    print: int

    @property
    def named(self) -> bool:
        return self.raw_type >= 0


def _variable(c: _Cursor) -> _Slot:
    raw_type, has_label, n_missing, shown, _ = c.unpack("5i")
    short = c.take(8)
    label = None
    if has_label == 1:
        size = c.int()
        label = c.take(sf.round_up(size, 4))[:size]
    return _Slot(raw_type, short, label, (n_missing, [c.take(8) for _ in range(abs(n_missing))]), shown)


def _labels(c: _Cursor) -> tuple[list[tuple[bytes, bytes]], list[int]]:
    found = []
    for _ in range(c.int()):
        value = c.take(8)
        size = c.take(1)[0]
        found.append((value, c.take(sf.round_up(size + 1, 8) - 1)[:size]))
    if (kind := c.int()) != 4:
        raise SavError(f"a value label record is followed by a record of type {kind}, not 4")
    count = c.int()
    if count < 1:
        raise SavError(f"value labels for {count} variables")
    slots = [i - 1 for i in c.unpack(f"{count}i")]
    if min(slots) < 0:
        raise SavError(f"value labels for variable {min(slots) + 1}")
    return found, slots


def _records(c: _Cursor) -> _Raw:
    raw = _Raw(c.order)
    while (kind := c.int()) != 999:
        if kind == 2:
            raw.variables.append(_variable(c))
        elif kind == 3:
            raw.label_sets.append(_labels(c))
        elif kind == 6:
            raw.notes += [c.take(80) for _ in range(c.int())]
        elif kind == 7:
            subtype, size, count = c.unpack("3i")
            if size < 0 or count < 0:
                raise SavError(f"info record {subtype} has {count} elements of {size} bytes")
            raw.info[subtype] = c.take(size * count)
        else:
            raise SavError(f"unknown record type {kind}")
    c.int()  # filler
    return raw


class _Pieces:
    """Length-prefixed pieces of an info record; ends where the record does."""

    def __init__(self, raw: bytes, order: str):
        self.raw, self.order, self.at = raw, order, 0

    def int(self) -> int | None:
        got = self.bytes(4)
        return None if got is None else struct.unpack(self.order + "i", got)[0]

    def bytes(self, n: int | None) -> bytes | None:
        if n is None or n < 0 or self.at + n > len(self.raw):
            self.at = len(self.raw) + 1
            return None
        self.at += n
        return self.raw[self.at - n : self.at]

    def counted(self) -> bytes | None:
        return self.bytes(self.int())


def parse_mr_sets(text: str) -> list[dict]:
    """`$name=D<n> <counted value> <n> <label> names` or `$name=C <n> <label> names`, a line each."""
    number = re.compile(r"\d+")
    found = []

    def counted(rest: str) -> tuple[str, str] | None:
        m = number.match(rest)
        if not m:
            return None
        rest = rest[m.end() :].removeprefix(" ")
        return rest[: int(m[0])], rest[int(m[0]) :] if len(rest) >= int(m[0]) else "\0"

    for line in text.split("\n"):
        line = line.strip("\0").strip()
        name, eq, rest = line.removeprefix("$").partition("=")
        if not line.startswith("$") or not eq or rest[:1] not in ("D", "E", "C") or not rest:
            continue
        dichotomy, rest, value = rest[0] != "C", rest[1:], None
        if dichotomy:
            got = counted(rest)
            if got is None or got[1] == "\0":
                continue
            value, rest = got
        got = counted(rest.lstrip())
        if got is None:
            continue
        label, names = got
        short = names == "\0"
        found.append({"name": name, "label": label.strip() if short else label, "mr_type": "dichotomy" if dichotomy else "category", "counted_value": value, "variables": [] if short else names.split()})
    return found


def _display(raw: _Raw, named: int) -> list[tuple[int, int | None, int]]:
    """(measure, width, alignment) of each named record, from triples or from pairs without width."""
    body = raw.info.get(11, b"")
    values = struct.unpack(f"{raw.order}{len(body) // 4}i", body[: len(body) // 4 * 4])
    if len(values) == 2 * named and len(values) != 3 * named:
        return [(m, 8, a) for m, a in zip(values[::2], values[1::2], strict=True)]
    return list(zip(values[::3], values[1::3], values[2::3], strict=False))


def _missing(slot: _Slot, text, number) -> list[dict]:
    n, values = slot.missing
    if slot.raw_type > 0:
        return [{"type": "string_value", "value": text(v.rstrip(PADDING))} for v in values]
    if n in (-2, -3):
        ranged = [{"type": "range", "low": number(values[0]), "high": number(values[1])}]
        return ranged + [{"type": "value", "value": number(v)} for v in values[2:]]
    return [{"type": "value", "value": number(v)} for v in values]


def _charset(raw: _Raw) -> str:
    if 20 in raw.info:
        return cs.from_label(raw.info[20].decode("latin-1").strip("\0 \t\r\n"))
    if len(raw.info.get(3, b"")) >= 32:
        return cs.from_code_page(struct.unpack(raw.order + "8i", raw.info[3][:32])[7])
    return cs.DEFAULT


def _float_info(raw: _Raw) -> FloatInfo | None:
    body = raw.info.get(4, b"")
    return FloatInfo(*struct.unpack(raw.order + "3d", body[:24])) if len(body) >= 24 else None


def _pairs(text: str, between: str) -> dict[str, str]:
    parts = (p.partition("=") for p in re.split(between, text))
    return {k.strip().upper(): v.strip(" \0") for k, eq, v in parts if eq}


def read_dictionary(path: str) -> SavDictionary:
    """Read header and dictionary of a file; no data is read."""
    with open_input(path) as source:
        head = source.read(sf.HEADER_BYTES)
        if len(head) < sf.HEADER_BYTES or head[:4] not in (sf.MAGIC_PLAIN, sf.MAGIC_ZLIB):
            raise SavError(f"{path} isn't an SPSS system file")
        order = next((o for o in "<>" if struct.unpack(o + "i", head[64:68])[0] in (2, 3)), None)
        if order is None:
            raise SavError("the layout code is neither 2 nor 3 in any byte order")
        slots, compression, weight, cases = struct.unpack(order + "4i", head[68:84])
        if compression not in sf.COMPRESSIONS:
            raise SavError(f"unknown compression {compression}")
        cursor = _Cursor(source, order)
        raw = _records(cursor)
        start = source.tell()
    return _resolve(path, head, raw, slots, sf.COMPRESSIONS[compression], weight, cases, start)


def _resolve(path: str, head: bytes, raw: _Raw, slots: int, compression: str, weight: int, cases: int, start: int) -> SavDictionary:
    order, charset = raw.order, _charset(raw)
    text = lambda b: cs.decode(b, charset)
    trimmed = lambda b: text(b).rstrip(" �")
    number = lambda b: struct.unpack(order + "d", b)[0]
    info = lambda k: text(raw.info.get(k, b""))

    shorts = [text(v.short.rstrip(PADDING)).upper() for v in raw.variables]
    long_names = _pairs(info(13), "\t")
    names = [long_names.get(s) or s for s in shorts]
    widths = {k: int(v) for k, v in _pairs(info(14), "[\0\t]+").items() if v.isdigit()}
    # The later segments of a very long string aren't variables.
    hidden: set[int] = {i for i, v in enumerate(raw.variables) if not v.named}
    for i, short in enumerate(shorts):
        if i not in hidden and short in widths:
            ahead = (j for j in range(i + 1, len(shorts)) if j not in hidden)
            hidden |= {j for j, _ in zip(ahead, range(-(-widths[short] // sf.SEGMENT_WIDTH) - 1), strict=False)}
    named = [i for i, v in enumerate(raw.variables) if v.named]
    shown = dict(zip(named, _display(raw, len(named)), strict=False))

    visible = [i for i in range(len(shorts)) if i not in hidden]
    if len({names[i] for i in visible}) != len(visible):
        raise SavError("two variables have the same name")
    meta: dict[str, Any] = {k: {} for k in ("labelled", "spss_variable_types", "variable_types", "variable_alignment", "variable_storage_width", "variable_display_width", "variable_measure", "variable_missing")}
    kinds: dict[int, tuple[str, int]] = {}
    for i in visible:
        v, name = raw.variables[i], names[i]
        width = widths.get(shorts[i], max(v.raw_type, 0))
        form = Format.unpack(v.print)
        kind = "string" if width else form.kind if form else "double"
        kinds[i] = kind, width
        if label := trimmed(v.label or b""):
            meta["labelled"][name] = label
        if form:
            meta["spss_variable_types"][name] = f"{form.name}{width}" if width > 255 else str(form)
        meta["variable_types"][name] = TYPE_NAMES[kind]
        measure, display, align = shown.get(i, (0, form.width if form else 8, -1))
        meta["variable_measure"][name] = sf.MEASURES.get(measure, "unknown")
        meta["variable_alignment"][name] = sf.ALIGNMENTS.get(align, "unknown")
        meta["variable_display_width"][name] = width if width > 255 and display == 0 else display
        meta["variable_storage_width"][name] = 8 if not width else width if width > 255 else sf.round_up(width, 8)
        if specs := _missing(v, text, number):
            meta["variable_missing"][name] = specs

    by_any = {**{names[i].upper(): names[i] for i in visible}, **{shorts[i]: names[i] for i in visible}}
    labels = _value_labels(raw, visible, names, text, trimmed, number)
    pieces = _Pieces(raw.info.get(21, b""), order)
    while (who := pieces.counted()) is not None:
        count = pieces.int()
        found = {}
        for _ in range(count or 0):
            value, label = pieces.counted(), pieces.counted()
            if label is None:
                break
            found[text(value.rstrip(PADDING))] = trimmed(label)
        name = by_any.get(text(who).strip().upper())
        if found and name:
            labels[name] = found
    pieces = _Pieces(raw.info.get(22, b""), order)
    while (who := pieces.counted()) is not None:
        count, size = pieces.bytes(1), pieces.int()
        values = [pieces.bytes(size) for _ in range(count[0] if count else 0)]
        name = by_any.get(text(who).strip().upper())
        specs = [{"type": "string_value", "value": text(v.rstrip(PADDING))} for v in values if v is not None]
        if specs and name:
            meta["variable_missing"][name] = specs

    by_short = {shorts[i]: names[i] for i in visible}
    sets = {}
    for s in parse_mr_sets(info(7)):
        members = [by_short[m.upper()] for m in s["variables"] if m.upper() in by_short]
        if members:
            sets[s["name"]] = s | {"variables": members}
    metadata = SpssMetadata(
        file_label=text(head[109:173]).rstrip(" \0"),
        file_encoding=charset,
        compression=compression,
        creation_time=text(head[92:101]).rstrip(" \0"),
        modification_time=text(head[101:109]).rstrip(" \0"),
        notes=[text(line.rstrip(PADDING)) for line in raw.notes],
        number_rows=cases if cases >= 0 else None,
        number_columns=len(visible),
        file_format="zsav" if compression == "zlib" else "sav",
        variable_names=[names[i] for i in visible],
        variable_value_labels={names[i]: labels[names[i]] for i in visible if names[i] in labels},
        mr_sets=sets,
        weight_variable=names[weight - 1] if 0 < weight <= len(names) else None,
        **meta,
    )
    variables = tuple(Variable(names[i], i, *kinds[i], column_metadata(metadata, names[i])) for i in visible)
    needed = max((v.slot + slot_count(v.width) for v in variables if v.width), default=0)
    slots = len(raw.variables) if slots <= 0 else slots
    if slots < max(needed, 1 + max((v.slot for v in variables), default=-1)) or not variables:
        raise SavError(f"rows of {slots} slots don't hold the variables")
    return SavDictionary(path, order, compression, number(head[84:92]), slots, start, charset, variables, metadata, _float_info(raw))


def slot_count(width: int) -> int:
    """Slots up to the last byte of a variable of a width; a number has none."""
    if width <= 255:
        return max(1, -(-width // 8))
    full, rest = divmod(width, sf.SEGMENT_BYTES)
    return full * sf.SEGMENT_SLOTS + -(-rest // 8)


def _value_labels(raw: _Raw, visible: list[int], names: list[str], text, trimmed, number) -> dict[str, dict]:
    """Labels by variable; a set is of strings if the first variable it is for is one."""
    found: dict[str, dict] = {}
    shown = set(visible)
    for pairs, slots in raw.label_sets:
        first = slots[0]
        strings = first < len(raw.variables) and raw.variables[first].raw_type > 0
        labels = {text(v.rstrip(PADDING)) if strings else number(v): trimmed(label) for v, label in pairs}
        found |= {names[i]: dict(labels) for i in slots if i in shown}
    return found


def column_metadata(meta: SpssMetadata, name: str) -> str:
    """What a column's schema field says about it, as JSON."""
    out: dict[str, Any] = {"label": meta.labelled.get(name), "format": meta.spss_variable_types.get(name), "measure": meta.variable_measure.get(name)}
    if name in meta.variable_value_labels:
        out["value_labels"] = {str(k): v for k, v in meta.variable_value_labels[name].items()}
    if name in meta.variable_missing:
        out["missing"] = meta.variable_missing[name]
    return json.dumps({k: v for k, v in out.items() if v is not None})

