"""`spark.read.format("sav")`: system files as a batch and as a streaming source."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quadrat.runtime import ship
from quadrat.sources.codec import LARGE_SPAN, Span, plan, read_slots
from quadrat.sources.columns import packed, to_batch
from quadrat.sources.dictionary import SavDictionary, read_dictionary
from quadrat.sources.filters import OPERATORS, Test, passing
from quadrat.sources.sav_format import SavError
from quadrat.sources.storage import list_files

BATCH_ROWS = 100_000
#: Slot bytes of a batch, so that wide rows come in fewer.
BATCH_BYTES = 16 << 20
PARTITION_BYTES = LARGE_SPAN


class SavPartition(InputPartition):
    """Rows of one file, and the number of its first row over all files."""

    def __init__(self, path: str, span: Span, base: int):
        super().__init__((path, span.first_row))
        self.path, self.span, self.base = path, span, base


class SavOptions:
    """path, columns (JSON list of names), nRows, batchSize, partitionBytes, rowIndexName, rowIndexOffset, where.

    where is a JSON list of tests [column, operator, value]; rows for which one isn't true are
    left out after nRows and row numbers.
    """

    def __init__(self, options: dict[str, str]):
        low = {k.lower(): v for k, v in options.items()}
        if "path" not in low:
            raise SavError("the sav source needs a path")
        self.path = low["path"]
        self.columns: list[str] | None = json.loads(low["columns"]) if low.get("columns") else None
        self.rows = int(low["nrows"]) if low.get("nrows") is not None else None
        self.batch = max(1, int(low.get("batchsize", BATCH_ROWS)))
        self.target = max(1, int(low.get("partitionbytes", PARTITION_BYTES)))
        self.index = low.get("rowindexname")
        self.offset = int(low.get("rowindexoffset", 0))
        self.where: list[Test] = [tuple(t) for t in json.loads(low["where"])] if low.get("where") else []
        for _, op, _ in self.where:
            if op not in OPERATORS:
                raise ValueError(f"no test is called {op}")
        if self.offset < 0:
            raise ValueError("row_index_offset cannot be negative")
        if self.rows is not None and self.rows < 0:
            raise ValueError("nRows cannot be negative")

    def files(self) -> list[str]:
        found = list_files(self.path)
        if not found:
            raise FileNotFoundError(f"no system files at {self.path}")
        return found

    def fields(self, d: SavDictionary) -> T.StructType:
        names = self.columns or [v.name for v in d.variables]
        if len(set(names)) != len(names):
            raise ValueError("a column is named twice")
        if self.index in names:
            raise ValueError(f"the row index {self.index} is also a column")
        index = [T.StructField(self.index, T.LongType(), True)] if self.index else []
        return T.StructType(index + [v.field for v in d.pick(names)])


class _Decoder:
    def __init__(self, options: SavOptions, schema: T.StructType):
        self.options, self.schema = options, schema
        self.names = [n for n in schema.fieldNames() if n != options.index]
        self.cached: dict[str, SavDictionary] = {}
        self.tested = [n for n in dict.fromkeys(t[0] for t in options.where) if n not in self.names]

    def dictionary(self, path: str) -> SavDictionary:
        """A file's dictionary, in which the columns have the types that are asked for."""
        if path not in self.cached:
            d = read_dictionary(path)
            for v in d.pick(self.names):
                if v.field.dataType != self.schema[v.name].dataType:
                    raise SavError(f"{v.name} is {v.field.dataType.simpleString()} in {path}, not {self.schema[v.name].dataType.simpleString()}")
            self.cached = {path: d}
        return self.cached[path]

    def spans(self, path: str, limit: int | None) -> list[Span]:
        return plan(self.dictionary(path), limit, self.options.target)

    def decode(self, part: SavPartition) -> Iterator[pa.RecordBatch]:
        d, o = self.dictionary(part.path), self.options
        names = [*self.names, *self.tested]
        columns, picked = d.pick(names), None
        if d.compression != "none":
            columns, picked = packed(columns, d.slots)
        by_name = dict(zip(names, columns, strict=True))
        row = part.base + part.span.first_row + o.offset
        for slots in read_slots(d, part.span, max(1, min(o.batch, BATCH_BYTES // (d.slots * 8))), picked):
            numbers = np.arange(row, row + len(slots), dtype=np.int64)
            row += len(slots)
            done: dict[str, pa.Array] = {}
            if o.where:
                # The columns of tests first; of the others only the rows that pass are made.
                used = list(dict.fromkeys(t[0] for t in o.where))
                done = dict(zip(used, to_batch(slots, d, [by_name[n] for n in used]), strict=True))
                kept = passing(o.where, done)
                if not kept.all():
                    slots, numbers, keep = slots[kept], numbers[kept], pa.array(kept)
                    done = {n: a.filter(keep) for n, a in done.items()}
                if not len(slots):
                    continue
            rest = [n for n in self.names if n not in done]
            arrays = done | dict(zip(rest, to_batch(slots, d, [by_name[n] for n in rest]), strict=True))
            if o.index:
                arrays[o.index] = pa.array(numbers)
            names = self.schema.fieldNames()
            if names:
                yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names)


def _count(d: _Decoder, path: str, spans: list[Span]) -> int:
    """The rows of a file, decoding what of it has no known end."""
    if not spans or spans[-1].rows is not None and d.dictionary(path).compression == "none":
        return sum(s.rows for s in spans)
    last = spans[-1]
    return last.first_row + sum(len(s) for s in read_slots(d.dictionary(path), last, BATCH_ROWS))


class SavReader(DataSourceReader):
    def __init__(self, options: SavOptions, schema: T.StructType):
        self.decoder, self.options = _Decoder(options, schema), options

    def partitions(self) -> list[SavPartition]:
        o, out, base = self.options, [], 0
        files = o.files()
        for path in files:
            left = None if o.rows is None else o.rows - base
            spans = [] if left == 0 else self.decoder.spans(path, left)
            out += [SavPartition(path, s, base) for s in spans]
            if len(files) > 1 and (o.rows is not None or o.index):
                base += _count(self.decoder, path, spans)
        return out or [SavPartition(files[0], Span(0, 0, 0), 0)]

    def read(self, partition: SavPartition) -> Iterator[pa.RecordBatch]:
        if partition.span.rows == 0:
            return iter(())
        return self.decoder.decode(partition)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All rows in this process: nothing is cut, so that only a file's last batch is shorter."""
        self.options.target = sys.maxsize
        return chain.from_iterable(map(self.read, self.partitions()))


def _digest(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()[:16]


class SavStreamReader(DataSourceStreamReader):
    """Files of a folder as a stream: each is read once, when it is there.

    An offset is the names of the files that have been read, as digests of 8 bytes, so that a
    file may come late under a name that sorts before others.
    """

    def __init__(self, options: SavOptions, schema: T.StructType):
        self.decoder, self.options = _Decoder(options, schema), options

    def initialOffset(self) -> dict:
        return {"seen": []}

    def latestOffset(self) -> dict:
        return {"seen": sorted(map(_digest, list_files(self.options.path)))}

    def partitions(self, start: dict, end: dict) -> list[SavPartition]:
        seen, there = set(start["seen"]), set(end["seen"])
        new = [f for f in list_files(self.options.path) if _digest(f) in there and _digest(f) not in seen]
        return [SavPartition(f, s, 0) for f in new for s in self.decoder.spans(f, self.options.rows)]

    def read(self, partition: SavPartition) -> Iterator[pa.RecordBatch]:
        return self.decoder.decode(partition)


class SavDataSource(DataSource):
    """Format name `sav`; reads .sav and .zsav files, a folder or a pattern of them."""

    @classmethod
    def name(cls) -> str:
        return "sav"

    def schema(self) -> T.StructType:
        o = SavOptions(self.options)
        return o.fields(read_dictionary(o.files()[0]))

    def reader(self, schema: T.StructType) -> SavReader:
        return SavReader(SavOptions(self.options), schema)

    def streamReader(self, schema: T.StructType) -> SavStreamReader:
        return SavStreamReader(SavOptions(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; may be called again."""
    ship(spark)
    spark.dataSource.register(SavDataSource)
