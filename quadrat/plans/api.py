"""read_sav, scan_sav, read_sav_metadata: system files as DataFrames, with their metadata."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quadrat.metadata import SpssMetadata
from quadrat.runtime import fresh_path, ship
from quadrat.sources.columns import ARROW
from quadrat.sources.datasource import SavOptions, SavReader, register
from quadrat.sources.dictionary import SavDictionary, read_dictionary
from quadrat.sources.filters import OPERATORS, Test
from quadrat.sources.sav_format import InvalidVariable
from quadrat.sources.storage import _system, list_files

#: Bytes of batches that are written together.
GROUP_BYTES = 8 << 20
Columns = Sequence[int] | Sequence[str] | None


def resolve_columns(columns: Columns, names: list[str]) -> list[str]:
    """Names of the columns asked for by name or by place; none asked for: all."""
    if not columns:
        return list(names)
    return [names[c] for c in columns] if isinstance(columns[0], int) else list(columns)


def _scan(spark: SparkSession, path: str | os.PathLike, columns: Columns, n_rows: int | None, row_index_name: str | None, row_index_offset: int, batch_size: int | None, partition_bytes: int | None, where: Sequence[Test]) -> tuple[DataFrame, SpssMetadata]:
    if row_index_offset < 0:
        raise ValueError("row_index_offset cannot be negative")
    register(spark)
    path = os.fspath(path)
    dictionary = read_dictionary(list_files(path)[0])
    names = resolve_columns(columns, [v.name for v in dictionary.variables])
    dictionary.pick(names)
    options = {"columns": json.dumps(names) if columns else None, "nRows": n_rows, "rowIndexName": row_index_name, "rowIndexOffset": row_index_offset or None, "batchSize": batch_size, "partitionBytes": partition_bytes}
    if where:
        dictionary.pick([t[0] for t in where])
        if unknown := {op for _, op, _ in where}.difference(OPERATORS):
            raise ValueError(f"no test is called {unknown.pop()}")
        options["where"] = json.dumps(where, default=str)
    reader = spark.read.format("sav").options(**{k: str(v) for k, v in options.items() if v is not None})
    return reader.load(path), dictionary.metadata


def read_sav(spark: SparkSession, path: str | os.PathLike, *, columns: Columns = None, n_rows: int | None = None, row_index_name: str | None = None, row_index_offset: int = 0, batch_size: int | None = None, partition_bytes: int | None = None, where: Sequence[Test] = ()) -> tuple[DataFrame, SpssMetadata]:
    """A file's rows and metadata.

    columns (names, or places that may be negative) are the only ones decoded, in this order;
    n_rows cuts the scan before any filter; row_index_name adds a first column of contiguous
    row numbers in file order; where has tests (column, operator, value) that all must be true,
    which the scan makes after n_rows and numbering, so that of other rows nothing else is
    decoded (Spark's own pushdown to Python sources is not used: a source that is scanned twice
    with different filters would share them). A name that isn't in the file raises InvalidVariable, an
    IOError. The DataFrame is lazy: nothing but the dictionary is read here.
    """
    return _scan(spark, path, columns, n_rows, row_index_name, row_index_offset, batch_size, partition_bytes, where)


def scan_sav(spark: SparkSession, path: str | os.PathLike, **how) -> tuple[DataFrame, SpssMetadata]:
    """As read_sav; a name that isn't in the file raises KeyError."""
    try:
        return read_sav(spark, path, **how)
    except InvalidVariable as e:
        raise KeyError(str(e)) from e


def read_sav_bytes(spark: SparkSession, raw: bytes, **how) -> tuple[DataFrame, SpssMetadata]:
    """read_sav of a file that is held in memory: it is put in the shared folder first."""
    from pyarrow import fs

    path = fresh_path(spark, "upload") + ".sav"
    system, place = _system(path)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(place.rpartition("/")[0], recursive=True)
    with system.open_output_stream(place) as out:
        out.write(raw)
    return read_sav(spark, path, **how)


def read_sav_dictionary(path: str | os.PathLike) -> SavDictionary:
    return read_dictionary(os.fspath(path))


def read_sav_metadata(path: str | os.PathLike) -> SpssMetadata:
    """A file's metadata; its data isn't read, also if it is compressed."""
    return read_sav_dictionary(path).metadata


def schema_types(df: DataFrame) -> dict[str, str]:
    """Name to Float64, String, Date, Datetime, Duration, or Unknown."""
    names = {"double": "Float64", "string": "String", "date": "Date", "timestamp_ntz": "Datetime"}
    return {n: "Duration" if t.startswith("interval") else names.get(t, "Unknown") for n, t in df.dtypes}


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as a row that holds it as an Arrow stream."""
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])


def iter_batches(df: DataFrame, batch_size: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The rows of df in order, in batches, a partition at a time; they come as Arrow, not row by row."""
    ship(df.sparkSession)
    schema = to_arrow_schema(df.schema)
    held = schema.empty_table()
    for row in df.mapInArrow(_as_bytes, "batch binary").toLocalIterator(prefetchPartitions=True):
        held = pa.concat_tables([held, pa.ipc.open_stream(row["batch"]).read_all().cast(schema)])
        for at in range(0, held.num_rows - batch_size + 1, batch_size):
            yield held.slice(at, batch_size).combine_chunks().to_batches()[0]
        held = held.slice(held.num_rows // batch_size * batch_size)
    if held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def to_arrow(df: DataFrame) -> pa.Table:
    """The rows of df in order as one table, whose buffers lie in a mapped file and not in memory.

    The file is in this process's temporary folder and goes with the table.
    """
    file, path = tempfile.mkstemp(suffix=".arrow")
    os.close(file)
    try:
        with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, to_arrow_schema(df.schema)) as out:
            for batch in iter_batches(df):
                out.write_batch(batch)
        return pa.ipc.open_file(pa.memory_map(path)).read_all()
    finally:
        os.unlink(path)


def from_arrow(spark: SparkSession, batches: Iterable[pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """Batches as a DataFrame; they are written to the shared folder as they come, and not held."""
    path = fresh_path(spark, "arrow")
    system, place = _system(path)
    system.create_dir(place, recursive=True)
    arrow = to_arrow_schema(schema)
    held, size = [], 0
    with system.open_output_stream(f"{place}/part-0.parquet") as sink, pq.ParquetWriter(sink, arrow) as out:
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP_BYTES:
                out.write_table(pa.Table.from_batches(held, arrow))
                held, size = [], 0
        if held:
            out.write_table(pa.Table.from_batches(held, arrow))
    return spark.read.schema(schema).parquet(path)


class SavBatchReader:
    """One file's rows as Arrow batches in this process, a batch in memory at a time.

    select() and limit() hold from the next batch on and may be called before the first one.
    """

    def __init__(self, path: str | os.PathLike, batch_size: int | None = None, columns: Columns = None, n_rows: int | None = None):
        self.path, self.dictionary = os.fspath(path), read_dictionary(os.fspath(path))
        self.batch_size, self.names, self.n_rows = batch_size, resolve_columns(columns, [v.name for v in self.dictionary.variables]), n_rows
        self.dictionary.pick(self.names)
        self.rows_read = 0
        self._batches: Iterator[pa.RecordBatch] | None = None

    @property
    def metadata(self) -> SpssMetadata:
        return self.dictionary.metadata

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([(v.name, ARROW[v.kind]) for v in self.dictionary.pick(self.names)])

    def _before_reading(self) -> None:
        if self._batches is not None:
            raise ValueError("batches have been read already")

    def select(self, columns: Columns) -> SavBatchReader:
        self._before_reading()
        names = resolve_columns(columns, [v.name for v in self.dictionary.variables])
        self.dictionary.pick(names)
        self.names = names
        return self

    def limit(self, n_rows: int | None) -> SavBatchReader:
        self._before_reading()
        self.n_rows = n_rows
        return self

    def next_batch(self) -> pa.RecordBatch | None:
        """The next rows; None at the end or at the limit."""
        if self._batches is None:
            options = {"path": self.path, "columns": json.dumps(self.names), "nRows": self.n_rows, "batchSize": self.batch_size}
            chosen = SavOptions({k: str(v) for k, v in options.items() if v is not None})
            fields = T.StructType([v.field for v in self.dictionary.pick(self.names)])
            self._batches = SavReader(chosen, fields).batches()
        batch = next(self._batches, None)
        self.rows_read += 0 if batch is None else batch.num_rows
        return batch

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        return iter(self.next_batch, None)

    def collect_all(self) -> list[pa.RecordBatch]:
        """All batches that are left."""
        return list(self)

    def collect_single(self) -> pa.RecordBatch:
        """All rows that are left as one batch; an empty one with the schema if there are none."""
        found = pa.Table.from_batches(self.collect_all(), self.schema).combine_chunks().to_batches()
        return found[0] if found else pa.RecordBatch.from_pylist([], self.schema)


def _needed(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of a scan that df needs, by its optimized plan."""
    attributes = lambda seq: {seq.apply(i).toString(): seq.apply(i).name() for i in range(seq.size())}
    wanted: set[str] = set()

    def walk(node, above: dict[str, str]) -> None:
        children = node.children()
        if children.isEmpty():
            wanted.update(n for key, n in attributes(node.output()).items() if key in above)
            return
        own = attributes(node.references().toSeq())
        below = own if node.nodeName() in ("Project", "Aggregate") else above | own
        for i in range(children.size()):
            walk(children.apply(i), below)

    plan = df._jdf.queryExecution().optimizedPlan()
    walk(plan, attributes(plan.output()))
    return [n for n in names if n in wanted]


def scan_pruned(spark: SparkSession, path: str | os.PathLike, then: Callable[[DataFrame], DataFrame], **how) -> tuple[DataFrame, SpssMetadata]:
    """then(scan), of which only the columns are decoded that then's plan needs, and the metadata.

    Spark doesn't tell a Python source which columns a later select keeps, so the plan over all
    columns is asked, and the scan made anew. then builds a plan and runs nothing. Where the
    plan doesn't show what it needs, all columns are decoded.
    """
    df, meta = scan_sav(spark, path, **how)
    whole = then(df)
    index = how.get("row_index_name")
    names = [n for n in df.columns if n != index]
    needed = _needed(whole, names) or names[:1]
    if len(needed) == len(names):
        return whole, meta
    try:
        return then(scan_sav(spark, path, **how | {"columns": needed})[0]), meta
    except AnalysisException:
        return whole, meta
