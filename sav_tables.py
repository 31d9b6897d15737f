"""The driver's tables as system files: Spark tasks encode their rows, the driver holds no rows.

A task encodes the rows it reads into piece files in the shared folder; the driver collects
where each piece begins and how long it is, and tasks copy them to their places in one file.
For zlib the pieces are one stream, of which tasks pack ranges of blocks. Not part of the library.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

import sav_encoder
from quadrat.runtime import fresh_path, shared_dir, ship
from sav_encoder import Column, bytecode, head, slot_matrix, slot_places, zlib_frame

EPOCH = 12_219_379_200
#: Widths of the columns that texts are laid out in, over as many rows as they need.
TEXT_BYTES = 32_000
LATIN_BYTES = 4_000
WIDTHS = (255, 256, 503, 504, 505, 757, 1000, 1009)
#: Slot bytes that a task encodes at a time; bytes of a zlib block; blocks that a task packs at a time.
ENCODED_BYTES = 8 << 20
BLOCK = 1 << 18
BLOCKS = 64

#: Table and columns that each file is made of.
SOURCES = {
    "customer": ("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "orders": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "lineitem": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]),
    "events": ("events", ["event_id", "ts", "user_id", "event_type", "value"]),
    "texts": ("documents", ["doc_id", "text", "n_chars"]),
    "widths": ("documents", ["doc_id", "n_chars"]),
    "latin": ("documents", ["doc_id", "text"]),
    "embeddings": ("embeddings", ["vec_id", "embedding"]),
    "labels": ("labels", ["doc_id", "quality", "toxic"]),
}

#: Files that other code has written aren't used.
_VERSION = hashlib.md5(b"".join(open(m, "rb").read() for m in (__file__, sav_encoder.__file__))).hexdigest()[:8]
_shipped: set[str] = set()


def seconds(stamps: pa.Array) -> np.ndarray:
    """Timestamps as whole seconds since 1582."""
    micros = stamps.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)
    return np.floor_divide(micros, 1_000_000).astype(np.float64) + EPOCH


def laid_out(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row of the text, part, and piece: texts as pieces of at most width bytes.

    Every piece but a text's last ends in a mark, as blanks at the end of a string are lost;
    no character of UTF-8 is cut.
    """
    row, part, pieces = [], [], []
    for i, raw in enumerate(texts):
        raw, at, k = raw.rstrip(b" \0"), 0, 0
        while len(raw) - at > width:
            to = at + width - 1
            while raw[to] & 0xC0 == 0x80 and to > at + width - 4:
                to -= 1
            pieces.append(raw[at:to] + b"|")
            row.append(i)
            part.append(k)
            at, k = to, k + 1
        pieces.append(raw[at:])
        row.append(i)
        part.append(k)
    return np.array(row, np.int64), np.array(part, np.int64), pieces


def columns_of(name: str, t: pa.RecordBatch, first: int, given: dict) -> tuple[list[Column], dict]:
    """Rows of a driver table, of which the first has this number, as columns of a system file, and how the file is to be written.

    given: the nations' names by key, and the length of a vector.
    """
    text = lambda c: t[c].to_pylist()
    real = lambda c: t[c].to_numpy(zero_copy_only=False).astype(float)
    num = lambda n, c, f=("F", 10, 0), **k: Column(n, real(c), format=f, **k)
    whole = ("F", 10, 0)
    if name == "customer":
        return [
            num("c_custkey", "c_custkey", label="Customer key", measure=3),
            Column("c_name", text("c_name"), 24, label="Name", measure=1),
            num("c_nationkey", "c_nationkey", ("F", 8, 0), labels=given["nations"], measure=1, missing=(1, [0.0])),
            num("c_acctbal", "c_acctbal", ("F", 12, 2), label="Balance", measure=3, missing=(-2, [-1000.0, 0.0])),
            Column("c_mktsegment", text("c_mktsegment"), 16, measure=1, labels={"BUILDING": "Building trade"}),
            Column("never_blank", ["" if k % 3 == 0 else "  x " for k in range(first, first + len(t))], 8),
        ], {"label": "customers", "weight": "c_custkey", "notes": ("first note", "second note"), "mr_sets": "$keys=C 4 Keys V1 V3\n$two=D1 1 3 Two V1 V3\n"}
    if name == "orders":
        return [
            num("o_orderkey", "o_orderkey"), num("o_custkey", "o_custkey"), Column("o_orderstatus", text("o_orderstatus"), 1),
            num("o_totalprice", "o_totalprice", ("F", 12, 2)), Column("o_orderdate", seconds(t["o_orderdate"]), format=("DATE", 11, 0)),
            Column("o_orderpriority", text("o_orderpriority"), 16),
        ], {}
    if name == "lineitem":
        keys = [num(c, c) for c in ("l_orderkey", "l_partkey", "l_suppkey")] + [num("l_linenumber", "l_linenumber", ("F", 8, 0))]
        money = [num(c, c, ("F", 12, 2)) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
        flags = [Column(c, text(c), 1) for c in ("l_returnflag", "l_linestatus")]
        discount = np.ma.masked_array(real("l_discount"), pc.fill_null(pc.equal(t["l_discount"], 0), True).to_numpy(zero_copy_only=False))
        return [*keys, *money, *flags, Column("l_shipdate", seconds(t["l_shipdate"]), format=("DATETIME", 20, 0)), Column("discount_or_null", discount, format=("F", 8, 2))], {}
    if name == "events":
        stamps = seconds(t["ts"])
        return [
            num("event_id", "event_id"), Column("ts", stamps, format=("DATETIME", 20, 0)), Column("time_of_day", np.mod(stamps, 86400), format=("TIME", 8, 0)),
            num("user_id", "user_id"), Column("event_type", text("event_type"), 16), num("value", "value", ("F", 12, 2)),
        ], {}
    if name == "texts":
        row, part, pieces = laid_out([x.encode() for x in text("text")], TEXT_BYTES)
        return [Column("doc_id", real("doc_id")[row], format=whole), Column("text", pieces, TEXT_BYTES), Column("n_chars", real("n_chars")[row], format=whole), Column("nth", first + row, format=whole), Column("part", part, format=whole)], {}
    if name == "widths":
        ids = text("doc_id")
        return [num("doc_id", "doc_id"), *(Column(f"w{w}", [("ab" * w)[: w - i % 7] for i in ids], w) for w in WIDTHS), num("last", "n_chars")], {}
    if name == "latin":
        row, part, pieces = laid_out([x.encode("cp1252", "ignore") for x in text("text")], LATIN_BYTES)
        columns = [Column("doc_id", real("doc_id")[row], format=whole), Column("text", pieces, LATIN_BYTES), Column("nth", first + row, format=whole), Column("part", part, format=whole)]
        return columns, {"charset": "cp1252", "charset_name": None, "code_page": 1252}
    if name == "embeddings":
        wide = np.array(text("embedding"), float).reshape(len(t), given["length"])
        return [num("vec_id", "vec_id"), *(Column(f"e{k}", wide[:, k], format=("F", 12, 6)) for k in range(given["length"]))], {}
    if name == "labels":
        yes = {0.0: "no", 1.0: "yes"}
        return [num("doc_id", "doc_id"), num("quality", "quality", ("F", 1, 0), labels=yes, label="Quality"), num("toxic", "toxic", ("F", 1, 0), labels=yes)], {"mr_sets": "$marks=D1 1 5 Marks V2 V3\n"}
    raise KeyError(name)


class _Piece:
    """The encoded rows of consecutive input rows, in a file of their own.

    Bytecode is written by eight rows, so that control words end with rows; what is left at the
    end is filled up with codes that are skipped.
    """

    def __init__(self, folder: str, plain: bool, first: int):
        self.path, self.plain, self.first, self.inputs, self.rows = f"{folder}/piece-{uuid.uuid4().hex}", plain, first, 0, 0
        self.out, self.held = open(self.path, "wb"), None  # noqa: SIM115

    def add(self, inputs: int, slots: np.ndarray) -> None:
        self.inputs += inputs
        self.rows += len(slots)
        if self.plain:
            self.out.write(slots.tobytes())
            return
        slots = slots if self.held is None else np.concatenate([self.held, slots])
        whole = len(slots) // 8 * 8
        self.held = slots[whole:].copy()
        if whole:
            self.out.write(bytecode(slots[:whole], 100.0, slots[:whole]))

    def close(self) -> pa.RecordBatch:
        if self.held is not None and len(self.held):
            self.out.write(bytecode(self.held, 100.0, self.held))
        size = self.out.tell()
        self.out.close()
        return pa.RecordBatch.from_pylist([{"first": self.first, "inputs": self.inputs, "n": self.rows, "size": size, "path": self.path}])


_PIECES = "first long, inputs long, n long, size long, path string"


def _encoder(name: str, plain: bool, bases: dict[str, int], given: dict, folder: str, step: int) -> Callable:
    """Rows of a table with their file and place in it, to the pieces that hold them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = None
        for b in batches:
            files = b["file"].dictionary_encode()
            number = np.array([bases[f] for f in files.dictionary.to_pylist()], np.int64)[files.indices.to_numpy()] + b["at"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number) != 1) + 1).tolist(), len(number)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                for at in range(start, end, step):
                    part, first = b.slice(at, min(step, end - at)), int(number[at])
                    if piece is None or piece.first + piece.inputs != first:
                        if piece is not None:
                            yield piece.close()
                        piece = _Piece(folder, plain, first)
                    columns, how = columns_of(name, part, first, given)
                    piece.add(len(part), slot_matrix(columns, how.get("charset", "utf-8")))
        if piece is not None:
            yield piece.close()

    return encode


def _packer(pieces: list[tuple[str, int]], folder: str) -> Callable:
    """Numbers of ranges of a stream that lies in pieces, to their packed blocks."""
    ends = np.cumsum([size for _, size in pieces]).tolist()

    def read(at: int, size: int) -> bytes:
        found, k = [], bisect_right(ends, at)
        while size and k < len(pieces):
            with open(pieces[k][0], "rb") as f:
                f.seek(at - ends[k] + pieces[k][1])
                found.append(f.read(size))
            at, size, k = at + len(found[-1]), size - len(found[-1]), k + 1
        return b"".join(found)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b["id"].to_pylist():
                path, sizes = f"{folder}/blocks-{uuid.uuid4().hex}", []
                with open(path, "wb") as out:
                    for n in range(k * BLOCKS, (k + 1) * BLOCKS):
                        if raw := read(n * BLOCK, BLOCK):
                            packed = zlib.compress(raw, 1)
                            out.write(packed)
                            sizes.append((len(raw), len(packed)))
                yield pa.RecordBatch.from_pylist([{"k": k, "path": path, "full": [s for s, _ in sizes], "packed": [s for _, s in sizes]}])

    return pack


def _mover(target: str, moves: list[tuple[str, int]]) -> Callable:
    """Numbers of files, to their copies at their places in the target."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b["id"].to_pylist():
                path, at = moves[k]
                with open(path, "rb") as source, open(target, "r+b") as out:
                    out.seek(at)
                    shutil.copyfileobj(source, out, 1 << 20)
            yield b

    return move


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, n))


def _local(named: str) -> str:
    if not named.startswith(("file:", "/")):
        raise ValueError(f"the files of these queries need a mounted folder, not {named}")
    folder = "/" + named.removeprefix("file:").lstrip("/")
    os.makedirs(folder, exist_ok=True)
    return folder


def local_folder(spark: SparkSession) -> str:
    """The folder for these files: tasks write at places in them, so it must be a mounted one."""
    return _local(f"{shared_dir(spark)}/sav")


def _ship(spark: SparkSession) -> None:
    ship(spark)
    if spark.sparkContext.applicationId not in _shipped:
        _shipped.add(spark.sparkContext.applicationId)
        for module in (__file__, sav_encoder.__file__):
            spark.sparkContext.addPyFile(module)


def write_table(spark: SparkSession, sf_dir: str, name: str, codec: str, path: str) -> None:
    """A driver table's rows, in the order of its files, as a system file at path."""
    _ship(spark)
    source, names = SOURCES[name]
    given: dict = {"nations": {}}
    if name == "embeddings":
        given["length"] = max((len(r[0]) for r in spark.read.parquet(f"{sf_dir}/{source}.parquet").select("embedding").take(1)), default=0)
    table = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    bases, n = {}, 0
    for r in sorted(table.groupBy(F.col("_metadata.file_path").alias("file")).count().collect()):
        bases[r["file"]], n = n, n + r["count"]
    rows = table.select(*names, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    nothing = pa.RecordBatch.from_pylist([], to_arrow_schema(rows.schema))
    step = max(8, ENCODED_BYTES // (slot_places(columns_of(name, nothing, 0, given)[0])[1] * 8) // 8 * 8)
    folder = _local(fresh_path(spark, "sav"))
    try:
        pieces = sorted(rows.mapInArrow(_encoder(name, codec == "none", bases, given, folder, step), _PIECES).collect())
        upto = 0
        for p in pieces:
            if p["first"] != upto:
                raise RuntimeError(f"rows of {source} from {upto} on are at {p['first']}")
            upto += p["inputs"]
        if upto != n:
            raise RuntimeError(f"{upto} rows of {source} were read, not {n}")
        if name == "customer":
            given["nations"] = {float(k): v for k, v in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()}
        columns, how = columns_of(name, nothing, 0, given)
        first, last = head(columns, codec, sum(p["n"] for p in pieces), **how), b""
        parts = [(p["path"], p["size"]) for p in pieces]
        if codec == "zlib":
            ranges = -(-sum(s for _, s in parts) // (BLOCKS * BLOCK))
            packed = sorted(_numbers(spark, ranges).mapInArrow(_packer(parts, folder), "k long, path string, full array<long>, packed array<long>").collect())
            before, last = zlib_frame(len(first), [s for r in packed for s in zip(r["full"], r["packed"], strict=True)], BLOCK)
            first, parts = first + before, [(r["path"], sum(r["packed"])) for r in packed]
        with open(path, "wb") as out:
            out.write(first)
            out.seek(len(first) + sum(s for _, s in parts))
            out.write(last)
            out.truncate()
        places = np.cumsum([len(first), *(s for _, s in parts)]).tolist()
        _numbers(spark, len(parts)).mapInArrow(_mover(path, [(p, at) for (p, _), at in zip(parts, places, strict=False)]), "id long").count()
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def sav_file(spark: SparkSession, sf_dir: str, name: str, codec: str = "none") -> str:
    """The path of a driver table's system file; written where it isn't there yet."""
    folder = local_folder(spark)
    path = f"{folder}/{_VERSION}-{hashlib.md5(os.path.abspath(sf_dir).encode()).hexdigest()[:12]}-{name}-{codec}.{'zsav' if codec == 'zlib' else 'sav'}"
    if not os.path.exists(path):
        write_table(spark, sf_dir, name, codec, f"{path}.{os.getpid()}")
        os.replace(f"{path}.{os.getpid()}", path)
    return path
