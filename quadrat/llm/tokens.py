"""Token-ID output: Arrow IPC files of equal-length sequences in fixed-size lists.

A file has record batches of input_ids and mask, fixed-size lists of SEQUENCE elements, both
uncompressed: reading sequence i is arithmetic on a mapped file and copies nothing. Documents
follow one another in ascending doc_id order across sequences; the last sequence of a file is
padded with mask 0. A second file lists each document's doc_id, first token and tokens.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.files import open_file, write_file
from quadrat.llm.memory import released
from quadrat.runtime import fresh_path, materialize, ship

SEQUENCE = 2048
#: Sequences of a record batch.
ROWS = 256
#: Documents of a file, about.
FILE_DOCS = 16384
#: Bytes that the kept pieces and their ids take, about; a fuller cache starts anew.
CACHE_BYTES = 32_000_000
#: What an entry takes besides its characters and ids: two offsets and, while pieces are looked up, a copy in a hash table.
ENTRY_BYTES = 100
#: Characters of text that are encoded at a time, whole texts at least; each time makes a hash table of what is kept.
BATCH = 4_000_000
#: Characters that the library gets at a time, whole texts at least: it takes far more memory than the ids.
LIBRARY = 250_000
DOTTED = "İ"
#: Letters that are cut from punctuation behind them: all tables have them as letters.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != DOTTED)
TAILED = f"^(?P<core>[{LETTERS}]+)(?P<tail>[{re.escape(string.punctuation)}]*)$"
# How the tokenizers that this is for normalise texts and cut them.
STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Python splits words at these, the tokenizer doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Words of letters that are encoded as one string.
JOINED = 64
#: Files at most; beyond FILE_DOCS times that, files grow.
MAX_FILES = 20_000

_loaded: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes whole texts with a tokenizer that drops white space, and keeps the ids of pieces.

    As the tokenizer's pre-tokenizer never joins characters across white space, a text's ids
    are those of its words in order. Words are looked up as the tokenizer normalises them: in
    composed form and lower case, each different one of a batch once, all in Arrow columns. A
    word of Latin letters with punctuation behind it is two pre-tokens, and two pieces; others
    are one piece. The tokenizers library encodes the pieces that aren't kept: letters in one
    string for many, with a digit, which is a pre-token of its own, between them; pieces of
    other kinds, such as letters that composition takes apart, go to it as they are. Texts with
    characters at which Python but not the tokenizer splits, or with the text of one of its
    added tokens in any case, go to it whole, and so do all texts for a tokenizer that doesn't
    normalise and cut as STEPS say.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        self.by_words = (steps["normalizer"], steps["pre_tokenizer"]) == STEPS
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The same model without what normalised letters don't need.
        self.speller = Tokenizer.from_file(path)
        self.speller.normalizer = normalizers.Sequence([])
        self.speller.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("0", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        (self.between,) = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.forget()

    def _library(self, texts: list[str]) -> list[bytes]:
        found: list[bytes] = []
        for at, to in spans([len(t) for t in texts], LIBRARY):
            encoded = self.tokenizer.encode_batch_fast(texts[at:to], add_special_tokens=False)
            found += [np.array(e.ids, self.dtype).tobytes() for e in encoded]
        return found

    def _spell(self, letters: pa.Array) -> pa.Array:
        flat, bounds = [np.array([], self.dtype)], [np.zeros(1, np.int64)]
        for at in range(0, len(letters), 4096):
            group = letters[at : at + 4096]
            lists = pa.ListArray.from_arrays([*range(0, len(group), JOINED), len(group)], group)
            read: list[int] = []
            for e in self.speller.encode_batch_fast(pc.binary_join(lists, pa.scalar("0", pa.large_string())).to_pylist(), add_special_tokens=False):
                read += e.ids
                read.append(self.between)
            ids = np.array(read, self.dtype)
            between = ids == self.between
            ends = np.flatnonzero(between)
            if len(ends) != len(group):
                raise ValueError(f"{len(group)} words, ids of {len(ends)}")
            flat.append(ids[~between])
            bounds.append(bounds[-1][-1] + ends - np.arange(len(ends)))
        offsets = np.concatenate(bounds) * np.dtype(self.dtype).itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(letters), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(flat))])

    def _learn(self, pieces: pa.Array) -> None:
        """Keep the ids of pieces that aren't kept yet."""
        plain = pc.match_substring_regex(pieces, f"^[{LETTERS}]+$")
        letters, other = pieces.filter(plain), pieces.filter(pc.invert(plain))
        self.pieces = pa.concat_arrays([self.pieces, letters, other])
        self.ids = pa.concat_arrays([self.ids, self._spell(letters), pa.array(self._library(other.to_pylist()), pa.large_binary())])

    def forget(self) -> None:
        self.pieces, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _of_pieces(self, pieces: pa.Array) -> pa.Array:
        places = pc.index_in(pieces, value_set=self.pieces)
        if places.null_count:
            fresh, known = pieces.filter(places.is_null()), len(self.pieces)
            self._learn(fresh)
            again = pc.add(pc.index_in(fresh, value_set=self.pieces.slice(known)), pa.scalar(known, pa.int32()))
            places = pc.replace_with_mask(places, places.is_null(), again)
        return self.ids.take(places)

    def _of_words(self, words: pa.Array) -> pa.Array:
        parts = pc.extract_regex(words, TAILED)
        pieces = pa.concat_arrays([pc.coalesce(pc.struct_field(parts, "core"), words), pc.coalesce(pc.struct_field(parts, "tail"), pa.scalar("", pa.large_string()))])
        distinct = pieces.dictionary_encode()
        ids, places = self._of_pieces(distinct.dictionary), distinct.indices
        return pc.binary_join_element_wise(ids.take(places[: len(words)]), ids.take(places[len(words) :]), pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words or not texts:
            return self._library(texts)
        if self.pieces.nbytes + self.ids.nbytes + ENTRY_BYTES * len(self.ids) > CACHE_BYTES:
            self.forget()
        plain = list(map(normalised, texts))
        whole = [i for i, t in enumerate(plain) if not t.isprintable() and any(c in t for c in SEPARATORS) or any(x in t for x in self.added)]
        for i in whole:
            plain[i] = ""
        split = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids = self._of_words(words.dictionary).take(words.indices)
        _, ends, raw = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        raw = memoryview(raw or b"")
        found = [bytes(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        for i, t in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            found[i] = t
        return found


def spans(sizes: Sequence[int] | np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose sizes add up to so much at most, but one entry at least."""
    ends, to = np.cumsum(sizes), 0
    while to < len(ends):
        at = to
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to


def normalised(text: str) -> str:
    """Composed and lower case, each letter on its own: a capital sigma has one small form.

    The one capital whose small form has a mark stays: composed again, its marks might change places.
    """
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower() if DOTTED not in text else DOTTED.join(p.lower() for p in text.split(DOTTED))


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None, bounds: list[int] | None = None) -> DataFrame:
    """part, doc_id, n_tokens, width, ids of every row's whole text, with end_id behind it.

    part is how many of the ascending bounds are no larger than doc_id. ids are little-endian unsigned integers of 16 bits, or 32 if the vocabulary is larger. A
    null text is an empty one. Rows stay as they are.
    """
    ship(docs.sparkSession)
    edges = np.array(bounds or [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        enc.forget()
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        width = np.dtype(enc.dtype).itemsize
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for at, to in spans(sizes, BATCH):
                part = batch.slice(at, to - at)
                ids = [x + end for x in enc.encode([t or "" for t in part.column(1).to_pylist()])]
                keys = pc.fill_null(part.column(0), -(1 << 63)).to_numpy(zero_copy_only=False)
                place = np.searchsorted(edges, keys, side="right").astype(np.int32)
                yield pa.record_batch({"part": pa.array(place), "doc_id": part.column(0), "n_tokens": pa.array([len(x) // width for x in ids], pa.int64()), "width": pa.array([width] * len(ids), pa.int32()), "ids": pa.array(ids, pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "part int, doc_id long, n_tokens long, width int, ids binary")


def _sequence_batches(parts: Iterator[np.ndarray], dtype, sequence: int) -> Iterator[pa.RecordBatch]:
    held, size, room = [], 0, sequence * ROWS

    def batch(tokens: np.ndarray) -> pa.RecordBatch:
        rows = -(-len(tokens) // sequence)
        full = np.zeros(rows * sequence, dtype)
        full[: len(tokens)] = tokens
        mask = np.arange(rows * sequence) < len(tokens)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), sequence) for x in (full, mask)]
        return pa.record_batch(lists, ["input_ids", "mask"])

    for part in parts:
        held.append(part)
        size += len(part)
        if size >= room:
            tokens = np.concatenate(held)
            for at in range(0, size - size % room, room):
                yield batch(tokens[at : at + room])
            held = [tokens[size - size % room :]]
            size = len(held[0])
    if size:
        yield batch(np.concatenate(held))


def file_bounds(docs: DataFrame, file_docs: int = FILE_DOCS) -> list[int]:
    """doc_ids at which files begin, but the first; read from the doc_id column alone."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    files = min(MAX_FILES, -(-ids.count() // file_docs))
    if files < 2:
        return []
    return sorted({int(x) for x in ids.approxQuantile("doc_id", [i / files for i in range(1, files)], 1 / (8 * files))})


def write_token_files(encoded: DataFrame, parts: int, folder: str, sequence: int = SEQUENCE) -> DataFrame:
    """Write encoded (part, doc_id, n_tokens, width, ids) as token files under folder; their list.

    A row for each file: part (ascending with doc_id), path, n_docs, n_tokens. Each task writes
    one pair of files under a name of its own and lists it when whole, so a task that runs
    again leaves no trace in the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        dtype = np.uint16 if first.column(3)[0].as_py() == 2 else np.uint32
        name = f"{folder}/{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}"
        index: list[tuple] = []

        def parts() -> Iterator[np.ndarray]:
            for b in chain([first], batches):
                index.append((b.column(1), b.column(2)))
                for x in b.column(4):
                    yield np.frombuffer(x.as_buffer(), dtype)

        def write(out: pa.NativeFile) -> None:
            item = pa.from_numpy_dtype(dtype)
            schema = pa.schema([("input_ids", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
            with pa.ipc.new_file(out, schema) as writer:
                for b in _sequence_batches(parts(), dtype, sequence):
                    writer.write_batch(b.cast(schema) if b.schema != schema else b)

        write_file(f"{name}.arrow", write)
        ids, sizes = (pa.concat_arrays([x[i] for x in index]) for i in (0, 1))
        total = np.cumsum(sizes.to_numpy())
        table = pa.table({"doc_id": ids, "first": pa.array(total - sizes.to_numpy()), "n_tokens": sizes})

        def write_index(out: pa.NativeFile) -> None:
            with pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table, 65536)

        write_file(f"{name}.index.arrow", write_index)
        yield pa.record_batch({"part": [TaskContext.get().partitionId()], "path": [name], "n_docs": [len(ids)], "n_tokens": [int(total[-1])]})

    ordered = encoded.repartitionById(parts, "part").sortWithinPartitions("doc_id", "ids")
    return materialize(ordered.mapInArrow(released(run), "part long, path string, n_docs long, n_tokens long"), "token-files")


class TokenFile:
    """Random access to a token file's sequences and documents."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(open_file(f"{path}.arrow"))
        self.index = pa.ipc.open_file(open_file(f"{path}.index.arrow")).read_all()
        self.sequence_length = self.file.schema.field("input_ids").type.list_size
        self.batches = [self.file.get_batch(i) for i in range(self.file.num_record_batches)]
        self.flat = [b.column(0).flatten().to_numpy() for b in self.batches]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """input_ids (a view of the file) and mask of one sequence."""
        batch, row = divmod(i, ROWS)
        at = row * self.sequence_length
        mask = self.batches[batch].column(1).slice(row, 1).flatten().to_numpy(zero_copy_only=False)
        return self.flat[batch][at : at + self.sequence_length], mask

    def tokens(self, first: int, count: int) -> np.ndarray:
        """Tokens by place in the file; a view unless they span record batches."""
        room, found = ROWS * self.sequence_length, []
        while count or not found:
            batch, at = divmod(first, room)
            got = self.flat[batch][at : at + count] if batch < len(self.flat) else np.zeros(0, np.uint16)
            found.append(got)
            first, count = first + len(got), count - len(got)
        return found[0] if len(found) == 1 else np.concatenate(found)


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of all documents of a list of files.

    start counts the tokens of all documents before, across files, without padding.
    """
    spark = files.sparkSession
    listed = files.orderBy("part").collect()  # one row a file, as Spark lists the files of a table
    starts = [0, *np.cumsum([f.n_tokens for f in listed]).tolist()]
    rows = [(f.path, s) for f, s in zip(listed, starts, strict=False)]
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = TokenFile(path)
                for part in tokens.index.to_batches(2048):
                    first, count = part.column(1).to_numpy(), part.column(2).to_numpy()
                    ids = [tokens.tokens(f, n).astype("<u4").tobytes() for f, n in zip(first.tolist(), count.tolist(), strict=True)]
                    yield pa.record_batch({"doc_id": part.column(0), "start": pa.array(first + start), "n_tokens": part.column(2), "ids": pa.array(ids, pa.binary())})

    paths = spark.createDataFrame(rows, "path string, start long").repartition(len(rows))
    return paths.mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids binary")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, sequence: int = SEQUENCE) -> DataFrame:
    """Encode docs, write the token files, and read all documents back from them.

    Rows in ascending doc_id order: null first, rows of the same doc_id by their ids. Null and
    empty texts have the end id only. An empty table has no files and gives an empty result.
    """
    spark = docs.sparkSession
    bounds = file_bounds(docs)
    encoded = encode_documents(docs, tokenizer_path, end_id, bounds)
    return read_documents(write_token_files(encoded, len(bounds) + 1, fresh_path(spark, "tokens"), sequence))


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2, sequence: int = SEQUENCE) -> DataFrame:
    """token_table with the unsigned crc32 of each document's ids in their place."""
    return token_table(docs, tokenizer_path, end_id, sequence).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
