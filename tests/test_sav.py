"""Files that the encoder writes, read through Spark."""

import datetime as dt
import random
import struct

import pytest

from quadrat.operators import metadata_tables as mt
from quadrat.operators import survey
from quadrat.plans.api import SavBatchReader, iter_batches, read_sav, read_sav_bytes, read_sav_metadata, scan_pruned, scan_sav, schema_types
from quadrat.sources.sav_format import HIGHEST, LOWEST, SavError
from sav_encoder import Column, write_sav

CODECS = ("none", "bytecode", "zlib")
EPOCH = 12_219_379_200


def rows(df):
    return [tuple(r) for r in df.collect()]


def random_columns(r, n):
    out = []
    for k in range(r.randint(1, 7)):
        kind = r.choice(["whole", "real", "short", "long", "date", "time"])
        name = f"{r.choice('aBé$@#_')}.{k}{kind}"
        if kind in ("short", "long"):
            width = r.choice([1, 7, 8, 9, 40, 255]) if kind == "short" else r.choice([256, 503, 504, 505, 509, 510, 757, 1009])
            text = lambda w: "".join(r.choices("ab éz", k=r.randint(0, w))).encode()[:w].decode(errors="ignore").rstrip()
            out.append(Column(name, [text(width) for _ in range(n)], width))
        elif kind == "whole":
            out.append(Column(name, [r.choice([None, 0, 1, -99, -100, 151, 152, 7]) for _ in range(n)]))
        elif kind == "real":
            out.append(Column(name, [r.choice([None, 1e300, -0.5, r.random()]) for _ in range(n)]))
        elif kind == "date":
            out.append(Column(name, [None if r.random() < 0.2 else EPOCH + 86400 * r.randint(-5000, 20000) for _ in range(n)], format=("DATE", 11, 0)))
        else:
            out.append(Column(name, [r.randint(0, 10**6) for _ in range(n)], format=("TIME", 8, 0)))
    return out


def expected(columns):
    def cell(c, v):
        if v is None:
            return None
        if c.width:
            return v
        if c.format and c.format[0] == "DATE":
            return dt.date(1970, 1, 1) + dt.timedelta(days=(v - EPOCH) // 86400)
        return dt.timedelta(seconds=v) if c.format and c.format[0] == "TIME" else float(v)

    return list(zip(*([cell(c, v) for v in c.values] for c in columns), strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_random_files_in_all_codecs_and_partitions(spark, tmp_path, seed):
    r = random.Random(seed)
    n = r.choice([0, 1, 5, 60, 300])
    columns, want = random_columns(r, n), None
    order = "<" if seed % 3 else ">"
    want = expected(columns)
    for codec in CODECS:
        path = str(tmp_path / f"f-{codec}.sav")
        write_sav(path, columns, codec, order=order, bias=r.choice([100.0, 50.0]), block=r.choice([64, 1 << 18]))
        for size in (None, 2000, 300):
            df, meta = read_sav(spark, path, row_index_name="row", partition_bytes=size, batch_size=r.choice([1, 7, 1000]))
            got = sorted(rows(df))
            assert [g[0] for g in got] == list(range(n)) and [g[1:] for g in got] == want
            assert meta.number_rows == n and meta.compression == codec and df.columns == ["row", *meta.variable_names]


@pytest.fixture
def people(tmp_path):
    path = str(tmp_path / "people.sav")
    write_sav(path, [
        Column("id", list(range(100)), label="Identifier  ", measure=3, format=("F", 8, 0)),
        Column("Name.x", [f"n{i}" for i in range(100)], 10, measure=1, labels={"n1": "first"}),
        Column("when", [EPOCH + i for i in range(100)], format=("DATETIME", 20, 0), missing=(1, [float(EPOCH)])),
        Column("score", [None if i % 10 == 0 else i / 2 for i in range(100)], missing=(-3, [LOWEST, 1.0, 9.0]), labels={1.0: "low", 2.5: "mid", 1e6: "high"}),
        Column("text", ["x" * i for i in range(100)], 600, format=("A", 255, 0), display=0),
    ], "bytecode", label="People", notes=("a note", "b"), weight="score", mr_sets="$m=D1 1 3 Set V1 V4 NOPE\n", long_labels={"text": {"xxxxxxxxxxxx": "twelve"}}, long_missing={"text": ["xx"]})
    return path


def test_projection_limit_and_index(spark, people):
    df, _ = read_sav(spark, people, columns=["text", "id"], n_rows=3)
    assert rows(df) == [("", 0.0), ("x", 1.0), ("xx", 2.0)]
    assert read_sav(spark, people, columns=[-1, 0])[0].columns == ["text", "id"]
    assert read_sav(spark, people, columns=[])[0].columns == ["id", "Name.x", "when", "score", "text"]
    assert read_sav(spark, people, n_rows=0)[0].count() == 0
    with pytest.raises(IndexError):
        read_sav(spark, people, columns=[9])
    with pytest.raises(OSError, match="column not found: nope"):
        read_sav(spark, people, columns=["nope"])
    with pytest.raises(KeyError):
        scan_sav(spark, people, columns=["nope"])
    with pytest.raises(ValueError, match="row_index_offset cannot be negative"):
        read_sav(spark, people, row_index_name="i", row_index_offset=-1)
    df, _ = scan_sav(spark, people, columns=["score"], row_index_name="i", row_index_offset=5, n_rows=4)
    assert rows(df.filter("score >= 1")) == [(7, 1.0), (8, 1.5)]
    assert schema_types(read_sav(spark, people)[0]) == {"id": "Float64", "Name.x": "String", "when": "Datetime", "score": "Float64", "text": "String"}
    batches = list(iter_batches(read_sav(spark, people, columns=["id"])[0], 30))
    assert [b.num_rows for b in batches] == [30, 30, 30, 10] and batches[1].column(0)[0].as_py() == 30.0


def test_pruned_columns_reach_the_scan(spark, people):
    df, _ = read_sav(spark, people, columns=["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "id#" in plan and "text#" not in plan
    assert df.schema["id"].metadata == {"label": "Identifier", "format": "F8.0", "measure": "scale"}
    again = spark.read.format("sav").schema(df.schema).load(people)
    assert again.columns == ["id"] and again.count() == 100


def test_metadata(people):
    m = read_sav_metadata(people)
    assert (m.file_label, m.file_encoding, m.file_format, m.notes, m.weight_variable) == ("People", "UTF-8", "sav", ["a note", "b"], "score")
    assert m.variable_labels == {"id": "Identifier", "Name.x": None, "when": None, "score": None, "text": None}
    assert m.label("id") == "Identifier" and m.format("text") == "A600" and m.measure("Name.x") == "nominal"
    assert m.value("Name.x") == {"n1": "first"} and m.value("text") == {"xxxxxxxxxxxx": "twelve"} and m.value("id") is None
    assert m.variable_missing["score"] == [{"type": "range", "low": LOWEST, "high": 1.0}, {"type": "value", "value": 9.0}]
    assert m.variable_missing["text"] == [{"type": "string_value", "value": "xx"}]
    assert m.variable_storage_width == {"id": 8, "Name.x": 16, "when": 8, "score": 8, "text": 600} and m.variable_display_width["text"] == 600
    assert m.mr_sets == {"m": {"name": "m", "label": "Set", "mr_type": "dichotomy", "counted_value": "1", "variables": ["id", "score"]}}
    assert list(m.schema)[:5] == ["file_label", "file_format", "file_encoding", "creation_time", "modification_time"] and len(m.schema) == 20
    assert m.schema["creation_time"] == "2024-01-01 14:30:00"
    assert repr(m) == 'SpssMetadata(columns=5, rows=100, encoding="UTF-8", compression="bytecode")'
    with pytest.raises(KeyError, match="variable 'zz' not found in metadata"):
        m.label("zz")
    with pytest.raises(OSError):
        m.describe(3)
    text = m.describe_text(["score", "Name.x"])
    assert "Missing:  LOW thru 1, 9" in text and "Value Labels (3):\n  1       low\n  2.5     mid" in text and "Type:     String" in text
    summary = m.summary_text()
    assert "  Numeric           3     60.0%" in summary and "  Notes:        2 record(s) │ a note" in summary and "  Labeled:          1 / 5" in summary


def test_diff_of_objects_and_of_tables_agree(spark, tmp_path, people):
    other = str(tmp_path / "other.sav")
    write_sav(other, [Column("id", [1], label="Other", measure=1), Column("new", [1]), Column("score", [1], labels={1.0: "low"})], mr_sets="$z=C 1 Z V1\n")
    a, b = read_sav_metadata(people), read_sav_metadata(other)
    d = a.diff(b, print_output=False)
    assert not d.is_match and d["file_level"]["number_rows"] == (100, 1) and d["file_level"]["file_label"] == ("People", "")
    tables = mt.diff_tables(spark, a, b)
    assert [r[0] for r in rows(tables["variables_only_in_self"])] == d.variables_only_in_self == ["Name.x", "text", "when"]
    for name in ("variable_labels", "variable_value_labels", "spss_variable_types", "variable_measure", "variable_missing", "mr_sets", "variable_display_width"):
        assert sorted(map(str, (list(x.values()) for x in d[name]))) == sorted(str(list(r)) for r in rows(tables[name])), name
    with pytest.raises(KeyError):
        d["nothing"]
    same = a.diff(a, print_output=False)
    assert same.is_match and repr(same) == "MetaDiff(is_match=true, diffs=0)" and "Result: MATCH" in same.summary_text()
    assert "Only in self:       3   [Name.x, text, when]" in d.summary_text()


def test_survey_operators(spark, people):
    df, m = read_sav(spark, people)
    assert survey.decode_labels(df, m, "score", "l").filter("l is not null").select("score", "l").collect() == [(1.0, "low"), (2.5, "mid")]
    nulls = survey.null_missing(df, m)
    assert nulls.filter("score is null").count() == 10 + 2 + 1 and nulls.filter("text is null").count() == 1
    assert rows(survey.weighted_frequencies(df.filter("id in (3, 4, 10)"), "text", "score").orderBy("n", "value")) == [("xxx", 1, 1.5), ("xxxx", 1, 2.0), ("x" * 10, 1, 0.0)]
    assert rows(survey.weighted_mean(df.filter("id in (2, 4)"), "id", "score")) == [((2 * 1 + 4 * 2) / 3,)]
    assert rows(survey.tabulate_set(df, m, "m").orderBy("response")) == [("id", 1, 1.0), ("score", 1, 1.0)]


def test_charsets_and_display_layouts(spark, tmp_path):
    path = str(tmp_path / "x.sav")
    for charset, name, page, want in (("cp1252", None, 1252, "windows-1252"), ("cp932", "Shift_JIS", None, "Shift_JIS"), ("utf-8", None, None, "windows-1252")):
        text = "日本" if charset == "cp932" else "é"
        write_sav(path, [Column("a", [text, "plain"], 16, label=text, measure=2, display=9)], charset=charset, charset_name=name, code_page=page, display="pairs")
        df, m = read_sav(spark, path)
        assert m.file_encoding == want and m.variable_measure == {"a": "ordinal"} and m.variable_display_width == {"a": 8}
        shown = "Ã©" if charset == "utf-8" else text
        assert rows(df) == [(shown,), ("plain",)] and m.label("a") == shown
    write_sav(path, [Column("Long", [b"\xff\xfeok", "\0 x \0 "], 8)], long_names=False)
    df, _ = read_sav(spark, path)
    assert df.columns == ["V1"] and rows(df) == [("��ok",), ("\0 x",)]


def test_case_counts_are_a_hint(spark, tmp_path):
    path = str(tmp_path / "x.sav")
    for codec in CODECS:
        for claimed, shown in ((-1, None), (1, 1), (99, 99), (0, 0)):
            tail = b"part" if codec == "none" else b""
            write_sav(path, [Column("a", [1.5, 2.0, 3.0]), Column("b", ["x", "y", ""], 3)], codec, ncases=claimed, tail=tail)
            df, m = read_sav(spark, path)
            assert rows(df) == [(1.5, "x"), (2.0, "y"), (3.0, "")] and m.number_rows == shown


def test_broken_files(tmp_path):
    path = str(tmp_path / "x.sav")
    write_sav(path, [Column("a", [1.0], labels={1.0: "x"})])
    good = open(path, "rb").read()
    at = good.index(struct.pack("<3i", 4, 1, 1))
    for bad in (b"", b"nope" + good[4:], good[:64] + b"\7\0\0\0" + good[68:], good[:72] + b"\3\0\0\0" + good[76:], good[:300], good[:at] + struct.pack("<i", 2) + good[at + 4 :], good[: at + 8] + b"\0\0\0\0" + good[at + 12 :], good[: at + 4] + b"\0\0\0\0" + good[at + 8 :]):
        open(path, "wb").write(bad)
        with pytest.raises(SavError):
            read_sav_metadata(path)


def test_folder_bytes_and_stream(spark, tmp_path):
    for k in range(3):
        write_sav(str(tmp_path / f"p{k}.sav"), [Column("a", [10 * k + i for i in range(4)])], CODECS[k])
    df, _ = read_sav(spark, str(tmp_path), row_index_name="i", n_rows=9)
    assert sorted(rows(df)) == [(i, float(10 * (i // 4) + i % 4)) for i in range(9)]
    df, _ = read_sav_bytes(spark, open(tmp_path / "p1.sav", "rb").read())
    assert rows(df) == [(10.0,), (11.0,), (12.0,), (13.0,)]
    from quadrat.streaming.sav_stream import stream_sav

    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run():
        q = stream_sav(spark, str(tmp_path)).writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return spark.read.parquet(out).count()

    assert run() == 12
    write_sav(str(tmp_path / "p9.sav"), [Column("a", [1.0, 2.0])])
    assert run() == 14 and run() == 14


def test_extremes_are_the_formats():
    assert (HIGHEST, LOWEST) == (struct.unpack("<d", b"\xff\xff\xff\xff\xff\xff\xef\x7f")[0], struct.unpack("<d", b"\xfe\xff\xff\xff\xff\xff\xef\xff")[0])


def test_tests_of_a_scan_and_pruned_columns(spark, tmp_path):
    nan = float("nan")
    columns = [Column("a", [1, None, 3, nan, -5]), Column("s", ["x", "", "xy", "é", "x"], 300), Column("b", [None, 2.5, 1e300, 4, 5]), Column("t", ["q"] * 5, 3)]
    for codec in CODECS:
        path = str(tmp_path / f"w-{codec}.sav")
        write_sav(path, columns, codec)
        read = lambda **how: read_sav(spark, path, **how)[0]  # noqa: B023, E731
        assert [r.row for r in read(where=[("a", ">", 0)], row_index_name="row", columns=["b"]).collect()] == [0, 2, 3]
        assert [r.b for r in read(where=[("a", "is null", None)]).collect()] == [2.5]
        assert [r.t for r in read(where=[("s", "starts with", "x"), ("b", "is not null", None)], n_rows=4).collect()] == ["q"]
        assert [r.s for r in read(where=[("s", "in", ["xy", "é"])], columns=["s"]).collect()] == ["xy", "é"]
        assert read(where=[("a", "=", 99)]).count() == 0
        df, _ = scan_pruned(spark, path, lambda d: d.filter("b > 3").select("s"))
        assert [r.s for r in df.collect()] == ["xy", "é", "x"]
        assert "sav[s#" in df._jdf.queryExecution().toString() and "t#" not in df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        read(where=[("a", "~", 1)]).count()
    with pytest.raises(OSError):
        read(where=[("nope", "=", 1)])


def test_batch_reader(tmp_path):
    path = str(tmp_path / "b.sav")
    write_sav(path, [Column("a", list(range(25))), Column("s", [f"v{i}" for i in range(25)], 5)], "bytecode")
    reader = SavBatchReader(path, batch_size=10).select(["s"])
    assert [(b.num_rows, reader.rows_read) for b in reader] == [(10, 10), (10, 20), (5, 25)] and reader.next_batch() is None
    assert reader.metadata.number_columns == 2 and reader.schema.names == ["s"]
    with pytest.raises(ValueError):
        reader.limit(3)
    assert SavBatchReader(path).limit(7).collect_single().column(0).to_pylist() == [float(i) for i in range(7)]
    empty = SavBatchReader(path, columns=[1]).limit(0).collect_single()
    assert empty.num_rows == 0 and empty.schema.names == ["s"]


@pytest.mark.parametrize("codec", CODECS)
def test_batches_are_full_wherever_the_stream_is_cut(tmp_path, codec, monkeypatch):
    path = str(tmp_path / "long.sav")
    write_sav(path, [Column("a", [i + 0.5 for i in range(1000)]), Column("s", [f"v{i}" for i in range(1000)], 5)], codec, block=256)
    monkeypatch.setattr("quadrat.sources.codec.CHUNK", 640)
    monkeypatch.setattr("quadrat.sources.codec.FIRST_CHUNK", 640, raising=False)
    reader = SavBatchReader(path, batch_size=64)
    found = list(reader)
    assert [b.num_rows for b in found] == [64] * 15 + [40] and [b.column(0)[0].as_py() for b in found] == [64 * k + 0.5 for k in range(16)]
    assert [b.num_rows for b in SavBatchReader(path, batch_size=64, n_rows=130)] == [64, 64, 2]


@pytest.mark.parametrize("codec", CODECS)
def test_a_span_reads_its_own_bytes_and_spans_are_few(tmp_path, codec, monkeypatch):
    from quadrat.sources.codec import plan, read_slots, stream
    from quadrat.sources.dictionary import read_dictionary

    path = str(tmp_path / "spans.sav")
    write_sav(path, [Column("a", [i + 0.5 for i in range(5000)]), Column("s", [f"v{i}" for i in range(5000)], 5)], codec, block=512)
    d = read_dictionary(path)
    spans = plan(d, None, 100)
    assert 100 < len(spans) <= 300 and sum(s.rows or 0 for s in spans[:-1]) == spans[-1].first_row
    rows = [len(x) for s in spans for x in read_slots(d, s, 1000)]
    assert sum(rows) == 5000
    if codec != "none":
        size = sum(map(len, stream(d)))
        assert sum(len(p) for s in spans for p in stream(d, s.at, s.until)) <= size + 72 * len(spans)
