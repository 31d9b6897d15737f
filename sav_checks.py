"""More registered queries of the reader: parts of files, of the API and of metadata that sav_queries doesn't reach."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import sav_encoder
from quadrat.functions import spss
from quadrat.metadata import value_text
from quadrat.operators import metadata_tables as mt
from quadrat.operators import survey
from quadrat.plans.api import SavBatchReader, from_arrow, iter_batches, read_sav, read_sav_bytes, read_sav_dictionary, read_sav_metadata, scan_pruned, scan_sav, schema_types, to_arrow
from sav_encoder import Column, write_sav
from sav_queries import _VERSION, _longs, _meta, _pair, _values, local_folder, sav_file

_MINE = hashlib.md5(open(__file__, "rb").read()).hexdigest()[:8]

#: Code page, codec that writes it, and a text with letters of its own.
PAGES = [
    (874, "cp874", "ภาษาไทย"), (932, "cp932", "日本語テスト"), (936, "gbk", "简体中文"), (949, "cp949", "한국어 시험"),
    (950, "big5", "繁體中文"), (1250, "cp1250", "Příliš žluťoučký kůň"), (1251, "cp1251", "Съешь ещё этих"), (1252, "cp1252", "naïve €uro Œuvre"),
    (1253, "cp1253", "Ξεσκεπάζω την"), (1254, "cp1254", "İstanbul ığüşöç"), (1255, "cp1255", "שלום עולם"), (1256, "cp1256", "مرحبا پچ"),
    (1257, "cp1257", "ąčęėįšųūž"), (1258, "cp1258", "Đăng ơư"), (28592, "iso8859_2", "Łódź ďěř"), (28593, "iso8859_3", "Ħaġ ŝĉĝ"),
    (28594, "iso8859_4", "ĀĒĢĪĶ"), (28595, "iso8859_5", "Привет Ђ"), (28596, "iso8859_6", "مرحبا"), (28597, "iso8859_7", "Καλημέρα"),
    (28598, "iso8859_8", "שלום"), (28599, "iso8859_9", "ğİş"), (28603, "iso8859_13", "ŠŽąę"), (28605, "iso8859_15", "€uro ŠšŽžŒœ"),
    (51932, "euc_jp", "日本語"), (51949, "euc_kr", "한국어"), (54936, "gb18030", "中文😀"), (65001, "utf-8", "Zoë 😀 日本"),
]


def nations(spark: SparkSession, sf_dir: str, codec: str = "none", **how) -> str:
    """The path of the table nation as a survey file with labels, missing values and notes of all kinds."""
    tag = hashlib.md5(repr((os.path.abspath(sf_dir), codec, sorted(how.items()))).encode()).hexdigest()[:12]
    path = f"{local_folder(spark)}/{_VERSION}-{_MINE}-nation-{tag}.sav"
    if not os.path.exists(path):
        t, r = (pq.read_table(f"{sf_dir}/{n}.parquet") for n in ("nation", "region"))
        regions = dict(zip(map(float, r["r_regionkey"].to_pylist()), r["r_name"].to_pylist(), strict=True))
        names = t["n_name"].to_pylist()
        columns = [
            Column("n_nationkey", t["n_nationkey"].to_numpy().astype(float), format=("F", 8, 0), measure=3, display=11, align=2, label="Nation key"),
            Column("n_name", names, 25, measure=1, display=30, align=0),
            Column("n_regionkey", t["n_regionkey"].to_numpy().astype(float), format=("F", 8, 0), measure=2, labels=regions, missing=(-3, [3.0, 4.0, 1.0])),
        ]
        given = {"notes": ("Nations and regions", "second note"), "long_labels": {"n_name": {n: f"Nation {k}" for k, n in enumerate(names)}}, "long_missing": {"n_name": ["NATION_0", "NATION_7"]}}
        write_sav(f"{path}.{os.getpid()}", columns, codec, label="nations", **given | how)
        os.replace(f"{path}.{os.getpid()}", path)
    return path


def _nation(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in df.columns if c in ("n_nationkey", "n_regionkey")})


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return _rows(spark, list(enumerate(text.split("\n"))), "line int, text string")


def read_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(sav_file(spark, sf_dir, "customer", "bytecode"), "rb") as f:
        df, _ = read_sav_bytes(spark, f.read(), columns=["c_custkey", "c_acctbal"])
    return _longs(df, "c_custkey")


def scan_batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = read_sav(spark, sav_file(spark, sf_dir, "customer", "zlib"), columns=["c_custkey", "c_name"], batch_size=7, partition_bytes=9_000)
    return _longs(df, "c_custkey")


def batch_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = SavBatchReader(sav_file(spark, sf_dir, "customer", "bytecode"), batch_size=400).select(["c_custkey"])
    rows = [(k, b.num_rows, reader.rows_read, int(b.column(0)[0].as_py())) for k, b in enumerate(reader)]
    return _rows(spark, rows, "batch long, n long, rows_read long, first_key long")


def batch_reader_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = SavBatchReader(sav_file(spark, sf_dir, "customer", "none"), batch_size=50, columns=[0, 1]).limit(120)
    first = reader.next_batch()
    rest = reader.collect_single()
    none = SavBatchReader(reader.path).limit(0).collect_single()
    rows = [("first", first.num_rows), ("rest", rest.num_rows), ("read", reader.rows_read), ("at_end", int(reader.next_batch() is None)), ("limit_zero", none.num_rows), ("columns", len(reader.schema.names))]
    return _rows(spark, rows, "what string, n long")


def arrow_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = read_sav(spark, sav_file(spark, sf_dir, "orders", "bytecode"), columns=["o_orderkey", "o_orderdate"])
    return _longs(from_arrow(spark, to_arrow(df).to_batches(), df.schema), "o_orderkey")


def arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _ = read_sav(spark, sav_file(spark, sf_dir, "orders", "none"), columns=["o_orderkey", "o_orderpriority"], partition_bytes=50_000)
    parts = [from_arrow(spark, p, df.schema) for p in (to_arrow(df).to_batches(), iter_batches(df, 999))]
    return _longs(parts[0].unionByName(parts[1]), "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def project_after_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = lambda df: df.filter("c_acctbal > 100").select("c_name", F.col("c_custkey").cast("long").alias("key"))
    return scan_pruned(spark, sav_file(spark, sf_dir, "customer", "bytecode"), then)[0]


def scan_columns_of_a_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns reach the scan: read off the optimized plan's leaf."""
    then = lambda df: df.filter("c_acctbal > 100").groupBy("c_mktsegment").agg(F.max("c_custkey").alias("k"))
    plan = scan_pruned(spark, sav_file(spark, sf_dir, "customer", "bytecode"), then)[0]._jdf.queryExecution().optimizedPlan()
    while not plan.children().isEmpty():
        plan = plan.children().apply(0)
    names = [plan.output().apply(i).name() for i in range(plan.output().size())]
    return _rows(spark, [(n,) for n in names], "name string")


def filter_pushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = [("l_quantity", ">=", 45), ("l_returnflag", "in", ["A", "R"]), ("l_shipdate", "<", "1998-01-01"), ("discount_or_null", "is not null", None), ("l_linestatus", "starts with", "F")]
    frames = []
    for codec in ("none", "bytecode", "zlib"):
        df, _ = read_sav(spark, sav_file(spark, sf_dir, "lineitem", codec), columns=["l_orderkey", "l_quantity"], row_index_name="row", where=tests, partition_bytes=300_000)
        frames.append(_longs(df, "l_orderkey"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def schema_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(t, n, k) for t in ("orders", "events") for n, k in schema_types(read_sav(spark, sav_file(spark, sf_dir, t, "none"))[0]).items()]
    return _rows(spark, found, "file string, name string, type string")


def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = sav_file(spark, sf_dir, "customer", "bytecode"), local_folder(spark)
    with open(path, "rb") as f:
        raw = f.read()
    broken = {"not_a_file": b"PK\3\4" + raw[4:], "cut_dictionary": raw[:300], "compression": raw[:72] + b"\7" + raw[73:]}
    for name, body in broken.items():
        with open(f"{folder}/broken-{os.getpid()}-{name}.sav", "wb") as f:
            f.write(body)
    cases: dict[str, Callable] = {
        "read_unknown_column": lambda: read_sav(spark, path, columns=["nope"]),
        "scan_unknown_column": lambda: scan_sav(spark, path, columns=["nope"]),
        "unknown_variable": lambda: read_sav_metadata(path).label("nope"),
        "unknown_difference": lambda: _meta(spark, sf_dir).diff(_meta(spark, sf_dir), print_output=False)["nope"],
        "describe_number": lambda: read_sav_metadata(path).describe_text(3),
        "negative_offset": lambda: read_sav(spark, path, row_index_name="r", row_index_offset=-1),
        "no_file": lambda: read_sav(spark, path + ".gone"),
        **{name: lambda name=name: read_sav_metadata(f"{folder}/broken-{os.getpid()}-{name}.sav") for name in broken},
    }
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, "none"))
        except Exception as e:
            rows.append((name, next(k.__name__ for k in (KeyError, FileNotFoundError, OSError, ValueError, Exception) if isinstance(e, k))))
    return _rows(spark, rows, "what string, error string")


def limit_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = sav_file(spark, sf_dir, "customer", "bytecode")
    counts = [read_sav(spark, path, columns=["c_custkey"], n_rows=a)[0].limit(b).agg(F.lit(f"{a} {b}").alias("limits"), F.count("*").alias("n"), F.max("c_custkey").cast("long").alias("last")) for a, b in ((50, 80), (50, 50), (0, 5))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def ncases_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [_nation(read_sav(spark, nations(spark, sf_dir, c, ncases=n))[0]).withColumn("said", F.lit(n)) for c, n in (("none", 3), ("bytecode", -1), ("zlib", 1000))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def big_endian(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [_nation(read_sav(spark, nations(spark, sf_dir, c, order=">"))[0]).withColumn("codec", F.lit(c)) for c in ("none", "bytecode", "zlib")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def big_endian_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mt.value_labels_table(spark, read_sav_metadata(nations(spark, sf_dir, order=">"))).filter("variable = 'n_regionkey'")
    return t.select(F.col("value_number").cast("int").alias("r_regionkey"), F.col("value_label").alias("r_name"))


def float_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [(o, read_sav_dictionary(nations(spark, sf_dir, order=o)).float_info) for o in "<>"]
    return _rows(spark, [(o, f.sysmis, f.highest, f.lowest) for o, f in found], "byte_order string, sysmis double, highest double, lowest double")


def user_missing_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, meta = read_sav(spark, nations(spark, sf_dir, "bytecode"))
    return _nation(survey.null_missing(df, meta))


def charset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = []
    for page, codec, text in PAGES:
        path = f"{local_folder(spark)}/{_VERSION}-{_MINE}-page-{page}.sav"
        if not os.path.exists(path):
            write_sav(f"{path}.{os.getpid()}", [Column("text", [text, "plain"], 64, label=text)], charset=codec, charset_name=None, code_page=page)
            os.replace(f"{path}.{os.getpid()}", path)
        df, meta = read_sav(spark, path)
        frames.append(df.withColumns({"page": F.lit(page), "label": F.lit(meta.label("text"))}))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def meta_diff_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark)
    diff = a.diff(b, print_output=False)
    names = ("variables_only_in_self", "variables_only_in_other", "variable_labels", "variable_value_labels", "spss_variable_types", "variable_measure", "variable_display_width", "variable_storage_width", "variable_missing", "mr_sets")
    return _rows(spark, [(n, len(diff[n]), len(getattr(diff, n))) for n in names], "key string, by_key long, by_name long")


def meta_diff_file_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark)
    return _rows(spark, [(k, str(x), str(y)) for k, (x, y) in a.diff(b, print_output=False).file_level.items()], "key string, self string, other string")


def meta_diff_is_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _pair(spark)
    pairs = {"same": a.diff(a, print_output=False), "other": a.diff(b, print_output=False)}
    return _rows(spark, [(k, d.is_match, repr(d)) for k, d in pairs.items()], "pair string, is_match boolean, shown string")


def meta_display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = [1.0, -3.0, 2.5, 1e15, 0.1, 1.7976931348623157e308, -1.7976931348623157e308, "text"]
    return _rows(spark, [(k, value_text(v)) for k, v in enumerate(given)], "nth int, shown string")


def meta_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_sav_metadata(nations(spark, sf_dir)).schema
    return _rows(spark, [(k, len(v) if isinstance(v, (list, dict)) else -1, None if isinstance(v, (list, dict)) or v is None else str(v)) for k, v in schema.items()], "key string, size int, value string")


def spss_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as system files hold them, made and read by column functions alone."""
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    x = t.select("o_orderkey", spss.spss_seconds(F.col("at")).alias("x"))
    missing = F.when(F.col("o_orderkey") % 5 == 0, F.lit(spss.MISSING)).otherwise(F.col("x"))
    trimmed = spss.trim_padding(F.concat(F.col("o_orderkey").cast("string"), F.lit("  \0")))
    return x.select("o_orderkey", spss.spss_date(F.col("x")).alias("day"), spss.spss_timestamp(F.col("x")).alias("stamp"), spss.system_missing(missing).isNull().alias("missing"), trimmed.alias("key"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(read_sav(spark, sav_file(spark, sf_dir, "customer", "bytecode"), columns=["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])[0], "c_custkey", "c_nationkey")


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = _customers(spark, sf_dir).withColumn("place", F.row_number().over(best)).withColumn("behind", F.round(F.lag("c_acctbal").over(best) - F.col("c_acctbal"), 2))
    return ranked.filter("place <= 3").select("c_nationkey", "place", "c_custkey", "behind")


def top_and_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).orderBy(F.desc("c_acctbal"), "c_custkey").offset(5).limit(20).select("c_custkey", "c_acctbal")


def sql_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    _customers(spark, sf_dir).createOrReplaceTempView("sav_customer")
    return spark.sql("""
        SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, count(DISTINCT c_nationkey) AS nations
        FROM sav_customer WHERE c_nationkey IN (SELECT c_nationkey FROM sav_customer GROUP BY 1 HAVING count(*) > 10)
        GROUP BY c_mktsegment HAVING count(*) > 1""")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _customers(spark, sf_dir)
    rich, poor = t.filter("c_acctbal > 5000").select("c_nationkey", "c_mktsegment"), t.filter("c_acctbal < 0").select("c_nationkey", "c_mktsegment")
    return rich.intersect(poor).withColumn("kind", F.lit("both")).unionByName(rich.exceptAll(poor).withColumn("kind", F.lit("rich"))).unionByName(rich.union(poor).distinct().withColumn("kind", F.lit("any")))


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, meta = read_sav(spark, sav_file(spark, sf_dir, "customer", "bytecode"), columns=["c_custkey", "c_acctbal"])
    return survey.weighted_mean(df, "c_acctbal", meta.weight_variable).select(F.round("weighted_mean", 6).alias("weighted_mean"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_bytes": read_bytes,
    "scan_batch_size": scan_batch_size,
    "batch_reader": batch_reader,
    "batch_reader_limit": batch_reader_limit,
    "arrow_single": arrow_single,
    "arrow_batches": arrow_batches,
    "project_after_select": project_after_select,
    "scan_columns_of_a_plan": scan_columns_of_a_plan,
    "filter_pushed": filter_pushed,
    "schema_of": schema_of,
    "error_kinds": error_kinds,
    "limit_combination": limit_combination,
    "ncases_hint": ncases_hint,
    "big_endian": big_endian,
    "big_endian_metadata": big_endian_metadata,
    "float_info": float_info,
    "charset_pages": charset_pages,
    "user_missing_strings": user_missing_strings,
    "meta_notes": lambda spark, sf_dir: mt.file_table(spark, read_sav_metadata(nations(spark, sf_dir))).select(F.posexplode("notes").alias("line", "note")),
    "meta_display": lambda spark, sf_dir: mt.variables_table(spark, read_sav_metadata(nations(spark, sf_dir))).select("variable", "measure", "alignment", "display_width", "storage_width", "has_missing"),
    "meta_long_labels": lambda spark, sf_dir: mt.value_labels_table(spark, read_sav_metadata(nations(spark, sf_dir))).filter("variable = 'n_name'").select(F.col("value_string").alias("n_name"), "value_label"),
    "meta_long_missing": lambda spark, sf_dir: mt.missing_table(spark, read_sav_metadata(nations(spark, sf_dir))).select("variable", "type", "value", "low", "high", "string_value"),
    "meta_created": lambda spark, sf_dir: _rows(spark, [tuple(_meta(spark, sf_dir).schema[k] for k in ("creation_time", "modification_time"))], "creation_time string, modification_time string"),
    "meta_summary_text": lambda spark, sf_dir: _lines(spark, _meta(spark, sf_dir).summary_text()),
    "meta_describe_text": lambda spark, sf_dir: _lines(spark, read_sav_metadata(nations(spark, sf_dir)).describe_text(["n_nationkey", "n_regionkey"])),
    "meta_repr": lambda spark, sf_dir: _lines(spark, repr(_meta(spark, sf_dir))),
    "meta_schema": meta_schema,
    "meta_display_values": meta_display_values,
    "meta_diff_object": meta_diff_object,
    "meta_diff_file_level": meta_diff_file_level,
    "meta_diff_is_match": meta_diff_is_match,
    "meta_diff_summary_text": lambda spark, sf_dir: _lines(spark, _pair(spark)[0].diff(_pair(spark)[1], print_output=False).summary_text()),
    "spss_functions": spss_functions,
    "window_rank": window_rank,
    "top_and_offset": top_and_offset,
    "sql_view": sql_view,
    "set_operations": set_operations,
    "weighted_mean": weighted_mean,
}

_SQL_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def _text_rows(*lines: str) -> str:
    quoted = (line if line.startswith("(SELECT") else "'" + line.replace("'", "''") + "'" for line in lines)
    return _values("line, text", *(f"({k}, {line})" for k, line in enumerate(quoted)))


ORACLES: dict[str, str] = {
    "read_bytes": "SELECT c_custkey, c_acctbal FROM customer",
    "scan_batch_size": "SELECT c_custkey, c_name FROM customer",
    "batch_reader": "SELECT c_custkey // 400 AS batch, count(*) AS n, max(c_custkey) + 1 AS rows_read, min(c_custkey) AS first_key FROM customer GROUP BY 1",
    "batch_reader_limit": "SELECT what, CAST(n AS BIGINT) AS n FROM (VALUES ('first', 50), ('rest', 70), ('read', 120), ('at_end', 1), ('limit_zero', 0), ('columns', 2)) AS t(what, n)",
    "arrow_single": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
    "arrow_batches": "SELECT o_orderpriority, 2 * count(*) AS n, CAST(2 * sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1",
    "project_after_select": "SELECT c_name, c_custkey AS key FROM customer WHERE c_acctbal > 100",
    "scan_columns_of_a_plan": _values("name", "('c_custkey')", "('c_acctbal')", "('c_mktsegment')"),
    "filter_pushed": """
        SELECT row, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER () - 1 AS row FROM lineitem), range(3)
        WHERE l_quantity >= 45 AND l_returnflag IN ('A', 'R') AND date_trunc('second', l_shipdate) < TIMESTAMP '1998-01-01' AND l_discount <> 0 AND l_linestatus = 'F'""",
    "schema_of": _values(
        "file, name, type", "('orders', 'o_orderkey', 'Float64')", "('orders', 'o_custkey', 'Float64')", "('orders', 'o_orderstatus', 'String')", "('orders', 'o_totalprice', 'Float64')",
        "('orders', 'o_orderdate', 'Date')", "('orders', 'o_orderpriority', 'String')", "('events', 'event_id', 'Float64')", "('events', 'ts', 'Datetime')", "('events', 'time_of_day', 'Duration')",
        "('events', 'user_id', 'Float64')", "('events', 'event_type', 'String')", "('events', 'value', 'Float64')",
    ),
    "error_kinds": _values(
        "what, error", "('read_unknown_column', 'OSError')", "('scan_unknown_column', 'KeyError')", "('unknown_variable', 'KeyError')", "('unknown_difference', 'KeyError')", "('describe_number', 'OSError')",
        "('negative_offset', 'ValueError')", "('no_file', 'FileNotFoundError')", "('not_a_file', 'OSError')", "('cut_dictionary', 'OSError')", "('compression', 'OSError')",
    ),
    "limit_combination": "SELECT limits, CAST(n AS BIGINT) AS n, CAST(last AS BIGINT) AS last FROM (VALUES ('50 80', 50, 49), ('50 50', 50, 49), ('0 5', 0, NULL)) AS t(limits, n, last)",
    "ncases_hint": f"SELECT *, CAST(3 AS INTEGER) AS said FROM ({_SQL_NATION}) UNION ALL SELECT *, -1 FROM ({_SQL_NATION}) UNION ALL SELECT *, 1000 FROM ({_SQL_NATION})",
    "big_endian": " UNION ALL ".join(f"SELECT *, '{c}' AS codec FROM ({_SQL_NATION})" for c in ("none", "bytecode", "zlib")),
    "big_endian_metadata": "SELECT r_regionkey, r_name FROM region",
    "float_info": "SELECT byte_order, CAST(-1.7976931348623157e308 AS DOUBLE) AS sysmis, CAST(1.7e308 AS DOUBLE) AS highest, CAST(-1.7e308 AS DOUBLE) AS lowest FROM (VALUES ('<'), ('>')) AS t(byte_order)",
    "charset_pages": _values("text, page, label", *(f"('{x}', {page}, '{text}')" for page, _, text in PAGES for x in (text, "plain"))),
    "user_missing_strings": "SELECT n_nationkey, CASE WHEN n_name NOT IN ('NATION_0', 'NATION_7') THEN n_name END AS n_name, CASE WHEN n_regionkey NOT IN (1, 3, 4) THEN n_regionkey END AS n_regionkey FROM nation",
    "meta_notes": _values("line, note", "(0, 'Nations and regions')", "(1, 'second note')"),
    "meta_display": _values("variable, measure, alignment, display_width, storage_width, has_missing", "('n_nationkey', 'scale', 'center', 11, 8, false)", "('n_name', 'nominal', 'left', 30, 32, true)", "('n_regionkey', 'ordinal', 'right', 8, 8, true)"),
    "meta_long_labels": "SELECT n_name, 'Nation ' || n_nationkey AS value_label FROM nation",
    "meta_long_missing": "SELECT variable, type, CAST(value AS DOUBLE) AS value, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, string_value FROM (VALUES ('n_name', 'string_value', NULL, NULL, NULL, 'NATION_0'), ('n_name', 'string_value', NULL, NULL, NULL, 'NATION_7'), ('n_regionkey', 'range', NULL, 3, 4, NULL), ('n_regionkey', 'value', 1, NULL, NULL, NULL)) AS t(variable, type, value, low, high, string_value)",
    "meta_created": _values("creation_time, modification_time", "('2024-01-01 14:30:00', '2024-01-01 14:30:00')"),
    "meta_summary_text": _text_rows(
        "SPSS Metadata Summary", "═" * 42, "", "File", "  Label:        customers", "  Format:       sav", "  Encoding:     UTF-8", "  Created:      2024-01-01 14:30:00",
        "(SELECT '  Rows:         ' || format('{:,}', count(*)) FROM customer)", "  Columns:      6", "  Weight:       c_custkey", "  Notes:        2 record(s) │ first note", "", "Variables",
        "  Numeric           3     50.0%", "  String            3     50.0%", "", "  Nominal           3", "  Ordinal           0", "  Scale             2", "  Unknown           1", "", "Annotations",
        "  Labeled:          3 / 6       50.0%", "  Value labels:     2 / 6       33.3%", "  Missing:          2 / 6       33.3%", "  MR sets:          2",
    ),
    "meta_describe_text": _text_rows(
        "Variable: n_nationkey", "Label:    Nation key", "Format:   F8.0        Measure: scale", "Type:     Numeric     Align:   center", "Display:  11          Storage: 8", "Missing:  (none)", "",
        "Variable: n_regionkey", "Label:    (none)", "Format:   F8.0        Measure: ordinal", "Type:     Numeric     Align:   right", "Display:  8           Storage: 8", "Missing:  3 thru 4, 1", "",
        "(SELECT 'Value Labels (' || count(*) || '):' FROM region)", *(f"(SELECT '  ' || rpad('{k}', 8, ' ') || r_name FROM region WHERE r_regionkey = {k})" for k in range(5)),
    ),
    "meta_repr": "SELECT 0 AS line, 'SpssMetadata(columns=6, rows=' || count(*) || ', encoding=\"UTF-8\", compression=\"bytecode\")' AS text FROM customer",
    "meta_schema": """
        SELECT key, CAST(size AS INTEGER) AS size, value FROM (VALUES ('file_label', -1, 'nations'), ('file_format', -1, 'sav'), ('file_encoding', -1, 'UTF-8'),
          ('creation_time', -1, '2024-01-01 14:30:00'), ('modification_time', -1, '2024-01-01 14:30:00'), ('number_rows', -1, (SELECT CAST(count(*) AS VARCHAR) FROM nation)),
          ('number_columns', -1, '3'), ('weight_variable', -1, NULL), ('notes', 2, NULL), ('variable_names', 3, NULL), ('variable_labels', 3, NULL), ('variable_value_labels', 2, NULL),
          ('variable_measure', 3, NULL), ('spss_variable_types', 3, NULL), ('rust_variable_types', 3, NULL), ('variable_alignment', 3, NULL), ('variable_display_width', 3, NULL),
          ('variable_storage_width', 3, NULL), ('variable_missing', 2, NULL), ('mr_sets', 0, NULL)) AS t(key, size, value)""",
    "meta_display_values": _values("nth, shown", "(0, '1')", "(1, '-3')", "(2, '2.5')", "(3, '1000000000000000')", "(4, '0.1')", "(5, 'HIGH')", "(6, 'LOW')", "(7, 'text')"),
    "meta_diff_object": "SELECT key, CAST(n AS BIGINT) AS by_key, CAST(n AS BIGINT) AS by_name FROM (VALUES ('variables_only_in_self', 1), ('variables_only_in_other', 1), ('variable_labels', 1), ('variable_value_labels', 1), ('spss_variable_types', 2), ('variable_measure', 1), ('variable_display_width', 1), ('variable_storage_width', 1), ('variable_missing', 1), ('mr_sets', 2)) AS t(key, n)",
    "meta_diff_file_level": _values("key, self, other", "('file_label', 'file a', 'file b')"),
    "meta_diff_is_match": _values("pair, is_match, shown", "('same', true, 'MetaDiff(is_match=true, diffs=0)')", "('other', false, 'MetaDiff(is_match=false, diffs=6)')"),
    "meta_diff_summary_text": _text_rows(
        "Metadata Diff", "=============", "", "File-level:", "  file_label               ('file a', 'file b')", "", "Variables:", "  Only in self:       1   [only_a]", "  Only in other:      1   [only_b]", "", "Field diffs:",
        "  variable_labels               1 diff ", "  variable_value_labels         1 diff ", "  spss_variable_types           2 diffs", "  variable_measure              1 diff ", "  variable_display_width        1 diff ",
        "  variable_storage_width        1 diff ", "  variable_missing              1 diff ", "  mr_sets                       2 diffs", "", "Result: DIFFERENCES FOUND",
    ),
    "spss_functions": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderdate AS stamp, o_orderkey % 5 = 0 AS missing, CAST(o_orderkey AS VARCHAR) AS key FROM orders",
    "window_rank": """
        SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(place AS INTEGER) AS place, c_custkey, round(behind, 2) AS behind FROM (
          SELECT *, row_number() OVER w AS place, lag(c_acctbal) OVER w - c_acctbal AS behind FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) WHERE place <= 3""",
    "top_and_offset": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5",
    "sql_view": """
        SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, count(DISTINCT c_nationkey) AS nations FROM customer
        WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 10) GROUP BY 1 HAVING count(*) > 1""",
    "set_operations": """
        WITH rich AS (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000),
        poor AS (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0)
        SELECT *, 'both' AS kind FROM (SELECT * FROM rich INTERSECT SELECT * FROM poor)
        UNION ALL SELECT *, 'rich' FROM (SELECT * FROM rich EXCEPT ALL SELECT * FROM poor)
        UNION ALL SELECT *, 'any' FROM (SELECT * FROM rich UNION SELECT * FROM poor)""",
    "weighted_mean": "SELECT round(sum(c_acctbal * c_custkey) / sum(c_custkey), 6) AS weighted_mean FROM customer",
}
