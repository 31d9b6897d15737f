"""The registered queries of the reader: driver tables as system files, read back and queried.

The files are written once for each table and codec into the session's shared folder (sav_tables.py).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.metadata import SpssMetadata
from quadrat.operators import metadata_tables as mt
from quadrat.operators import survey
from quadrat.plans.api import read_sav, read_sav_metadata, scan_sav
from sav_encoder import Column, write_sav
from sav_tables import _VERSION, WIDTHS, local_folder, sav_file


def joined(df: DataFrame, *keys: str) -> DataFrame:
    """doc_id, text and the other keys of texts laid out over rows."""
    pieces = F.sort_array(F.collect_list(F.struct("part", "text")))
    last = F.size(pieces) - 1
    text = F.concat_ws("", F.transform(pieces, lambda p, i: F.when(i < last, p["text"].substr(F.lit(1), F.length(p["text"]) - 1)).otherwise(p["text"])))
    return df.groupBy("nth", *keys).agg(text.alias("text")).select("doc_id", "text", *[k for k in keys if k != "doc_id"])


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _scan(codec: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, _ = read_sav(spark, sav_file(spark, sf_dir, "customer", codec), columns=CUSTOMER, partition_bytes=40_000)
        return _longs(df, "c_custkey", "c_nationkey")

    return query


def _customer(then: Callable[[DataFrame], DataFrame], **how):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return then(scan_sav(spark, sav_file(spark, sf_dir, "customer", "bytecode"), **how)[0])

    return query


def _of(table: str, then: Callable[[DataFrame], DataFrame], codec: str = "none", **how):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return then(read_sav(spark, sav_file(spark, sf_dir, table, codec), **how)[0])

    return query


def pricing_summary(spark: SparkSession, sf_dir: str, codec: str = "none") -> DataFrame:
    """The flagship: a pricing summary over a system file, with only the needed columns decoded."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    df, _ = read_sav(spark, sav_file(spark, sf_dir, "lineitem", codec), columns=names)
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    total = lambda c: F.round(F.sum(c), 2)
    return df.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        total("l_quantity").alias("sum_qty"), total("l_extendedprice").alias("sum_base_price"), total(price).alias("sum_disc_price"),
        total(price * (1 + F.col("l_tax"))).alias("sum_charge"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


PRICING_SQL = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
"""


def _meta(spark: SparkSession, sf_dir: str, table: str = "customer") -> SpssMetadata:
    return read_sav_metadata(sav_file(spark, sf_dir, table, "bytecode"))


def _pair(spark: SparkSession) -> tuple[SpssMetadata, SpssMetadata]:
    """Two small files that differ in each way that is compared."""
    folder = local_folder(spark)
    v = [1.0, 2.0]
    a = [
        Column("id", v, label="Key"), Column("only_a", v), Column("kind", v, labels={1.0: "one", 2.0: "two"}, measure=1),
        Column("size", v, missing=(1, [9.0]), format=("F", 8, 2)), Column("name", ["x", "y"], 8), Column("same", v, label="Same", labels={1.0: "a"}),
    ]
    b = [
        Column("id", v, label="Identifier"), Column("kind", v, labels={1.0: "one", 3.0: "three", 4.0: "four"}, measure=2),
        Column("size", v, format=("F", 5, 0), display=12), Column("name", ["x", "y"], 20), Column("same", v, label="Same", labels={1.0: "a"}), Column("only_b", v),
    ]
    found = []
    for name, columns, sets in (("a", a, "$s1=C 1 S V1 V3\n$both=C 1 S V1 V3\n"), ("b", b, "$both=C 1 S V1 V3\n$s2=C 1 S V1 V3\n")):
        path = f"{folder}/pair-{name}-{os.getpid()}.sav"
        write_sav(path, columns, label=f"file {name}", mr_sets=sets)
        found.append(read_sav_metadata(path))
    return found[0], found[1]


def _diff(name: str):
    return lambda spark, sf_dir: mt.diff_tables(spark, *_pair(spark))[name]


def meta_value_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mt.value_labels_table(spark, _meta(spark, sf_dir)).filter("variable = 'c_nationkey'")
    return t.select(F.col("value_number").cast("long").alias("value"), "value_label")


def label_decode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, meta = read_sav(spark, sav_file(spark, sf_dir, "customer", "zlib"), columns=["c_custkey", "c_nationkey"])
    return _longs(survey.decode_labels(df, meta, "c_nationkey", "nation"), "c_custkey").select("c_custkey", "nation")


def user_missing_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, meta = read_sav(spark, sav_file(spark, sf_dir, "customer", "none"), columns=["c_custkey", "c_nationkey", "c_acctbal"])
    return _longs(survey.null_missing(df, meta), "c_custkey", "c_nationkey")


def weighted_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, meta = read_sav(spark, sav_file(spark, sf_dir, "customer", "bytecode"), columns=["c_custkey", "c_mktsegment"])
    return survey.weighted_frequencies(df, "c_mktsegment", meta.weight_variable)


def tabulate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, meta = read_sav(spark, sav_file(spark, sf_dir, "labels", "bytecode"))
    return survey.tabulate_set(df, meta, "marks")


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrat.runtime import fresh_path
    from quadrat.streaming.sav_stream import stream_sav

    folder = os.path.dirname(sav_file(spark, sf_dir, "customer", "none")) + f"/stream-{_VERSION}-" + hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    os.makedirs(folder, exist_ok=True)
    for codec in ("none", "bytecode"):
        source = sav_file(spark, sf_dir, "customer", codec)
        if not os.path.exists(f"{folder}/{codec}.sav"):
            os.link(source, f"{folder}/{codec}.sav")
    out = fresh_path(spark, "stream")
    query = stream_sav(spark, folder).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment").writeStream.format("parquet").option("checkpointLocation", out + "-log").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


def _unpivot(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c != "vec_id"]
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.array(*names).alias("e")).select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.element_at("e", 1).alias("first"), F.element_at("e", -1).alias("last"))


def _index(df: DataFrame) -> DataFrame:
    return _longs(df, "c_custkey").select("row", "c_custkey")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_raw": _scan("none"),
    "scan_bytecode": _scan("bytecode"),
    "scan_zsav": _scan("zlib"),
    "scan_lazy": _customer(lambda df: _longs(df.select(*CUSTOMER), "c_custkey", "c_nationkey")),
    "project_by_name": _customer(lambda df: df, columns=["c_mktsegment", "c_name"]),
    "project_by_index": _customer(lambda df: df, columns=[1, -2]),
    "project_empty_is_all": _customer(lambda df: _longs(df, "c_custkey", "c_nationkey"), columns=[]),
    "limit_n_rows": _customer(lambda df: _longs(df, "c_custkey"), columns=["c_custkey", "c_name"], n_rows=37),
    "limit_zero": _customer(lambda df: df, columns=["c_name"], n_rows=0),
    "limit_before_filter": _of("customer", lambda df: _longs(df.filter("c_acctbal > 0"), "c_custkey"), columns=["c_custkey", "c_acctbal"], n_rows=100),
    "row_index": _of("customer", _index, "bytecode", columns=["c_custkey"], row_index_name="row", partition_bytes=5_000),
    "row_index_offset": _of("customer", _index, columns=["c_custkey"], row_index_name="row", row_index_offset=1000, n_rows=90, partition_bytes=2_000),
    "filter_numeric": _customer(lambda df: _longs(df.filter("c_acctbal >= 5000 and c_nationkey < 10"), "c_custkey", "c_nationkey").select("c_custkey", "c_nationkey", "c_acctbal")),
    "filter_string": _customer(lambda df: _longs(df.filter("c_mktsegment = 'BUILDING'"), "c_custkey").select("c_custkey", "c_mktsegment")),
    "filter_date": _of("orders", lambda df: _longs(df.filter("o_orderdate >= date'1997-01-01'"), "o_orderkey").select("o_orderkey", "o_orderdate"), "zlib"),
    "sysmis_null": _of("lineitem", lambda df: _longs(df, "l_orderkey", "l_linenumber"), "bytecode", columns=["l_orderkey", "l_linenumber", "discount_or_null"]),
    "blank_string_not_null": _of("customer", lambda df: _longs(df, "c_custkey").withColumn("is_null", F.col("never_blank").isNull()), columns=["c_custkey", "never_blank"]),
    "date_cast": _of("orders", lambda df: _longs(df, "o_orderkey"), columns=["o_orderkey", "o_orderdate"]),
    "datetime_cast": _of("events", lambda df: _longs(df, "event_id"), "bytecode", columns=["event_id", "ts"]),
    "duration_seconds": _of("events", lambda df: _longs(df, "event_id").select("event_id", (F.extract(F.lit("HOUR"), "time_of_day") * 3600 + F.extract(F.lit("MINUTE"), "time_of_day") * 60 + F.extract(F.lit("SECOND"), "time_of_day")).cast("long").alias("seconds")), columns=["event_id", "time_of_day"]),
    "vls_documents": _of("texts", lambda df: _longs(joined(df, "doc_id", "n_chars"), "doc_id", "n_chars"), "zlib"),
    "vls_boundary_widths": _of("widths", lambda df: _longs(df, "doc_id", "last"), "bytecode"),
    "charset_1252": _of("latin", lambda df: _longs(joined(df, "doc_id"), "doc_id")),
    "wide_file": _of("embeddings", _unpivot),
    "pricing_summary": lambda spark, sf_dir: pricing_summary(spark, sf_dir, "none"),
    "pricing_summary_bytecode": lambda spark, sf_dir: pricing_summary(spark, sf_dir, "bytecode"),
    "pricing_summary_zsav": lambda spark, sf_dir: pricing_summary(spark, sf_dir, "zlib"),
    "meta_variables": lambda spark, sf_dir: mt.variables_table(spark, _meta(spark, sf_dir)).select("position", "variable", "label", "spss_type", "type", "measure", "storage_width"),
    "meta_value_labels": meta_value_labels,
    "meta_missing": lambda spark, sf_dir: mt.missing_table(spark, _meta(spark, sf_dir)).select("variable", "type", "value", "low", "high"),
    "meta_mr_sets": lambda spark, sf_dir: mt.mr_sets_table(spark, _meta(spark, sf_dir)).select("name", "label", "mr_type", "counted_value", F.explode("variables").alias("variable")),
    "meta_file": lambda spark, sf_dir: mt.file_table(spark, _meta(spark, sf_dir)).select("file_label", "file_encoding", "compression", "file_format", "number_columns", "weight_variable"),
    "meta_diff_only_self": _diff("variables_only_in_self"),
    "meta_diff_only_other": _diff("variables_only_in_other"),
    "meta_diff_labels": _diff("variable_labels"),
    "meta_diff_types": _diff("spss_variable_types"),
    "meta_diff_measure": _diff("variable_measure"),
    "meta_diff_display_width": _diff("variable_display_width"),
    "meta_diff_storage_width": _diff("variable_storage_width"),
    "meta_diff_value_labels": _diff("variable_value_labels"),
    "meta_diff_missing": _diff("variable_missing"),
    "meta_diff_mr": _diff("mr_sets"),
    "meta_summary_counts": lambda spark, sf_dir: mt.summary_counts(mt.variables_table(spark, _meta(spark, sf_dir))),
    "label_decode_join": label_decode_join,
    "user_missing_null": user_missing_null,
    "weighted_count": weighted_count,
    "mr_tabulation": tabulate_set,
    "stream_rows": stream_rows,
}

_CUSTOMERS = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
_BLANK = "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '  x' END"
_WIDTHS = ", ".join(f"left(repeat('ab', {w}), CAST({w} - doc_id % 7 AS INTEGER)) AS w{w}" for w in WIDTHS)

_LATIN = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def _values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({names})"


ORACLES: dict[str, str] = {
    "scan_raw": _CUSTOMERS,
    "scan_bytecode": _CUSTOMERS,
    "scan_zsav": _CUSTOMERS,
    "scan_lazy": _CUSTOMERS,
    "project_by_name": "SELECT c_mktsegment, c_name FROM customer",
    "project_by_index": "SELECT c_name, c_mktsegment FROM customer",
    "project_empty_is_all": f"SELECT *, {_BLANK} AS never_blank FROM ({_CUSTOMERS})",
    "limit_n_rows": "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 37",
    "limit_zero": "SELECT c_name FROM customer WHERE false",
    "limit_before_filter": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey < 100 AND c_acctbal > 0",
    "row_index": "SELECT c_custkey AS row, c_custkey FROM customer",
    "row_index_offset": "SELECT c_custkey + 1000 AS row, c_custkey FROM customer WHERE c_custkey < 90",
    "filter_numeric": "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_nationkey < 10",
    "filter_string": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-01-01'",
    "sysmis_null": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, NULLIF(l_discount, 0) AS discount_or_null FROM lineitem",
    "blank_string_not_null": f"SELECT c_custkey, {_BLANK} AS never_blank, false AS is_null FROM customer",
    "date_cast": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
    "datetime_cast": "SELECT event_id, date_trunc('second', ts) AS ts FROM events",
    "duration_seconds": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS seconds FROM events",
    "vls_documents": "SELECT doc_id, rtrim(text, ' ') AS text, n_chars FROM documents",
    "charset_1252": f"SELECT doc_id, rtrim(regexp_replace(text, '[^\\x00-\\x7F\\xA0-\\xFF{_LATIN}]', '', 'g'), ' ') AS text FROM documents",
    "vls_boundary_widths": f"SELECT doc_id, {_WIDTHS}, n_chars AS last FROM documents",
    "wide_file": "SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding]), 6) AS norm2, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM embeddings",
    "pricing_summary": PRICING_SQL,
    "pricing_summary_bytecode": PRICING_SQL,
    "pricing_summary_zsav": PRICING_SQL,
    "meta_variables": _values(
        "position, variable, label, spss_type, type, measure, storage_width",
        "(0, 'c_custkey', 'Customer key', 'F10.0', 'f64', 'scale', 8)", "(1, 'c_name', 'Name', 'A24', 'String', 'nominal', 24)",
        "(2, 'c_nationkey', NULL, 'F8.0', 'f64', 'nominal', 8)", "(3, 'c_acctbal', 'Balance', 'F12.2', 'f64', 'scale', 8)",
        "(4, 'c_mktsegment', NULL, 'A16', 'String', 'nominal', 16)", "(5, 'never_blank', NULL, 'A8', 'String', 'unknown', 8)",
    ),
    "meta_value_labels": "SELECT CAST(n_nationkey AS BIGINT) AS value, n_name AS value_label FROM nation",
    "meta_missing": "SELECT 'c_nationkey' AS variable, 'value' AS type, CAST(0 AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high UNION ALL SELECT 'c_acctbal', 'range', NULL, -1000, 0",
    "meta_mr_sets": _values(
        "name, label, mr_type, counted_value, variable",
        "('keys', 'Keys', 'category', NULL, 'c_custkey')", "('keys', 'Keys', 'category', NULL, 'c_nationkey')",
        "('two', 'Two', 'dichotomy', '1', 'c_custkey')", "('two', 'Two', 'dichotomy', '1', 'c_nationkey')",
    ),
    "meta_file": _values("file_label, file_encoding, compression, file_format, number_columns, weight_variable", "('customers', 'UTF-8', 'bytecode', 'sav', 6, 'c_custkey')"),
    "meta_diff_only_self": _values("variable", "('only_a')"),
    "meta_diff_only_other": _values("variable", "('only_b')"),
    "meta_diff_labels": _values("variable, self, other", "('id', 'Key', 'Identifier')"),
    "meta_diff_types": _values("variable, self, other", "('size', 'F8.2', 'F5.0')", "('name', 'A8', 'A20')"),
    "meta_diff_measure": _values("variable, self, other", "('kind', 'nominal', 'ordinal')"),
    "meta_diff_display_width": _values("variable, self, other", "('size', 8, 12)"),
    "meta_diff_storage_width": _values("variable, self, other", "('name', 8, 24)"),
    "meta_diff_value_labels": "SELECT 'kind' AS variable, CAST(2 AS BIGINT) AS self_count, CAST(3 AS BIGINT) AS other_count",
    "meta_diff_missing": _values("variable, self_has_missing, other_has_missing", "('size', true, false)"),
    "meta_diff_mr": _values("key, status", "('s1', 'only_in_self')", "('s2', 'only_in_other')"),
    "meta_summary_counts": "SELECT kind, measure, CAST(n AS BIGINT) AS n FROM (VALUES ('numeric', 'scale', 2), ('numeric', 'nominal', 1), ('string', 'nominal', 2), ('string', 'unknown', 1)) AS t(kind, measure, n)",
    "label_decode_join": "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "user_missing_null": "SELECT c_custkey, CAST(NULLIF(c_nationkey, 0) AS BIGINT) AS c_nationkey, CASE WHEN c_acctbal BETWEEN -1000 AND 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer",
    "weighted_count": "SELECT c_mktsegment AS value, count(*) AS n, CAST(sum(c_custkey) AS DOUBLE) AS weighted_n FROM customer GROUP BY 1",
    "mr_tabulation": "SELECT 'quality' AS response, count(*) AS n, CAST(count(*) AS DOUBLE) AS weighted_n FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', count(*), count(*) FROM labels WHERE toxic = 1",
    "stream_rows": "SELECT c_mktsegment, CAST(2 * count(*) AS BIGINT) AS n, CAST(2 * sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1",
}
