"""Driver tables that tasks write as system files."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import sav_queries
import sav_tables
from quadrat.plans.api import read_sav
from quadrat.sources.codec import _zlib_blocks
from quadrat.sources.dictionary import read_dictionary
from quadrat.sources.storage import open_input
from sav_encoder import write_sav

SF = "/root/testdata/sf0.001"


@pytest.fixture
def orders(tmp_path):
    """1,003 orders in three files, of which row groups of 100 rows are read apart; no rows in the last."""
    whole = pq.read_table(f"{SF}/orders.parquet").slice(0, 1003)
    (tmp_path / "orders.parquet").mkdir()
    for k, (at, n) in enumerate([(0, 501), (501, 502), (1003, 0)]):
        pq.write_table(whole.slice(at, n), tmp_path / "orders.parquet" / f"part-{k}.parquet", row_group_size=100)
    return str(tmp_path), whole


@pytest.mark.parametrize("codec", ["none", "bytecode", "zlib"])
def test_rows_of_many_files_and_row_groups_come_in_order(spark, orders, codec, monkeypatch):
    folder, whole = orders

    def refuse(*_, **__):
        raise AssertionError("the driver reads rows")

    monkeypatch.setattr(pq, "read_table", refuse)
    monkeypatch.setattr(sav_tables, "BLOCK", 4096)
    monkeypatch.setattr(sav_tables, "BLOCKS", 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        assert spark.read.parquet(f"{folder}/orders.parquet").rdd.getNumPartitions() > 3
        path = sav_queries.sav_file(spark, folder, "orders", codec)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    df, meta = read_sav(spark, path, columns=["o_orderkey", "o_totalprice", "o_orderpriority"], row_index_name="row")
    got = [tuple(r) for r in df.orderBy("row").collect()]
    assert got == [(k, float(a), b, c) for k, (a, b, c) in enumerate(zip(*(whole[n].to_pylist() for n in df.columns[1:]), strict=True))]
    assert meta.number_rows == 1003
    if codec == "zlib":
        d = read_dictionary(path)
        with open_input(path) as source:
            sizes = _zlib_blocks(d, source)[:, 2].tolist()
        assert len(sizes) > 3 and set(sizes[:-1]) == {4096}


@pytest.mark.parametrize("name, codec", [("customer", "bytecode"), ("lineitem", "none"), ("texts", "zlib"), ("latin", "none"), ("embeddings", "none"), ("labels", "bytecode")])
def test_same_bytes_as_a_file_of_columns_in_memory(spark, name, codec, tmp_path):
    table, names = sav_tables.SOURCES[name]
    rows = pq.read_table(f"{SF}/{table}.parquet", columns=names).combine_chunks().to_batches()[0]
    nations = pq.read_table(f"{SF}/nation.parquet")
    given = {"nations": dict(zip(map(float, nations["n_nationkey"].to_pylist()), nations["n_name"].to_pylist(), strict=True)), "length": 64 if name != "embeddings" else len(rows["embedding"][0])}
    columns, how = sav_tables.columns_of(name, rows, 0, given)
    write_sav(f"{tmp_path}/whole.sav", columns, codec, **how)
    sav_tables.write_table(spark, SF, name, codec, f"{tmp_path}/tasks.sav")
    assert (tmp_path / "tasks.sav").read_bytes() == (tmp_path / "whole.sav").read_bytes()


@pytest.mark.parametrize("codec", ["none", "bytecode", "zlib"])
def test_a_table_without_rows(spark, codec, tmp_path):
    pq.write_table(pq.read_table(f"{SF}/orders.parquet").slice(0, 0), tmp_path / "orders.parquet")
    df, meta = read_sav(spark, sav_queries.sav_file(spark, str(tmp_path), "orders", codec))
    assert df.count() == 0 and meta.number_rows == 0 and len(df.columns) == 6


def test_discounts_that_are_zero_or_null_are_missing():
    columns, _ = sav_tables.columns_of("lineitem", pa.RecordBatch.from_pydict({n: pa.array([None, 0.0, 0.5, float("nan")], pa.float64()) if n == "l_discount" else pa.array([None] * 4, pa.timestamp("us") if n == "l_shipdate" else pa.float64()) for n in sav_tables.SOURCES["lineitem"][1]}), 0, {})
    assert sav_tables.slot_matrix([columns[-1]], "utf-8")[:, 0].tolist()[:2] == [sav_tables.sav_encoder.SYSMIS] * 2
    assert sav_tables.slot_matrix([columns[-1]], "utf-8")[:, 0].view(float).tolist()[2] == 0.5
