"""Arrow tables and batches of a DataFrame, and back."""

import pyarrow as pa
from pyspark.sql import functions as F

import sav_checks
from quadrat.plans.api import from_arrow, iter_batches, to_arrow

SF = "/root/testdata/sf0.001"


def test_there_and_back_in_order(spark):
    df = spark.range(0, 1000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é"), "id")).alias("s"), F.timestamp_millis("id").cast("timestamp_ntz").alias("t"), F.make_dt_interval(secs=F.col("id")).alias("d"), F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")).alias("day"))
    want = [tuple(r) for r in df.collect()]
    table = to_arrow(df)
    assert isinstance(table, pa.Table) and table.equals(df.toArrow())
    assert [b.num_rows for b in iter_batches(df, 300)] == [300, 300, 300, 100]
    back = from_arrow(spark, iter_batches(df, 17), df.schema)
    assert back.dtypes == df.dtypes and [tuple(r) for r in back.orderBy("id").collect()] == want
    assert to_arrow(df.limit(0)).num_rows == 0 and from_arrow(spark, iter_batches(df.limit(0)), df.schema).count() == 0


def test_queries_hold_no_table(spark, monkeypatch):
    """Neither a table nor its rows are collected, nor sent to Spark from this process's memory."""
    create = type(spark).createDataFrame

    def refuse(*_, **__):
        raise AssertionError("the driver holds the table")

    def few(self, data, *args, **kwargs):
        assert not isinstance(data, pa.Table)
        return create(self, data, *args, **kwargs)

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toArrow", refuse)
    monkeypatch.setattr(type(spark), "createDataFrame", few)
    for name in ("arrow_single", "arrow_batches"):
        assert sav_checks.QUERIES[name](spark, SF).count() > 0
