"""Column functions against the decoder's kernels."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quadrat.functions import spss
from quadrat.sources import columns
from quadrat.sources import sav_format as sf

E = sf.EPOCH_SECONDS


def test_temporal_functions_agree_with_the_decoder(spark):
    x = [float(E), E + 19723 * 86400.0 + 5, E - 1.0, E - 86401.0, E - 1.25, 0.0, 13_900_000_000.5]
    raw = np.array(x, "<f8").view("<u8")
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = df.select(spss.spss_date(F.col("x")).alias("d"), spss.spss_timestamp(F.col("x")).alias("t")).collect()
    assert [r.d for r in got] == columns.numeric(raw, "date", "<").to_pylist()
    assert [r.t for r in got] == columns.numeric(raw, "timestamp", "<").to_pylist()


def test_round_trip_of_timestamps(spark):
    df = spark.sql("select timestamp_ntz'2024-02-29 13:45:10.5' as t, date'1960-01-02' as d")
    r = df.select(spss.spss_seconds(F.col("t")).alias("t"), spss.spss_seconds(F.col("d")).alias("d")).first()
    back = spark.createDataFrame([(r.t, r.d)], "t double, d double").select(spss.spss_timestamp(F.col("t")), spss.spss_date(F.col("d"))).first()
    assert tuple(back) == tuple(df.first())


def test_missing_and_padding(spark):
    missing = float(np.array(sf.SYSMIS, np.uint64).view(np.float64))
    df = spark.createDataFrame([(missing, "a \0 "), (1.0, " b"), (float("nan"), None)], "x double, s string")
    got = df.select(spss.system_missing(F.col("x")), spss.trim_padding(F.col("s")), spss.spss_date(F.col("x") * float("nan"))).collect()
    assert [r[0] is None for r in got] == [True, False, False] and [r[1] for r in got] == ["a", " b", ""] and all(r[2] is None for r in got)


def test_string_columns_of_any_padding():
    from quadrat.sources.dictionary import Variable

    rows = np.frombuffer(b"ab \0 \0  " + b"\0\0\0\0\0\0\0\0" + "é  \0\xff  ".encode("latin-1")[:8].ljust(8), np.uint8).reshape(3, 8)
    assert columns.string(rows, Variable("v", 0, "string", 8), "windows-1252").to_pylist() == ["ab", "", "é  \0ÿ"]
    assert columns.string(rows[:2], Variable("v", 0, "string", 3), "UTF-8").type == pa.string()
