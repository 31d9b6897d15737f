"""System files of a folder as a stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quadrat.plans.api import read_sav_dictionary
from quadrat.sources.datasource import register
from quadrat.sources.storage import list_files


def stream_sav(spark: SparkSession, folder: str | os.PathLike, **options) -> DataFrame:
    """Rows of the files of a folder, each read once, when it is there.

    The schema is that of the first file there. Options are those of the batch source.
    """
    register(spark)
    folder = os.fspath(folder)
    schema = read_sav_dictionary(list_files(folder)[0]).schema
    return spark.readStream.format("sav").schema(schema).options(**{k: str(v) for k, v in options.items()}).load(folder)
