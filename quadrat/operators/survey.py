"""What survey data are used for beyond reading them: labels, missing values, weights, response sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.metadata import SpssMetadata
from quadrat.operators.metadata_tables import value_labels_table


def decode_labels(df: DataFrame, meta: SpssMetadata, column: str, into: str) -> DataFrame:
    """df with the label of each value of a column, null where it has none.

    A file's labels of one variable are few: they were read with its dictionary on the
    driver, so the join's other side is bounded by it, and is sent to the executors.
    """
    labels = value_labels_table(df.sparkSession, meta).filter(F.col("variable") == column)
    key = "value_string" if meta.is_string(column) else "value_number"
    labels = labels.select(F.col(key).alias("__value"), F.col("value_label").alias(into))
    return df.join(F.broadcast(labels), F.col(f"`{column}`") == F.col("__value"), "left").drop("__value")


def _is_missing(column: Column, specs: list[dict]) -> Column:
    tests = [column.between(s["low"], s["high"]) if s["type"] == "range" else column == F.lit(s["value"]) for s in specs]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def null_missing(df: DataFrame, meta: SpssMetadata, columns: list[str] | None = None) -> DataFrame:
    """df with null for each value that its variable's specification calls missing."""
    chosen = [c for c in (df.columns if columns is None else columns) if c in meta.variable_missing]
    kinds = dict(df.dtypes)
    for c in chosen:
        if kinds[c] not in ("double", "string"):
            continue
        v = F.col(f"`{c}`")
        df = df.withColumn(c, F.when(~F.coalesce(_is_missing(v, meta.variable_missing[c]), F.lit(False)), v))
    return df


def weighted_frequencies(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """value, n, weighted_n of a column's values; rows without weight, or with none above 0, weigh 0."""
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(f"`{weight}`"), F.lit(0.0)), F.lit(0.0))
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"), F.sum(w).alias("weighted_n"))


def weighted_mean(df: DataFrame, column: str, weight: str) -> DataFrame:
    """weighted_mean over rows that have both value and weight."""
    v, w = F.col(f"`{column}`"), F.col(f"`{weight}`")
    return df.filter(v.isNotNull() & w.isNotNull()).agg((F.sum(v * w) / F.sum(w)).alias("weighted_mean"))


def tabulate_set(df: DataFrame, meta: SpssMetadata, name: str, weight: str | None = None) -> DataFrame:
    """response, n (and weighted n) of a multiple-response set, in one pass over its variables.

    Of a dichotomy a response is a variable with the counted value; of a category set it is a
    value of any of its variables.
    """
    mr = meta.mr_sets[name]
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(f"`{weight}`"), F.lit(0.0))
    counted = mr["counted_value"]

    def response(v: str) -> Column:
        c = F.col(f"`{v}`")
        if counted is None:
            return c.cast("string")
        hit = F.trim(c) == F.lit(counted.strip()) if meta.is_string(v) else c == F.lit(float(counted))
        return F.when(hit, F.lit(v))

    rows = df.select(w.alias("w"), F.explode(F.array(*map(response, mr["variables"]))).alias("response")).filter("response is not null")
    return rows.groupBy("response").agg(F.count("*").alias("n"), F.sum("w").alias("weighted_n"))
