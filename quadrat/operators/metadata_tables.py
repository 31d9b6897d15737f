"""A file's metadata as DataFrames, and the differences of two files as joins of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.metadata import SpssMetadata, value_text

VARIABLES = "position int, variable string, label string, spss_type string, type string, measure string, alignment string, storage_width int, display_width int, has_missing boolean"
VALUE_LABELS = "variable string, position int, value_number double, value_string string, value_text string, value_label string"
MISSING = "variable string, position int, type string, value double, low double, high double, string_value string"
MR_SETS = "name string, label string, mr_type string, counted_value string, variables array<string>"
FILE = "file_label string, file_encoding string, compression string, file_format string, creation_time string, modification_time string, number_rows long, number_columns int, weight_variable string, notes array<string>"


def file_table(spark: SparkSession, m: SpssMetadata) -> DataFrame:
    return spark.createDataFrame([(m.file_label, m.file_encoding, m.compression, m.file_format, m.creation_time, m.modification_time, m.number_rows, m.number_columns, m.weight_variable, m.notes)], FILE)


def variables_table(spark: SparkSession, m: SpssMetadata) -> DataFrame:
    """A row for each visible variable, in file order by position."""
    rows = [
        (i, n, m.labelled.get(n), m.spss_variable_types.get(n), m.variable_types[n], m.variable_measure.get(n), m.variable_alignment.get(n), m.variable_storage_width.get(n), m.variable_display_width.get(n), n in m.variable_missing)
        for i, n in enumerate(m.variable_names)
    ]
    return spark.createDataFrame(rows, VARIABLES)


def value_labels_table(spark: SparkSession, m: SpssMetadata) -> DataFrame:
    """A row for each labelled value; numbers and strings in columns of their own."""
    rows = [
        (n, i, None if isinstance(v, str) else v, v if isinstance(v, str) else None, value_text(v), label)
        for n, found in m.variable_value_labels.items()
        for i, (v, label) in enumerate(found.items())
    ]
    return spark.createDataFrame(rows, VALUE_LABELS)


def missing_table(spark: SparkSession, m: SpssMetadata) -> DataFrame:
    """A row for each missing-value specification: value, range or string_value."""
    rows = [
        (n, i, s["type"], s["value"] if s["type"] == "value" else None, s.get("low"), s.get("high"), s["value"] if s["type"] == "string_value" else None)
        for n, specs in m.variable_missing.items()
        for i, s in enumerate(specs)
    ]
    return spark.createDataFrame(rows, MISSING)


def mr_sets_table(spark: SparkSession, m: SpssMetadata) -> DataFrame:
    return spark.createDataFrame([(s["name"], s["label"], s["mr_type"], s["counted_value"], s["variables"]) for s in m.mr_sets.values()], MR_SETS)


def summary_counts(variables: DataFrame) -> DataFrame:
    """n by measure and by whether variables are strings: the counts of the summary."""
    kind = F.when(F.col("type") == "String", "string").otherwise("numeric")
    return variables.groupBy(kind.alias("kind"), F.coalesce("measure", F.lit("unknown")).alias("measure")).agg(F.count("*").alias("n"))


def only_in(a: DataFrame, b: DataFrame, key: str = "variable") -> DataFrame:
    """Keys of a that b lacks, in order."""
    return a.select(key).join(b.select(key), key, "left_anti").orderBy(key)


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("variable").intersect(b.select("variable"))


def changed(a: DataFrame, b: DataFrame, column: str, default: Column | None = None) -> DataFrame:
    """variable, self, other where a column of two variables_tables differs."""
    fill = (lambda c: F.coalesce(c, default)) if default is not None else (lambda c: c)
    x = a.select("variable", "position", fill(F.col(column)).alias("self"))
    y = b.select("variable", fill(F.col(column)).alias("other"))
    return x.join(y, "variable").filter(~F.col("self").eqNullSafe(F.col("other"))).orderBy("position").select("variable", "self", "other")


def value_label_changes(a: DataFrame, b: DataFrame, both: DataFrame) -> DataFrame:
    """variable, self_count, other_count where the labelled values of shared variables differ."""
    x = a.select("variable", "value_number", "value_string", F.col("value_label").alias("mine"))
    y = b.select(F.col("variable").alias("v"), F.col("value_number").alias("n"), F.col("value_string").alias("s"), F.col("value_label").alias("theirs"))
    same = (F.col("variable") == F.col("v")) & F.col("value_number").eqNullSafe(F.col("n")) & F.col("value_string").eqNullSafe(F.col("s"))
    rows = x.join(y, same, "full").withColumn("variable", F.coalesce("variable", "v"))
    counts = rows.groupBy("variable").agg(
        F.count("mine").alias("self_count"),
        F.count("theirs").alias("other_count"),
        F.sum((~F.col("mine").eqNullSafe(F.col("theirs"))).cast("int")).alias("different"),
    )
    return counts.filter("different > 0").join(both, "variable", "left_semi").select("variable", "self_count", "other_count")


def missing_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """variable, self_has_missing, other_has_missing where only one of two variables has a specification."""
    x = a.select("variable", F.col("has_missing").alias("self_has_missing"))
    return x.join(b.select("variable", F.col("has_missing").alias("other_has_missing")), "variable").filter("self_has_missing <> other_has_missing")


def mr_set_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, status of the multiple-response sets that only one file has."""
    mine = only_in(a, b, "name").select(F.col("name").alias("key"), F.lit("only_in_self").alias("status"))
    return mine.unionByName(only_in(b, a, "name").select(F.col("name").alias("key"), F.lit("only_in_other").alias("status")))


def diff_tables(spark: SparkSession, a: SpssMetadata, b: SpssMetadata) -> dict[str, DataFrame]:
    """All differences of two files, by the names that MetaDiff gives them."""
    x, y = variables_table(spark, a), variables_table(spark, b)
    return {
        "variables_only_in_self": only_in(x, y),
        "variables_only_in_other": only_in(y, x),
        "variable_labels": changed(x, y, "label", F.lit("")),
        "variable_value_labels": value_label_changes(value_labels_table(spark, a), value_labels_table(spark, b), shared(x, y)),
        "spss_variable_types": changed(x, y, "spss_type", F.lit("")),
        "variable_measure": changed(x, y, "measure", F.lit("?")),
        "variable_display_width": changed(x, y, "display_width"),
        "variable_storage_width": changed(x, y, "storage_width"),
        "variable_missing": missing_changes(x, y),
        "mr_sets": mr_set_changes(mr_sets_table(spark, a), mr_sets_table(spark, b)),
    }
