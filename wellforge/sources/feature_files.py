"""Records of delivered feature files: one row per file with its whole content, to one row per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notations of a missing value in feature files.
MISSING = ("", "NA", "NaN", "null")
#: Fixed pattern: a number with an optional sign, point and exponent. A decimal comma, unit or mark makes text.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def series_name(name: Column, path: Column) -> Column:
    """The series of a file: `name`, or where it is null the last folder of `path` (doubled slashes count as one)."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.coalesce(name, F.try_element_at(parts, F.lit(-2)))


def canonical_value(v: Column) -> Column:
    """Text under which equal values are equal: missing notations alike, numbers as numbers, else the text itself."""
    number = F.concat(F.lit("n"), (v.cast("double") + F.lit(0.0)).cast("string"))
    return F.when(v.isNull() | v.isin(*MISSING), F.lit("m")).when(v.rlike(NUMBER), number).otherwise(F.concat(F.lit("t"), v))


def feature_records(files: DataFrame) -> DataFrame:
    """One row per record: file_id, path, written_at, series, label, columns, line.

    Files with null or empty content have no records. A record beyond the end of `index` has a null label.
    Further columns of `files`, whatever their names, are not carried along.
    """
    one = files.select(
        "file_id",
        F.col("Path").alias("path"),
        (F.col("written_at") if "written_at" in files.columns else F.lit(None)).cast("timestamp_ntz").alias("written_at"),
        series_name(F.col("name"), F.col("Path")).alias("series"),
        F.col("columns"),
        F.col("index").alias("labels"),
        F.when(F.col("content") != "", F.split("content", "\n")).alias("lines"),
    )
    line = one.select("file_id", "path", "written_at", "series", "columns", "labels", F.posexplode("lines").alias("pos", "line"))
    return line.select("file_id", "path", "written_at", "series", F.get("labels", F.col("pos")).alias("label"), "columns", "line")


def record_key(columns: Column, line: Column, series: Column, label: Column) -> Column:
    """128 bits that agree for records of equal series, label and values, in whatever column order."""
    cells = F.transform(
        F.arrays_zip(columns.alias("c"), F.split(line, "\t").alias("v")),
        lambda x: F.concat(F.coalesce(x["c"], F.lit("")), F.lit("\x01"), canonical_value(x["v"])),
    )
    body = F.concat_ws("\x02", F.array_sort(cells))
    # a null series or label is marked, so that it differs from empty text
    keyed = [F.coalesce(F.concat(F.lit("s"), k), F.lit("null")) for k in (series, label)]
    return F.unhex(F.md5(F.concat_ws("\x03", *keyed, body)))
