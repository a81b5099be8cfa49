"""Relational operators on feature tables, file listings and plates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellforge.functions.arrays import clean
from wellforge.functions.text import SEPARATOR, age_text, joined
from wellforge.operators.sampling import group_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def split_by_kind(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numeric columns, and all others."""
    numeric = numeric_columns(df)
    return df.select(*numeric), df.select(*(c for c in df.columns if c not in numeric))


def without_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every float column: aggregates then skip both alike."""
    return df.withColumns({f.name: clean(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def matching_files(files: DataFrame, pattern: str, path: str = "file_path", regex: bool = False) -> DataFrame:
    """Files whose base name contains `pattern`, or matches it as a regular expression."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return files.filter(name.rlike(pattern) if regex else name.contains(pattern))


def parse_names(files: DataFrame, pattern: str, groups: dict[str, int], name: str = "filename") -> DataFrame:
    """Adds typed fields from the groups of a pattern, counted from 0: channel as text, row, column, zstack, FOV and time as integers.

    Rows may be letters (A is 1). A name without a match has null fields. With row and column, WellIndex is row * 1000 + column.
    """
    out = files
    for field, k in groups.items():
        text = F.nullif(F.regexp_extract(F.col(name), pattern, k + 1), F.lit(""))
        if field == "row":
            value = F.when(text.rlike("^[A-Za-z]$"), F.ascii(F.upper(text)) - 64).otherwise(text.try_cast("int"))
        else:
            value = text if field == "channel" else text.try_cast("int")
        out = out.withColumn(field, value)
    return out.withColumn("WellIndex", F.col("row") * 1000 + F.col("column")) if {"row", "column"} <= groups.keys() else out


def channel_counts(files: DataFrame) -> DataFrame:
    """Files per channel, with whether all channels have as many as this one."""
    n = files.groupBy(F.lower("channel").alias("channel")).agg(F.count("*").alias("files"))
    # one row: as many as there are channels before it
    every = n.agg(F.min("files").alias("low"), F.max("files").alias("high"))
    return n.crossJoin(F.broadcast(every)).select("channel", "files", (F.col("low") == F.col("high")).alias("balanced"))


def check_channels(files: DataFrame) -> None:
    """Raise ValueError if there are no files, or if the channels have unequal numbers of them."""
    n = {r["channel"]: r["files"] for r in channel_counts(files).collect()}
    if len(set(n.values())) != 1:
        raise ValueError(f"channels with unequal numbers of files, or none: {n}")


def drop_rows_without_values(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Leaves out rows whose columns other than `keys` are all null or NaN."""
    return without_nan(df).na.drop("all", subset=[c for c in df.columns if c not in set(keys)])


def drop_empty_columns(df: DataFrame, how: str = "all") -> DataFrame:
    """Leaves out columns in which all ('all') or any ('any') value is null or NaN: one aggregation decides."""
    if how not in ("all", "any"):
        raise ValueError(how)
    counts = without_nan(df).agg(F.count("*").alias("_n"), *(F.count(f"`{c}`").alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if (counts[c] == 0 if how == "all" else counts[c] < counts["_n"])))


def aggregate(df: DataFrame, by: Sequence[str], function: str | Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """Groups by `by`, rows with a null key left out, and reduces every numeric (or listed) column; "unique" keeps single values."""
    if function == "unique":
        return unique_values(df, by)
    if function == "median":
        return group_medians(df, by, columns)
    reduce = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}.get(function, function)
    values = columns or [c for c in numeric_columns(df) if c not in by]
    return without_nan(df).na.drop("any", subset=list(by)).groupBy(*by).agg(*(reduce(F.col(c)).alias(c) for c in values))


def group_medians(df: DataFrame, by: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The exact median of every numeric (or listed) column per group, without gathering a group in one task; null if it has no value."""
    values = columns or [c for c in numeric_columns(df) if c not in by]
    rows = df.na.drop("any", subset=list(by))
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in values))).alias("_z")).select(*by, "_z.*")
    found = group_quantiles(long, [*by, "_column"], "_value", (0.5,))
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("_column") == c, F.col("value"))).alias(c) for c in values))
    return rows.select(*by).distinct().join(wide, list(by), "left")


def unique_values(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group each other column's value if it has exactly one, nulls aside; else null. Two values are enough to know."""
    rest = [c for c in df.columns if c not in by]
    one = [F.when(F.min(c).eqNullSafe(F.max(c)), F.max(c)).alias(c) for c in rest]
    return without_nan(df).na.drop("any", subset=list(by)).groupBy(*by).agg(*one)


def single_valued(df: DataFrame) -> DataFrame:
    """One row: of each column its value if the whole table has just one (a null counts as a value), else null."""
    return df.agg(*(F.when(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count("*")), F.max(c)).alias(c) for c in df.columns))


def with_group(df: DataFrame, columns: Sequence[str], name: str = "Group", separator: str = SEPARATOR) -> DataFrame:
    """Adds the columns joined as text; a missing one raises ValueError."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.withColumn(name, joined(columns, separator))


def with_platemap(df: DataFrame, platemap: DataFrame, key: str = "WellIndex", check: bool = True) -> DataFrame:
    """Inner join with the well metadata, whose columns come first and replace those of the same name.

    With `check`, a well that is missing or repeated in the platemap raises ValueError (two counts are run). A platemap has a row
    per well of a plate layout, a few hundred; whether it is broadcast is left to its measured size.
    """
    kept = df.select(key, *(c for c in df.columns if c not in platemap.columns))
    out = platemap.join(kept, key)
    if check and out.count() != df.count():
        raise ValueError("wells are missing or repeated in the platemap")
    return out.select(*platemap.columns, *(c for c in kept.columns if c != key))


def ages_parsed(df: DataFrame, age: str = "Age") -> DataFrame:
    """Keeps the text as AgeInput and writes ages as days."""
    return df.withColumn("AgeInput", F.col(age)).withColumn(age, age_text(F.col(age)))


def split_by(df: DataFrame, column: str, values: Sequence[str]) -> dict[str, DataFrame]:
    """One lazy filter per value; as many scans only where all parts are used. To store parts, write partitioned by `column`."""
    return {v: df.filter(F.col(column) == v) for v in values}


def plate(df: DataFrame, value: Column, row: str | Sequence[str] = "Row", column: str = "Column", columns: Sequence[int] = tuple(range(1, 25))) -> DataFrame:
    """Plate grid: a row per `row`, a column c1 .. per plate column; empty wells are 0.

    The columns are given, so the pivot needs no scan for them; a well in another column raises when the rows are read, and one
    without a column is left out. Several values for a well take the smallest, in any order of rows (see `repeated_wells`).
    """
    # a plate of 1536 wells has 48 columns
    at = F.col(column)
    at = F.when(at.isNull() | at.isin(list(columns)), at).otherwise(F.raise_error(F.concat(F.lit("well in a column that is not given: "), at.cast("string"))))
    rows = [row] if isinstance(row, str) else list(row)
    cells = df.select(*rows, at.alias("_c"), value.alias("_v")).groupBy(*rows).pivot("_c", list(columns)).agg(F.min("_v"))
    return cells.select(*rows, *(F.coalesce(F.col(str(c)), F.lit(0)).alias(f"c{c}") for c in columns))


def repeated_wells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once: a plate grid must have none."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def well_metadata(df: DataFrame, platemap: DataFrame, measure: Column | tuple[str, float], well: str = "WellIndex") -> DataFrame:
    """One row per well: the aggregated `measure` as `value`, with the well's Row and Column.

    A measure (column, p) is the exact p-quantile of the column, null for a well without values.
    """
    rows = df.filter(F.col(well).isNotNull())
    if isinstance(measure, tuple):
        found = group_quantiles(rows, [well], measure[0], (measure[1],)).select(well, "value")
        per_well = rows.select(well).distinct().join(found, well, "left")
    else:
        per_well = without_nan(rows).groupBy(well).agg(measure.alias("value"))
    places = platemap.groupBy(well).agg(F.min("Row").alias("Row"), F.min("Column").alias("Column"))
    return per_well.join(places, well)
