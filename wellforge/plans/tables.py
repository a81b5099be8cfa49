"""Queries on file listings, platemaps, cell tables and plates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellforge.functions.text import age_days, age_text, is_float, join_all, join_present, joined, padded_well, pixel_diameter, reordered, row_letter
from wellforge.operators import tables as ops
from wellforge.session import table

INTENSITY = "Ch1_object_average_intensity"
CELL_VALUES = ["MOR_object_pixel_count", "Ch1_object_average_intensity", "Ch1_TXT_TAS_1_10"]


def r6(c) -> F.Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


def find_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "file_information")
    return ops.matching_files(files, r"_z0?1\b|z01_", regex=True).select("file_id", "file_path")


def find_files_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.matching_files(table(spark, sf_dir, "feature_files"), "_features", path="Path").select("file_id", F.col("Path").alias("path"))


NAME_PATTERN = r"^([A-P])(\d{2})_s(\d+)_z(\d+)_t(\d+)_(\w+)\."


def parse_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "file_information").select("file_id", "filename")
    parsed = ops.parse_names(files, NAME_PATTERN, {"row": 0, "column": 1, "FOV": 2, "zstack": 3, "time": 4, "channel": 5})
    return parsed.select("file_id", "row", "column", "FOV", "zstack", "time", "channel", "WellIndex")


def padded_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "imageqc").groupBy("row", "column").agg(F.count("*").alias("n")).select("row", "column", padded_well(F.col("row"), F.col("column")).alias("well"), "n")


def channel_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.channel_counts(table(spark, sf_dir, "file_information"))


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "imageqc").select("WellIndex", "plate", "FOV", r6("ch1_percent_max").alias("ch1_percent_max"))
    b = table(spark, sf_dir, "platemap").select("WellIndex", "Sample", "Tissue")
    return ops.without_nan(a.unionByName(b, allowMissingColumns=True))


def qc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = table(spark, sf_dir, "imageqc").drop("checked_at")
    kept = ops.drop_rows_without_values(qc, ["plate", "WellIndex", "row", "column", "FOV"])
    return rounded(kept, "ch1_percent_max", "ch1_percent_median2sd", "ch1_loglog_slope").orderBy("WellIndex", "row", "column", "FOV")


def aggregate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ops.aggregate(table(spark, sf_dir, "cells"), ["WellIndex"], "mean", CELL_VALUES)
    return means.withColumns({c: F.round(c, 9) for c in CELL_VALUES})


def aggregate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = ops.aggregate(table(spark, sf_dir, "cells"), ["WellIndex"], "median", CELL_VALUES)
    # middles of values with six decimals end in a five: they are rounded as binary numbers, not by their decimal text
    return medians.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in CELL_VALUES})


def placed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell with the metadata of its well; a repeated well gives its cells once for each entry."""
    return table(spark, sf_dir, "cells").select("WellIndex", "cell_id").join(table(spark, sf_dir, "platemap"), "WellIndex")


def aggregate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.aggregate(placed_cells(spark, sf_dir).drop("cell_id"), ["Sample"], "unique")


def single_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.single_valued(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.lit("open").alias("state"), "o_orderstatus"))


def join_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_cells(spark, sf_dir).select("cell_id", joined(["Tissue", "Condition", "FieldOfView"]).alias("joined"))


def group_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.with_group(table(spark, sf_dir, "df_distance").select("dist_id", "Sample", "WellIndex"), ["Sample", "WellIndex"])


def join_iterables(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array("Sample", "Tissue", "Age")
    return placed_cells(spark, sf_dir).select("cell_id", join_present(parts).alias("present"), join_all(parts).alias("every"))


def float_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the values in feature files pass for numbers, by column position."""
    files = table(spark, sf_dir, "feature_files").filter("content <> ''")
    values = files.select(F.explode(F.split(F.regexp_replace("content", "\n", "\t"), "\t")).alias("v"))
    return values.groupBy(is_float(F.col("v")).alias("passes")).agg(F.count("*").alias("n"))


def reorder_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "cells").filter(F.size("data") == 32)
    order = F.array(*(F.lit(i) for i in (3, 1, 0, 2)))
    return cells.select("cell_id", F.transform(reordered(F.col("data"), order), lambda x: F.when(~F.isnan(x), F.round(x, 6))).alias("v")).select("cell_id", *(F.col("v")[i].alias(f"v{i}") for i in range(4)))


def cell_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ops.without_nan(table(spark, sf_dir, "cells").select("cell_id", "MOR_object_pixel_count"))
    return cells.select("cell_id", r6(pixel_diameter(F.col("MOR_object_pixel_count"))).alias("diameter"))


QC_COLUMNS = ("plate", "WellIndex", "row", "column", "FOV", "ch1_percent_max", "ch1_percent_median2sd", "ch1_loglog_slope")


def dropna_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the plate QC that remain without any, and without only, missing values, with how many values they hold."""
    qc = table(spark, sf_dir, "imageqc").select(*QC_COLUMNS).withColumn("empty", F.lit(None).cast("double"))
    parts = []
    for how in ("any", "all"):
        kept = ops.without_nan(ops.drop_empty_columns(qc, how))
        parts.append(kept.agg(F.array(*(F.struct(F.lit(c).alias("name"), F.count(c).alias("values")) for c in kept.columns)).alias("x")).select(F.lit(how).alias("how"), F.inline("x")))
    return parts[0].unionByName(parts[1])


def age_to_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_cells(spark, sf_dir).select("cell_id", "Row", "FieldOfView", F.col("Age").alias("AgeInput"), age_text(F.col("Age")).alias("Age"), age_days(F.col("Age")).alias("days"))


def split_by_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ops.split_by(placed_cells(spark, sf_dir), "Tissue", ["heart", "liver", "skin"])
    out = None
    for t, df in parts.items():
        one = df.select("cell_id", "Sample", F.lit(t).alias("part"))
        out = one if out is None else out.unionByName(one)
    return out


def split_by_every_tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every placed cell with its tissue, as it is written or null, as the part."""
    return placed_cells(spark, sf_dir).select("cell_id", "Sample", F.col("Tissue").alias("part"))


def platemap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    wells = table(spark, sf_dir, "platemap").filter(F.col("WellIndex").isNotNull()).groupBy("WellIndex").agg(F.min("Sample").alias("Sample"), F.min("Tissue").alias("Tissue"), F.min("Row").alias("Row"), F.min("Column").alias("Column"))
    cells = ops.without_nan(table(spark, sf_dir, "cells").select("WellIndex", "cell_id", *CELL_VALUES))
    return rounded(ops.with_platemap(cells, wells, check=False), *CELL_VALUES)


def clean_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages parsed, joined with the cells, thresholded by size, standardised."""
    from wellforge.operators.sampling import within_size, zscored

    wells = ops.ages_parsed(table(spark, sf_dir, "platemap")).groupBy("WellIndex").agg(F.min("Age").alias("Age"), F.min("AgeInput").alias("AgeInput"), F.min("Tissue").alias("Tissue"))
    cells = ops.without_nan(table(spark, sf_dir, "cells").select("WellIndex", "cell_id", *CELL_VALUES))
    sized = within_size(ops.with_platemap(cells, wells, check=False), CELL_VALUES[0], "median", 0.5, 1.5)
    return rounded(zscored(sized, CELL_VALUES), *CELL_VALUES)


def plate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first listed file of every well of every plate."""
    return ops.plate(table(spark, sf_dir, "file_information"), F.col("file_id"), row=["plate", "row"], column="column")


def plate_pivot_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    qc = ops.without_nan(table(spark, sf_dir, "imageqc"))
    return ops.plate(qc, r6(F.col("ch1_percent_max")), row=["row", "FOV"], column="column")


def plate_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per well on a grid whose rows and columns come from the well number itself."""
    wells = table(spark, sf_dir, "cells").filter("WellIndex IS NOT NULL").groupBy("WellIndex").agg(F.count("*").alias("n"))
    return ops.plate(wells.select(row_letter(F.col("WellIndex")).alias("Row"), (F.col("WellIndex") % 100).alias("Column"), "n"), F.col("n"))


def repeated_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.repeated_wells(table(spark, sf_dir, "imageqc"), ["plate", "WellIndex", "FOV"])


def cellcount_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ops.well_metadata(table(spark, sf_dir, "cells"), table(spark, sf_dir, "platemap"), F.count("cell_id"))
    return ops.plate(m, F.col("value"))


def _intensity(measure):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = ops.well_metadata(table(spark, sf_dir, "cells"), table(spark, sf_dir, "platemap"), measure(INTENSITY) if callable(measure) else measure)
        return ops.plate(m, r6(F.coalesce(F.col("value"), F.lit(0.0))))

    return query


def _cols(fmt: str) -> str:
    return ", ".join(fmt.format(i=i) for i in range(1, 25))


def _plate_sql(source: str, rows: str, col: str, value: str, zero: str = "0") -> str:
    cols = _cols(f"coalesce(min({value}) FILTER (WHERE {col} = {{i}}), {zero}) AS c{{i}}")
    return f"SELECT {rows}, {cols} FROM {source} GROUP BY {rows}"


def _nan(c: str) -> str:
    # isnan on a scanned column is folded from file statistics, which know no NaN; the text is not
    return f"""CASE WHEN CAST("{c}" AS VARCHAR) = 'nan' THEN NULL ELSE "{c}" END"""


_CELLS = "SELECT cell_id, \"WellIndex\", " + ", ".join(f"{_nan(c)} AS \"{c}\"" for c in CELL_VALUES) + " FROM cells"
_PLACED = '(SELECT c.cell_id, p.* FROM cells c JOIN platemap p ON p."WellIndex" = c."WellIndex")'
_WELLS = 'SELECT "WellIndex", min("Row") AS "Row", min("Column") AS "Column" FROM platemap GROUP BY 1'
_LIFE = r"B(\d\d-\d\d-\d{4})_D(\d\d-\d\d-\d{4})"
_DAYS = f"""coalesce(CASE WHEN regexp_matches("Age", '{_LIFE}') THEN date_diff('day', try_strptime(regexp_extract("Age", '{_LIFE}', 1), '%m-%d-%Y')::DATE,
  try_strptime(regexp_extract("Age", '{_LIFE}', 2), '%m-%d-%Y')::DATE)::INT END,
  CASE WHEN regexp_matches("Age", '\\d?\\d?\\d ?(day)s?') THEN regexp_extract("Age", '(\\d?\\d?\\d) ?(day)s?', 1)::INT END)"""
_AGE = f"""coalesce(({_DAYS}) || ' days', "Age")"""


def _map_sql(measure: str, zero: str) -> str:
    src = f"""(SELECT w.*, v.value FROM (SELECT "WellIndex", {measure} AS value FROM ({_CELLS}) WHERE "WellIndex" IS NOT NULL GROUP BY 1) v JOIN ({_WELLS}) w USING ("WellIndex"))"""
    return _plate_sql(src, '"Row"', '"Column"', "value", zero)


QUERIES = {
    f.__name__: f
    for f in (
        find_files, find_files_containing, parse_filenames, padded_wells, channel_balance, union_by_name, qc_clean, aggregate_mean, aggregate_median, aggregate_unique, single_valued,
        join_columns, group_col, join_iterables, float_texts, reorder_vector, cell_diameter, dropna_columns, age_to_days, split_by_tissue, split_by_every_tissue, platemap_join, clean_pipeline,
        plate_pivot, plate_pivot_fov, plate_letters, repeated_wells, cellcount_map,
    )
} | {"intensity_map_mean": _intensity(F.avg), "intensity_map_median": _intensity((INTENSITY, 0.5)), "intensity_map_quantile": _intensity((INTENSITY, 0.9))}

ORACLES = {
    "find_files": r"SELECT file_id, file_path FROM file_information WHERE regexp_matches(string_split(file_path, '/')[-1], '_z0?1\b|z01_')",
    "find_files_containing": r"""SELECT file_id, "Path" AS path FROM feature_files WHERE contains(string_split("Path", '/')[-1], '_features')""",
    "parse_filenames": rf"""
WITH m AS (SELECT file_id, regexp_matches(filename, '{NAME_PATTERN}') AS ok, regexp_extract(filename, '{NAME_PATTERN}', ['r', 'c', 'f', 'z', 't', 'ch']) AS g FROM file_information),
p AS (SELECT file_id, CASE WHEN ok THEN ascii(g.r) - 64 END AS "row", TRY_CAST(g.c AS INT) AS "column", TRY_CAST(g.f AS INT) AS "FOV",
      TRY_CAST(g.z AS INT) AS zstack, TRY_CAST(g.t AS INT) AS "time", CASE WHEN ok THEN g.ch END AS channel FROM m)
SELECT *, "row" * 1000 + "column" AS "WellIndex" FROM p""",
    "padded_wells": 'SELECT "row", "column", CASE WHEN "row" < 100 AND "column" < 100 THEN "row" * 100 + "column" END AS well, count(*) AS n FROM imageqc GROUP BY 1, 2',
    "channel_balance": """WITH n AS (SELECT lower(channel) AS channel, count(*) AS files FROM file_information GROUP BY 1)
SELECT channel, files, min(files) OVER () = max(files) OVER () AS balanced FROM n""",
    "union_by_name": f"""SELECT "WellIndex", plate, "FOV", round({_nan('ch1_percent_max')}, 6) AS ch1_percent_max, NULL AS "Sample", NULL AS "Tissue" FROM imageqc
UNION ALL SELECT "WellIndex", NULL, NULL, NULL, "Sample", "Tissue" FROM platemap""",
    "qc_clean": f"""WITH q AS (SELECT plate, "WellIndex", "row", "column", "FOV", round({_nan('ch1_percent_max')}, 6) AS ch1_percent_max, round({_nan('ch1_percent_median2sd')}, 6) AS ch1_percent_median2sd,
  round({_nan('ch1_loglog_slope')}, 6) AS ch1_loglog_slope FROM imageqc) SELECT * FROM q WHERE coalesce(ch1_percent_max, ch1_percent_median2sd, ch1_loglog_slope) IS NOT NULL""",
    "aggregate_mean": 'SELECT "WellIndex", ' + ", ".join(f'round(avg("{c}"), 9) AS "{c}"' for c in CELL_VALUES) + f' FROM ({_CELLS}) WHERE "WellIndex" IS NOT NULL GROUP BY 1',
    "aggregate_median": 'SELECT "WellIndex", ' + ", ".join(f'round(median("{c}"), 6) AS "{c}"' for c in CELL_VALUES) + f' FROM ({_CELLS}) WHERE "WellIndex" IS NOT NULL GROUP BY 1',
    "aggregate_unique": 'SELECT "Sample", ' + ", ".join(f'CASE WHEN count(DISTINCT "{c}") = 1 THEN max("{c}") END AS "{c}"' for c in ("WellIndex", "Age", "Tissue", "Condition", "Row", "Column", "FieldOfView")) + f' FROM {_PLACED} WHERE "Sample" IS NOT NULL GROUP BY 1',
    "single_valued": """WITH o AS (SELECT year(o_orderdate)::INT AS y, 'open' AS state, o_orderstatus FROM orders)
SELECT CASE WHEN count(DISTINCT y) = 1 THEN max(y) END AS y, CASE WHEN count(DISTINCT state) = 1 THEN max(state) END AS state, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS o_orderstatus FROM o""",
    "join_columns": f"""SELECT cell_id, coalesce("Tissue", 'nan') || '_' || coalesce("Condition", 'nan') || '_' || coalesce("FieldOfView"::VARCHAR, 'nan') AS joined FROM {_PLACED}""",
    "group_col": """SELECT dist_id, "Sample", "WellIndex", coalesce("Sample", 'nan') || '_' || coalesce("WellIndex"::VARCHAR, 'nan') AS "Group" FROM df_distance""",
    "join_iterables": f"""SELECT cell_id, concat_ws('_', "Sample", "Tissue", "Age") AS present, coalesce("Sample", 'None') || '_' || coalesce("Tissue", 'None') || '_' || coalesce("Age", 'None') AS every FROM {_PLACED}""",
    "float_texts": r"""WITH v AS (SELECT unnest(string_split(replace(content, chr(10), chr(9)), chr(9))) AS v FROM feature_files WHERE content <> '')
SELECT v = trim(v) AND (regexp_matches(v, '^[0-9]*$') OR regexp_matches(v, '^[0-9]*.[0-9]*$')) AS passes, count(*) AS n FROM v GROUP BY 1""",
    "reorder_vector": "SELECT cell_id, " + ", ".join(f"CASE WHEN isnan(data[{k}]) THEN NULL ELSE round(data[{k}], 6) END AS v{i}" for i, k in enumerate((3, 1, -1, 2))) + " FROM cells WHERE len(data) = 32",
    "cell_diameter": f"SELECT cell_id, round(sqrt(4 * \"MOR_object_pixel_count\" / pi()), 6) AS diameter FROM ({_CELLS})",
    "dropna_columns": "WITH c AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS name, count({_nan(c) if c.startswith("ch1") else f'"{c}"'}) AS "values", count(*) AS n FROM imageqc""" for c in QC_COLUMNS)
    + """ UNION ALL SELECT 'empty', 0, count(*) FROM imageqc), h AS (SELECT unnest(['any', 'all']) AS how) SELECT how, name, "values" FROM c, h WHERE CASE WHEN how = 'any' THEN "values" = n ELSE "values" > 0 END""",
    "age_to_days": f'SELECT cell_id, "Row", "FieldOfView", "Age" AS "AgeInput", {_AGE} AS "Age", {_DAYS} AS days FROM {_PLACED}',
    "split_by_tissue": f"""SELECT cell_id, "Sample", "Tissue" AS part FROM {_PLACED} WHERE "Tissue" IN ('heart', 'liver', 'skin')""",
    "split_by_every_tissue": f"""SELECT cell_id, "Sample", "Tissue" AS part FROM {_PLACED}""",
    "platemap_join": f"""SELECT w."WellIndex", w."Sample", w."Tissue", w."Row", w."Column", cell_id, {', '.join(f'round("{c}", 6) AS "{c}"' for c in CELL_VALUES)}
FROM ({_CELLS}) c JOIN (SELECT "WellIndex", min("Sample") AS "Sample", min("Tissue") AS "Tissue", min("Row") AS "Row", min("Column") AS "Column" FROM platemap GROUP BY 1) w USING ("WellIndex")""",
    "clean_pipeline": f"""WITH w AS (SELECT "WellIndex", min({_AGE}) AS "Age", min("Age") AS "AgeInput", min("Tissue") AS "Tissue" FROM platemap GROUP BY 1),
j AS (SELECT w.*, c.* EXCLUDE ("WellIndex") FROM ({_CELLS}) c JOIN w USING ("WellIndex")),
m AS (SELECT median("MOR_object_pixel_count") AS m FROM j),
s AS (SELECT j.* FROM j, m WHERE "MOR_object_pixel_count" > 0.5 * m AND "MOR_object_pixel_count" < 1.5 * m)
SELECT "WellIndex", "Age", "AgeInput", "Tissue", cell_id, {', '.join(f'round(("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER (), 6) AS "{c}"' for c in CELL_VALUES)} FROM s""",
    "plate_pivot": _plate_sql("file_information", 'plate, "row"', '"column"', "file_id"),
    "plate_pivot_fov": _plate_sql("imageqc", '"row", "FOV"', '"column"', f"round({_nan('ch1_percent_max')}, 6)", "0.0"),
    "plate_letters": _plate_sql('(SELECT chr((64 + "WellIndex" // 1000)::INT) AS "Row", "WellIndex" % 100 AS "Column", count(*) AS n FROM cells WHERE "WellIndex" IS NOT NULL GROUP BY "WellIndex")', '"Row"', '"Column"', "n"),
    "repeated_wells": 'SELECT plate, "WellIndex", "FOV", count(*) AS n FROM imageqc GROUP BY 1, 2, 3 HAVING count(*) > 1',
    "cellcount_map": _map_sql("count(cell_id)", "0"),
    "intensity_map_mean": _map_sql('round(coalesce(avg("Ch1_object_average_intensity"), 0), 6)', "0.0"),
    "intensity_map_median": _map_sql('round(coalesce(median("Ch1_object_average_intensity"), 0), 6)', "0.0"),
    "intensity_map_quantile": _map_sql('round(coalesce(quantile_cont("Ch1_object_average_intensity", 0.9), 0), 6)', "0.0"),
}
