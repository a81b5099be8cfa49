"""Percentiles of very large columns per group: exact bisection on value intervals, from counts that can be combined.

A summary counts the values of each group in dyadic cells: the first levels of the bisection, all midpoints at once. Summaries of
days or partitions are added up (`combine`), and the interval of every percentile follows from them with a known error bound. To
resolve it further, only rows inside an interval are read again, and each pass counts them below the midpoints of the interval
until the target rank is reached. The result is exact, or as near as asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellforge.session import stored

BITS = 5  # a cell spans 2**-BITS of its power of two, so its ends differ by 3.2 % at most
SECTIONS = 16  # parts that a pass divides an interval into: four levels of bisection
KEYS = ["kind", "key"]


def cell_of(v: Column) -> Column:
    """A number that grows with `v`, equal within a cell: sign, exponent and the first BITS bits of the mantissa."""
    a = F.abs(v)
    e = F.floor(F.log2(a))
    m = F.floor((a / F.pow(F.lit(2.0), e) - 1) * (1 << BITS))
    inside = (F.signum(v) * ((e + 1100) * (1 << BITS) + m)).cast("long")
    return F.when(v == 0, F.lit(0).cast("long")).when(a == float("inf"), F.signum(v).cast("long") * F.lit(1 << 40)).when(a < 1e-300, F.signum(v).cast("long")).otherwise(inside)


def valued(values: DataFrame) -> DataFrame:
    """Rows (kind, key, v) that count: v neither null nor NaN. Infinities count and lie at the ends; -0.0 is 0.0."""
    return values.filter(F.col("v").isNotNull() & ~F.isnan("v")).select("kind", F.col("key").cast("string").alias("key"), (F.col("v").cast("double") + F.lit(0.0)).alias("v"))


def summarise(values: DataFrame) -> DataFrame:
    """The mergeable form: (kind, key, cell, n, low, high), aggregated in the tasks before the shuffle. A null key is a group."""
    rows = valued(values).withColumn("cell", cell_of(F.col("v")))
    return rows.groupBy(*KEYS, "cell").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def combine(summaries: Iterable[DataFrame]) -> DataFrame:
    """The summary of all rows of several summaries."""
    rows = reduce(DataFrame.unionByName, summaries)
    return rows.groupBy(*KEYS, "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def intervals(summary: DataFrame, percents: Iterable[float]) -> DataFrame:
    """(kind, key, p, n, cell, rank, within, low, high): for each p the interval that holds the value of rank ceil(p n).

    `rank` counts within the interval's `within` rows. A group has at most some thousand cells, whatever its rows.
    """
    w = Window.partitionBy(*KEYS)
    run = w.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = summary.select("*", F.sum("n").over(w).alias("total"), F.sum("n").over(run).alias("upto"))
    p = F.explode(F.array(*(F.lit(float(x)) for x in percents)))
    # the product is rounded first, so that 0.95 * 100 has rank 95 and not 96
    target = F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("total"), 9)).cast("long"))
    ranked = cells.withColumn("p", p).withColumn("target", target)
    hit = ranked.filter((F.col("target") <= F.col("upto")) & (F.col("target") > F.col("upto") - F.col("n")))
    return hit.select(*KEYS, "p", F.col("total").alias("n"), "cell", (F.col("target") - F.col("upto") + F.col("n")).alias("rank"), F.col("n").alias("within"), "low", "high")


def _narrowed(iv: DataFrame) -> DataFrame:
    """First and last ranks are the interval's ends themselves."""
    ends = iv.withColumn("high", F.when(F.col("rank") == 1, F.col("low")).otherwise(F.col("high")))
    return ends.withColumn("low", F.when(F.col("rank") == F.col("within"), F.col("high")).otherwise(F.col("low")))


MOST_SENT = 32 << 20  # bytes of a table of intervals that are sent to all tasks; beyond, it is joined by shuffle, with equal rows


def _size(small: DataFrame) -> tuple[int, int]:
    """Rows of a table of intervals, and about how many bytes they are: their keys and ten numbers each."""
    n, letters = small.agg(F.count("*"), F.coalesce(F.sum(F.length("kind") + F.coalesce(F.length("key"), F.lit(0))), F.lit(0))).first()
    return n, 4 * int(letters) + 80 * n


def _sent(small: DataFrame, size: int) -> DataFrame:
    return F.broadcast(small) if size <= MOST_SENT else small


def percentiles(values: DataFrame, percents: Iterable[float], max_error: float = 0.0, summary: DataFrame | None = None) -> DataFrame:
    """(kind, key, p, n, value, error) of `values` (kind, key, v): the smallest value with at least p n values up to it.

    `error` bounds the distance from the true value; with `max_error` 0 it is 0 throughout. Groups without any value have no row.
    Two scans of `values` (one, if a summary is given); later passes read only the distinct values inside open intervals.
    """
    first = stored(summary if summary is not None else summarise(values), "percentile_cells")
    now = stored(_narrowed(intervals(first, percents)), "percentile_intervals")
    # two infinite ends are equal, but their difference is NaN, which Spark holds to be larger than any number
    wide = (F.col("low") != F.col("high")) & ((F.col("high") - F.col("low")) > 2 * max_error)
    done = [now.filter(~wide)]
    open_ = now.filter(wide)
    targets = open_.select(*KEYS, "cell").distinct()
    n, size = _size(targets)
    if n:
        rows = valued(values).withColumn("cell", cell_of(F.col("v")))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*KEYS, "cell")]
        inside = rows.alias("r").join(_sent(targets, size).alias("t"), same, "left_semi")
        inside = stored(inside.groupBy(*KEYS, "cell", "v").agg(F.count("*").alias("c")), "percentile_rows")
    if n:
        n, size = _size(open_)
    while n:
        now = stored(_pass(inside, open_, size), "percentile_intervals")
        done.append(now.filter(~wide))
        open_ = now.filter(wide)
        n, size = _size(open_)
    out = reduce(DataFrame.unionByName, done)
    # infinite ends are resolved intervals; their mean and difference would not be numbers
    exact = F.col("low") == F.col("high")
    value = F.when(exact, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) / 2)
    return out.select(*KEYS, "p", "n", value.alias("value"), F.when(exact, 0.0).otherwise((F.col("high") - F.col("low")) / 2).alias("error"))


def _pass(inside: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """One pass: rows of each interval counted below its midpoints, and the part that holds the rank."""
    iv = open_.select(*KEYS, "cell", "p", "n", "rank", "low", "high")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"i.{c}")) for c in (*KEYS, "cell")]
    joined = inside.alias("r").join(_sent(iv, size).alias("i"), [*same, F.col("r.v").between(F.col("i.low"), F.col("i.high"))])
    step = (F.col("i.high") - F.col("i.low")) / SECTIONS
    # a step of 0 (neighbouring numbers) leaves the two ends
    part = F.when(F.col("r.v") >= F.col("i.high"), F.lit(SECTIONS - 1)).when(step > 0, F.least(F.lit(SECTIONS - 1), F.floor((F.col("r.v") - F.col("i.low")) / F.greatest(step, F.lit(5e-324))).cast("int"))).otherwise(0)
    parts = joined.groupBy(*(F.col(f"i.{c}").alias(c) for c in (*KEYS, "cell", "p", "n", "rank")), part.alias("part")).agg(
        F.sum("r.c").alias("within"), F.min("r.v").alias("low"), F.max("r.v").alias("high")
    )
    run = Window.partitionBy(*KEYS, "p").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = parts.withColumn("upto", F.sum("within").over(run))
    hit = upto.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("within")))
    return _narrowed(hit.select(*KEYS, "p", "n", "cell", (F.col("rank") - F.col("upto") + F.col("within")).alias("rank"), "within", "low", "high"))
