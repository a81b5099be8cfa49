"""Thresholds, scaling, bins and bootstraps, with hash-based sampling that any engine can repeat."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellforge.functions.text import pixel_diameter


def exact_quantile(df: DataFrame, x: Column, p: float, gather: int = 100_000) -> float | None:
    """The p-quantile of all values, linear between neighbours; null and NaN do not count, None if there are none.

    At most `gather` numbers (800 kB) reach the driver. If the approximation fails to narrow, pieces of the values are sorted in
    tasks instead (`group_quantiles`). The rows between two approximate quantiles around the wanted rank are counted, again and again closer, until at most `gather`
    are left or all are equal; only those are sorted in one place. Each round is two aggregations and leaves about a thousandth.
    """
    values = df.select(x.cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    rank = p * (n - 1)
    first = int(rank)
    last = min(first + 1, n - 1)
    below, inside = 0, n
    share = 2e-3
    while inside > gather and low < high:
        between = values.filter(F.col("x").between(low, high))
        at = (first - below) / inside
        ends = [max(0.0, at - share), min(1.0, at + share)]
        a, b = between.agg(F.percentile_approx("x", F.array(*map(F.lit, ends)), 10_000)).first()[0]
        less, within = between.agg(F.count_if(F.col("x") < a), F.count_if(F.col("x").between(a, b))).first()
        if below + less <= first and last < below + less + within and within < inside:
            low, high, below, inside = a, b, below + less, within
        else:
            share *= 4  # the approximation missed the rank
            if share > 1:
                break
    if low == high:
        return float(low)
    rows = [r["x"] for r in values.filter(F.col("x").between(low, high)).groupBy("x").agg(F.count("*").alias("c")).orderBy("x").selectExpr("x", "c").collect() for _ in range(r["c"])] if inside <= gather else None
    if rows is None:
        return group_quantiles(values.withColumn("_all", F.lit(0)), ["_all"], "x", (p,)).first()["value"]
    u, v = rows[first - below], rows[last - below]
    return u + (v - u) * (rank - first)


def group_quantiles(df: DataFrame, by: Sequence[str], column: str, percents: Sequence[float], pieces: int = 64) -> DataFrame:
    """(by.., p, value): exact quantiles of each group, linear between neighbours; null and NaN do not count, a null key is a group.

    Equal values of a group are counted together in the tasks. Each group is cut at approximate quantiles of itself; the counts of
    its pieces say in which of them a rank lies, and only those pieces are sorted. So a group with a third of all rows is spread
    over `pieces` tasks, and no task holds more than a piece of its distinct values.
    """
    rows = df.select(*by, F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    cuts = rows.groupBy(*by).agg(F.percentile_approx("_x", F.array(*(F.lit(i / pieces) for i in range(1, pieces))), 50 * pieces).alias("_cuts"), F.count("*").alias("_n"))
    counted = rows.groupBy(*by, "_x").agg(F.count("*").alias("_c"))
    placed = counted.alias("a").join(cuts.alias("b"), same("a", "b", by)).select("a.*", "_n", F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).alias("_piece"))
    upto = F.sum("_m").over(Window.partitionBy(*by).orderBy("_piece"))
    sizes = placed.groupBy(*by, "_piece", "_n").agg(F.sum("_c").alias("_m")).withColumn("_before", upto - F.col("_m"))
    p = F.explode(F.array(*(F.lit(float(x)) for x in percents)))
    ranked = sizes.withColumn("p", p).withColumn("_r", F.col("p") * (F.col("_n") - 1)).withColumn("_low", F.floor("_r")).withColumn("_high", F.least(F.col("_low") + 1, F.col("_n") - 1))
    holds = lambda rank: (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_m"))
    hit = ranked.filter(holds("_low") | holds("_high"))
    keys = [*by, "_piece"]
    inside = placed.alias("a").join(hit.alias("h"), same("a", "h", keys)).select(*(F.col(f"a.{k}").alias(k) for k in by), "p", "a._piece", "_x", "_c", "_r", "_low", "_high", "_before")
    run = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "p", "_piece").orderBy("_x")))
    first = lambda rank: F.min(F.when((F.col("_upto") > F.col(rank)) & (F.col("_before") <= F.col(rank)), F.col("_x")))
    ends = run.groupBy(*by, "p", "_r", "_low").agg(first("_low").alias("_u"), first("_high").alias("_v"))
    # weighted ends: the middle of two values is then rounded once, and an end alone stays as it is
    share = F.col("_r") - F.col("_low")
    return ends.select(*by, "p", F.when(share == 0, F.col("_u")).otherwise(F.col("_u") * (1 - share) + F.col("_v") * share).alias("value"))


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """What a box plot and error bars show: (group, n, mean, std, q1, q2, q3, low, high), the whiskers within 1.5 interquartile ranges.

    Groups with a null key and values that are null or NaN are left out.
    """
    rows = df.select(F.col(group), F.col(value).alias("_v")).filter(F.col(group).isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v"))
    means = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    q = group_quantiles(rows, [group], "_v", (0.25, 0.5, 0.75)).groupBy(group).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = rows.join(q.select(group, "q1", "q3"), group).filter(F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)).groupBy(group).agg(F.min("_v").alias("low"), F.max("_v").alias("high"))
    return means.join(q, group).join(ends, group)


def category_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by.., n, mean, std) of the values of each category; categories with a null key are left out."""
    return df.na.drop("any", subset=list(by)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(low, n): rows per class of `width`; null and NaN values are left out."""
    x = F.col(value)
    return df.filter(x.isNotNull() & ~F.isnan(x.cast("double"))).groupBy((F.floor(x / width) * width).alias("low")).agg(F.count("*").alias("n"))


def thresholds(df: DataFrame, column: str, metric: str = "median", low: float = 0.0, high: float = 2.0, diameter: bool = False) -> tuple[float | None, float | None]:
    """Lower and upper threshold: multiples of the median or mean, quantiles, or the values themselves; None without values."""
    x = pixel_diameter(F.col(column)) if diameter else F.col(column)
    if metric == "values":
        return float(low), float(high)
    if metric == "quantile":
        return exact_quantile(df, x, low), exact_quantile(df, x, high)
    centre = exact_quantile(df, x, 0.5) if metric == "median" else df.agg(F.avg(F.when(~F.isnan(x), x))).first()[0]
    return (None, None) if centre is None else (centre * low, centre * high)


def within_size(df: DataFrame, column: str, metric: str = "median", low: float = 0.0, high: float = 2.0, diameter: bool = False) -> DataFrame:
    """Rows strictly between the thresholds; null and NaN sizes are left out. The filter holds two literals and is pushed down."""
    x = pixel_diameter(F.col(column)) if diameter else F.col(column)
    least, most = thresholds(df, column, metric, low, high, diameter)
    return df.filter(~F.isnan(x) & (x > F.lit(least).cast("double")) & (x < F.lit(most).cast("double")))


def zscored(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns less their mean over their population standard deviation; 0 for a constant column."""
    stats = [f(F.when(~F.isnan(c), F.col(c))).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    wide = df.crossJoin(F.broadcast(df.agg(*stats)))
    z = {c: F.when(F.col(f"_s_{c}") == 0, 0.0).otherwise((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns}
    return wide.withColumns(z).select(*df.columns)


def hashed(seed: int, *parts: Column) -> Column:
    """32 hex digits that are even over the ids and the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def positions(df: DataFrame, by: Sequence[str], order: Sequence[Column], ranges: int = 64) -> DataFrame:
    """Adds `pos` (from 0) and `size` in each group under `order`, whose first term is a hash in hex digits.

    A group is numbered in `ranges` pieces: the hash is even, so its leading digits give ranges of about equal size. Rows are
    numbered within a range and the sizes of the ranges before it are added: a group with a third of all rows is spread over
    `ranges` tasks instead of one. `ranges` is at most 256.
    """
    piece = F.floor(F.conv(F.substring(order[0], 1, 2), 16, 10).cast("int") * ranges / 256).cast("int")
    rows = df.withColumn("_piece", piece)
    inside = Window.partitionBy(*by, "_piece").orderBy(*order)
    counts = rows.groupBy(*by, "_piece").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = counts.select(*by, "_piece", (F.sum("_n").over(group.orderBy("_piece")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("size"))
    return rows.withColumn("_in", F.row_number().over(inside)).join(before, [*by, "_piece"]).withColumn("pos", F.col("_before") + F.col("_in") - 1).drop("_piece", "_in", "_before")


def bins(df: DataFrame, by: Sequence[str], ids: Sequence[str], size: int = 200, seed: int = 0) -> DataFrame:
    """Adds `bin` (from 1): each group in random bins of exactly `size` rows without replacement; what is left over goes.

    Groups with a null key are left out. `ids` must tell rows apart.
    """
    rows = df.na.drop("any", subset=list(by))
    order = [hashed(seed, *(F.col(c) for c in ids)), *(F.col(c) for c in ids)]
    placed = positions(rows, by, order)
    return placed.withColumn("bin", F.floor(F.col("pos") / size) + 1).filter(F.col("bin") <= F.floor(F.col("size") / size)).drop("pos", "size")


def bootstrap(df: DataFrame, by: Sequence[str], ids: Sequence[str], columns: Sequence[str], draws: int | str, rounds: int, metric: str | Callable[[str], Column] = "mean", seed: int = 0, small: str = "draw") -> DataFrame:
    """Per group `rounds` resamples of `draws` rows with replacement ("original": as many as the group has), each reduced by `metric`.

    The metric is the mean, the standard deviation ("std"), or any aggregate of a column. Groups smaller than `draws` are drawn from
    all the same, or with small="raise" raise ValueError. The drawn position is a hash of seed, group, round and draw. A draw
    fetches its row by an equi-join on group and position; rows never drawn are not aggregated.
    """
    reduce = metric if callable(metric) else {"mean": F.avg, "std": F.stddev_samp}[metric]
    rows = df.na.drop("any", subset=list(by))
    order = [hashed(seed, *(F.col(c) for c in ids)), *(F.col(c) for c in ids)]
    numbered = positions(rows, by, order).select(*by, "pos", *columns)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("size"))
    if small == "raise" and draws != "original" and (least := sizes.agg(F.min("size")).first()[0]) is not None and least < draws:
        raise ValueError(f"a group has {least} rows, fewer than the {draws} to draw")
    last = F.col("size") if draws == "original" else F.lit(draws)
    draw = sizes.withColumn("bootstrap", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("j", F.explode(F.sequence(F.lit(1), last.cast("int"))))
    at = F.pmod(F.conv(F.substring(hashed(seed, *(F.col(c) for c in by), F.col("bootstrap"), F.col("j")), 1, 8), 16, 10).cast("long"), F.col("size"))
    return draw.withColumn("pos", at).join(numbered, [*by, "pos"]).groupBy(*by, "bootstrap").agg(*(reduce(c).alias(c) for c in columns))


def centroids(df: DataFrame, sample: Sequence[str], columns: Sequence[str], bin_size: int = 200) -> DataFrame:
    """Means per sample and their standard errors, `<column>_SEM`, for bins of `bin_size` rows."""
    means = [F.avg(c).alias(c) for c in columns]
    errors = [(F.stddev_samp(c) / F.sqrt(F.lit(float(bin_size)))).alias(f"{c}_SEM") for c in columns]
    return df.groupBy(*sample).agg(*means, *errors)


def group_centroids(samples: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means of the samples' means per group; the squares of their standard errors add up."""
    means = [F.avg(c).alias(c) for c in columns]
    errors = [F.sqrt(F.sum(F.col(f"{c}_SEM") ** 2)).alias(f"{c}_SEM") for c in columns]
    return samples.groupBy(*groups).agg(*means, *errors)


def variation(x: str) -> Column:
    """Population standard deviation over the mean, a mean of 0 counting as 1e-15."""
    return F.stddev_pop(x) / F.when(F.avg(x) == 0, 1e-15).otherwise(F.avg(x))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: term, sum_sq, df, mean_sq, f, eta_sq, omega_sq for 'group' and 'residual'.

    Sums of squares come from counts, sums and means per group: one aggregation of the rows. Null groups and values do not count.
    """
    rows = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    one = per.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    mse = F.col("within") / (F.col("n") - F.col("k"))
    base = one.select(between.alias("b"), F.col("within").alias("w"), (F.col("k") - 1).alias("db"), (F.col("n") - F.col("k")).alias("dw"), mse.alias("mse"))
    total = F.col("b") + F.col("w")
    terms = F.array(
        F.struct(F.lit("group").alias("term"), F.col("b").alias("sum_sq"), F.col("db").alias("df"), (F.col("b") / F.col("db")).alias("mean_sq"), (F.col("b") / F.col("db") / F.col("mse")).alias("f"), (F.col("b") / total).alias("eta_sq"), ((F.col("b") - F.col("db") * F.col("mse")) / (total + F.col("mse"))).alias("omega_sq")),
        F.struct(F.lit("residual").alias("term"), F.col("w").alias("sum_sq"), F.col("dw").alias("df"), F.col("mse").alias("mean_sq"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("double").alias("eta_sq"), F.lit(None).cast("double").alias("omega_sq")),
    )
    return base.select(F.explode(terms).alias("t")).select("t.*")


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row on y = slope x + intercept: n, slope, intercept, sse, ss_total, r2, f, aic, bic.

    The sums are taken around the means by built-in aggregates, so one pass over the rows suffices.
    """
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    one = ok.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("ss_total"), F.regr_r2(y, x).alias("r2"))
    n, sse = F.col("n").cast("double"), F.col("ss_total") * (1 - F.col("r2"))
    likely = n * F.log(2 * F.pi() * sse / n)
    f = F.try_divide(F.col("r2") * (n - 2), 1 - F.col("r2"))
    return one.select("n", "slope", "intercept", sse.alias("sse"), "ss_total", "r2", f.alias("f"), aic(n, 2, sse).alias("aic"), (likely + F.log(n) * 3 + n).alias("bic"))


def f_test_p(df: DataFrame, f: float, between: float, within: float) -> float:
    """The chance of a larger F under no effect, from the distribution functions that come with Spark."""
    jvm = df.sparkSession.sparkContext._jvm
    return 1.0 - jvm.org.apache.commons.math3.distribution.FDistribution(float(between), float(within)).cumulativeProbability(float(f))


def anova_with_p(df: DataFrame, group: str, value: str) -> DataFrame:
    """The two rows of `anova` with the chance of the group's F, null for the residual."""
    table = anova(df, group, value)
    rows = {r["term"]: r for r in table.collect()}
    g, w = rows["group"], rows["residual"]
    p = f_test_p(df, g["f"], g["df"], w["df"]) if g["f"] is not None and g["df"] and w["df"] else None
    return table.withColumn("p_value", F.when(F.col("term") == "group", F.lit(p).cast("double")))


def curve_anova(df: DataFrame, predicted: Column, y: str, parameters: int, is_line: bool = False) -> DataFrame:
    """Analysis of variance of a fitted curve: rows 'model', 'treatment', 'residual', 'uncorrected total' and 'corrected total'.

    (term, df, sum_sq, mean_sq, f, p_value, r2, adjusted_r2, aic, bic); f and what follows stand in the row 'treatment', which
    compares the curve with the mean alone. r2 is against the mean for a line, else against zero. All sums come from one
    aggregation of the rows; rows without a value or a prediction do not count.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), predicted.cast("double").alias("f")).filter("y IS NOT NULL AND f IS NOT NULL AND NOT isnan(y) AND NOT isnan(f)")
    mean = rows.agg(F.avg("y").alias("m"))
    one = rows.crossJoin(F.broadcast(mean)).agg(
        F.count("*").alias("n"), F.sum(F.col("y") ** 2).alias("ss"), F.sum(F.col("f") ** 2).alias("model"), F.sum((F.col("y") - F.col("m")) ** 2).alias("sst"),
        F.sum((F.col("f") - F.col("y")) ** 2).alias("sse"), F.sum((F.col("f") - F.col("m")) ** 2).alias("ssr"),
    ).first()
    n, p = one["n"], parameters
    if n <= p:
        raise ValueError("a curve needs more rows than parameters")
    residual = one["sse"] / (n - p)
    f = one["ssr"] / (p - 1) / residual if p > 1 and residual else None
    r2 = 1 - one["sse"] / one["sst" if is_line else "ss"]
    adjusted = 1 - (1 - r2) * (n - 1 if is_line else n) / (n - p)
    fit = [f, f_test_p(df, f, p - 1, n - p) if f is not None else None, r2, adjusted]
    none = [None] * 4
    out = [
        ("model", p, one["model"], one["model"] / p, *none, n), ("treatment", p - 1, one["ssr"], one["ssr"] / (p - 1) if p > 1 else None, *fit, n), ("residual", n - p, one["sse"], residual, *none, n),
        ("uncorrected total", n, one["ss"], None, *none, n), ("corrected total", n - 1, one["sst"], None, *none, n),
    ]
    table = df.sparkSession.createDataFrame(out, "term string, df long, sum_sq double, mean_sq double, f double, p_value double, r2 double, adjusted_r2 double, n long")
    only = lambda c: F.when(F.col("term") == "treatment", c)
    return table.withColumn("aic", only(aic(F.col("n"), p, F.lit(one["sse"])))).withColumn("bic", only(bic(F.col("n"), p, F.lit(one["sse"])))).drop("n")


def aic(n: Column, k: int, rss: Column) -> Column:
    return n * F.log(2 * F.pi() * rss / n) + 2 * (k + 1) + n


def bic(n: Column, k: int, rss: Column) -> Column:
    return n * F.log(2 * F.pi() * rss / n) + F.log(n) * (k + 1) + n


def exponential(x: Column, a: float, b: float, c: float) -> Column:
    return a * F.exp(b * x) + c


def inverse(x: Column, a: float, b: float, c: float) -> Column:
    return F.try_divide(F.lit(a), x - b) + c


def linear(x: Column, a: float, b: float) -> Column:
    return b * x + a


def power_law(x: Column, m: float, c: float, y0: float) -> Column:
    return c * F.pow(x, F.lit(m)) + y0


def multi_otsu(df: DataFrame, column: str, classes: int = 3, bins_: int = 256) -> list[float]:
    """Thresholds that part the values into `classes` with the greatest variance between them.

    The histogram is one aggregation of the rows; only its `bins_` counts reach the driver, where the best cuts are found by
    dynamic programming over prefix sums.
    """
    x = F.col(column)
    ok = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ends = ok.agg(F.min(x), F.max(x)).first()
    if ends[0] is None or ends[0] == ends[1]:
        return []
    low, width = float(ends[0]), (float(ends[1]) - float(ends[0])) / bins_
    part = F.least(F.floor((x - low) / width), F.lit(bins_ - 1))
    count = {r["b"]: r["n"] for r in ok.groupBy(part.alias("b")).agg(F.count("*").alias("n")).collect()}
    weight, moment = [0.0], [0.0]
    for b in range(bins_):
        weight.append(weight[-1] + count.get(b, 0))
        moment.append(moment[-1] + count.get(b, 0) * (low + (b + 0.5) * width))

    def gain(i: int, j: int) -> float:
        w = weight[j] - weight[i]
        return (moment[j] - moment[i]) ** 2 / w if w else 0.0

    best, came = [gain(0, j) for j in range(bins_ + 1)], []
    for _ in range(classes - 1):
        # of equal cuts, as in a gap without values, the lowest
        step, back = [0.0], [0]
        for j in range(1, bins_ + 1):
            total, cut = -1.0, 0
            for i in range(j):
                if (value := best[i] + gain(i, j)) > total * (1 + 1e-12):
                    total, cut = value, i
            step.append(total)
            back.append(cut)
        best = step
        came.append(back)
    cuts, j = [], bins_
    for back in reversed(came):
        j = back[j]
        cuts.append(low + (j - 0.5) * width)
    return sorted(cuts)
