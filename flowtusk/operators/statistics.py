"""Descriptive statistics of table columns, whole or per group.

Skewness and kurtosis are the population forms, kurtosis in excess of 3. Percentiles
interpolate linearly. NULLs are left out. What too few rows or values without spread leave
undefined is 0; NaN among the values stays NaN.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtusk.functions.addresses import _col
from flowtusk.plans.ordering import with_global_position, with_running_total
from flowtusk.plans.storage import store


SALTS = 32


def _join_groups(values: DataFrame, groups: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Join one row per group to the group's distinct values, a large group over `SALTS` tasks."""
    salted = values.withColumn("__salt", F.pmod(F.xxhash64(x), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*by, "__salt"]).drop("__salt")


def _variance(x: Column) -> Column:
    return F.when(F.count(x) < 2, F.lit(0.0)).otherwise(F.var_samp(x))


def _shape(measure, x: Column) -> Column:
    return F.when(_variance(x) == 0, F.lit(0.0)).otherwise(measure(x))


def _both(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull()


def _covariance(x: str, y: str) -> Column:
    return F.when(F.count_if(_both(x, y)) < 2, F.lit(0.0)).otherwise(F.covar_samp(x, y))


def _corr(x: str, y: str) -> Column:
    """Pearson correlation of the rows that have both values, 0 where undefined.

    The built-in function divides by zero for constant columns in ANSI mode.
    """
    both = _both(x, y)
    spread = F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y)))
    undefined = (F.count_if(both) < 2) | (spread == 0)
    return F.when(undefined, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def sample_mean(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(x).alias("mean"))


def sample_variance(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Divided by n-1; 0 for a single row."""
    return df.groupBy(*by).agg(_variance(_col(x)).alias("variance"))


def sample_skewness(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """0 where the variance is 0."""
    return df.groupBy(*by).agg(_shape(F.skewness, _col(x)).alias("skewness"))


def sample_kurtosis(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """0 where the variance is 0."""
    return df.groupBy(*by).agg(_shape(F.kurtosis, _col(x)).alias("kurtosis"))


def sample_moments(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, variance, skewness and kurtosis in one pass."""
    c = _col(x)
    return df.groupBy(*by).agg(F.avg(c).alias("mean"), _variance(c).alias("variance"),
                               _shape(F.skewness, c).alias("skewness"), _shape(F.kurtosis, c).alias("kurtosis"))


def sample_adev(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute deviation from the mean, in two passes."""
    if not by:
        mean = df.agg(F.avg(x).alias("m")).scalar()
        return df.agg(F.avg(F.abs(F.col(x) - mean)).alias("adev"))
    # Equal values are merged before the means are joined.
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
    means = df.groupBy(*by).agg(F.avg(x).alias("m"))
    away = F.abs(F.col(x) - F.col("m")) * F.col("n")
    return _join_groups(counts, means, by, x).groupBy(*by).agg((F.sum(away) / F.sum("n")).alias("adev"))


def sample_percentile(df: DataFrame, x: str, percentiles: Sequence[float], by: Sequence[str] = (),
                      weight: str | None = None) -> DataFrame:
    """Exact percentiles, one row per group with columns `p0`, `p1`, ... in the order given.

    Values are counted, ordered globally and given running totals; no group is gathered in
    one buffer. `weight` names a column that says how often a row counts. Runs one job.
    """
    if any(not 0 <= p <= 1 for p in percentiles):
        raise ValueError("percentiles must lie between 0 and 1")
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(times.alias("n"))
    ranked = with_running_total(counts, [*by, x], "n")
    groups = ranked.groupBy(*by).agg(F.min("before").alias("start"), F.sum("n").alias("size"))
    if by:
        placed = _join_groups(ranked, groups, by, x).withColumn("before", F.col("before") - F.col("start"))
    else:
        placed = ranked.withColumn("size", groups.select("size").scalar())
    chosen, result = [], []
    for at, p in enumerate(percentiles):
        target = F.lit(float(p)) * (F.col("size") - 1)
        low = F.floor(target)
        covers = {}
        for name, position in (("lo", low), ("hi", F.least(low + 1, F.col("size") - 1))):
            inside = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
            covers[name] = F.max(F.when(inside, F.col(x))).cast("double").alias(f"{name}{at}")
        chosen += [*covers.values(), F.max(target - low).alias(f"w{at}")]
        lo, hi = F.col(f"lo{at}"), F.col(f"hi{at}")
        result.append((lo + (hi - lo) * F.col(f"w{at}")).alias(f"p{at}"))
    return placed.groupBy(*by).agg(*chosen).select(*by, *result)


def sample_median(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    return sample_percentile(df, x, [0.5], by).withColumnRenamed("p0", "median")


def cov2(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample covariance; 0 for fewer than two rows."""
    return df.groupBy(*by).agg(_covariance(x, y).alias("cov"))


def pearson_corr2(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation; 0 where undefined."""
    return df.groupBy(*by).agg(_corr(x, y).alias("corr"))


def average_ranks(df: DataFrame, x: str) -> DataFrame:
    """Each distinct value with its rank from 0 over all rows, ties averaged. Runs one job."""
    counts = df.groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    return with_running_total(counts, [x], "n").select(
        x, (F.col("before") + (F.col("n") - 1) / 2.0).alias("rank"))


def spearman_corr2(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of the average ranks; 0 where undefined.

    Equal (x, y) rows are merged first. A value that still occurs in very many pairs is split
    by adaptive skew joins, as the rank side holds it once.
    """
    both = df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    pairs = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    ranked = (pairs.join(average_ranks(both, "x").withColumnRenamed("rank", "rx"), "x")
              .join(average_ranks(both, "y").withColumnRenamed("rank", "ry"), "y"))
    middle = (both.agg(F.count(F.lit(1)).alias("c")).scalar() - 1) / 2.0
    n, dx, dy = F.col("n"), F.col("rx") - middle, F.col("ry") - middle
    sums = ranked.agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"))
    return sums.select(F.coalesce(F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))), F.lit(0.0)).alias("corr"))


def _matrix(df: DataFrame, pairs: list[tuple[str, str]], measure) -> DataFrame:
    """One aggregation of all distinct pairs, in long form `i, j, v`."""
    unordered = list(dict.fromkeys(tuple(sorted(p)) for p in pairs))
    names = {p: f"v{at}" for at, p in enumerate(unordered)}
    row = df.agg(*[measure(*p).alias(names[p]) for p in unordered])
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(names[tuple(sorted((i, j)))]).alias("v"))
        for i, j in pairs])
    return row.select(F.inline(cells))


def cov_matrix(df: DataFrame, xs: Sequence[str], ys: Sequence[str] | None = None) -> DataFrame:
    """Covariances of all columns `xs`, or of each `xs` with each `ys`."""
    return _matrix(df, list(product(xs, ys or xs)), _covariance)


def pearson_matrix(df: DataFrame, xs: Sequence[str], ys: Sequence[str] | None = None) -> DataFrame:
    return _matrix(df, list(product(xs, ys or xs)), _corr)


#: Columns of up to about so many different values have a table of ranks that is sent to every task.
BROADCAST_RANKS = 1_000_000


def column_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`columns` of the rows that have all of them, each replaced by its rank from 0, ties averaged.

    The ranks of a column with few different values come from their counts, and its rows are not shuffled. All
    other columns are stacked and sorted at once: two shuffles whatever their number. Of equal values the
    places ascend by row in one half of the sort and descend in the other; the mean of both is the
    average rank, so equal values need not meet and may be split over tasks. Runs jobs.
    """
    rows = store(df.select(*columns).dropna().withColumn("__at", F.monotonically_increasing_id()), "complete")
    count, *different = rows.agg(F.count("*"), *[F.approx_count_distinct(c) for c in columns]).first()
    few = [c for c, n in zip(columns, different, strict=True) if n <= BROADCAST_RANKS]
    many = [c for c in columns if c not in few]
    for c in few:
        ranks = average_ranks(rows.select(F.col(c).alias("__value")), "__value")
        rows = rows.join(F.broadcast(ranks), F.col(c) == F.col("__value")).drop("__value", c).withColumnRenamed("rank", c)
    if not many:
        return rows.select(*columns)
    stacked = rows.select("__at", *few, F.posexplode(F.array(*many)).alias("__which", "__value"))
    both = stacked.select("__at", *few, "__which", "__value", F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("__at").alias("turn")), F.struct(F.lit(1).alias("half"), (-F.col("__at")).alias("turn")))).alias("e"))
    # The ranks known already go with one row of each.
    own_row = (F.col("__which") == 0) & (F.col("e.half") == 0)
    both = both.select("e.*", "__which", "__value", *[F.when(own_row, F.col(c)).alias(c) for c in few])
    placed = with_global_position(both, ["half", "__which", "__value", "turn"])
    # Every column has as many places, so its first one is known.
    own = (F.col("position") - (F.col("half") * len(many) + F.col("__which")) * F.lit(count)) / 2.0
    return placed.groupBy(F.abs("turn").alias("__at")).agg(
        *[F.sum(F.when(F.col("__which") == at, own)).alias(c) for at, c in enumerate(many)],
        *[F.max(c).alias(c) for c in few]).select(*columns)


def spearman_matrix(df: DataFrame, xs: Sequence[str], ys: Sequence[str] | None = None) -> DataFrame:
    """Rank correlations of the rows that have all columns: one aggregation over the rows' ranks."""
    columns = list(dict.fromkeys([*xs, *(ys or xs)]))
    return _matrix(column_ranks(df, columns), list(product(xs, ys or xs)), _corr)


def _places(values: Column, sign: int) -> Column:
    """Each element's place when sorted by value, equal ones by their index times `sign`."""
    sorted_ = F.sort_array(F.transform(values, lambda v, i: F.struct(v.alias("v"), (i * sign).alias("i"))))
    back = F.sort_array(F.transform(sorted_, lambda e, k: F.struct((e["i"] * sign).alias("i"), k.alias("k"))))
    return F.transform(back, lambda e: e["k"])


def _row_ranks(values: Column) -> Column:
    """Average ranks of an array's elements, from 0; NULL has none and does not count. Sorting twice, with equal
    values in opposite orders, gives places whose mean is the average rank: n log n, without a lookup."""
    missing = F.size(F.filter(values, lambda v: v.isNull()))  # they sort first
    mean = F.zip_with(_places(values, 1), _places(values, -1), lambda a, b: (a + b) / 2.0)
    return F.zip_with(values, mean, lambda v, m: F.when(v.isNotNull(), m - missing))


def _middle(values: Column) -> Column:
    """Mean of the ranks in a row: of the features that are present."""
    return (F.size(F.filter(values, lambda y: y.isNotNull())) - 1) / 2.0


def rank_data(df: DataFrame, features: Sequence[str], centered: bool = False) -> DataFrame:
    """Replace each row's features by their ranks within the row, from 0, ties averaged.

    A NULL feature has no rank and does not count. `centered` subtracts the row mean. Rows are
    independent, so nothing is shuffled.
    """
    packed = df.withColumn("__row", F.array(*[F.col(c).cast("double") for c in features]))
    shift = _middle(F.col("__row")) if centered else F.lit(0.0)
    ranked = packed.withColumns({"__shift": shift, "__ranks": _row_ranks(F.col("__row"))})
    return ranked.withColumns({c: F.col("__ranks")[at] - F.col("__shift") for at, c in enumerate(features)}).drop(
        "__row", "__ranks", "__shift")


def rank_array(df: DataFrame, column: str, centered: bool = False) -> DataFrame:
    """The same for a row of features held in one array column."""
    ranks = _row_ranks(F.col(column))
    if centered:
        ranks = F.zip_with(ranks, F.array_repeat(_middle(F.col(column)), F.size(column)), lambda r, middle: r - middle)
    return df.withColumn(column, ranks)
