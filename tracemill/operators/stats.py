"""Moments, percentiles and empirical distributions per key.

Percentiles follow one fixed rule. A group of n values has the distribution points (k-th point, rank):
with n >= 100 there are 100 of them, 0.01 apart, and a percentile is the value at its point; with fewer
there are n, and a percentile is interpolated linearly between neighbouring points, the lowest neighbour
being the anchor (0, 0). Steps are added up one by one, and the probability of a point is rounded to two
decimals, so both are computed here the same way and not as k/n.

A key may hold any share of the rows. Rows of a key come together by one exchange, and all steps work inside these
partitions. Hot keys go another way: their values are counted first, so equal values become one row before
the shuffle, and spread over narrow value buckets. Only one row per bucket is
ever brought together for a whole hot key, to learn how many values lie below each bucket. Hot keys are
found by their exact sizes, as part of the same plan; which keys are spread has no influence on any result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERCENTILES = (25, 50, 75, 90, 95, 99)
STAT6 = ("min", "max", "avg", "stdev", "cv", *[f"p{p}" for p in PERCENTILES])

# From this size on a distribution has the fixed number of points.
FULL = 100
TOLERANCE = 1e-6
# Buckets of a hot key per doubling of (1 + |value|).
BUCKETS_PER_DOUBLING = 4096
# A key is hot from this many rows on.
HOT_ROWS = 1_000_000
# So many hot keys are broadcast at most.
HOT_KEYS = 100_000
# Values that one task counts, ranks and sums, where it is known how many there are.
VALUES_A_TASK = 500_000


def coefficient_of_variation(avg: Column, stdev: Column) -> Column:
    return F.when(avg <= 0, 0.0).otherwise(stdev / avg)


def moments(value: Column, prefix: str = "") -> list[Column]:
    """Aggregates avg, stdev and cv (population moments)."""
    avg, stdev = F.avg(value), F.stddev_pop(value)
    return [
        avg.alias(f"{prefix}avg"),
        stdev.alias(f"{prefix}stdev"),
        coefficient_of_variation(avg, stdev).alias(f"{prefix}cv"),
    ]


def moment_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n, min, max, avg, variance, stdev, cv. One aggregation with partial sums."""
    column = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(column).alias("n"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        F.var_pop(column).alias("variance"),
        *moments(column),
    )


def stat3(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n, avg, stdev, cv."""
    column = F.col(value)
    return df.groupBy(*keys).agg(F.count(column).alias("n"), *moments(column))


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per key: n, population covariance and Pearson's coefficient (NULL without variance)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    covariance = F.covar_pop(x, y)
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        covariance.alias("covariance"),
        F.try_divide(covariance, F.stddev_pop(x) * F.stddev_pop(y)).alias("pearson"),
    )


def _two_decimals(probability: Column) -> Column:
    return F.floor(probability * 100 + 0.5) / 100


def small_group_points(spark: SparkSession) -> DataFrame:
    """One row per group size below FULL: size, probs, and per percentile hi, gap and over.

    ``probs[k-1]`` is the probability of the k-th point. A percentile lies between the points hi - 1
    and hi, ``gap`` apart, ``over`` above the lower one.
    """
    added = "aggregate(sequence(1, k), 0D, (acc, x) -> acc + 1D / size)"
    wanted = f"array({', '.join(f'{p / 100!r}D' for p in PERCENTILES)})"
    at = lambda k: f"get(concat(array(0D), probs), CAST({k} AS INT))"
    return (
        spark.range(1, FULL)
        .selectExpr("CAST(id AS INT) AS size")
        .selectExpr("size", f"transform(sequence(1, size), k -> floor({added} * 100 + 0.5D) / 100) AS probs")
        .selectExpr("*", f"transform({wanted}, p -> array_position(transform(probs, prob -> prob >= p), true)) AS hi")
        .selectExpr(
            "*",
            f"transform(hi, k -> {at('k')} - {at('k - 1')}) AS gap",
            f"zip_with(hi, {wanted}, (k, p) -> p - {at('k - 1')}) AS over",
        )
    )


def _full_probabilities() -> list[float]:
    """0.01 added up 1 ... FULL times."""
    out, total = [], 0.0
    for _ in range(FULL):
        total += 0.01
        out.append(total)
    return out


def _reached(rank: Column, n: Column, probability: Column) -> Column:
    """The value at ``rank`` of ``n`` reaches ``probability``."""
    share = rank / n
    return (share >= probability) | (F.abs(share - probability) < TOLERANCE)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with ``hot_rows`` rows at least, NULL among them, as columns named ``_<key>``.

    Of more than HOT_KEYS the largest: any other key then holds less than one part in HOT_KEYS of all rows.
    """
    named = [F.col(key).alias(f"_{key}") for key in keys]
    sizes = df.groupBy(*named).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= hot_rows)
    names = [f"_{key}" for key in keys]
    return sizes.orderBy(F.desc("_rows"), *names).limit(HOT_KEYS).select(*names)


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, hot: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of other keys, and rows of hot ones. Without keys all rows are one group, which is always split.

    ``hot``: what ``hot_keys`` has found already. Its size is bounded, so it is broadcast. Where no key is hot, Spark drops
    the work on the second part when it comes to it.
    """
    if not keys:
        return df.where(F.lit(False)), df
    found = F.broadcast(hot_keys(df, keys, hot_rows) if hot is None else hot)
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys]
    return df.join(found, same, "left_anti"), df.join(found, same, "left_semi")


def tasks_for(values: int) -> int:
    """Tasks for so many values. Their number grows with the table, so that the memory of one does not."""
    return max(1, -(-values // VALUES_A_TASK))


def _together(df: DataFrame, keys: Sequence[str], placed: bool = False, tasks: int | None = None) -> DataFrame:
    """All rows of a key in one partition: the one exchange that counting, ranking and summing need. ``placed``: they are.

    ``tasks``: partitions, which stay as they are. Without it Spark joins small ones, by bytes that know nothing of the
    metrics a row is multiplied by.
    """
    if placed or not keys:
        return df
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def _counted(rows: DataFrame, cell: Sequence[str], weight: str | None, least: str | None) -> DataFrame:
    """Equal values once, with their number ``c``; NULL and NaN do not count."""
    present = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    carried = [F.min(least).alias(least)] if least else []
    return present.groupBy(*cell, "value").agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("c"), *carried
    )


def _in_cell(counted: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Add upto (rank of the last equal value), n and total inside each cell."""
    c, whole = F.col("c"), Window.partitionBy(*cell)
    upto = whole.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumns(
        {"upto": F.sum(c).over(upto), "n": F.sum(c).over(whole), "total": F.sum(c * F.col("value")).over(whole)}
    )


def _cold_ranks(
    rows: DataFrame, keys: Sequence[str], weight: str | None = None, least: str | None = None
) -> DataFrame:
    """Distinct values with the ranks they cover: keys, value, c, after (exclusive), upto, n, avg.

    ``rows``: keys and value, rows of a key together. ``weight``: a column that says how often a row counts; ``least``: one whose
    minimum travels along.
    """
    ranked = _in_cell(_counted(rows, keys, weight, least), keys)
    return _finished(ranked.withColumn("avg", F.col("total") / F.col("n")), keys, least)


def _hot_ranks(
    rows: DataFrame, keys: Sequence[str], weight: str | None = None, least: str | None = None
) -> DataFrame:
    """The same for keys of any size, whose values are spread over buckets."""
    value = F.col("value")
    # All values of a bucket lie below those of the next.
    spread = F.floor(F.signum(value) * F.log2(1 + F.abs(value)) * BUCKETS_PER_DOUBLING)
    cell = [*keys, "bucket"]
    counted = _counted(rows.withColumn("bucket", spread), cell, weight, least)
    whole_key = Window.partitionBy(*keys)
    below = whole_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = counted.groupBy(*cell).agg(F.sum("c").alias("cell_n"), F.sum(F.col("c") * value).alias("cell_total"))
    shifts = cells.select(
        *[F.col(key).alias(f"_{key}") for key in cell],
        F.coalesce(F.sum("cell_n").over(below), F.lit(0)).alias("key_below"),
        F.sum("cell_n").over(whole_key).alias("key_n"),
        F.sum("cell_total").over(whole_key).alias("key_total"),
    )
    same = [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in cell]
    placed = _in_cell(counted, cell).join(shifts, same).withColumns(
        {
            "upto": F.col("upto") + F.col("key_below"),
            "n": F.col("key_n"),
            "avg": F.col("key_total") / F.col("key_n"),
        }
    )
    return _finished(placed, keys, least)


def _finished(ranked: DataFrame, keys: Sequence[str], least: str | None) -> DataFrame:
    carried = [least] if least else []
    return ranked.select(*keys, *carried, "value", "c", "upto", "n", "avg", (F.col("upto") - F.col("c")).alias("after"))


def _with_points(df: DataFrame, points: DataFrame, *columns: str) -> DataFrame:
    """Attach the points of small groups by ``n``; NULL from FULL on. The table has FULL - 1 rows."""
    small = F.broadcast(points.select("size", *columns))
    return df.join(small, F.col("n") == F.col("size"), "left").drop("size")


def _high(i: int, p: int) -> str:
    """SQL of the value at the percentile, or, in a small group, at the point above it."""
    step = f"{_full_probabilities()[p - 1]!r}D"
    full = f"upto / n >= {step} OR abs(upto / n - {step}) < {TOLERANCE!r}D"
    return f"min(CASE WHEN CASE WHEN n >= {FULL} THEN {full} ELSE upto >= get(hi, {i}) END THEN value END) AS high{p}"


def _low(i: int, p: int) -> str:
    """SQL of the value at the point below the percentile of a small group."""
    return f"min(CASE WHEN get(hi, {i}) > 1 AND upto >= get(hi, {i}) - 1 THEN value END) AS low{p}"


def _between(i: int, p: int) -> str:
    """SQL of a percentile. Nothing has rank 0, which is the anchor."""
    low = f"coalesce(low{p}, 0D)"
    return f"CASE WHEN n >= {FULL} THEN high{p} ELSE {low} + (high{p} - {low}) / get(gap, {i}) * get(over, {i}) END AS p{p}"


def _summary(
    ranked: DataFrame, points: DataFrame, groups: Sequence[str], min_count: int | None = None, least: str | None = None
) -> DataFrame:
    """n, min, max, avg, stdev, cv, p25 ... p99 per group of ranked values. ``points``: of ``small_group_points``.

    A struct among the results has Spark go through the groups in the order that ranking has left, with one group in
    memory and not a table of all.
    """
    enough = ranked if min_count is None else ranked.where(F.col("n") >= min_count)
    known = _with_points(enough, points, "hi")
    aggregates = [
        "any_value(struct(n, avg)) AS whole",
        "min(value) AS min",
        "max(value) AS max",
        "sum(c * (value - avg) * (value - avg)) AS squares",
        *([f"min(`{least}`) AS `{least}`"] if least else []),
        *[_high(i, p) for i, p in enumerate(PERCENTILES)],
        *[_low(i, p) for i, p in enumerate(PERCENTILES)],
    ]
    summary = known.groupBy(*groups).agg(*map(F.expr, aggregates)).selectExpr("*", "whole.*").drop("whole")
    # Without groups an empty table has one row of NULLs.
    weighted = _with_points(summary.where("n IS NOT NULL"), points, "gap", "over")
    stdev = F.sqrt(F.col("squares") / F.col("n"))
    return weighted.select(
        *groups,
        *([least] if least else []),
        "n",
        "min",
        "max",
        "avg",
        stdev.alias("stdev"),
        coefficient_of_variation(F.col("avg"), stdev).alias("cv"),
        *[F.expr(_between(i, p)) for i, p in enumerate(PERCENTILES)],
    )


def stat6(
    long: DataFrame,
    keys: Sequence[str],
    min_count: int | None = None,
    hot_rows: int = HOT_ROWS,
    weight: str | None = None,
) -> DataFrame:
    """Statistics of ``value`` per ``keys`` and ``metric``: n, min, max, avg, stdev, cv, p25 ... p99.

    NULL and NaN values do not count. ``min_count`` keeps only groups with that many values. ``weight`` names a column
    that says how often a row counts, as in a table of counted values.
    """
    groups = [*keys, "metric"]
    cold, hot = split_hot(long, groups, hot_rows)
    points = small_group_points(long.sparkSession)
    ranks = [_cold_ranks(_together(cold, groups), groups, weight), _hot_ranks(hot, groups, weight)]
    return reduce(DataFrame.unionByName, [_summary(ranked, points, groups, min_count) for ranked in ranks])


def wide_stats(
    df: DataFrame,
    keys: Sequence[str],
    metrics: dict[str, Column],
    min_count: int | None = None,
    hot_rows: int = HOT_ROWS,
    least: str | None = None,
    hot: DataFrame | None = None,
    placed: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """One row per key with ``<metric>_<stat>`` of every metric; ``n`` is that of the first one.

    ``least`` names a column whose minimum comes along, also from the rows of the first metric. ``hot``: see
    ``split_hot``. ``placed``: rows of a key are together already, as in a table bucketed by keys. ``tasks``: how many
    bring them together, see ``tasks_for``.

    Rows of a key are brought together before they are multiplied by the metrics. Everything after works
    inside these partitions; only hot keys take further exchanges.
    """
    carried = [*keys, *([least] if least else [])]
    narrow = df.select(*carried, *[column.cast("double").alias(f"_m{k}") for k, column in enumerate(metrics.values())])
    cells = [cell for k, name in enumerate(metrics) for cell in (F.lit(name), F.col(f"_m{k}"))]
    stack = F.stack(F.lit(len(metrics)), *cells).alias("metric", "value")
    parts = split_hot(narrow, keys, hot_rows, hot)
    cold = _together(parts[0], keys, placed, tasks).select(*carried, stack)
    groups = [*keys, "metric"]
    ranks = [_cold_ranks(cold, groups, None, least), _hot_ranks(parts[1].select(*carried, stack), groups, None, least)]
    points = small_group_points(df.sparkSession)
    stats = [_summary(ranked, points, groups, min_count, least) for ranked in ranks]
    return reduce(DataFrame.unionByName, [_as_wide(part, keys, list(metrics), least) for part in stats])


def _as_wide(
    stats: DataFrame, keys: Sequence[str], metrics: Sequence[str], least: str | None = None
) -> DataFrame:
    """One row per key with columns ``<metric>_<stat>``; ``n`` and ``least`` are those of the first metric."""
    fields = ["n", *STAT6, *([least] if least else [])]
    pivoted = stats.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first(F.struct(*fields)))
    first = [f"`{metrics[0]}`.`{name}` AS `{name}`" for name in ("n", *([least] if least else []))]
    each = [f"`{m}`.`{name}` AS `{m}_{name}`" for m in metrics for name in STAT6]
    return pivoted.selectExpr(*[f"`{key}`" for key in keys], *first, *each)


def _ranked(
    df: DataFrame, keys: Sequence[str], value: str, hot_rows: int, weight: str | None, tasks: int | None = None
) -> list[DataFrame]:
    """Ranks of one column, of the keys that are not hot and of those that are."""
    rows = df.select(*keys, F.col(value).cast("double").alias("value"), *([weight] if weight else []))
    cold, hot = split_hot(rows, keys, hot_rows)
    hot_ranks = _hot_ranks(hot, keys, weight)
    return [_cold_ranks(_together(cold, keys, tasks=tasks), keys, weight), hot_ranks] if keys else [hot_ranks]


def value_stats(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    hot_rows: int = HOT_ROWS,
    weight: str | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Per key: n, min, max, avg, stdev, cv and the six percentiles. ``weight``: a column that says how often a row counts.

    ``tasks``: how many bring the rows of a key together, see ``tasks_for``.
    """
    points = small_group_points(df.sparkSession)
    parts = [_summary(ranked, points, keys) for ranked in _ranked(df, keys, value, hot_rows, weight, tasks)]
    return reduce(DataFrame.unionByName, parts)


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, hot_rows: int = HOT_ROWS, weight: str | None = None
) -> DataFrame:
    """Per key: n and the six percentiles."""
    return value_stats(df, keys, value, hot_rows, weight).select(*keys, "n", *[f"p{p}" for p in PERCENTILES])


def cdf(
    df: DataFrame, keys: Sequence[str], value: str, hot_rows: int = HOT_ROWS, weight: str | None = None
) -> DataFrame:
    """Per key: the points (prob, value) of the empirical distribution, with the anchor (0, 0)."""
    # No exchange follows the ranks, so both kinds of keys share the rest.
    ranks = reduce(DataFrame.unionByName, _ranked(df, keys, value, hot_rows, weight))
    ranked = _with_points(ranks, small_group_points(df.sparkSession), "probs")
    n, after, upto = F.col("n"), F.col("after"), F.col("upto")
    # Points first reached by this value: those near its share of ranks, then exactly.
    lowest = F.greatest(F.lit(1), F.floor(after * FULL / n) - 1)
    highest = F.least(F.lit(FULL), F.ceil(upto * FULL / n) + 1)
    steps = F.lit(_full_probabilities())
    step = lambda k: F.get(steps, (k - 1).cast("int"))
    full = F.transform(
        F.filter(
            F.sequence(lowest, highest),
            lambda k: _reached(upto, n, step(k)) & ~((after > 0) & _reached(after, n, step(k))),
        ),
        lambda k: _two_decimals(step(k)),
    )
    small = F.slice("probs", (after + 1).cast("int"), F.col("c").cast("int"))
    point = lambda prob, v: F.struct(prob.alias("prob"), v.alias("value"))
    reached = F.transform(F.when(n >= FULL, full).otherwise(small), lambda prob: point(prob, F.col("value")))
    # The smallest value brings the anchor along.
    anchor = F.when(after == 0, F.array(point(F.lit(0.0), F.lit(0.0)))).otherwise(
        F.array().cast("array<struct<prob:double,value:double>>")
    )
    return ranked.select(*keys, F.inline(F.concat(anchor, reached)))
