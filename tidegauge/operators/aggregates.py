"""Grouped summaries, distinct keys, numeric statistics.

All of them combine rows on the map side before anything is shuffled, so a
group holding a large share of the input costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import exact
from tidegauge.functions.keys import row_key


def grouped_summary(
    df: DataFrame,
    by: Sequence[str],
    metrics: Sequence[str],
    flag: Column,
    count_as: str = "row_count",
    flag_as: str = "flagged",
    exact_means: bool = False,
) -> DataFrame:
    """Per group: the mean of each metric, the rows, and the rows where ``flag`` is true.

    A NULL flag counts as false; a NULL group value is a group of its own. With
    ``exact_means`` values are added without rounding, so a mean has the same
    bits whatever the partitioning and order of the rows; see ``functions.exact``.
    """
    mean = (lambda metric: exact.mean(exact.sum_state(exact.quoted(metric)))) if exact_means else F.avg
    means = [mean(metric).alias(f"avg_{metric}") for metric in metrics]
    return df.groupBy(*by).agg(*means, F.count("*").alias(count_as), F.count_if(flag).alias(flag_as))


def summarize_readings(readings: DataFrame, by: Sequence[str] = ("location",), exact_means: bool = False) -> DataFrame:
    """Sensor readings per location: mean measures, readings, and those with status 1."""
    return grouped_summary(
        readings,
        by,
        metrics=("temperature", "humidity", "pressure"),
        flag=F.col("status") == 1,
        count_as="reading_count",
        flag_as="active_sensors",
        exact_means=exact_means,
    )


def distinct_keys(df: DataFrame, keys: Sequence[str], rsd: float | None = None, digest: bool = True) -> DataFrame:
    """How many different keys there are, in one row; with ``rsd``, about how many.

    The estimate needs no shuffle of keys at all.
    """
    if rsd is None:
        count = F.count_distinct(row_key(df, keys, digest))
    else:
        # The hash behind the estimate passes over NULLs, so say where they are.
        nulls = (F.col(key).isNull().alias(f"n{i}") for i, key in enumerate(keys))
        count = F.approx_count_distinct(F.struct(row_key(df, keys, digest=False), *nulls), rsd)
    return df.agg(count.alias("distinct_keys"))


def numeric_stats(df: DataFrame, column: str, exact_sums: bool = False) -> DataFrame:
    """Mean and population standard deviation of a column, in one row.

    With ``exact_sums`` both have the same bits whatever the order of the rows.
    That takes a second scan of the column: squared distances from the mean are
    added, as nothing cancels out among them.
    """
    if exact_sums:
        values = df.select(F.col(column).cast("double").alias("value"))
        mean = exact.mean(exact.sum_state("value")).alias("mean")
        centre = values.agg(mean)
        apart = values.select("value", (F.col("value") - centre.scalar()).alias("apart"))
        squares = apart.select("value", (F.col("apart") * F.col("apart")).alias("square"))
        return squares.agg(mean, F.sqrt(exact.mean(exact.sum_state("square"))).alias("std"))
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
