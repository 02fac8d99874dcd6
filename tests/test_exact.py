"""Exact sums against fractions, and draws that follow from an id."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import exact, normal_draw, uniform_draw
from tidegauge.operators import grouped_summary, numeric_stats
from tidegauge.sources import hourly_series

random_ = random.Random(11)
MIXED = [random_.uniform(-1, 1) * 10 ** random_.randint(-18, 17) for _ in range(3000)]


def numbers(spark, values, parts=3):
    return spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)


def summed(df):
    return df.agg(F.expr(exact.sum_state("v")).alias("s")).select(exact.total("s"), exact.mean("s")).first()


@pytest.mark.parametrize("values", [[0.1] * 10, [1e16, 1.0, -1e16], [-0.1, -0.2, -1e-20], [1.0, -(1 - 2.0**-53)], [3.5], [0.0, -0.0], MIXED])
def test_sum_is_the_rounded_sum_of_fractions(spark, values):
    want = float(sum(map(Fraction, values)))
    df = numbers(spark, [*values, None])
    assert tuple(summed(df)) == (want, want / len(values))
    assert tuple(summed(df.coalesce(1))) == tuple(summed(df.orderBy("v"))) == (want, want / len(values))


def test_sums_of_parts_add_up(spark):
    df = numbers(spark, MIXED).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(5)))
    states = df.groupBy("part").agg(F.expr(exact.sum_state("v")).alias("s"))
    empty = spark.range(1).select(F.lit(9).cast("long").alias("part"), F.expr(exact.empty_state()).alias("s"))
    both = states.unionByName(empty).agg(F.expr(exact.merged("s")).alias("s"))
    assert both.select(exact.total("s"), exact.mean("s")).first() == summed(df)


def test_no_values(spark):
    assert tuple(summed(numbers(spark, []))) == (None, None)
    assert tuple(summed(numbers(spark, [None, None]))) == (None, None)


def test_values_out_of_range(spark):
    assert summed(numbers(spark, [1e300, 1.0, 1e300]))[0] == 2e300
    assert summed(numbers(spark, [math.inf, 1.0]))[0] == math.inf
    assert math.isnan(summed(numbers(spark, [math.nan, 1.0]))[0])


def test_aggregates(spark):
    df = spark.createDataFrame([("a", v) for v in MIXED] + [("b", 0.1), ("b", 0.2), (None, None)], "g string, `the v` double")
    got = {r.g: r for r in grouped_summary(df, ["g"], ["the v"], F.lit(True), exact_means=True).collect()}
    assert got["a"]["avg_the v"] == float(sum(map(Fraction, MIXED))) / len(MIXED)
    assert got["b"]["avg_the v"] == float(Fraction(0.1) + Fraction(0.2)) / 2 and got[None]["avg_the v"] is None
    values = [1e6 + x for x in (0.1, 0.2, 0.3, 0.4)]
    mean = float(sum(map(Fraction, values))) / 4
    want = math.sqrt(float(sum(Fraction((v - mean) ** 2) for v in values)) / 4)
    for parts in (1, 4):
        assert tuple(numeric_stats(numbers(spark, values, parts), "v", exact_sums=True).first()) == (mean, want)
    assert tuple(numeric_stats(numbers(spark, []), "v", exact_sums=True).first()) == (None, None)


def test_draws_follow_from_the_id(spark):
    ids = spark.range(20_000)
    one = {r.sensor_id: r.value for r in hourly_series(ids.repartition(8), seed=3).collect()}
    assert one == {r.sensor_id: r.value for r in hourly_series(ids.coalesce(1).orderBy(F.desc("id")), seed=3).collect()}
    some = hourly_series(ids.where("id % 100 = 7"), seed=3).collect()
    assert len(some) == 200 and all(one[r.sensor_id] == r.value for r in some)
    other = {r.sensor_id: r.value for r in hourly_series(ids, seed=4).collect()}
    assert sum(one[k] == other[k] for k in one) == 0
    assert hourly_series(ids, seed=None).collect() != hourly_series(ids, seed=None).collect()


def test_draws_are_distributed_as_they_should_be(spark):
    draws = spark.range(100_000).select(normal_draw(F.col("id"), 5).alias("n"), uniform_draw(F.col("id"), 5).alias("u"))
    got = draws.agg(
        F.avg("n"), F.stddev_pop("n"), F.skewness("n"), F.avg((F.abs("n") < 1.959964).cast("int")), F.avg("u"), F.min("u"), F.max("u"), F.corr("n", "u")
    ).first()
    assert abs(got[0]) < 0.013 and abs(got[1] - 1) < 0.01 and abs(got[2]) < 0.04 and abs(got[3] - 0.95) < 0.004
    assert abs(got[4] - 0.5) < 0.004 and 0 < got[5] < 1e-3 and 1 - 1e-3 < got[6] < 1 and abs(got[7]) < 0.013
    assert spark.range(1).select(normal_draw(F.lit(None).cast("long"))).first()[0] is None
