import pytest
from pyspark.sql import functions as F

import fixtures
from plans import executed, shuffled_rows, shuffles
from tidegauge.operators import (
    distinct_keys,
    duplicate_ratio,
    grouped_summary,
    numeric_stats,
    quality_report,
    summarize_readings,
)


def test_sample_summary(sample):
    df = summarize_readings(sample)
    assert df.dtypes == [
        ("location", "string"),
        ("avg_temperature", "double"),
        ("avg_humidity", "double"),
        ("avg_pressure", "double"),
        ("reading_count", "bigint"),
        ("active_sensors", "bigint"),
    ]
    got = {r.location: tuple(r)[1:] for r in df.collect()}
    assert got.keys() == fixtures.SUMMARY.keys()
    for location, want in fixtures.SUMMARY.items():
        assert got[location] == pytest.approx(want, rel=1e-12)


def test_nulls_in_a_summary(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, None, 1), ("A", None, 0)], "g string, m double, s int")
    got = grouped_summary(df, ["g"], ["m"], F.col("s") == 1)
    assert {tuple(r) for r in got.collect()} == {(None, 1.0, 2, 1), ("A", None, 1, 0)}


def test_summary_of_nothing(spark, sample):
    assert summarize_readings(sample.where("false")).collect() == []
    whole = grouped_summary(spark.createDataFrame([], "m double, s int"), [], ["m"], F.col("s") == 1)
    assert whole.collect() == [(None, 0, 0)]


def test_summary_combines_before_its_only_shuffle(spark, tmp_path):
    spark.range(100).selectExpr("id % 3 g", "cast(id as double) m", "id unused").write.parquet(str(tmp_path / "t"))
    df = grouped_summary(spark.read.parquet(str(tmp_path / "t")), ["g"], ["m"], F.col("g") == 1)
    assert shuffles(df) == 1
    assert "partial_avg" in executed(df)
    assert "ReadSchema: struct<g:bigint,m:double>" in executed(df)


ROWS = [
    ("a", 1.0), ("a", 1.0), ("a", None), ("a", None), (None, 1.0), (None, None), (None, None),
    ("nan", float("nan")), ("nan", float("nan")), ("zero", 0.0), ("zero", -0.0),
    ("x" * 31, 0.0), ("x" * 32, 0.0), ("x" * 33, 0.0), ("x" * 33, 0.0), ("é" * 16, 0.0), ("", 0.0),
]


@pytest.mark.parametrize("keys", [["k"], ["v"], ["k", "v"], ["v", "k"], []])
@pytest.mark.parametrize("digest", [True, False])
def test_distinct_keys_as_in_distinct(spark, keys, digest):
    df = spark.createDataFrame(ROWS, "k string, v double")
    for frame in (df, df.where("false")):
        assert distinct_keys(frame, keys, digest=digest).collect() == [(frame.select(keys).distinct().count(),)]


def test_distinct_keys_of_other_types(spark):
    df = spark.sql("select * from values (array('a'), x'00', 'B'), (array('a'), x'00', 'b'), (array(null), null, 'b') t(a, b, c)")
    df = df.withColumn("d", F.collate("c", "UTF8_LCASE"))
    for keys, want in ((["a"], 2), (["b"], 2), (["c"], 2), (["d"], 1), (["a", "b", "d"], 2)):
        assert distinct_keys(df, keys).first()[0] == want


def test_long_keys_are_shuffled_as_digests(spark):
    df = spark.range(10).select(F.repeat(F.col("id").cast("string"), 1000).alias("k"))
    assert "sha2" in executed(distinct_keys(df, ["k"]))
    assert "sha2" not in executed(distinct_keys(df, ["k"], digest=False))
    assert distinct_keys(df, ["k"]).first()[0] == 10


def test_estimated_distinct_keys(spark):
    df = spark.range(50_000).selectExpr("id % 20000 a", "if(id % 2 = 0, null, id % 20000) b")
    estimate = distinct_keys(df, ["a", "b"], rsd=0.01)
    assert estimate.first()[0] == pytest.approx(20_000, rel=0.05)
    # NULLs in different places make different keys.
    few = spark.createDataFrame([(None, 1), (1, None), (1, 1), (None, None)], "a int, b int")
    assert distinct_keys(few, ["a", "b"], rsd=0.01).first()[0] == 4
    assert "sha2" not in executed(estimate) and "hashpartitioning" not in executed(estimate)


def test_statistics(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    mean, std = numeric_stats(df, "v").first()
    assert (mean, round(std, 4)) == (3.0, 1.4142)
    assert numeric_stats(df.where("false"), "v").first() == (None, None)


def test_a_hot_group_shuffles_one_row_per_task(spark):
    tasks, rows = 8, 30_000
    df = spark.range(0, rows, 1, tasks).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 20)).alias("g"),
        F.col("id").cast("double").alias("m"),
        (F.col("id") % 7).alias("s"),
    )
    brute = {}
    for i in range(rows):
        brute.setdefault("hot" if i % 3 == 0 else f"g{i % 20}", []).append(i)

    summary = grouped_summary(df, ["g"], ["m"], F.col("s") == 1)
    assert {r.g: (r.avg_m, r.row_count, r.flagged) for r in summary.collect()} == {
        g: (pytest.approx(sum(ids) / len(ids)), len(ids), sum(i % 7 == 1 for i in ids)) for g, ids in brute.items()
    }
    groups = len(brute)
    assert groups == 21
    assert shuffled_rows(grouped_summary(df, ["g"], ["m"], F.col("s") == 1)) <= tasks * groups

    assert duplicate_ratio(df, ["g"]).first()[:2] == (rows, groups)
    # The partial rows of the keys, then at most one row per partition of the final counts.
    for query in (distinct_keys(df, ["g"]), duplicate_ratio(df, ["g"]), quality_report(df, ["g"], ["m", "s"])):
        assert shuffled_rows(query) <= tasks * groups + 8 + tasks
