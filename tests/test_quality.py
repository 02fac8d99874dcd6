from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plans import executed, scans, shuffles
from tidegauge.operators import (
    QualityResult,
    Thresholds,
    append_history,
    duplicate_ratio,
    null_ratio,
    quality_report,
    quality_result,
    quality_verdict,
)
from tidegauge.session import FOOTER_COUNTS, set_options
from tidegauge.sources import Location, scan_parquet

ROW_WARNING = "Row count %d below minimum threshold (warning)"


def by_check(report):
    return {(r.check_name, r.column_name): r for r in report.collect()}


def test_sample_result(sample):
    got = quality_result(sample, ["device_id"], ["temperature", "humidity", "pressure"])
    assert got == QualityResult(
        passed=True,
        row_count=5,
        null_ratios={"temperature": 0.0, "humidity": 0.0, "pressure": 0.0},
        duplicate_ratio=0.0,
        issues=[ROW_WARNING % 5],
    )
    assert list(got.as_dict()) == ["passed", "row_count", "null_ratios", "duplicate_ratio", "issues"]


def test_all_issues_in_order(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, None), (1, 2.0, "y"), (2, 1.0, "z")], "k int, a double, b string")
    got = quality_result(df, ["k"], ["b", "a"])
    assert got == QualityResult(
        passed=False,
        row_count=4,
        null_ratios={"b": 0.25, "a": 0.5},
        duplicate_ratio=0.5,
        issues=[
            "Column 'b' null ratio 0.2500 exceeds threshold",
            "Column 'a' null ratio 0.5000 exceeds threshold",
            "Duplicate ratio 0.5000 exceeds threshold",
            ROW_WARNING % 4,
        ],
    )
    assert list(got.null_ratios) == ["b", "a"]


def test_empty_frame(spark):
    df = spark.createDataFrame([], "k int, a double")
    assert quality_result(df, ["k"], ["a"]) == QualityResult(True, 0, {"a": 0.0}, 0.0, [ROW_WARNING % 0])
    assert null_ratio(df, ["a"]).collect() == [(1, "a", 0.0)]
    assert duplicate_ratio(df, ["k"]).collect() == [(0, 0, 0.0)]


@pytest.mark.parametrize("rows, violated", [(99, True), (100, False), (101, False)])
def test_row_floor(spark, rows, violated):
    result = quality_result(spark.range(rows), ["id"], ["id"])
    assert result.passed and bool(result.issues) == violated


@pytest.mark.parametrize("nulls, violated", [(5, False), (6, True)])
def test_null_limit(spark, nulls, violated):
    df = spark.range(100).select("id", F.when(F.col("id") >= nulls, 1).alias("a"))
    row = by_check(quality_report(df, ["id"], ["a"]))["null_ratio", "a"]
    assert (row.value, row.violated, row.severity) == (nulls / 100, violated, "error")


@pytest.mark.parametrize("copies, violated", [(1, False), (2, True)])
def test_duplicate_limit(spark, copies, violated):
    df = spark.range(100).select(F.greatest("id", F.lit(copies)).alias("id"))
    row = by_check(quality_report(df, ["id"], []))["duplicate_ratio", None]
    assert (row.value, row.violated) == (copies / 100, violated)


def test_thresholds_one_by_one(spark):
    assert Thresholds() == Thresholds(null_ratio_max=0.05, duplicate_ratio_max=0.01, min_row_count=100)
    df = spark.createDataFrame([(1, None), (1, 2)], "k int, a int")
    assert not quality_result(df, ["k"], ["a"], Thresholds(min_row_count=1)).passed
    loose = quality_result(df, ["k"], ["a"], Thresholds(null_ratio_max=0.5, duplicate_ratio_max=0.5))
    assert loose.passed and loose.issues == [ROW_WARNING % 2]


def test_nan_is_not_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,)], "a double")
    assert null_ratio(df, ["a"]).collect() == [(1, "a", 0.5)]


def test_null_keys_equal_each_other(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, None), (None, None), (1, None)], "a int, b int")
    assert duplicate_ratio(df, ["a", "b"]).collect() == [(5, 3, 0.4)]


def test_column_named_twice(spark):
    df = spark.createDataFrame([(1, None)], "k int, a int")
    assert quality_result(df, ["k"], ["a", "k", "a"]).null_ratios == {"a": 1.0, "k": 0.0}


def test_names_of_any_shape(spark):
    names = ["a b", "quote'\"`s", "é\\n", "😀"]
    df = spark.createDataFrame([(1, None, 1, None)], ", ".join(f"`{n.replace('`', '``')}` int" for n in names))
    quoted = [f"`{n.replace('`', '``')}`" for n in names]
    assert list(quality_result(df, quoted, quoted).null_ratios.items()) == list(zip(quoted, (0.0, 1.0, 0.0, 1.0)))


def test_a_wide_table(spark):
    df = spark.range(8).select("id", *(F.when(F.col("id") % 8 >= i % 8, 1).alias(f"c{i}") for i in range(120)))
    ratios = quality_result(df, ["id"], df.columns[1:]).null_ratios
    assert ratios == {f"c{i}": (i % 8) / 8 for i in range(120)}


def test_no_columns(spark):
    assert null_ratio(spark.range(3), []).collect() == []
    assert quality_result(spark.range(3), ["id"], []).null_ratios == {}
    # Without keys all rows are one key's.
    assert quality_result(spark.range(4), [], ["id"]).duplicate_ratio == 0.75


cells = st.one_of(st.none(), st.sampled_from([0.0, 1.5, float("nan")]))
texts = st.one_of(st.none(), st.sampled_from(["", "a", "b" * 40, "c" * 40]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(texts, cells, cells), max_size=12))
def test_report_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(3)
    n = len(rows)
    want = [
        ("null_ratio", "a", sum(r[1] is None for r in rows) / n if n else 0.0),
        ("null_ratio", "b", sum(r[2] is None for r in rows) / n if n else 0.0),
        ("duplicate_ratio", None, (n - len({(r[0], repr(r[1])) for r in rows})) / n if n else 0.0),
        ("row_count", None, float(n)),
    ]
    for options in ({}, {"single_scan": True}, {"digest": False}):
        report = quality_report(df, ["k", "a"], ["a", "b"], **options).sort("position").collect()
        assert [(r.check_name, r.column_name, r.value) for r in report] == want


@pytest.mark.parametrize("single_scan, scanned", [(True, 1), (False, 2)])
def test_scans_and_shuffles(spark, tmp_path, single_scan, scanned):
    spark.range(10).selectExpr("id k", "id a", "id b", "id c").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    report = quality_report(df, ["k"], ["a", "b", "c"], single_scan=single_scan)
    assert scans(report) == scanned
    # One shuffle of keys; the rest bring partial counts to the final row.
    assert shuffles(report) == 1 + scanned


def test_counts_from_file_footers(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select(
        (F.col("id") % 500).alias("k"),
        F.when(F.col("id") % 5 > 0, "x").alias("a"),
        F.when(F.col("id") % 2 > 0, F.lit(float("nan"))).alias("b"),
        F.lit(None).cast("int").alias("c"),
    )
    df.write.parquet(str(tmp_path / "t"))
    want = quality_report(df, ["k"], ["a", "b", "c", "k"]).sort("position").collect()
    saved = {key: spark.conf.get(key) for key in FOOTER_COUNTS}
    try:
        set_options(spark, FOOTER_COUNTS)
        table = spark.read.parquet(str(tmp_path / "t"))
        report = quality_report(table, ["k"], ["a", "b", "c", "k"])
        ratios = null_ratio(table, ["a", "b", "c"])
        assert [r.null_ratio for r in ratios.sort("position").collect()] == [0.2, 0.5, 1.0]
        assert report.sort("position").collect() == want
        assert "ReadSchema: struct<count(*):bigint,count(a):bigint" in executed(ratios)
        assert executed(report).count("ReadSchema: struct<count(*):bigint,count(a):bigint") == 1
        assert executed(report).count("ReadSchema: struct<k:bigint>") == 1
    finally:
        set_options(spark, saved)


def test_history_keeps_every_run(spark, sample, tmp_path):
    at = Location(str(tmp_path))
    good = quality_report(sample, ["device_id"], ["temperature"])
    bad = quality_report(sample, ["location"], ["humidity"])
    append_history(good, at, "runs", "monday", datetime(2024, 1, 1))
    append_history(bad, at, "runs", "tuesday", datetime(2024, 1, 2))
    append_history(bad, at, "runs", "now")
    runs = scan_parquet(spark, at, "runs")
    assert runs.groupBy("run_id").count().sort("run_id").collect() == [("monday", 3), ("now", 3), ("tuesday", 3)]
    assert runs.where("recorded_at is null").isEmpty()
    verdicts = {r.run_id: r for r in quality_verdict(runs, by=["run_id", "recorded_at"]).collect()}
    assert verdicts["monday"].passed and verdicts["monday"].recorded_at == datetime(2024, 1, 1)
    assert not verdicts["tuesday"].passed
    assert verdicts["tuesday"].issues == ["Duplicate ratio 0.4000 exceeds threshold", ROW_WARNING % 5]
    assert verdicts["tuesday"].null_ratios == {"humidity": 0.0}


def test_a_run_tried_again_replaces_itself(spark, tmp_path):
    from tidegauge.operators import record_run, recorded_runs

    at = Location(str(tmp_path))
    good = spark.createDataFrame([(i, 1.0) for i in range(200)], "k int, a double")
    bad = spark.createDataFrame([(1, None)] * 3, "k int, a double")
    for run, df, columns in (("001", good, ["a"]), ("2024-01-02", bad, ["a"]), ("x/y=z", bad, []), ("2024-01-02", good, ["a"])):
        record_run(quality_report(df, ["k"], columns), at, "runs", run, datetime(2024, 1, 1))
    runs = recorded_runs(spark, at, "runs")
    assert runs.groupBy("run_id").count().collect() and runs.schema["run_id"].dataType.simpleString() == "string"
    got = {r.run_id: (r.passed, r.row_count) for r in quality_verdict(runs, by=["run_id"]).collect()}
    assert got == {"001": (True, 200), "2024-01-02": (True, 200), "x/y=z": (False, 3)}
    with pytest.raises(ValueError):
        record_run(quality_report(good, ["k"], []), at, "runs", "")


def test_unreadable_lines_are_a_check(spark):
    from tidegauge.operators import unreadable_check

    lines = spark.createDataFrame([(i > 0,) for i in range(4)], "readable boolean")
    report = quality_report(spark.range(200).toDF("k"), ["k"], ["k"]).unionByName(unreadable_check(lines, 4))
    verdict = quality_verdict(report).first()
    assert not verdict.passed and verdict.issues == ["Unreadable line ratio 0.2500 exceeds threshold"]
    allowed = unreadable_check(lines, 4, thresholds=Thresholds(unreadable_ratio_max=0.25)).first()
    assert not allowed.violated and allowed.value == 0.25
    assert unreadable_check(lines.limit(0), 4).first().value == 0.0
