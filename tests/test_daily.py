"""Reports from daily states against scans of the whole table."""

import pytest
from pyspark.sql import functions as F

from plans import scan_metrics
from tidegauge.operators import Thresholds, error_bound, quality_report, summarize_readings
from tidegauge.plans import DailyStates, sensor_job
from tidegauge.sources import Location, readings_view, write_parquet

TRIGGER = "2024-01-03 12:00:00"
COLUMNS = ["device_id", "location", "temperature", "humidity", "pressure", "timestamp", "status"]


def readings(spark, days, per_day=200, shift=0):
    rows = [
        (f"d{(i * 7 + d) % 90}", f"place {i % 3}" if i % 11 else None, 0.1 * i + d + shift, None if i % 5 == 0 else 0.3 * i, 1.0 / (i + 1),
         f"2024-01-{d:02} {i % 24:02}:{i % 60:02}:00", i % 3)
        for d in days for i in range(per_day)
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    return readings_view(df, {c: c for c in COLUMNS}).withColumn("day", F.to_date("timestamp"))


def land(df, at, mode="append"):
    write_parquet(df, at, "readings", mode=mode, partition_by=["day"], rebalance=True)


def full(spark, at):
    return spark.read.parquet(at.path("readings"))


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.collect()), key=repr)


def check(spark, states, at, **options):
    job = sensor_job(full(spark, at), TRIGGER, alert_above=5.0, date_column="day", exact_means=True, **options)
    same(states.report(spark, TRIGGER, alert_above=5.0), job.report())
    same(states.summary(spark), summarize_readings(full(spark, at), exact_means=True))
    same(states.quality(spark), quality_report(full(spark, at), states.keys, states.columns))


def test_new_days_alone_are_read(spark, tmp_path):
    at = Location(str(tmp_path))
    states = DailyStates(at.path("readings"), at, "states")
    land(readings(spark, [1, 2, 3]), at)
    assert states.refresh(spark) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    check(spark, states, at)
    land(readings(spark, [4]), at)
    # Before the refresh the former states are in force.
    assert states.quality(spark).where("check_name = 'row_count'").first()["value"] == 600
    assert states.refresh(spark) == ["2024-01-04"]
    check(spark, states, at)
    assert states.refresh(spark) == []
    # The scan behind a refresh opens the files of its days only.
    days = scan_metrics(states._groups(states._readings_of(spark, ["day 2024-01-04"])))
    assert days["numPartitions"] == 1 and days["numOutputRows"] == 200


def test_late_rows_replaced_and_removed_days(spark, tmp_path):
    at = Location(str(tmp_path))
    states = DailyStates(at.path("readings"), at, "states", keys=("device_id", "status"), columns=("humidity", "temperature"))
    land(readings(spark, [1, 2, 3]), at)
    states.refresh(spark)
    land(readings(spark, [2], per_day=50, shift=1), at)
    assert states.refresh(spark) == ["2024-01-02"]
    check(spark, states, at, keys=("device_id", "status"), columns=("humidity", "temperature"))
    files = spark._jvm.org.apache.hadoop.fs.Path(at.path("readings/day=2024-01-01"))
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)
    assert states.refresh(spark) == ["2024-01-01"]
    check(spark, states, at, keys=("device_id", "status"), columns=("humidity", "temperature"))
    land(readings(spark, [1], per_day=20), at)
    assert states.refresh(spark) == ["2024-01-01"]
    check(spark, states, at, keys=("device_id", "status"), columns=("humidity", "temperature"))


def test_a_refresh_that_broke_off(spark, tmp_path, monkeypatch):
    """States written without their entry do not count, and the next refresh writes them once."""
    from tidegauge.plans import daily

    at = Location(str(tmp_path))
    states = DailyStates(at.path("readings"), at, "states")
    land(readings(spark, [1, 2]), at)
    states.refresh(spark)
    land(readings(spark, [2, 3], per_day=30), at)
    write = daily.write_parts

    def broken(df, to, key, parts):
        if key.endswith("days"):
            raise RuntimeError("lost")
        write(df, to, key, parts)

    monkeypatch.setattr(daily, "write_parts", broken)
    with pytest.raises(RuntimeError):
        states.refresh(spark)
    assert states.quality(spark).where("check_name = 'row_count'").first()["value"] == 400
    monkeypatch.setattr(daily, "write_parts", write)
    assert states.refresh(spark) == ["2024-01-02", "2024-01-03"]
    check(spark, states, at)


def test_some_days_and_thresholds(spark, tmp_path):
    at = Location(str(tmp_path))
    states = DailyStates(at.path("readings"), at, "states")
    land(readings(spark, [1, 2, 3, 4]), at)
    states.refresh(spark)
    some = full(spark, at).where("day between date '2024-01-02' and date '2024-01-03'")
    limits = Thresholds(null_ratio_max=0.5, duplicate_ratio_max=0.99, min_row_count=500)
    same(states.quality(spark, limits, ("2024-01-02", "2024-01-03")), quality_report(some, ["device_id"], states.columns, limits))
    none = states.quality(spark, days=("2025-01-01", "2025-12-31"))
    same(none, quality_report(some.limit(0), ["device_id"], states.columns))


def test_sketched_keys(spark, tmp_path):
    at = Location(str(tmp_path))
    states = DailyStates(at.path("readings"), at, "states", lg_k=12)
    land(readings(spark, [1, 2, 3], per_day=4000).withColumn("device_id", F.concat("device_id", F.col("temperature").cast("string"))), at)
    states.refresh(spark)
    exact = {r.check_name: r.value for r in quality_report(full(spark, at), ["device_id"], []).collect()}
    got = {r.check_name: r.value for r in states.quality(spark).collect()}
    assert abs((1 - got["duplicate_ratio"]) / (1 - exact["duplicate_ratio"]) - 1) < error_bound(12)
    assert got["row_count"] == exact["row_count"]


def test_nothing_stored(spark, tmp_path):
    with pytest.raises(ValueError):
        DailyStates(str(tmp_path / "none"), Location(str(tmp_path)), "states").summary(spark)


def test_rows_without_a_day(spark, tmp_path):
    at = Location(str(tmp_path))
    states = DailyStates(at.path("readings"), at, "states")
    land(readings(spark, [1, 2]).withColumn("day", F.when(F.col("status") > 0, F.col("day"))), at)
    assert len(states.refresh(spark)) == 3
    same(states.summary(spark), summarize_readings(full(spark, at), exact_means=True))
