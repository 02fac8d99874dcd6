from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import fixtures
from plans import executed, rows_of_joins
from tidegauge.operators import downstream_rollup, trigger_window
from tidegauge.sources import Location, write_parquet


@pytest.fixture(scope="module")
def history(spark):
    """Each sample row inside the hour before the trigger, and its copies outside."""
    inside = [timedelta(hours=1), timedelta(minutes=30), timedelta(minutes=1), timedelta(microseconds=1)]
    outside = [timedelta(hours=1, microseconds=1), timedelta(0), timedelta(hours=-1), timedelta(days=400)]
    rows = [(*row, fixtures.TRIGGER_TIME - before) for row, before in zip(fixtures.HISTORY, inside)]
    rows += [("elsewhere", "zone_A", 0.0, 0.0, fixtures.TRIGGER_TIME - before) for before in outside]
    rows.append(("never", "zone_A", 0.0, 0.0, None))
    return spark.createDataFrame(rows, "device_id string, zone string, temperature double, humidity double, timestamp timestamp")


@pytest.mark.parametrize("type_", ["timestamp", "timestamp_ntz"])
def test_sample_window(history, type_):
    df = trigger_window(history.withColumn("timestamp", F.col("timestamp").cast(type_)), fixtures.TRIGGER)
    got = df.select("trigger_time", "device_id", "zone", "temperature", "humidity", "duration_minutes")
    assert got.dtypes[0] == ("trigger_time", type_) and got.dtypes[-1] == ("duration_minutes", "bigint")
    want = [(fixtures.TRIGGER_TIME, *row, 60) for row in fixtures.HISTORY]
    assert sorted(map(tuple, got.collect())) == want


def test_window_lengths(history):
    counts = {m: trigger_window(history, fixtures.TRIGGER_TIME, m).count() for m in (0, 1, 30, 60, 61)}
    assert counts == {0: 0, 1: 2, 30: 3, 60: 4, 61: 5}


def test_window_arguments(history):
    with pytest.raises(ValueError):
        trigger_window(history, fixtures.TRIGGER, -1)
    with pytest.raises(ValueError):
        trigger_window(history, "ten o'clock")
    with pytest.raises(TypeError):
        trigger_window(history, fixtures.TRIGGER, time_column="zone")
    with pytest.raises(ValueError):
        trigger_window(history.selectExpr("cast(timestamp as timestamp_ntz) t"), "2024-01-01T10:00:00+08:00", time_column="t")


def test_trigger_with_a_zone(history):
    aware = datetime(2024, 1, 1, 10, tzinfo=UTC)
    assert trigger_window(history, aware).count() == 4
    assert trigger_window(history, "2024-01-01T18:00:00+08:00").count() == 4


def test_bounds_reach_the_scan(spark, history, tmp_path):
    for type_, sep in (("timestamp", " "), ("timestamp_ntz", "T")):
        path = str(tmp_path / type_)
        history.withColumn("timestamp", F.col("timestamp").cast(type_)).write.parquet(path)
        df = trigger_window(spark.read.parquet(path), fixtures.TRIGGER).select("temperature")
        assert f"GreaterThanOrEqual(timestamp,2024-01-01{sep}09:00" in executed(df)
        assert f"LessThan(timestamp,2024-01-01{sep}10:00" in executed(df)
        assert "ReadSchema: struct<temperature:double,timestamp:" in executed(df)


def test_only_the_days_of_the_window_are_read(spark, history, tmp_path):
    at = Location(str(tmp_path))
    write_parquet(history.withColumn("day", F.to_date("timestamp")), at, "t", partition_by=["day"])
    table = spark.read.parquet(at.path("t"))
    df = trigger_window(table, fixtures.TRIGGER, date_column="day")
    assert df.count() == 4
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.selectedPartitions().partitionCount() == 1
    # Up to midnight: the day before only holds rows.
    midnight = trigger_window(table, "2024-01-02 00:00:00", 24 * 60, date_column="day")
    assert midnight.count() == trigger_window(table, "2024-01-02 00:00:00", 24 * 60).count() > 0


def test_sample_rollup(spark):
    spread = (-1.5, 0.5, 1.0)
    rows = [
        (pipeline, stage, mean + off, fixtures.TRIGGER_TIME - timedelta(minutes=10 * i + 1))
        for pipeline, stage, mean, _ in fixtures.DOWNSTREAM
        for i, off in enumerate(spread)
    ]
    rows.append(("ds_001", "processed", 1000.0, fixtures.TRIGGER_TIME))
    df = spark.createDataFrame(rows, "pipeline_id string, stage string, temperature double, timestamp timestamp")
    got = downstream_rollup(df, fixtures.TRIGGER, alert_above=25.0)
    assert got.dtypes == [
        ("trigger_time", "timestamp"), ("pipeline_id", "string"), ("stage", "string"), ("avg_temp", "double"),
        ("alert_status", "string"), ("window_minutes", "bigint"),
    ]
    want = [(fixtures.TRIGGER_TIME, p, s, pytest.approx(t), a, 60) for p, s, t, a in fixtures.DOWNSTREAM]
    assert sorted(map(tuple, got.collect())) == want


def test_alert_needs_more_than_the_limit(spark):
    df = spark.createDataFrame([("a", 25.0), ("b", None)], "p string, v double").withColumn(
        "timestamp", F.lit("2024-01-01 09:30:00").cast("timestamp")
    )
    got = downstream_rollup(df, fixtures.TRIGGER, alert_above=25.0, by=["p"], metric="v")
    assert {(r.p, r.avg_temp, r.alert_status) for r in got.collect()} == {("a", 25.0, "NORMAL"), ("b", None, "NORMAL")}


def many(spark, type_="timestamp_ntz", rows=3000):
    """Readings of three days, a third of them at one moment, and triggers all over and beyond."""
    moment = F.when(F.col("id") % 3 == 0, F.lit(777_777)).otherwise(F.pmod(F.xxhash64("id"), F.lit(3 * 86_400)))
    time = F.timestamp_seconds(F.lit(1_704_067_200) + moment)
    readings = spark.range(rows).select("id", time.cast(type_).alias("timestamp"), (F.col("id") % 4).alias("zone"), (F.col("id") * 0.1).alias("temperature"))
    moment = F.timestamp_seconds(F.lit(1_704_067_200 - 3600) + F.col("id") * 9_173)
    triggers = spark.range(40).select(moment.cast(type_).alias("trigger_time"), F.concat(F.lit("t"), "id").alias("name"))
    return readings.union(readings.limit(1).select("id", F.lit(None).cast(type_), "zone", "temperature")), triggers


def joined(readings, triggers, minutes):
    """Every reading with every trigger, on the driver."""
    left, right = readings.collect(), triggers.collect()
    return [
        (r, t) for t in right for r in left
        if r.timestamp is not None and t.trigger_time - timedelta(minutes=minutes) <= r.timestamp < t.trigger_time
    ]


@pytest.mark.parametrize("type_", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("split_rows", [100, 10**6])
def test_many_triggers(spark, type_, split_rows):
    from tidegauge.operators import trigger_windows

    readings, triggers = many(spark, type_)
    triggers = triggers.union(triggers.limit(2))
    got = trigger_windows(readings, triggers, 700, split_rows=split_rows)
    assert got.columns == ["id", "timestamp", "zone", "temperature", "trigger_time", "name", "duration_minutes"]
    want = joined(readings, triggers, 700)
    assert len(want) > 1000
    assert sorted((r.id, r["name"], r.duration_minutes) for r in got.collect()) == sorted((r.id, t["name"], 700) for r, t in want)
    assert "CartesianProduct" not in executed(got) and "NestedLoop" not in executed(got)


def test_many_triggers_at_the_bounds(spark):
    from tidegauge.operators import downstream_rollups, trigger_windows

    start = datetime(2024, 1, 1)
    times = [start + timedelta(minutes=m, microseconds=u) for m in (0, 59, 60, 61, 120) for u in (-1, 0, 1)]
    readings = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(times)], "id long, timestamp timestamp_ntz, temperature double")
    triggers = spark.createDataFrame([(start + timedelta(minutes=m),) for m in (60, 120, 121)] + [(None,)], "trigger_time timestamp_ntz")
    for minutes in (0, 1, 7, 60, 61):
        got = trigger_windows(readings, triggers, minutes)
        want = joined(readings, triggers.where("trigger_time is not null"), minutes)
        assert sorted((r.id, r.trigger_time) for r in got.collect()) == sorted((r.id, t.trigger_time) for r, t in want)
        rollup = downstream_rollups(readings.withColumn("g", F.lit(1)), triggers, minutes, alert_above=0.5, by=["g"])
        assert {r.trigger_time for r in rollup.collect()} == {t.trigger_time for _, t in want}
    with pytest.raises(ValueError):
        trigger_windows(readings, triggers, -1)
    with pytest.raises(ValueError):
        trigger_windows(readings.withColumn("trigger_time", F.lit(1)), triggers)
    with pytest.raises(TypeError):
        trigger_windows(readings.withColumn("timestamp", F.lit("x")), triggers)


@pytest.mark.parametrize("type_", ["timestamp", "timestamp_ntz"])
def test_many_rollups(spark, type_):
    from tidegauge.operators import downstream_rollups

    readings, triggers = many(spark, type_)
    groups = {}
    for r, t in joined(readings, triggers, 500):
        groups.setdefault((t.trigger_time, r.zone), []).append(r.temperature)
    for bin_minutes, split_rows in ((None, 10**6), (7, 50), (500, 10**6)):
        got = downstream_rollups(
            readings, triggers.union(triggers), 500, alert_above=150.0, by=["zone"], bin_minutes=bin_minutes, split_rows=split_rows
        )
        rows = {(r.trigger_time, r.zone): r for r in got.collect()}
        assert rows.keys() == groups.keys()
        for key, values in groups.items():
            assert rows[key].avg_temp == pytest.approx(sum(values) / len(values), rel=1e-12)
            assert rows[key].alert_status == ("WARNING" if rows[key].avg_temp > 150 else "NORMAL")
            assert rows[key].window_minutes == 500


def test_windows_over_a_clock_change(spark):
    """Instants, not clock times, decide where a time has a zone."""
    from tidegauge.operators import trigger_windows

    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        readings = spark.range(300).select("id", F.timestamp_seconds(F.lit(1_729_987_200) + F.col("id") * 60).alias("timestamp"))
        triggers = spark.range(10).select(F.timestamp_seconds(F.lit(1_729_987_200) + F.col("id") * 1777).alias("trigger_time"))
        got = trigger_windows(readings, triggers, 90).select("id", F.unix_seconds("trigger_time").alias("t")).collect()
        want = {(i, 1_729_987_200 + t * 1777) for t in range(10) for i in range(300) if t * 1777 - 5400 <= i * 60 < t * 1777}
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rollups_do_not_join_readings_with_triggers(spark):
    """Many readings and triggers in one bin: no join sees their pairs, in one task or in several, of any sort of value."""
    from tidegauge.operators import downstream_rollups

    time = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1_000_003)
    value = F.when(F.col("id") == 5, F.lit(float("inf"))).when(F.col("id") % 7 != 0, F.col("id") * 0.1)
    zone = F.when(F.col("id") % 3 > 0, F.col("id") % 3)
    readings = spark.range(2000).select("id", time.alias("timestamp"), zone.alias("zone"), value.alias("temperature"))
    triggers = readings.where("id % 2 = 0").select(F.col("timestamp").alias("trigger_time"))
    groups = {}
    for r, t in joined(readings, triggers, 20):
        groups.setdefault((t.trigger_time, r.zone), []).append(r.temperature)
    for bin_minutes, split_rows in ((100, 10**6), (20, 100)):
        got = downstream_rollups(
            readings, triggers, 20, alert_above=50.0, by=["zone"], bin_minutes=bin_minutes, split_rows=split_rows
        )
        # A bin of 20 minutes has 1,200 readings and 600 triggers; the pairs of all would be over 500,000.
        assert 0 < max(rows_of_joins(got)) <= 10_000
        found = got.collect()
        rows = {(r.trigger_time, r.zone): r.avg_temp for r in found}
        assert rows.keys() == groups.keys() and len(found) == len(groups)
        for key, values in groups.items():
            known = [v for v in values if v is not None]
            assert rows[key] == (pytest.approx(sum(known) / len(known), rel=1e-12) if known else None)
