import json

import pytest
from pyspark.errors import PySparkException

import fixtures
import __spark_entry__ as registered
from conftest import DATA
from plans import executed, scans
from tidegauge.__main__ import main
from tidegauge.operators import Thresholds
from tidegauge.plans import schema_catalog, sensor_job
from tidegauge.schema import CastRule, TableSchema
from tidegauge.session import DEFAULT_SETTINGS, MIB, open_session, set_options, settings_for_input
from tidegauge.sources import scratch


def test_job_on_the_sample(sample):
    job = sensor_job(sample, "2024-01-01 10:02:00", 2, alert_above=22.0, thresholds=Thresholds(min_row_count=6))
    assert {r.location for r in job.summary.collect()} == fixtures.SUMMARY.keys()
    assert job.window.count() == 4
    assert {(r.location, round(r.avg_temp, 9), r.alert_status) for r in job.downstream.collect()} == {
        ("warehouse_A", 24.3, "WARNING"),
        ("warehouse_B", 21.8, "NORMAL"),
        ("warehouse_C", 19.3, "NORMAL"),
    }
    report = job.report()
    assert report.columns == ["section", "subject", "measure", "value", "status"]
    rows = {(r.section, r.subject, r.measure): (r.value, r.status) for r in report.collect()}
    assert rows["summary", "warehouse_B", "active_sensors"] == (2.0, None)
    assert rows["quality", "humidity", "null_ratio"] == (0.0, "ok")
    assert rows["quality", None, "row_count"] == (5.0, "warning")
    assert rows["window", "warehouse_A", "readings"] == (2.0, None)
    assert rows["downstream", "warehouse_C", "avg_temp"] == (19.3, "NORMAL")
    assert len(rows) == 15 + 5 + 3 + 3
    assert "CartesianProduct" not in executed(report) and "NestedLoop" not in executed(report)


def test_catalog_shows_what_a_rule_does_to_the_data(spark):
    df = spark.createDataFrame([("1", "x"), ("y", "2"), ("3", None)], "a string, b string")
    table = TableSchema(
        "t", "d", (CastRule("a", "n", "int", nullable=False), CastRule("b", "m", "int"), CastRule("b", "n", "string"))
    )
    got = schema_catalog(df, table).sort("position").collect()
    assert [tuple(r) for r in got] == [
        ("d", "t", 1, "n", "b", "string", True, pytest.approx(1 / 3)),
        ("d", "t", 2, "m", "b", "int", True, pytest.approx(2 / 3)),
    ]


def test_session_settings(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        assert open_session("again", {key: "false"}) is spark
        assert spark.conf.get(key) == "false"
        open_session("again")
        assert all(spark.conf.get(k) == v for k, v in DEFAULT_SETTINGS.items())
        set_options(spark, {"spark.sql.files.maxPartitionBytes": "64m", key: "false"})
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "64m"
        assert spark.conf.get(key) == "false"
        with pytest.raises(PySparkException, match="CANNOT_MODIFY"):
            set_options(spark, {"spark.sql.warehouse.dir": "/elsewhere"})
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        set_options(spark, {key: "true"})


def test_sized_settings_can_be_set_on_a_live_session(spark):
    settings = settings_for_input(10**12)
    saved = {key: spark.conf.get(key, None) for key in settings}
    try:
        set_options(spark, settings)
        assert {key: spark.conf.get(key) for key in settings} == settings
        assert spark.range(10).groupBy("id").count().count() == 10
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_settings_grow_with_the_input():
    def settings(*args):
        got = settings_for_input(*args)
        return int(got["spark.sql.shuffle.partitions"]), int(got["spark.sql.files.maxPartitionBytes"]) // MIB

    assert settings(0) == (200, 128)
    assert settings(10**12) == (7451, 128)
    assert settings(10**14) == (745059, 128)
    assert settings(10**14, 10**12) == (7451, 128)


def test_settings_are_limited_only_by_the_caller():
    got = settings_for_input(10**14, most_shuffle_partitions=20_000, most_scan_tasks=200_000)
    assert got["spark.sql.shuffle.partitions"] == "20000"
    assert int(got["spark.sql.files.maxPartitionBytes"]) == 5 * 10**8


def test_report_takes_three_scans(spark):
    assert scans(registered.sensor_job(spark, str(DATA / "sf0.001"))) == 3


def test_report_of_an_empty_table(spark, sample):
    job = sensor_job(sample.limit(0), "2024-01-01 10:02:00", alert_above=1.0)
    assert sorted((r.section, r.measure, r.value, r.status) for r in job.report().collect()) == [
        ("quality", "duplicate_ratio", 0.0, "ok"), *[("quality", "null_ratio", 0.0, "ok")] * 3,
        ("quality", "row_count", 0.0, "warning"),
    ]


def test_scratch_folders_are_marked_for_deletion(spark):
    at = scratch(spark)
    spark.range(3).write.parquet(at.path("t"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(at.path(""))
    assert folder.getFileSystem(spark._jsc.hadoopConfiguration()).cancelDeleteOnExit(folder)


def test_job_from_the_command_line(spark, tmp_path, capsys):
    lines = [dict(zip(fixtures.READING_COLUMNS, row)) for row in fixtures.READINGS]
    (tmp_path / "readings.json").write_text("\n".join(map(json.dumps, lines)))
    for run in ("first", "second"):
        main([f"{tmp_path}/readings.json", f"{tmp_path}/out", "--trigger", "2024-01-01 10:02:00", "--minutes", "2",
              "--alert-above", "22", "--run-id", run])
    shown = capsys.readouterr().out
    assert "summary|warehouse_A|avg_temperature|" in shown
    assert {d.name for d in (tmp_path / "out" / "readings").glob("day=*")} == {"day=2024-01-01"}
    assert spark.read.parquet(f"{tmp_path}/out/history").groupBy("run_id").count().count() == 2
    assert spark.read.parquet(f"{tmp_path}/out/report").count() == 26
