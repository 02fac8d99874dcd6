"""Runs over batches of readings against the job over all of them at once."""

import json

import pytest
from pyspark.sql import functions as F

from plans import scan_metrics
from tidegauge.__main__ import main
from tidegauge.operators import quality_report, summarize_readings
from tidegauge.plans import SensorRuns, sensor_job
from tidegauge.schema import SENSOR_SCHEMA
from tidegauge.sources import Location, scan_json

TRIGGER = "2024-01-03 12:00:00"


def line(day, i, **changed):
    reading = {
        "temperature": 0.1 * i + day, "humidity": None if i % 5 == 0 else 0.3 * i, "pressure": 1.0 / (i + 1),
        "timestamp": f"2024-01-{day:02} {i % 24:02}:{i % 60:02}:00", "device_id": f"d{(i * 7 + day) % 90}",
        "location": f"place {i % 3}" if i % 11 else None, "status": i % 3,
    }
    return json.dumps(reading | changed)


def write(folder, name, lines):
    path = folder / f"{name}.json"
    path.write_text("\n".join(lines))
    return str(path)


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.collect()), key=repr)


def check(spark, runs, paths):
    """The last run's results are those of all lines read at once."""
    given = scan_json(spark, Location("/"), "", SENSOR_SCHEMA) if not paths else spark.read.schema(SENSOR_SCHEMA).json(paths)
    job = sensor_job(given, TRIGGER, 600, alert_above=5.0, exact_means=True)
    same(runs.last_report(spark), job.report())
    same(runs.states.summary(spark), summarize_readings(given, exact_means=True))
    same(runs.quality(spark).where("check_name != 'unreadable_ratio'"), quality_report(given, runs.keys, runs.columns))


def run(spark, runs, path, run_id):
    return runs.run(spark, path, run_id, TRIGGER, 600, alert_above=5.0)


def share(runs, spark, run_id):
    found = runs.history(spark).where(F.col("run_id") == run_id)
    return {r.check_name: r.value for r in found.collect()}


def test_a_run_reads_its_own_batch(spark, tmp_path):
    runs = SensorRuns(Location(str(tmp_path / "out")))
    first = write(tmp_path, "a", [line(d, i) for d in (1, 2, 3) for i in range(100)])
    # Late rows of the second day, and lines that cannot be read.
    second = write(tmp_path, "b", [line(d, i) for d in (2, 4) for i in range(40)] + ["no json", line(4, 1, status="x"), line(4, 2, timestamp="x")])
    assert run(spark, runs, first, "first") == ["2024-01-01 of first", "2024-01-02 of first", "2024-01-03 of first"]
    check(spark, runs, [first])
    assert run(spark, runs, second, "2") == ["2024-01-02 of 2", "2024-01-04 of 2", "__HIVE_DEFAULT_PARTITION__ of 2"]
    check(spark, runs, [first, second])
    assert share(runs, spark, "first")["unreadable_ratio"] == 0
    assert share(runs, spark, "2")["unreadable_ratio"] == 3 / 383
    assert {r.run_id: (r.passed, r.row_count) for r in runs.verdicts(spark).collect()} == {"first": (False, 300), "2": (False, 383)}
    # The late rows' state came from their own files.
    late = scan_metrics(runs.states._groups(runs.states._readings_of(spark, ["day 2024-01-02 of run 2"])))
    assert late["numOutputRows"] == 40
    assert run(spark, runs, second, "2") == ["2024-01-02 of 2", "2024-01-04 of 2", "__HIVE_DEFAULT_PARTITION__ of 2"]
    check(spark, runs, [first, second])


def test_a_run_tried_again_with_other_lines(spark, tmp_path):
    runs = SensorRuns(Location(str(tmp_path / "out")))
    first = write(tmp_path, "a", [line(d, i) for d in (1, 3) for i in range(50)])
    wrong = write(tmp_path, "b", [line(d, i) for d in (3, 4, 5) for i in range(30)] + ["{"])
    right = write(tmp_path, "c", [line(d, i) for d in (3, 4) for i in range(35)])
    run(spark, runs, first, "007")
    run(spark, runs, wrong, "2024-01-05")
    assert share(runs, spark, "2024-01-05")["unreadable_ratio"] == 1 / 191
    # The day that is gone leaves the report too.
    assert "2024-01-05 of 2024-01-05" in run(spark, runs, right, "2024-01-05")
    check(spark, runs, [first, right])
    assert share(runs, spark, "2024-01-05")["unreadable_ratio"] == 0
    assert runs.history(spark).groupBy("run_id").count().count() == 2
    days = runs.quality(spark, days=("2024-01-03", "2024-01-03"))
    assert {r.check_name: r.value for r in days.collect()}["row_count"] == 85


def test_batches_without_lines(spark, tmp_path):
    runs = SensorRuns(Location(str(tmp_path / "out")))
    none, some = write(tmp_path, "a", []), write(tmp_path, "b", [line(1, i) for i in range(20)])
    assert run(spark, runs, none, "empty") == []
    assert share(runs, spark, "empty") == {"null_ratio": 0, "duplicate_ratio": 0, "row_count": 0, "unreadable_ratio": 0}
    assert run(spark, runs, some, "some") == ["2024-01-01 of some"]
    check(spark, runs, [some])
    # Nothing but lines without a time, in the place of the former.
    bad = write(tmp_path, "c", ["x", "y"])
    run(spark, runs, bad, "some")
    check(spark, runs, [bad])
    assert share(runs, spark, "some")["unreadable_ratio"] == 1
    run(spark, runs, none, "some")
    assert share(runs, spark, "some")["row_count"] == 0


def test_run_ids_name_folders(spark, tmp_path):
    runs = SensorRuns(Location(str(tmp_path)))
    for bad in ("", "a/b", "a b", "a=b", "x:y"):
        with pytest.raises(ValueError):
            runs.land(spark, "nowhere", bad)


def test_batches_from_the_command_line(spark, tmp_path, capsys):
    first = write(tmp_path, "a", [line(1, i) for i in range(20)])
    second = write(tmp_path, "b", [line(2, i) for i in range(10)] + ["?"])
    for path, run_id in ((first, "one"), (second, "two"), (second, "two")):
        main([path, f"{tmp_path}/out", "--trigger", TRIGGER, "--alert-above", "5", "--run-id", run_id, "--batches"])
    shown = capsys.readouterr().out
    assert "Unreadable line ratio 0.0323 exceeds threshold" in shown
    assert spark.read.parquet(f"{tmp_path}/out/readings").count() == 31
