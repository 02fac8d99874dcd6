import json
from datetime import datetime
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidegauge import sources
from tidegauge.schema import SENSOR_SCHEMA, Source
from tidegauge.sources import Location
from tidegauge.sources.locations import shared_folder


@pytest.fixture
def at(tmp_path):
    return Location(f"file:{tmp_path}")


def test_paths_are_joined_as_given():
    assert Location("s3a://bucket", "a/b").path("c.parquet") == "s3a://bucket/a/b/c.parquet"
    assert Location("s3a://bucket").path("c.parquet") == "s3a://bucket/c.parquet"
    assert Location("s3a://bucket", "a/").path("/c") == "s3a://bucket/a///c"


def test_parquet_round_trip(spark, at):
    df = spark.range(3).withColumn("name", F.lit("x"))
    sources.write_parquet(df, at, "t")
    assert sources.scan_parquet(spark, at, "t").sort("id").collect() == df.collect()


def test_overwrite_replaces_all_partitions(spark, at):
    sources.write_parquet(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), at, "t", partition_by=["p"])
    sources.write_parquet(spark.createDataFrame([(3, "b")], "v int, p string"), at, "t", partition_by=["p"])
    assert sources.scan_parquet(spark, at, "t").collect() == [Row(v=3, p="b")]


def test_empty_partition_list_is_none(spark, at, tmp_path):
    sources.write_parquet(spark.range(1), at, "t", partition_by=[])
    assert not [p for p in (tmp_path / "t").iterdir() if p.is_dir()]


def test_partition_values_keep_their_text_under_a_schema(spark, at):
    sources.write_parquet(spark.createDataFrame([(1, "007")], "v int, p string"), at, "t", partition_by=["p"])
    assert spark.read.schema("v int, p string").parquet(at.path("t")).collect() == [Row(v=1, p="007")]


@pytest.mark.parametrize("rebalance", [False, True])
def test_partitioned_write_of_a_hot_value(spark, at, tmp_path, rebalance):
    # One value holds most rows; many others hold a few.
    df = spark.range(0, 60_000, 1, 16).select(
        F.sha2(F.col("id").cast("string"), 256).alias("v"),
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 10)).alias("p"),
    )
    saved = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        sources.write_parquet(df, at, "t", partition_by=["p"], rebalance=rebalance)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", saved)
    back = sources.scan_parquet(spark, at, "t")
    assert back.exceptAll(df).isEmpty() and back.count() == 60_000
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "t").glob("p=*")}
    if rebalance:
        # The hot value is spread; a small one is too only if it hashes to the same shuffle partition.
        assert files["p=hot"] > 1
        assert sum(files.values()) < 16 * len(files) / 3
    else:
        assert set(files.values()) == {16}


def test_json_inferred_and_declared(spark, at, tmp_path):
    (tmp_path / "t.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert sources.scan_json(spark, at, "t.json").dtypes == [("a", "bigint"), ("b", "string")]
    declared = sources.scan_json(spark, at, "t.json", "b string, a int")
    assert declared.collect() == [Row(b="x", a=1), Row(b=None, a=2)]


def test_csv_switches(spark, at, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    assert sources.scan_csv(spark, at, "t.csv").dtypes == [("a", "int"), ("b", "string")]
    assert sources.scan_csv(spark, at, "t.csv", infer=False).dtypes == [("a", "string"), ("b", "string")]
    assert sources.scan_csv(spark, at, "t.csv", header=False).columns == ["_c0", "_c1"]
    assert sources.scan_csv(spark, at, "t.csv", header=False).count() == 3
    assert sources.scan_csv(spark, at, "t.csv", schema="a bigint, b string").dtypes[0] == ("a", "bigint")


def test_readings_from_untidy_json(spark, tmp_path):
    good = {
        "device_id": "s1", "location": "A", "temperature": 1.5, "humidity": 2.5, "pressure": 3.5,
        "timestamp": "2024-01-01 10:00:00", "status": 1,
    }
    lines = [
        good,
        {k: v for k, v in good.items() if k != "pressure"},
        good | {"extra": 9},
        good | {"temperature": "hot"},
        good | {"status": 3_000_000_000},
        good | {"timestamp": "soon"},
    ]
    path = tmp_path / "r.json"
    path.write_text("\n".join(map(json.dumps, lines)) + f"\nnot json\n{json.dumps([good, good])}\n")
    df = sources.scan_readings(spark, str(path))
    assert df.schema == SENSOR_SCHEMA
    whole = Row(
        temperature=1.5, humidity=2.5, pressure=3.5, timestamp=datetime(2024, 1, 1, 10), device_id="s1", location="A",
        status=1,
    ).asDict()
    assert [r.asDict() for r in df.collect()] == [
        whole,
        whole | {"pressure": None},
        whole,
        whole | {"temperature": None},
        whole | {"status": None},
        whole | {"timestamp": None},
        dict.fromkeys(whole),
        # A line holding an array gives a row per element.
        whole,
        whole,
    ]


def test_readings_view_has_the_declared_schema(spark):
    df = spark.createDataFrame([("d", "A", "1.5", 2, 3.0, "2024-01-01 10:00:00", "x")], "d string, l string, t string, h int, p double, ts string, s string")
    view = sources.readings_view(
        df,
        {
            "device_id": "d", "location": F.lower("l"), "temperature": "t", "humidity": "h", "pressure": "p",
            "timestamp": "ts", "status": "s",
        },
    )
    assert view.schema == SENSOR_SCHEMA
    assert view.collect() == [Row(1.5, 2.0, 3.0, datetime(2024, 1, 1, 10), "d", "a", None)]
    with pytest.raises(ValueError, match="status"):
        sources.readings_view(df, {k: "d" for k in SENSOR_SCHEMA.names if k != "status"})


def test_series(spark):
    df = sources.generate_series(spark, 5, seed=1)
    assert df.dtypes == [("sensor_id", "string"), ("value", "double"), ("timestamp", "timestamp_ntz")]
    rows = df.collect()
    assert [(r.sensor_id, r.timestamp) for r in rows] == [(f"s_{i}", datetime(2024, 1, 1, i)) for i in range(5)]
    assert len({r.value for r in rows}) == 5
    many = sources.generate_series(spark, 100_000, seed=1).agg(F.avg("value"), F.stddev_pop("value")).first()
    assert many[0] == pytest.approx(0, abs=0.02) and many[1] == pytest.approx(1, abs=0.02)


def test_sources_are_described_and_validated(spark):
    full = Source("full", SENSOR_SCHEMA, lambda s: s.range(7))
    empty = Source("empty", SENSOR_SCHEMA, lambda s: s.range(0))
    assert sources.has_rows(full.read(spark)) and not sources.has_rows(empty.read(spark))
    assert sources.validate_sources(spark, [full, empty]).collect() == [("full", True), ("empty", False)]
    described = sources.source_metadata(spark, [full, empty])
    assert described.columns == ["source_name", "schema", "row_count"]
    assert {r.source_name: r.row_count for r in described.collect()} == {"full": 7, "empty": 0}


def session_with(master, shared):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf={"spark.checkpoint.dir": shared}, sparkContext=context)


def test_scratch_lies_in_the_shared_folder():
    shared = session_with("yarn", "hdfs:///shared")
    assert shared_folder(shared) == "hdfs:///shared"


def test_scratch_folders_differ(spark):
    first, second = sources.scratch(spark), sources.scratch(spark)
    assert first.base == second.base and first != second


def test_scratch_without_a_shared_folder():
    assert Path(shared_folder(session_with("local[2]", None))).is_dir()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_with("yarn", None))
