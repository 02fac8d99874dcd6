"""Stored sketches against exact counts, and tables laid out for lookups."""

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from plans import executed, scan_metrics
from tidegauge.operators import distinct_sketches, error_bound, store_sketches, stored_sketches, united
from tidegauge.sources import Location, land_json, scan_marking, write_clustered


def parted(spark, rows=60_000):
    return spark.range(rows).select(
        (F.col("id") % 10).cast("int").alias("day"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("a"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("b"),
    )


@pytest.mark.parametrize("lg_k", [10, 14])
def test_any_set_of_days(spark, tmp_path, lg_k):
    df, at = parted(spark), Location(str(tmp_path))
    store_sketches(distinct_sketches(df, ["day"], ["a", "b"], lg_k), at, "s", ["day"])
    stored = stored_sketches(spark, at, "s")
    for days in ([0], [1, 2], [3, 5, 7, 9], list(range(10))):
        got = united(stored.where(F.col("day").isin(days))).first()
        chosen = df.where(F.col("day").isin(days))
        count = chosen.select("a", "b").distinct().count()
        assert got.row_count == chosen.count() and abs(got.distinct_keys / count - 1) < error_bound(lg_k)
    # No row of the table is read for it, and only the folders of the days chosen.
    assert scan_metrics(united(stored.where("day in (3, 5)")))["numPartitions"] == 2
    got = {r.odd: r.distinct_keys for r in united(stored.withColumn("odd", F.col("day") % 2), ["odd"]).collect()}
    for odd in (0, 1):
        count = df.where(F.col("day") % 2 == odd).select("a", "b").distinct().count()
        assert abs(got[odd] / count - 1) < error_bound(lg_k)


def test_a_day_written_again_replaces_itself(spark, tmp_path):
    df, at = parted(spark, 1000), Location(str(tmp_path))
    store_sketches(distinct_sketches(df, ["day"], ["a"]), at, "s", ["day"])
    store_sketches(distinct_sketches(df.where("day = 4").limit(10), ["day"], ["a"]), at, "s", ["day"])
    rows = {r.day: r.row_count for r in united(stored_sketches(spark, at, "s"), ["day"]).collect()}
    assert rows == {day: 10 if day == 4 else 100 for day in range(10)}


def test_null_parts_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None), ("a", "a"), ("a", "a")], "x string, y string")
    assert tuple(united(distinct_sketches(df, [], ["x", "y"])).first()) == (5, 4)
    assert tuple(united(distinct_sketches(df, ["x"], ["y"]).limit(0)).first()) == (0, 0)
    with pytest.raises(ValueError):
        distinct_sketches(df.withColumn("_key", F.lit(1)), [], ["x"])


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    items = spark.read.parquet(str(DATA / "sf0.01" / "lineitem.parquet")).withColumn("day", F.to_date("l_shipdate"))
    items = items.withColumn("item", F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), 256)).dropDuplicates(["item"])
    at, rows = Location(str(tmp_path)), items.count()
    write_clustered(items, at, "items", ["day", "l_suppkey"], ["item"], files=4, group_rows=2000, lookup_values=2000)
    back = spark.read.parquet(at.path("items"))
    assert back.count() == rows
    for wanted in [r.item for r in items.orderBy("item").limit(3).collect()]:
        found = back.where(F.col("item") == wanted)
        assert 1 <= scan_metrics(found)["numOutputRows"] <= 2000 and found.count() == 1
    assert scan_metrics(back.where(F.col("item") == "none"))["numOutputRows"] == 0
    # A range of the clustering column reads the groups that it touches.
    month = back.where("day >= date '1995-03-01' and day < date '1995-04-01'")
    assert "PushedFilters" in executed(month)
    assert month.count() <= scan_metrics(month)["numOutputRows"] <= month.count() + 4000


def test_bad_lines_are_kept_apart(spark, tmp_path):
    lines = ['{"a": 1, "b": "x"}', "junk", '{"a": "no", "b": "y"}', "", '{"b": "z"}', "[1, 2", '{"a": 3000000000, "b": "w"}']
    (tmp_path / "in.json").write_text("\n".join(lines) + "\n")
    at = Location(str(tmp_path))
    rows, bad = land_json(spark, str(tmp_path / "in.json"), "a int, b string", at, "landed")
    got = sorted((r.a is None, r.a or 0, r.b or "", r.readable) for r in rows.collect())
    assert got == [(False, 1, "x", True), (True, 0, "", False), (True, 0, "", False), (True, 0, "w", False), (True, 0, "y", False), (True, 0, "z", True)]
    assert sorted(r.bad_line for r in bad.collect()) == sorted([lines[1], lines[2], lines[5], lines[6]])
    assert bad.count() == 4 and rows.where("readable").count() == 2
    with pytest.raises(ValueError):
        scan_marking(spark, str(tmp_path), "bad_line string")
    (tmp_path / "good.json").write_text('{"a": 1}\n')
    rows, bad = land_json(spark, str(tmp_path / "good.json"), "a int, b string", at, "good")
    assert rows.count() == 1 and bad.count() == 0
