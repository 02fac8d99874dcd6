"""Tables landed by their schema."""

import pytest

from plans import scan_metrics
from tidegauge.plans import as_table, read_table, required_report, write_table
from tidegauge.schema import TableSchema
from tidegauge.sources import Location

COLUMNS = [
    {"source": "k", "target": "key", "type": "string", "nullable": False},
    {"source": "n", "target": "a.b", "type": "int", "default": "7"},
    {"source": "day", "target": "day", "type": "date", "nullable": False},
    {"source": "n", "target": "bad", "type": "int", "default": "no number"},
]
TABLE = TableSchema.from_config("t", "db", COLUMNS, partition_keys=["day"])


def rows(spark):
    return spark.createDataFrame(
        [(1, "12.9", "2024-01-01", 0), (None, "x", "2024-01-01", 0), (3, None, "2024-01-02", 0), (4, "5", "never", 0)],
        "k long, n string, day string, other int",
    )


def found(df):
    return sorted(map(str, df.collect()))


def test_defaults_fill_what_is_missing(spark):
    got = as_table(rows(spark), TABLE)
    assert got.columns == ["key", "a.b", "day", "bad"] and dict(got.dtypes)["a.b"] == "int"
    assert sorted((r["key"] or "", r["a.b"], str(r["day"]), r["bad"]) for r in got.collect()) == [
        ("", 7, "2024-01-01", None), ("1", 12, "2024-01-01", 12), ("3", 7, "2024-01-02", None), ("4", 5, "None", 5),
    ]


def test_required_columns_are_counted(spark):
    got = {r.column_name: (r.rows, r.missing, r.violated) for r in required_report(rows(spark), TABLE).collect()}
    assert got == {"key": (4, 1, True), "day": (4, 1, True)}
    empty = {r.column_name: (r.rows, r.missing, r.violated) for r in required_report(rows(spark).limit(0), TABLE).collect()}
    assert empty == {"key": (0, 0, False), "day": (0, 0, False)}
    free = TableSchema.from_config("t", "db", [{"source": "k", "target": "k", "type": "int"}])
    assert required_report(rows(spark), free).count() == 0


def test_partitions_are_replaced_alone(spark, tmp_path):
    at = Location(str(tmp_path))
    write_table(rows(spark), TABLE, at)
    assert found(read_table(spark, TABLE, at)) == found(as_table(rows(spark), TABLE))
    assert scan_metrics(read_table(spark, TABLE, at).where("day = date '2024-01-02'"))["numPartitions"] == 1
    again = rows(spark).where("k = 3").union(rows(spark).where("k = 3"))
    write_table(again, TABLE, at, replace_parts=True)
    got = read_table(spark, TABLE, at)
    assert got.count() == 5 and got.where("day = date '2024-01-02'").count() == 2
    write_table(again, TABLE, at)
    assert read_table(spark, TABLE, at).count() == 2
    plain = TableSchema.from_config("u", "db", COLUMNS)
    write_table(rows(spark), plain, at, replace_parts=True)
    assert found(read_table(spark, plain, at)) == found(as_table(rows(spark), plain))
    with pytest.raises(ValueError):
        write_table(rows(spark), TableSchema.from_config("t", "db", COLUMNS, partition_keys=["none"]), at)
