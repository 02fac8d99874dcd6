import pytest
from pyspark.sql import types as T

from tidegauge.schema import SENSOR_SCHEMA, SENSOR_TYPES, CastRule, Source, TableSchema, struct_from_types, types_of


def test_sensor_schema():
    assert SENSOR_SCHEMA == T.StructType(
        [
            T.StructField("temperature", T.DoubleType()),
            T.StructField("humidity", T.DoubleType()),
            T.StructField("pressure", T.DoubleType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField("device_id", T.StringType()),
            T.StructField("location", T.StringType()),
            T.StructField("status", T.IntegerType()),
        ]
    )
    assert types_of(SENSOR_SCHEMA) == SENSOR_TYPES


def test_unknown_type_is_string():
    assert struct_from_types({"a": "bigint", "b": "integer"}).simpleString() == "struct<a:string,b:int>"


def test_metadata_text():
    source = Source("iot_sensors", SENSOR_SCHEMA, lambda spark: None)
    assert source.metadata() == {
        "source_name": "iot_sensors",
        "schema": "{'temperature': 'double', 'humidity': 'double', 'pressure': 'double', 'timestamp': 'timestamp', "
        "'device_id': 'string', 'location': 'string', 'status': 'integer'}",
    }


def test_cast_rule_defaults():
    rule = CastRule("raw_temp", "temperature", "double")
    assert rule.nullable and rule.default is None


def test_table_from_config():
    table = TableSchema.from_config(
        "readings",
        "plant",
        [
            {"source": "t", "target": "temperature", "type": "double", "default_value": "0"},
            {"source": "id", "target": "device id", "type": "decimal(9,0)", "nullable": False},
        ],
    )
    assert table.rules == (
        CastRule("t", "temperature", "double"),
        CastRule("id", "device id", "decimal(9,0)", nullable=False),
    )
    assert table.partition_keys == ()
    assert table.types() == {"temperature": "double", "device id": "decimal(9,0)"}


def test_table_struct(spark):
    table = TableSchema("t", "d", (CastRule("a", "x`y", "array<int>"), CastRule("b", "z", "date")))
    assert table.struct().names == ["x`y", "z"]
    assert [f.dataType.simpleString() for f in table.struct()] == ["array<int>", "date"]


def test_config_needs_its_keys():
    with pytest.raises(KeyError):
        TableSchema.from_config("t", "d", [{"source": "a", "target": "b"}])


def test_repeated_target():
    table = TableSchema("t", "d", (CastRule("a", "x", "int"), CastRule("b", "x", "string")))
    assert table.types() == {"x": "string"}
    with pytest.raises(ValueError):
        table.struct()
