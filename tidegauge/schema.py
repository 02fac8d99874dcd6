"""Schema metadata: type maps, cast rules, table schemas, named sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The columns and type names of a sensor reading, in order.
SENSOR_TYPES = {
    "temperature": "double",
    "humidity": "double",
    "pressure": "double",
    "timestamp": "timestamp",
    "device_id": "string",
    "location": "string",
    "status": "integer",
}

# The type names a type map may use; any other name means string.
_NAMED_TYPES = {t.typeName(): t for t in (T.DoubleType(), T.TimestampType(), T.StringType(), T.IntegerType())}


def struct_from_types(types: Mapping[str, str]) -> T.StructType:
    """Type map to schema: map order, every field nullable, unknown type to string."""
    schema = T.StructType()
    for name, type_name in types.items():
        schema.add(name, _NAMED_TYPES.get(type_name, T.StringType()))
    return schema


def types_of(schema: T.StructType) -> dict[str, str]:
    """Schema to type map: Spark's short names, but ``integer`` in full as in type maps."""
    return {
        f.name: "integer" if isinstance(f.dataType, T.IntegerType) else f.dataType.simpleString()
        for f in schema
    }


SENSOR_SCHEMA = struct_from_types(SENSOR_TYPES)


def quoted(name: str) -> str:
    """A column's name as SQL text, dots and all."""
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class CastRule:
    """Fill ``target`` with ``source`` cast to ``type``.

    ``nullable`` and ``default`` describe the column for readers of the
    catalogue and for tables landed by their schema; casting alone does not act on them.
    """

    source: str
    target: str
    type: str
    nullable: bool = True
    default: str | None = None


@dataclass(frozen=True)
class TableSchema:
    name: str
    database: str
    rules: tuple[CastRule, ...] = ()
    partition_keys: tuple[str, ...] = ()

    @classmethod
    def from_config(
        cls, name: str, database: str, columns: Iterable[Mapping], partition_keys: Iterable[str] = ()
    ) -> TableSchema:
        """Build from dicts with ``source``, ``target``, ``type`` and maybe ``nullable`` and ``default``."""
        rules = (CastRule(c["source"], c["target"], c["type"], c.get("nullable", True), c.get("default")) for c in columns)
        return cls(name, database, tuple(rules), tuple(partition_keys))

    def types(self) -> dict[str, str]:
        """Target column to type name; of two rules for one target the later wins."""
        return {rule.target: rule.type for rule in self.rules}

    def struct(self) -> T.StructType:
        """The targets as a schema. A target named twice is an error here."""
        if len(self.types()) < len(self.rules):
            raise ValueError(f"{self.name}: a target column is named twice")
        return T.StructType.fromDDL(", ".join(f"{quoted(name)} {ddl}" for name, ddl in self.types().items()))


@dataclass(frozen=True)
class Source:
    """A named input: what it is called, its schema, and how to read it."""

    name: str
    schema: T.StructType
    reader: Callable[[SparkSession], DataFrame]

    def read(self, spark: SparkSession) -> DataFrame:
        return self.reader(spark)

    def types(self) -> dict[str, str]:
        return types_of(self.schema)

    def metadata(self) -> dict[str, str]:
        return {"source_name": self.name, "schema": str(self.types())}
