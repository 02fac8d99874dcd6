"""A table landed by its schema: cast, completed, checked, and written in its partition folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.casting import cast_columns
from tidegauge.schema import TableSchema, quoted
from tidegauge.sources.files import write_parquet, write_parts
from tidegauge.sources.locations import Location


def table_key(table: TableSchema) -> str:
    """Where a table lies below its base: a folder per database, and in it one per table."""
    return f"{table.database}/{table.name}"


def as_table(df: DataFrame, table: TableSchema) -> DataFrame:
    """The targets of a table's rules alone, in order; where a value is missing or does not fit, the rule's default.

    Defaults are texts and are cast like values; one that does not fit its own type leaves NULL.
    """
    schema = table.struct()
    cast = cast_columns(df, table.rules).select(*(F.col(quoted(name)) for name in schema.names))
    defaults = {rule.target: rule for rule in table.rules if rule.default is not None}
    if not defaults:
        return cast
    given = cast.withColumns({name: F.coalesce(quoted(name), F.lit(rule.default).try_cast(rule.type)) for name, rule in defaults.items()})
    return given.select(*(F.col(quoted(name)) for name in schema.names))


def required_report(df: DataFrame, table: TableSchema) -> DataFrame:
    """One row per column that may not be NULL: column_name, rows, missing and violated, of the table that ``as_table`` makes.

    One scan counts for all columns; without such columns there is no row.
    """
    names = [rule.target for rule in table.rules if not rule.nullable]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, rows long, missing long, violated boolean")
    filled = [F.count(quoted(name)).alias(f"filled_{i}") for i, name in enumerate(names)]
    totals = as_table(df, table).agg(F.count("*").alias("rows"), *filled)
    each = F.array(*(F.struct(F.lit(name).alias("column_name"), F.col(f"filled_{i}").alias("filled")) for i, name in enumerate(names)))
    missing = F.col("rows") - F.col("each.filled")
    return totals.select("rows", F.explode(each).alias("each")).select(
        "each.column_name", "rows", missing.alias("missing"), (missing > 0).alias("violated")
    )


def write_table(df: DataFrame, table: TableSchema, at: Location, replace_parts: bool = False) -> None:
    """Land ``df`` as ``table`` in folders by its partition keys, if it has any.

    With ``replace_parts`` only the partitions that ``df`` has rows for are
    replaced, else the whole table. Rows of a partition are written by few tasks, large partitions by more.
    """
    if unknown := set(table.partition_keys) - set(table.types()):
        raise ValueError(f"{table.name}: no column for partition keys {', '.join(sorted(unknown))}")
    rows, keys = as_table(df, table), list(table.partition_keys)
    if keys and replace_parts:
        write_parts(rows, at, table_key(table), keys)
    else:
        write_parquet(rows, at, table_key(table), partition_by=keys or None, rebalance=bool(keys))


def read_table(spark: SparkSession, table: TableSchema, at: Location) -> DataFrame:
    """A table that ``write_table`` wrote, in its schema. Filters on partition keys read their folders alone."""
    return spark.read.schema(table.struct()).parquet(at.path(table_key(table))).select(*(F.col(quoted(n)) for n in table.types()))
