"""A table schema checked against its data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.casting import cast_columns
from tidegauge.operators.quality import null_ratio
from tidegauge.schema import TableSchema, quoted


def schema_catalog(df: DataFrame, table: TableSchema) -> DataFrame:
    """One row per target column: its rule, and the share of NULLs ``df`` gives under it."""
    rules = {rule.target: rule for rule in table.rules}

    def of_rule(attribute: str, type_: str) -> Column:
        values = [F.lit(v) for name, rule in rules.items() for v in (name, getattr(rule, attribute))]
        return F.create_map(*values)[F.col("column_name")].cast(type_)

    # A target's name may hold dots, which are no path into a struct here.
    columns = [quoted(name) for name in rules]
    names = F.array(*map(F.lit, rules))
    ratios = null_ratio(cast_columns(df, table.rules), columns).withColumn("column_name", F.get(names, F.col("position") - 1))
    return ratios.select(
        F.lit(table.database).alias("database_name"),
        F.lit(table.name).alias("table_name"),
        "position",
        "column_name",
        of_rule("source", "string").alias("source_column"),
        of_rule("type", "string").alias("type_name"),
        of_rule("nullable", "boolean").alias("nullable"),
        "null_ratio",
    )
