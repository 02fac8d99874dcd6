"""File scans and the Parquet sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tidegauge.schema import SENSOR_SCHEMA
from tidegauge.sources.locations import Location


def scan_parquet(spark: SparkSession, at: Location, key: str) -> DataFrame:
    """Parquet table; the files carry the schema."""
    return spark.read.parquet(at.path(key))


def scan_json(spark: SparkSession, at: Location, key: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines. Inferring the schema reads all input once more; pass one to avoid it."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(at.path(key))


def scan_csv(
    spark: SparkSession,
    at: Location,
    key: str,
    header: bool = True,
    infer: bool = True,
    schema: StructType | str | None = None,
) -> DataFrame:
    """CSV. As with JSON, a given schema saves the inference pass."""
    reader = spark.read.option("header", header)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", infer)
    return reader.csv(at.path(key))


def scan_readings(spark: SparkSession, path: str) -> DataFrame:
    """Sensor readings from JSON lines, in the declared schema.

    A missing field, a value of the wrong type and every field of an unreadable
    line become NULL; fields outside the schema are dropped.
    """
    return spark.read.schema(SENSOR_SCHEMA).json(path)


def write_parquet(
    df: DataFrame,
    at: Location,
    key: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] | None = None,
    rebalance: bool = False,
) -> None:
    """Write Parquet, optionally in partition folders.

    Each task writes one file per partition value it meets. With few values
    that is the cheapest form. With many, ``rebalance=True`` first shuffles by
    the partition columns and lets adaptive execution merge the small groups
    and split the large ones, so that file counts stay low and a value holding
    a third of the rows is still written by many tasks.
    """
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    df.write.parquet(at.path(key), mode=mode, partitionBy=list(partition_by or []) or None)


def write_parts(df: DataFrame, at: Location, key: str, parts: Sequence[str]) -> None:
    """Write folders by ``parts``, replacing those the data has rows for and leaving all others.

    What is written again, as when a run is tried a second time, takes its own
    place. The rows of one part are written by few tasks, large parts by more.
    """
    df.hint("rebalance", *parts).write.option("partitionOverwriteMode", "dynamic").parquet(
        at.path(key), mode="overwrite", partitionBy=list(parts)
    )


def write_clustered(
    df: DataFrame,
    at: Location,
    key: str,
    cluster_by: Sequence[str],
    lookup: Sequence[str] = (),
    files: int | None = None,
    group_bytes: int = 32 << 20,
    group_rows: int | None = None,
    lookup_values: int | None = None,
    mode: str = "overwrite",
) -> None:
    """Write Parquet sorted by ``cluster_by``, with bloom filters on the ``lookup`` columns.

    Rows are dealt to files by ranges of the clustering columns and sorted
    within, so each row group spans a short stretch of them, its footer says
    which, and a filter on the first of them skips all other groups. A value that holds many rows
    spans several files only if the further columns tell its rows apart. A ``lookup`` column may be
    in any order: a filter on one of its values skips the groups whose bloom
    filter lacks it. ``group_bytes`` bounds a row group, and so does ``group_rows`` if given;
    ``lookup_values`` is how many different values a group is expected to have.
    Spark compares times without a zone with no footer: cluster by their date.
    """
    columns = [F.col(f"`{c}`") for c in cluster_by]
    dealt = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    options = {"parquet.block.size": str(group_bytes), "parquet.page.size": str(64 << 10)}
    if group_rows:
        options["parquet.block.row.count.limit"] = str(group_rows)
    for column in lookup:
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        # Dictionaries would stand in for the filter only where a column has few values.
        options[f"parquet.enable.dictionary#{column}"] = "false"
        if lookup_values:
            options[f"parquet.bloom.filter.expected.ndv#{column}"] = str(lookup_values)
    dealt.sortWithinPartitions(*columns).write.options(**options).parquet(at.path(key), mode=mode)


def scan_marking(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, bad_line: str = "bad_line") -> DataFrame:
    """JSON lines in a given schema, with the text of each unreadable line in one more column.

    The column is NULL for lines that could be read. A line is unreadable if it is no JSON object or one of
    its values does not fit; of the latter kind the fields that fit are kept.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if bad_line in wanted.names:
        raise ValueError(f"the schema has a column {bad_line}")
    marked = StructType([*wanted.fields, StructField(bad_line, StringType())])
    return spark.read.schema(marked).option("columnNameOfCorruptRecord", bad_line).json(path if isinstance(path, str) else list(path))


def land_json(
    spark: SparkSession, path: str, schema: StructType | str, at: Location, key: str, bad_line: str = "bad_line"
) -> tuple[DataFrame, DataFrame]:
    """Parse JSON lines once and keep them as Parquet: (rows, unreadable lines).

    The first holds one row per line, as ``scan_json`` with a schema gives it,
    and a column ``readable``; the second the text of the unreadable lines
    alone, in a folder of its own, so that counting or looking at them reads nothing else.
    """
    marked = scan_marking(spark, path, schema, bad_line)
    if "readable" in marked.columns:
        raise ValueError("the schema has a column readable")
    marked.withColumn("readable", F.col(bad_line).isNull()).write.partitionBy("readable").parquet(at.path(key), mode="overwrite")
    types = StructType([*marked.schema.fields, StructField("readable", BooleanType())])
    landed = spark.read.schema(types).parquet(at.path(key))
    return landed.drop(bad_line), landed.where(~F.col("readable")).select(bad_line)
