"""Sensor readings out of other tables, and generated series."""

from __future__ import annotations

import secrets
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.casts import lenient_cast
from tidegauge.functions.draws import normal_draw
from tidegauge.schema import SENSOR_SCHEMA


def readings_view(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """A table seen as sensor readings: the declared columns, types and order.

    ``columns`` names the source of each reading column; what does not fit the
    declared type becomes NULL. It is a plain projection, so filters and column
    pruning go through it to the scan.
    """
    missing = [name for name in SENSOR_SCHEMA.names if name not in columns]
    if missing:
        raise ValueError(f"no source given for {', '.join(missing)}")
    given = df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))
    types = {field.name: field.dataType for field in given.schema}
    return given.select(
        *(lenient_cast(F.col(f.name), types[f.name], f.dataType).alias(f.name) for f in SENSOR_SCHEMA)
    )


def hourly_series(ids: DataFrame, id_column: str = "id", start: str = "2024-01-01 00:00:00", seed: int | None = None) -> DataFrame:
    """One noise value per id: ``s_<id>``, a normal draw, and ``start`` plus id hours.

    The draw follows from the id and the seed alone, so it does not depend on
    how the ids are partitioned. Without a seed each call has one of its own.
    """
    seed = secrets.randbits(63) if seed is None else seed
    hours = F.col(id_column) * F.expr("interval '1' hour")
    return ids.select(
        F.concat(F.lit("s_"), F.col(id_column).cast("string")).alias("sensor_id"),
        normal_draw(F.col(id_column), seed, "hourly").alias("value"),
        (F.lit(start).cast("timestamp_ntz") + hours).alias("timestamp"),
    )


def generate_series(spark: SparkSession, rows: int, start: str = "2024-01-01 00:00:00", seed: int | None = None) -> DataFrame:
    """``hourly_series`` over the ids 0 to ``rows`` - 1, made on the executors."""
    return hourly_series(spark.range(rows), "id", start, seed)
