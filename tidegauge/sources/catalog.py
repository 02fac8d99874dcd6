"""What can be said about sources: metadata, row counts, emptiness."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.schema import Source

JOBS_AT_ONCE = 8


def has_rows(df: DataFrame) -> bool:
    """Whether there is any row. Stops at the first one instead of counting."""
    return not df.isEmpty()


def validate_sources(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """One row per source: does it hold data?

    Runs one early-stopping job per source right away, a few side by side. A
    lazy ``limit(1)`` under an aggregate would start a task on every partition
    of every source.
    """
    with ThreadPoolExecutor(JOBS_AT_ONCE) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(lambda source: has_rows(source.read(spark))), sources))
    verdicts = [(source.name, valid) for source, valid in zip(sources, found)]
    return spark.createDataFrame(verdicts, "source_name string, valid boolean")


def source_metadata(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """One row per source: name, schema text and row count."""
    rows = (
        source.read(spark)
        .agg(F.count("*").alias("row_count"))
        .select(*(F.lit(text).alias(name) for name, text in source.metadata().items()), "row_count")
        for source in sources
    )
    return reduce(DataFrame.union, rows)
