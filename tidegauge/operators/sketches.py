"""Distinct counts out of stored sketches.

A sketch stands for the set of keys of one part of a table in a few kilobytes.
The sketch of several parts is the union of theirs, so the number of different
keys over any choice of parts, say days, needs their sketches and no row of the
table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.keys import row_key
from tidegauge.sources.files import write_parts
from tidegauge.sources.locations import Location

LG_K = 14


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """How far an estimate may lie from the count, as a share of it.

    A sketch has 2**lg_k registers; the deviation of the estimate of a union
    is 1.04 over the square root of their number.
    """
    return deviations * 1.04 / 2 ** (lg_k / 2)


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """A key as one number. NULL parts are told apart from each other's values, which the hash alone passes over."""
    nulls = (F.col(key).isNull() for key in keys)
    return F.xxhash64(row_key(df, keys, digest=False), *nulls)


def distinct_sketches(df: DataFrame, by: Sequence[str], keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Per value of ``by``: row_count and the sketch of its keys, a binary column. Each map task combines its rows first."""
    hashed = df.withColumns({"_key": key_hash(df, keys)}) if "_key" not in df.columns else None
    if hashed is None:
        raise ValueError("the column name _key is taken")
    return hashed.groupBy(*by).agg(F.count("*").alias("row_count"), F.hll_sketch_agg("_key", F.lit(lg_k)).alias("sketch"))


def united(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """row_count and distinct_keys, about, over all sketches, or per value of ``by``; without sketches both are 0."""
    found = sketches.groupBy(*by).agg(F.sum("row_count").alias("row_count"), F.hll_union_agg("sketch").alias("sketch"))
    rows = F.coalesce("row_count", F.lit(0)).cast("bigint")
    # No estimate exceeds the number of rows.
    about = F.least(F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("bigint"), rows)
    return found.select(*by, rows.alias("row_count"), about.alias("distinct_keys"))


def store_sketches(sketches: DataFrame, at: Location, key: str, by: Sequence[str]) -> None:
    """Write sketches in folders by their part; parts already there are replaced, the others stay."""
    write_parts(sketches, at, key, by)


def stored_sketches(spark: SparkSession, at: Location, key: str) -> DataFrame:
    """The stored sketches. A filter on their part reads the folders of the chosen ones alone."""
    return spark.read.parquet(at.path(key))
