"""Data-quality measures, report, verdict and history."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.functions.keys import row_key
from tidegauge.sources.files import write_parquet, write_parts
from tidegauge.sources.locations import Location

# The names of the checks and the texts of the issues.
NULL_RATIO = "null_ratio"
DUPLICATE_RATIO = "duplicate_ratio"
ROW_COUNT = "row_count"
NULL_ISSUE = "Column '%s' null ratio %.4f exceeds threshold"
DUPLICATE_ISSUE = "Duplicate ratio %.4f exceeds threshold"
ROW_COUNT_ISSUE = "Row count %d below minimum threshold (warning)"

# Checks of this library's own.
UNREADABLE_RATIO = "unreadable_ratio"
UNREADABLE_ISSUE = "Unreadable line ratio %.4f exceeds threshold"


@dataclass(frozen=True)
class Thresholds:
    """Limits; a ratio must exceed its limit, or the rows fall below theirs, to violate it."""

    # The default limits.
    null_ratio_max: float = 0.05
    duplicate_ratio_max: float = 0.01
    min_row_count: int = 100
    unreadable_ratio_max: float = 0.0


@dataclass(frozen=True)
class QualityResult:
    passed: bool
    row_count: int
    null_ratios: dict[str, float]
    duplicate_ratio: float
    issues: list[str]

    def as_dict(self) -> dict:
        return asdict(self)


def _share(part: Column, whole: Column) -> Column:
    """part / whole, and 0.0 for an empty whole (whose parts are 0 too)."""
    return part / F.greatest(whole, F.lit(1))


def _filled(columns: Sequence[str]) -> list[Column]:
    """The values that are not NULL, per column: counts a Parquet footer can answer."""
    return [F.count(F.col(column)).alias(f"filled_{i}") for i, column in enumerate(columns)]


def _numbers(totals: DataFrame, numbers: Mapping[int, str]) -> DataFrame:
    """The one row of totals as a row (row_count, at, number) per position and column named.

    What is computed from the numbers is then a fixed set of expressions,
    however many columns are checked.
    """
    pairs = ", ".join(f"named_struct('at', {at}, 'number', {name})" for at, name in numbers.items())
    return totals.select("row_count", F.expr(f"inline(cast(array({pairs}) as array<struct<at: int, number: bigint>>))"))


def _name_at(columns: Sequence[str], at: Column) -> Column:
    return F.get(F.from_json(F.lit(json.dumps(columns)), "array<string>"), at)


def _once(columns: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(columns))


def null_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The share of NULLs in each column, one row per column, from one scan. NaN is no NULL.

    Over a stored Parquet table read under ``session.FOOTER_COUNTS`` the scan
    is of the file footers alone.
    """
    columns = _once(columns)
    totals = df.agg(F.count("*").alias("row_count"), *_filled(columns))
    at, rows = F.col("at"), F.col("row_count")
    return _numbers(totals, {i: f"filled_{i}" for i in range(len(columns))}).select(
        (at + 1).alias("position"),
        _name_at(columns, at).alias("column_name"),
        _share(rows - F.col("number"), rows).alias("null_ratio"),
    )


def duplicate_ratio(df: DataFrame, keys: Sequence[str], digest: bool = True) -> DataFrame:
    """Rows, distinct keys, and the share of rows beyond the first of their key."""
    totals = df.agg(
        F.count("*").alias("row_count"),
        F.count_distinct(row_key(df, keys, digest)).alias("distinct_keys"),
    )
    rows = F.col("row_count")
    return totals.withColumn("duplicate_ratio", _share(rows - F.col("distinct_keys"), rows))


def quality_report(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    thresholds: Thresholds = Thresholds(),
    digest: bool = True,
    single_scan: bool = False,
) -> DataFrame:
    """All checks, one row each, as one lazy frame.

    The rows hold position, check_name, column_name (for null checks),
    value, threshold, severity and violated.

    The keys are counted apart from the checked columns. Over a columnar table
    each column is still read once, and the shuffle holds keys alone; under
    ``session.FOOTER_COUNTS`` nothing but the keys is read. Where each pass over
    ``df`` is dear, as with parsed text or a join, ``single_scan`` takes one
    pass for everything and lets the column counters travel with the keys.
    """
    columns = _once(columns)
    total, filled = F.count("*").alias("row_count"), _filled(columns)
    distinct = F.count_distinct(row_key(df, keys, digest)).alias("distinct_keys")

    n = len(columns)
    of_columns = {i: f"filled_{i}" for i in range(n)}
    of_keys, of_rows = {n: "distinct_keys"}, {n + 1: "row_count"}
    if single_scan:
        numbers = _numbers(df.agg(total, distinct, *filled), of_columns | of_keys | of_rows)
    else:
        numbers = _numbers(df.agg(total, *filled), of_columns | of_rows).union(
            _numbers(df.agg(total, distinct), of_keys)
        )

    found = check_columns(F.col("at"), F.col("row_count"), F.col("number"), columns, thresholds)
    return numbers.select(*(column.alias(name) for name, column in found.items()))


def report_from_counts(
    of_columns: DataFrame, of_keys: DataFrame, columns: Sequence[str], thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """``quality_report`` out of counts: one row (row_count, filled_0, ...) and one (row_count, distinct_keys)."""
    columns = _once(columns)
    n = len(columns)
    numbers = _numbers(of_columns, {i: f"filled_{i}" for i in range(n)} | {n + 1: "row_count"}).union(
        _numbers(of_keys, {n: "distinct_keys"})
    )
    found = check_columns(F.col("at"), F.col("row_count"), F.col("number"), columns, thresholds)
    return numbers.select(*(column.alias(name) for name, column in found.items()))


def unreadable_check(
    lines: DataFrame, position: int, readable: str = "readable", thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """The share of unreadable lines as one more row of a report, from a table with one row per line.

    Over a table that ``land_json`` made, ``readable`` is a folder, so counting reads no column.
    """
    limit = float(thresholds.unreadable_ratio_max)
    totals = lines.agg(F.count("*").alias("rows"), F.count_if(~F.col(readable)).alias("bad"))
    value = _share(F.col("bad"), F.col("rows"))
    return totals.select(
        F.lit(position).alias("position"),
        F.lit(UNREADABLE_RATIO).alias("check_name"),
        F.lit(None).cast("string").alias("column_name"),
        value.alias("value"),
        F.lit(limit).alias("threshold"),
        F.lit("error").alias("severity"),
        (value > limit).alias("violated"),
    )


def check_columns(
    at: Column, rows: Column, number: Column, columns: Sequence[str], thresholds: Thresholds
) -> dict[str, Column]:
    """What a report says, by column, of a number counted at position ``at`` over ``rows`` rows.

    The number counts, at each column's index, its values; after them the
    distinct keys; and last the rows.
    """
    n = len(columns)
    is_column, is_rows = at < n, at > n
    # A count of values or of distinct keys leaves the NULLs or the duplicates.
    value = F.when(is_rows, rows.cast("double")).otherwise(_share(rows - number, rows))
    limit = (
        F.when(is_column, float(thresholds.null_ratio_max))
        .when(is_rows, float(thresholds.min_row_count))
        .otherwise(float(thresholds.duplicate_ratio_max))
    )
    return {
        "position": at + 1,
        "check_name": F.when(is_column, NULL_RATIO).when(is_rows, ROW_COUNT).otherwise(DUPLICATE_RATIO),
        "column_name": _name_at(columns, at),
        "value": value,
        "threshold": limit,
        "severity": F.when(is_rows, "warning").otherwise("error"),
        "violated": F.when(is_rows, value < limit).otherwise(value > limit),
    }


def quality_verdict(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A report as one row: passed, row_count, null_ratios, duplicate_ratio, issues.

    Warnings are listed but do not fail the verdict. ``by`` splits a history of
    reports into its runs, as it must: what is collected per run is one entry
    per check. A history that may hold a run twice goes through ``newest_runs`` first.
    """
    check, value = F.col("check_name"), F.col("value")
    is_null, is_duplicate, is_count, is_unreadable = (
        check == n for n in (NULL_RATIO, DUPLICATE_RATIO, ROW_COUNT, UNREADABLE_RATIO)
    )
    text = (
        F.when(is_null, F.format_string(NULL_ISSUE, F.col("column_name"), value))
        .when(is_duplicate, F.format_string(DUPLICATE_ISSUE, value))
        .when(is_unreadable, F.format_string(UNREADABLE_ISSUE, value))
        .otherwise(F.format_string(ROW_COUNT_ISSUE, value.cast("bigint")))
    )
    issue = F.when(F.col("violated"), F.struct("position", text.alias("text")))
    ratio = F.when(is_null, F.struct("position", "column_name", "value"))
    return report.groupBy(*by).agg(
        F.bool_and(~(F.col("violated") & (F.col("severity") == "error"))).alias("passed"),
        F.max(F.when(is_count, value.cast("bigint"))).alias("row_count"),
        F.map_from_entries(
            F.transform(
                F.array_sort(F.collect_list(ratio)),
                lambda r: F.struct(r["column_name"], r["value"]),
            )
        ).alias("null_ratios"),
        F.max(F.when(is_duplicate, value)).alias("duplicate_ratio"),
        F.transform(F.array_sort(F.collect_list(issue)), lambda i: i["text"]).alias("issues"),
    )


def quality_result(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    thresholds: Thresholds = Thresholds(),
    digest: bool = True,
    single_scan: bool = False,
) -> QualityResult:
    """Run the checks now and return the verdict; one job, one row fetched."""
    report = quality_report(df, keys, columns, thresholds, digest, single_scan)
    verdict = quality_verdict(report).first().asDict()
    # A map comes back in no particular order.
    verdict["null_ratios"] = {column: verdict["null_ratios"][column] for column in _once(columns)}
    return QualityResult(**verdict)


def newest_runs(history: DataFrame) -> DataFrame:
    """A history with each run's latest record only, as a job that is tried again appends its report again."""
    newest = F.max("recorded_at").over(Window.partitionBy("run_id"))
    return history.withColumn("_newest", newest).where("recorded_at = _newest").drop("_newest")


def append_history(
    report: DataFrame, at: Location, key: str, run_id: str, recorded_at: datetime | None = None
) -> None:
    """Add a report to the table of past runs, stamped with run id and time."""
    stamp = F.current_timestamp() if recorded_at is None else F.lit(recorded_at)
    stamped = report.withColumns({"run_id": F.lit(run_id), "recorded_at": stamp})
    write_parquet(stamped, at, key, mode="append")


HISTORY_SCHEMA = (
    "position int, check_name string, column_name string, value double, threshold double, "
    "severity string, violated boolean, recorded_at timestamp, run_id string"
)


def record_run(report: DataFrame, at: Location, key: str, run_id: str, recorded_at: datetime | None = None) -> None:
    """Put a report into the table of past runs, in the folder of its run.

    A run that is tried again replaces what it recorded before and touches no
    other run, so the table needs no clean-up by ``newest_runs`` when it is read.
    """
    if not run_id:
        raise ValueError("a run needs an id")
    stamp = F.current_timestamp() if recorded_at is None else F.lit(recorded_at)
    write_parts(report.withColumns({"run_id": F.lit(run_id), "recorded_at": stamp.cast("timestamp")}), at, key, ["run_id"])


def recorded_runs(spark: SparkSession, at: Location, key: str) -> DataFrame:
    """The table of past runs. A filter on run_id reads the folders of the chosen runs alone."""
    return spark.read.schema(HISTORY_SCHEMA).parquet(at.path(key))
