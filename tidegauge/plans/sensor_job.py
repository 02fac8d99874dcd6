"""The whole sensor job: summary, quality, trigger window, downstream rollup."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import exact
from tidegauge.functions.keys import row_key
from tidegauge.operators.aggregates import summarize_readings
from tidegauge.operators.quality import Thresholds, check_columns, quality_report
from tidegauge.operators.windows import rollup_with_counts, trigger_window


MEANS = ("temperature", "humidity", "pressure")


@dataclass(frozen=True)
class SensorJob:
    """The job's tables. Each is lazy and reads only the columns it needs."""

    readings: DataFrame
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    thresholds: Thresholds
    digest: bool
    summary: DataFrame
    quality: DataFrame
    window: DataFrame
    rollup: DataFrame
    exact_means: bool = False

    @property
    def downstream(self) -> DataFrame:
        return self.rollup.drop("readings")

    def report(self) -> DataFrame:
        """All results as (section, subject, measure, value, status) rows, from three scans.

        One reads the measures and counts, per location and, added up, for the
        whole table; one the keys; one the trigger window.
        """
        sums = _exact_sums(MEANS) if self.exact_means else _plain_sums(MEANS)
        by_location = self.readings.groupBy("location").agg(
            *(c.alias(name) for name, c in ({n: s.start for n, s in sums.items()} | _counts(self.columns)).items())
        )
        keys = row_key(self.readings, self.keys, self.digest)
        key_rows = self.readings.agg(F.count("*").alias("row_count"), F.count_distinct(keys).alias("number"))
        return report_rows(by_location, key_rows, self.rollup, self.columns, self.thresholds, self.exact_means)


@dataclass(frozen=True)
class _Sum:
    """How a sum begins, how those of several parts are added, and that of no rows."""

    start: Column
    add: Column
    zero: Column


def _plain_sums(metrics: Sequence[str]) -> dict[str, _Sum]:
    sums = {f"sum_{m}": _Sum(F.sum(m), F.sum(f"sum_{m}"), F.lit(0.0)) for m in metrics}
    return sums | {f"n_{m}": _Sum(F.count(m), F.sum(f"n_{m}"), F.lit(0).cast("long")) for m in metrics}


def _exact_sums(metrics: Sequence[str]) -> dict[str, _Sum]:
    return {
        f"sum_{m}": _Sum(F.expr(exact.sum_state(m)), F.expr(exact.merged(f"sum_{m}")), F.expr(exact.empty_state())) for m in metrics
    }


def _counts(columns: Sequence[str]) -> dict[str, Column]:
    counts = {"reading_count": F.count("*"), "active_sensors": F.count_if(F.col("status") == 1)}
    return counts | {f"filled_{i}": F.count(F.col(c)) for i, c in enumerate(columns)}


def report_rows(
    by_location: DataFrame,
    key_rows: DataFrame,
    rollup: DataFrame,
    columns: Sequence[str],
    thresholds: Thresholds,
    exact_means: bool,
) -> DataFrame:
    """The report out of sums and counts per location, the row (row_count, number) of the keys, and the rollup."""
    totals = _totals(by_location, _exact_sums(MEANS) if exact_means else _plain_sums(MEANS), columns, exact_means)
    measures = [f"avg_{m}" for m in MEANS] + ["reading_count", "active_sensors"]
    n = len(columns)
    numbers = [f"filled_{i}" for i in range(n)]
    pairs = F.array(*(_number(i, F.col(name)) for i, name in enumerate(numbers)), _number(n + 1, F.col("reading_count")))
    values = F.array(*(_measure(m, F.col(m)) for m in measures))
    # A row of totals becomes its measures or, being that of the whole table, its checks.
    rows = totals.select(
        "location",
        F.col("reading_count").alias("row_count"),
        "whole",
        F.when(~F.col("whole"), values).alias("values"),
        F.when(F.col("whole"), pairs).alias("numbers"),
    ).select("location", "row_count", "whole", F.explode(F.coalesce(
        F.transform("values", lambda v: F.struct(v["measure"].alias("measure"), v["value"].alias("value"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("number"))),
        F.transform("numbers", lambda p: F.struct(F.lit(None).cast("string").alias("measure"), F.lit(None).cast("double").alias("value"), p["at"].alias("at"), p["number"].alias("number"))),
    )).alias("r"))
    no_text = F.lit(None).cast("string")
    everything = rows.select("location", "row_count", "whole", "r.*").unionByName(
        key_rows.select(
            no_text.alias("location"), "row_count", F.lit(True).alias("whole"), no_text.alias("measure"),
            F.lit(None).cast("double").alias("value"), F.lit(n).alias("at"), "number",
        )
    )
    found = check_columns(F.col("at"), F.col("row_count"), F.col("number"), columns, thresholds)
    whole = F.col("whole")
    both = everything.select(
        F.when(whole, "quality").otherwise("summary").alias("section"),
        F.when(whole, found["column_name"]).otherwise(F.col("location")).alias("subject"),
        F.when(whole, found["check_name"]).otherwise(F.col("measure")).alias("measure"),
        F.when(whole, found["value"]).otherwise(F.col("value")).alias("value"),
        F.when(whole, F.when(~found["violated"], "ok").otherwise(found["severity"])).alias("status"),
    )
    return both.unionByName(_window_rows(rollup))


def _totals(by_location: DataFrame, sums: dict[str, _Sum], columns: Sequence[str], exact_means: bool) -> DataFrame:
    """Per location, and once for the whole table (``whole``), what summary and checks are made of."""
    counts = list(_counts(columns))
    # The few rows per location once more, added up; an empty table has its zeros too.
    own = F.struct("location", F.lit(False).alias("whole"))
    all_ = F.struct(F.lit(None).cast("string").alias("location"), F.lit(True).alias("whole"))
    twice = by_location.withColumn("to", F.explode(F.array(own, all_))).drop("location")
    zeros = by_location.sparkSession.range(1).select(
        *(s.zero.alias(name) for name, s in sums.items()), *(F.lit(0).cast("long").alias(c) for c in counts), all_.alias("to")
    )
    added = twice.unionByName(zeros).groupBy("to").agg(
        *(s.add.alias(name) for name, s in sums.items()), *(F.sum(c).alias(c) for c in counts)
    )
    if exact_means:
        means = {f"avg_{m}": exact.mean(f"sum_{m}") for m in MEANS}
    else:
        means = {f"avg_{m}": F.when(F.col(f"n_{m}") > 0, F.col(f"sum_{m}") / F.col(f"n_{m}")) for m in MEANS}
    return added.withColumns(means).select("to.*", *means, *counts)


def _window_rows(rollup: DataFrame) -> DataFrame:
    """Readings and mean temperature of the trigger window per location, from one aggregate."""
    both = F.array(
        F.struct(F.lit("window").alias("section"), F.lit("readings").alias("measure"),
                 F.col("readings").cast("double").alias("value"), F.lit(None).cast("string").alias("status")),
        F.struct(F.lit("downstream").alias("section"), F.lit("avg_temp").alias("measure"),
                 F.col("avg_temp").cast("double").alias("value"), F.col("alert_status").alias("status")),
    )
    rows = rollup.select(F.col("location").alias("subject"), F.explode(both).alias("r"))
    return rows.select("r.section", "subject", "r.measure", "r.value", "r.status")


def _number(at: int, number: Column) -> Column:
    return F.struct(F.lit(at).alias("at"), number.cast("long").alias("number"))


def _measure(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"))


def sensor_job(
    readings: DataFrame,
    trigger: str,
    minutes: int = 60,
    *,
    alert_above: float,
    keys: Sequence[str] = ("device_id",),
    columns: Sequence[str] = ("temperature", "humidity", "pressure"),
    thresholds: Thresholds = Thresholds(),
    date_column: str | None = None,
    digest: bool = True,
    single_scan: bool = False,
    exact_means: bool = False,
) -> SensorJob:
    """Plan the job.

    ``date_column`` names the daily folders of a partitioned table; ``digest``
    and ``single_scan`` are those of ``quality_report``. ``report`` always takes
    the three scans that it names. With ``exact_means`` all means have the same
    bits whatever the order of the rows.
    """
    return SensorJob(
        readings=readings,
        keys=tuple(keys),
        columns=tuple(dict.fromkeys(columns)),
        thresholds=thresholds,
        digest=digest,
        summary=summarize_readings(readings, exact_means=exact_means),
        quality=quality_report(readings, keys, columns, thresholds, digest, single_scan),
        window=trigger_window(readings, trigger, minutes, date_column=date_column),
        rollup=rollup_with_counts(
            readings, trigger, minutes, alert_above=alert_above, by=("location",), date_column=date_column, exact_means=exact_means
        ),
        exact_means=exact_means,
    )
