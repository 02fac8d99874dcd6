"""The sensor job over readings that come in batches of JSON lines, one batch per run.

Each batch is parsed once, into folders of its own. The states of the days it
brings are added to those of the batches before, so a run reads its own batch and the
trigger window, and reports on all readings so far.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.quality import Thresholds, quality_report, quality_verdict, record_run, recorded_runs, unreadable_check
from tidegauge.plans.daily import DailyStates
from tidegauge.plans.sensor_job import MEANS, sensor_job
from tidegauge.schema import SENSOR_SCHEMA
from tidegauge.sources.files import scan_marking, scan_parquet, write_parquet
from tidegauge.sources.locations import Location

# What a run id is made of, as it names folders.
_RUN_ID = re.compile(r"[A-Za-z0-9_.-]+")
# A folder's value that no run id turns into a number or a date.
_RUN = "run "


@dataclass(frozen=True)
class SensorRuns:
    """Readings, states, quality history and report of all runs, in folders of ``at``.

    A run that is tried again, or again with other lines, replaces its own batch
    and its own history and touches no other run. An unreadable line is a row
    of NULLs, or of the fields that fit, without a day if it has no time; the
    quality of a run holds the share of such lines as its last check. A batch
    without lines is one without readings.
    """

    at: Location
    keys: tuple[str, ...] = ("device_id",)
    columns: tuple[str, ...] = MEANS
    lg_k: int | None = None

    @property
    def _schema(self) -> str:
        return f"{SENSOR_SCHEMA.toDDL()}, bad_line string, run string, readable boolean, day date"

    @property
    def states(self) -> DailyStates:
        return DailyStates(
            self.at.path("readings"), self.at, "states", "day", tuple(self.keys), tuple(self.columns), self.lg_k, "run", self._schema
        )

    def readings(self, spark: SparkSession) -> DataFrame:
        """All readings so far, with the columns bad_line, run, readable and day; the last three are folders."""
        return spark.read.schema(self._schema).parquet(self.at.path("readings"))

    def land(self, spark: SparkSession, lines: str | Sequence[str], run_id: str) -> None:
        """Parse a batch and put it in the place of the run's former one."""
        if not _RUN_ID.fullmatch(run_id):
            raise ValueError("a run id is made of letters, digits and _ . -")
        marked = scan_marking(spark, lines, SENSOR_SCHEMA)
        rows = marked.withColumns({"readable": F.col("bad_line").isNull(), "day": F.to_date("timestamp")})
        write_parquet(rows, self.at, f"readings/run={_RUN}{run_id}", partition_by=["readable", "day"], rebalance=True)

    def quality(
        self, spark: SparkSession, thresholds: Thresholds = Thresholds(), days: tuple[str, str] | None = None
    ) -> DataFrame:
        """The quality report of all readings, or those of some days, and the share of unreadable lines."""
        lines = self.readings(spark)
        columns = tuple(dict.fromkeys(self.columns))
        if self.states.is_empty(spark):
            checks = quality_report(lines, self.keys, columns, thresholds)
        else:
            checks = self.states.quality(spark, thresholds, days)
        if days is not None:
            lines = lines.where(F.col("day").between(*(F.lit(d).cast("date") for d in days)))
        return checks.unionByName(unreadable_check(lines, len(columns) + 3, thresholds=thresholds))

    def report(
        self, spark: SparkSession, trigger: str, minutes: int = 60, *, alert_above: float, thresholds: Thresholds = Thresholds()
    ) -> DataFrame:
        """``SensorJob.report`` with exact means, of all readings."""
        if self.states.is_empty(spark):
            job = sensor_job(
                self.readings(spark), trigger, minutes, alert_above=alert_above, keys=self.keys, columns=self.columns,
                thresholds=thresholds, date_column="day", exact_means=True,
            )
            return job.report()
        return self.states.report(spark, trigger, minutes, alert_above=alert_above, thresholds=thresholds)

    def run(
        self,
        spark: SparkSession,
        lines: str | Sequence[str],
        run_id: str,
        trigger: str,
        minutes: int = 60,
        *,
        alert_above: float,
        thresholds: Thresholds = Thresholds(),
        recorded_at: datetime | None = None,
    ) -> list[str]:
        """Land a batch, record the quality of all readings so far, write the report; the days read for it."""
        self.land(spark, lines, run_id)
        read = self.states.refresh(spark)
        record_run(self.quality(spark, thresholds), self.at, "history", run_id, recorded_at)
        write_parquet(self.report(spark, trigger, minutes, alert_above=alert_above, thresholds=thresholds), self.at, "report")
        return [part.replace(_RUN, "", 1) for part in read]

    def history(self, spark: SparkSession) -> DataFrame:
        """The quality of every run, as of its time."""
        return recorded_runs(spark, self.at, "history")

    def verdicts(self, spark: SparkSession) -> DataFrame:
        """One row per run."""
        return quality_verdict(self.history(spark), by=["run_id"])

    def last_report(self, spark: SparkSession) -> DataFrame:
        return scan_parquet(spark, self.at, "report")
