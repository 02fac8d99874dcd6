"""The job's report out of partial states kept per daily folder.

For every daily folder of a table three things are stored: sums and counts per
location, its different keys (or a sketch of them), and a fingerprint of its
files. A refresh lists the files, and computes again the days whose fingerprint
is new; the report then adds up states. After one new day that day is read and
no other, and the result is that of a scan of everything, bit by bit, as the
sums are exact.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import exact
from tidegauge.functions.keys import row_key
from tidegauge.operators.quality import Thresholds, report_from_counts
from tidegauge.operators.sketches import key_hash
from tidegauge.operators.windows import rollup_with_counts
from tidegauge.plans.sensor_job import MEANS, report_rows
from tidegauge.sources.files import write_parts
from tidegauge.sources.locations import Location

# What Spark calls the folder of the rows without a day.
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"
_OF_BATCH = " of "


@dataclass(frozen=True)
class DailyStates:
    """States of the readings in the daily folders of ``source``, kept under ``key``.

    ``day`` is the folders' column. With ``lg_k`` a sketch of 2**lg_k registers
    stands for the keys of a day, which bounds what is stored and read per day;
    the duplicate ratio is then an estimate. Other keys, columns or sketch sizes
    have states of their own.

    With ``batch``, a second folder column, each batch of a day has states of its
    own: rows that come late in a new batch are read without the day's other rows.
    ``schema`` is the type text of the table; without it the files are asked, and must exist.

    States are written under the day's fingerprint before the day's entry names
    it, so a refresh that breaks off leaves the former states in force, and one
    that is tried again replaces what it wrote.
    """

    source: str
    at: Location
    key: str
    day: str = "day"
    keys: tuple[str, ...] = ("device_id",)
    columns: tuple[str, ...] = MEANS
    lg_k: int | None = None
    batch: str | None = None
    schema: str | None = None

    def _part(self) -> Column:
        # A text that is never taken for a number or a date when folders are read.
        day = F.concat(F.lit("day "), F.coalesce(F.col(f"`{self.day}`").cast("string"), F.lit(_NO_DAY)))
        return F.concat(day, F.lit(_OF_BATCH), F.col(f"`{self.batch}`").cast("string")) if self.batch else day

    def _day_of(self, part: Column) -> Column:
        return F.substring_index(part, _OF_BATCH, 1) if self.batch else part

    def _table(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.schema(self.schema) if self.schema else spark.read
        return reader.parquet(self.source)

    def _folder(self, table: str) -> str:
        settings = repr((tuple(self.keys), tuple(dict.fromkeys(self.columns)), self.lg_k, *([self.batch] if self.batch else [])))
        return f"{self.key}/{zlib.crc32(settings.encode()):08x}/{table}"

    def _read(self, spark: SparkSession, table: str) -> DataFrame | None:
        try:
            return spark.read.parquet(self.at.path(self._folder(table)))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def fingerprints(self, spark: SparkSession) -> DataFrame:
        """(part, print, files, bytes) per daily folder, from names, sizes and times of its files; none is opened."""
        files = spark.read.format("binaryFile").load(self.source)
        if self.day not in files.columns:
            return spark.createDataFrame([], "part string, print long, files long, bytes long")
        name = F.element_at(F.split("path", "/"), -1)
        return files.groupBy(self._part().alias("part")).agg(
            F.bit_xor(F.xxhash64(name, "length", "modificationTime")).alias("print"),
            F.count("*").alias("files"),
            F.sum("length").alias("bytes"),
        )

    def _entries(self, spark: SparkSession) -> DataFrame:
        """(part, print) of the days whose states are in force."""
        days = self._read(spark, "days")
        if days is None:
            return spark.createDataFrame([], "part string, print long")
        return days.where(F.col("print").isNotNull()).select("part", "print")

    def is_empty(self, spark: SparkSession) -> bool:
        """Whether nothing was ever stored."""
        return self._read(spark, "groups") is None

    def refresh(self, spark: SparkSession) -> list[str]:
        """Bring the states up to date; the days (with ``batch``: "day of batch") that were read for it, and those that are no more.

        The driver sees one short row per changed day.
        """
        now, known = self.fingerprints(spark), self._entries(spark)
        changed = [tuple(r) for r in now.join(known, ["part", "print"], "left_anti").collect()]
        gone = [r["part"] for r in known.join(now, "part", "left_anti").select("part").collect()]
        if changed:
            fresh = spark.createDataFrame(changed, "part string, print long, files long, bytes long")
            readings = self._readings_of(spark, [row[0] for row in changed])
            for table, states in (("groups", self._groups(readings)), ("keys", self._keys(readings))):
                write_parts(states.join(fresh.select("part", "print"), "part"), self.at, self._folder(table), ["part", "print"])
        entries = changed + [(part, None, 0, 0) for part in gone]
        if entries:
            days = spark.createDataFrame(entries, "part string, print long, files long, bytes long")
            write_parts(days, self.at, self._folder("days"), ["part"])
        return sorted(entry[0].removeprefix("day ") for entry in entries)

    def _readings_of(self, spark: SparkSession, parts: list[str]) -> DataFrame:
        # The folders' own column alone decides, so all other folders are left out of the scan.
        return self._table(spark).where(self._part().isin(parts)).withColumn("part", self._part())

    def _groups(self, readings: DataFrame) -> DataFrame:
        counts = {f"filled_{i}": F.count(F.col(c)) for i, c in enumerate(dict.fromkeys(self.columns))}
        return readings.groupBy("part", "location").agg(
            *(F.expr(exact.sum_state(m)).alias(f"sum_{m}") for m in MEANS),
            F.count("*").alias("reading_count"),
            F.count_if(F.col("status") == 1).alias("active_sensors"),
            *(c.alias(name) for name, c in counts.items()),
        )

    def _keys(self, readings: DataFrame) -> DataFrame:
        if self.lg_k is None:
            return readings.select("part", row_key(readings, self.keys).alias("key")).distinct()
        return readings.select("part", key_hash(readings, self.keys).alias("key")).groupBy("part").agg(
            F.hll_sketch_agg("key", F.lit(self.lg_k)).alias("sketch")
        )

    def _in_force(self, spark: SparkSession, days: tuple[str, str] | None, *tables: str) -> list[DataFrame]:
        """The states of the chosen days; each table's folders are listed once."""
        entries = self._entries(spark)
        if days is not None:
            entries = entries.where(self._day_of(F.col("part")).between(f"day {days[0]}", f"day {days[1]}"))
        stored = [self._read(spark, table) for table in tables]
        if None in stored:
            raise ValueError("no states are stored; call refresh")
        return [table.join(entries, ["part", "print"], "left_semi") for table in stored]

    def by_location(self, spark: SparkSession, days: tuple[str, str] | None = None) -> DataFrame:
        """Sums and counts per location, over all days or those from the first to the last of ``days``."""
        return self._by_location(*self._in_force(spark, days, "groups"))

    def _by_location(self, groups: DataFrame) -> DataFrame:
        counts = [c for c in groups.columns if c.startswith("filled_") or c in ("reading_count", "active_sensors")]
        return groups.groupBy("location").agg(
            *(F.expr(exact.merged(f"sum_{m}")).alias(f"sum_{m}") for m in MEANS), *(F.sum(c).alias(c) for c in counts)
        )

    def summary(self, spark: SparkSession, days: tuple[str, str] | None = None) -> DataFrame:
        """``summarize_readings`` with exact means."""
        means = (exact.mean(f"sum_{m}").alias(f"avg_{m}") for m in MEANS)
        return self.by_location(spark, days).select("location", *means, "reading_count", "active_sensors")

    def _key_rows(self, groups: DataFrame, keys: DataFrame) -> DataFrame:
        """(row_count, number of different keys)."""
        if self.lg_k is None:
            number = F.count_distinct("key")
        else:
            number = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0))
        counted = keys.agg(F.lit(None).cast("bigint").alias("row_count"), number.cast("bigint").alias("number"))
        rows = groups.agg(F.sum("reading_count").alias("row_count"), F.lit(None).cast("bigint").alias("number"))
        both = rows.unionByName(counted).agg(*(F.coalesce(F.max(c), F.lit(0).cast("bigint")).alias(c) for c in ("row_count", "number")))
        return both.select("row_count", F.least("number", "row_count").alias("number"))

    def quality(
        self, spark: SparkSession, thresholds: Thresholds = Thresholds(), days: tuple[str, str] | None = None
    ) -> DataFrame:
        """``quality_report`` of the chosen days."""
        columns = list(dict.fromkeys(self.columns))
        filled = [f"filled_{i}" for i in range(len(columns))]
        groups, states = self._in_force(spark, days, "groups", "keys")
        totals = groups.agg(
            F.coalesce(F.sum("reading_count"), F.lit(0)).alias("row_count"),
            *(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in filled),
        )
        keys = self._key_rows(groups, states).withColumnRenamed("number", "distinct_keys")
        return report_from_counts(totals, keys, columns, thresholds)

    def report(
        self,
        spark: SparkSession,
        trigger: str,
        minutes: int = 60,
        *,
        alert_above: float,
        thresholds: Thresholds = Thresholds(),
        date_column: bool = True,
    ) -> DataFrame:
        """``SensorJob.report`` with exact means: the states, and the folders of the trigger window.

        ``date_column`` says that the folders are dates, those of the readings' times.
        """
        readings = self._table(spark)
        rollup = rollup_with_counts(
            readings, trigger, minutes, alert_above=alert_above, by=("location",),
            date_column=self.day if date_column else None, exact_means=True,
        )
        columns = tuple(dict.fromkeys(self.columns))
        groups, keys = self._in_force(spark, None, "groups", "keys")
        return report_rows(self._by_location(groups), self._key_rows(groups, keys), rollup, columns, thresholds, True)
