"""Registered queries, each with the SQL it must agree with.

``queries()`` maps a name to a function of (session, table folder);
``oracle_sql()`` holds the same computation as DuckDB SQL over the same tables.
Means are rounded in both, since the order of a floating-point sum is free.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidegauge import functions as fn  # noqa: E402
from tidegauge import operators as op  # noqa: E402
from tidegauge import plans, sources  # noqa: E402
from tidegauge.functions.dates import TIMESTAMP_PATTERN  # noqa: E402
from tidegauge.schema import SENSOR_SCHEMA, CastRule, Source, TableSchema  # noqa: E402

# The operators on training data are an optional part; the rest works without them and without what they need.
try:
    import corpus_pipeline
    from tidegauge.llm import queries as llm_queries
except ImportError:
    llm_queries, corpus_pipeline = None, None

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Which lineitem column stands in for which column of a sensor reading.
READING_COLUMNS = {
    "device_id": "l_suppkey",
    "location": "l_returnflag",
    "temperature": "l_quantity",
    "humidity": "l_extendedprice",
    "pressure": "l_discount",
    "timestamp": "l_shipdate",
    "status": "l_linenumber",
}
READING_MEANS = ("avg_temperature", "avg_humidity", "avg_pressure")
JOB_TRIGGER, JOB_MINUTES, JOB_ALERT = "1998-06-01 00:00:00", 30 * 24 * 60, 25.5
EVENT_TRIGGER, EVENT_MINUTES, EVENT_ALERT = "2024-01-15 12:00:00", 60, 50.0
# The days of events that come late, or are asked for; the orders looked up.
LATE_DAY, QUALITY_DAYS = "2024-01-29", ("2024-01-05", "2024-01-11")
LOOKED_UP = (1, 77, 1000)

ORDERS_TABLE = TableSchema.from_config(
    "orders",
    "sales",
    [
        {"source": "o_orderkey", "target": "order_id", "type": "string", "nullable": False},
        {"source": "o_totalprice", "target": "whole_price", "type": "int"},
        {"source": "o_orderpriority", "target": "priority", "type": "int"},
    ],
)
EVENTS_TABLE = TableSchema.from_config(
    "events",
    "telemetry",
    [
        {"source": "ts", "target": "day", "type": "date"},
        {"source": "event_type", "target": "event_type", "type": "string"},
        {"source": "value", "target": "level", "type": "decimal(10,1)"},
    ],
)

# Orders landed by status; priorities that are no number have a default, and customers of the status P no key.
LANDED_TABLE = TableSchema.from_config(
    "landed_orders",
    "sales",
    [
        {"source": "o_orderkey", "target": "order_id", "type": "string", "nullable": False},
        {"source": "o_totalprice", "target": "whole_price", "type": "int", "nullable": False},
        {"source": "o_orderpriority", "target": "priority", "type": "int", "default": "-1"},
        {"source": "customer", "target": "customer.id", "type": "bigint", "nullable": False},
        {"source": "o_orderstatus", "target": "status", "type": "string"},
    ],
    partition_keys=["status"],
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sources.scan_parquet(spark, sources.Location(sf_dir), f"{name}.parquet")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.readings_view(_table(spark, sf_dir, "lineitem"), READING_COLUMNS)


def _sources(spark: SparkSession, sf_dir: str) -> list[Source]:
    def source(name: str) -> Source:
        schema = _table(spark, sf_dir, name).schema
        return Source(name, schema, lambda s: s.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet"))

    return [source(name) for name in TABLES]


def _without_zone(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _no_null(df: DataFrame, column: str) -> DataFrame:
    """An integer column with -1 for NULL, as a table tool without such columns would make it floating-point."""
    return df.withColumn(column, F.coalesce(column, F.lit(-1)))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _documents_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(
        "text",
        F.when(F.col("n_chars") >= 200, F.col("n_chars")).alias("n_chars"),
        F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"),
    )


def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders")


def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, at = _table(spark, sf_dir, "part"), sources.scratch(spark)
    part.write.json(at.path("part"))
    return sources.scan_json(spark, at, "part").select(part.columns)


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sources.scratch(spark)
    _table(spark, sf_dir, "customer").write.option("header", True).csv(at.path("customer"))
    return sources.scan_csv(spark, at, "customer")


def scan_json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, at = _table(spark, sf_dir, "part"), sources.scratch(spark)
    part.write.json(at.path("part"))
    return sources.scan_json(spark, at, "part", part.schema)


def scan_csv_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, at = _table(spark, sf_dir, "customer"), sources.scratch(spark)
    customer.write.csv(at.path("customer"))
    return sources.scan_csv(spark, at, "customer", header=False, schema=customer.schema)


def scan_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, at = _table(spark, sf_dir, "customer"), sources.scratch(spark)
    customer.write.csv(at.path("customer"))
    plain = sources.scan_csv(spark, at, "customer", header=False, infer=False)
    return plain.toDF(*customer.columns)


def sensor_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, at = _readings(spark, sf_dir), sources.scratch(spark)

    def line(**changed: Column | None) -> Column:
        fields = {name: F.col(name) for name in readings.columns} | changed
        return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items() if c is not None)))

    status = F.col("status")
    lines = (
        F.when(status == 2, line(pressure=None))
        .when(status == 3, line(firmware=F.lit("1.0")))
        .when(status == 4, line(temperature=F.lit("hot")))
        .when(status == 5, line(status=F.lit(3_000_000_000)))
        .when(status == 7, "not json")
        .otherwise(line())
    )
    readings.select(lines.alias("value")).write.text(at.path("readings"))
    return _no_null(_without_zone(sources.scan_readings(spark, at.path("readings")), "timestamp"), "status")


def sensor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_zone(_readings(spark, sf_dir), "timestamp")


def series_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = sources.hourly_series(_table(spark, sf_dir, "events"), "event_id", seed=7)
    # The draw differs by partition; that it is one does not.
    return series.select("sensor_id", "timestamp", (F.abs("value") < 10).alias("drawn"))


def series_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Four standard errors around what a normal draw should give.
    series = sources.hourly_series(_table(spark, sf_dir, "events"), "event_id", seed=7)
    error = 4 / F.sqrt(F.count("*"))
    return series.agg(
        F.count("*").alias("row_count"),
        (F.abs(F.avg("value")) < error).alias("mean_is_0"),
        (F.abs(F.stddev_pop("value") - 1) < error).alias("deviation_is_1"),
    )


def write_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sources.scratch(spark)
    sources.write_parquet(_readings(spark, sf_dir), at, "readings", partition_by=["location"])
    back = spark.read.schema(SENSOR_SCHEMA).parquet(at.path("readings"))
    return _without_zone(back.select(SENSOR_SCHEMA.names), "timestamp")


def schema_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = plans.schema_catalog(_table(spark, sf_dir, "orders"), ORDERS_TABLE)
    return orders.union(plans.schema_catalog(_table(spark, sf_dir, "events"), EVENTS_TABLE))


def source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.source_metadata(spark, _sources(spark, sf_dir))


def validate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.validate_sources(spark, _sources(spark, sf_dir))


def cast_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, number = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    code = F.when(status == "F", F.concat(F.lit("no. "), number)).when(status == "P", F.concat(number, F.lit(".75")))
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", code.otherwise(number).alias("code")
    )
    rules = [
        CastRule("o_totalprice", "whole_price", "int"),
        CastRule("code", "code", "int"),
        CastRule("o_orderkey", "order_id", "string"),
    ]
    return _no_null(op.cast_columns(orders, rules), "code")


def cast_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    rules = [
        CastRule("o_totalprice", "whole_price", "int"),
        CastRule("whole_price", "price_text", "string"),
        CastRule("o_orderkey", "whole_price", "double"),
    ]
    return op.cast_columns(orders, rules)


def cast_alternating(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_totalprice", F.lit("")).alias("price"))
    rules = [CastRule("price", "price", "string" if i % 2 else "int") for i in range(16)]
    return op.cast_columns(orders, rules)


def cast_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some thousandths of the embeddings as text, every third value malformed.
    text = F.transform("embedding", lambda x, i: F.concat(F.floor(x * 1000).cast("string"), F.when(i % 3 == 0, "x").otherwise(".9")))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", text.alias("parts"))
    cast = op.cast_columns(vectors, [CastRule("parts", "whole", "array<int>")])
    return cast.select(
        "vec_id",
        F.aggregate("whole", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("total"),
        F.size(F.filter("whole", lambda x: x.isNull())).alias("malformed"),
    )


def parse_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("ts").cast("string")
    given = F.when(F.col("event_type") == "error", F.concat(F.lit("at "), text)).otherwise(text)
    events = _table(spark, sf_dir, "events").select("event_id", given.alias("given"))
    return _without_zone(events.withColumn("parsed", fn.parse_timestamp("given")), "parsed")


def format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        "event_id",
        fn.format_date("ts").alias("day"),
        fn.format_date("ts", TIMESTAMP_PATTERN).alias("second"),
    )


def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    unpadded = F.concat_ws("-", F.year("ts"), F.month("ts"), F.day("ts"))
    text = F.when(F.col("event_type") == "view", fn.format_date("ts")).otherwise(unpadded)
    events = _table(spark, sf_dir, "events").select("event_id", text.alias("given"))
    return _without_zone(events.withColumn("parsed", fn.parse_date("given")), "parsed")


def stamp_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    instant = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))
    return _table(spark, sf_dir, "events").select("event_id", fn.utc_stamp(instant).alias("stamp"))


def sensor_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.summarize_readings(_readings(spark, sf_dir)), *READING_MEANS)


def event_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return _rounded(op.grouped_summary(events, ["event_type"], ["value"], F.col("user_id") == 1), "avg_value")


def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.distinct_keys(_table(spark, sf_dir, "documents"), ["text"])


def distinct_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    exact, about = op.distinct_keys(docs, ["text"]), op.distinct_keys(docs, ["text"], rsd=0.02)
    both = exact.withColumn("kind", F.lit("exact")).union(about.withColumn("kind", F.lit("about")))
    of = {kind: F.max(F.when(F.col("kind") == kind, F.col("distinct_keys"))) for kind in ("exact", "about")}
    return both.agg((F.abs(of["about"] - of["exact"]) <= 0.08 * of["exact"]).alias("within_four_deviations"))


def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(op.numeric_stats(_table(spark, sf_dir, "events"), "value"), "mean", "std")


def trigger_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    return op.trigger_window(events, EVENT_TRIGGER, EVENT_MINUTES, time_column="ts")


def trigger_window_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sources.scratch(spark)
    by_day = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    sources.write_parquet(by_day, at, "events", partition_by=["day"], rebalance=True)
    events = sources.scan_parquet(spark, at, "events")
    return op.trigger_window(events, EVENT_TRIGGER, EVENT_MINUTES, time_column="ts", date_column="day").drop("day")


def downstream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("user_id") < 75, "processed").otherwise("raw")
    events = _table(spark, sf_dir, "events").withColumns({"pipeline_id": F.col("event_type"), "stage": stage})
    rollup = op.downstream_rollup(
        events, EVENT_TRIGGER, EVENT_MINUTES, alert_above=EVENT_ALERT, metric="value", time_column="ts"
    )
    return _rounded(rollup, "avg_temp")


def null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.null_ratio(_documents_with_nulls(spark, sf_dir), ["n_chars", "lang"])


def duplicate_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.duplicate_ratio(_table(spark, sf_dir, "documents"), ["text"])


def duplicate_ratio_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.duplicate_ratio(_documents_with_nulls(spark, sf_dir), ["lang", "n_chars"])


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.quality_report(_documents_with_nulls(spark, sf_dir), ["text"], ["n_chars", "lang"])


def quality_report_single_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = _readings(spark, sf_dir)
    return op.quality_report(readings, ["device_id", "timestamp"], ["temperature"], single_scan=True)


def quality_report_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = _table(spark, sf_dir, "documents").where(F.length("text") < 0)
    return op.quality_report(nothing, ["text"], ["n_chars", "lang"])


def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = op.quality_verdict(quality_report(spark, sf_dir))
    return verdict.select(
        "passed",
        "row_count",
        F.col("null_ratios")["n_chars"].alias("n_chars_null_ratio"),
        F.col("null_ratios")["lang"].alias("lang_null_ratio"),
        "duplicate_ratio",
        F.array_join("issues", "; ").alias("issues"),
    )


def quality_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = op.Thresholds(null_ratio_max=0.2, duplicate_ratio_max=0.5, min_row_count=10**9)
    return op.quality_report(_documents_with_nulls(spark, sf_dir), ["text"], ["n_chars", "lang"], limits)


def quality_history_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The second run is tried again, so its report is appended twice.
    at = sources.scratch(spark)
    readings = op.quality_report(_readings(spark, sf_dir), ["device_id"], ["temperature"])
    for day, (run, report) in enumerate(
        [("run-1", quality_report(spark, sf_dir)), ("run-2", readings), ("run-2", readings), ("run-3", quality_thresholds(spark, sf_dir))]
    ):
        op.append_history(report, at, "history", run, datetime(2024, 1, 1 + day))
    history = op.newest_runs(sources.scan_parquet(spark, at, "history"))
    verdict = op.quality_verdict(history, by=["run_id"])
    return verdict.select("run_id", "passed", "row_count", "duplicate_ratio", F.size("null_ratios").alias("columns"), F.array_join("issues", "; ").alias("issues"))


def quality_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sources.scratch(spark)
    readings = op.quality_report(_readings(spark, sf_dir), ["device_id", "timestamp"], ["temperature"])
    op.append_history(quality_report(spark, sf_dir), at, "history", "run-1")
    op.append_history(readings, at, "history", "run-2")
    return sources.scan_parquet(spark, at, "history").drop("recorded_at")


def sensor_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = plans.sensor_job(_readings(spark, sf_dir), JOB_TRIGGER, JOB_MINUTES, alert_above=JOB_ALERT)
    return _rounded(job.report(), "value")


def exact_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.summarize_readings(_readings(spark, sf_dir), exact_means=True)


def exact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.numeric_stats(_table(spark, sf_dir, "events"), "value", exact_sums=True)


def _event_readings(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    columns = {
        "device_id": "user_id",
        "location": "event_type",
        "temperature": "value",
        "humidity": F.when(F.col("user_id") % 7 > 0, F.col("user_id")),
        "pressure": F.when(F.col("event_id") % 50 > 0, F.col("value")),
        "timestamp": "ts",
        "status": F.col("user_id") % 3,
    }
    events = _table(spark, sf_dir, "events")
    return sources.readings_view(events if where is None else events.where(where), columns)


def incremental_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All days but the last two have their states before those arrive, the last but one late and in two files.
    at = sources.scratch(spark)
    daily = _event_readings(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    late = F.col("day") >= F.lit(LATE_DAY).cast("date")

    def land(rows: DataFrame) -> None:
        sources.write_parquet(rows, at, "readings", mode="append", partition_by=["day"], rebalance=True)

    states = plans.DailyStates(at.path("readings"), at, "states")
    land(daily.where(~late | ((F.col("day") == F.lit(LATE_DAY).cast("date")) & (F.col("status") == 1))))
    states.refresh(spark)
    land(daily.where(late & ~((F.col("day") == F.lit(LATE_DAY).cast("date")) & (F.col("status") == 1))))
    read_again = len(states.refresh(spark))
    report = states.report(spark, EVENT_TRIGGER, EVENT_MINUTES, alert_above=EVENT_ALERT)
    return report.withColumn("days_read_again", F.lit(read_again))


def incremental_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on some of the days, out of the states of all."""
    at = sources.scratch(spark)
    daily = _event_readings(spark, sf_dir).withColumn("day", F.to_date("timestamp"))
    sources.write_parquet(daily, at, "readings", partition_by=["day"], rebalance=True)
    states = plans.DailyStates(at.path("readings"), at, "states", keys=("device_id", "status"), columns=("pressure", "temperature"))
    states.refresh(spark)
    return states.quality(spark, days=QUALITY_DAYS)


def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sketches of this size hold so few keys one by one, so the rounded estimate is the count.
    at = sources.scratch(spark)
    events = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    op.store_sketches(op.distinct_sketches(events, ["day"], ["user_id", "event_type"], lg_k=18), at, "sketches", ["day"])
    stored = op.stored_sketches(spark, at, "sketches")
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd")
    spans = {"day": F.date_format("day", "yyyy-MM-dd"), "week": week, "all": F.lit("all")}
    found = [op.united(stored.withColumn("span", span), ["span"]).withColumn("kind", F.lit(kind)) for kind, span in spans.items()]
    return reduce(DataFrame.unionByName, found)


def trigger_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error with the events of the half hour before it."""
    events = _table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("trigger_id"), F.col("ts").alias("trigger_time"))
    return op.trigger_windows(events.select("event_id", "ts", "value"), errors, 30, time_column="ts", split_rows=500)


def downstream_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before every error, per kind of event, the mean of six hours."""
    events = _table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select(F.col("ts").alias("trigger_time"))
    return op.downstream_rollups(events, errors, 360, alert_above=EVENT_ALERT, by=["event_type"], metric="value", time_column="ts")


def series_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Logarithm and cosine may differ in the last bit.
    return sources.hourly_series(_table(spark, sf_dir, "events"), "event_id", seed=7).withColumn("value", F.round("value", 9))


def history_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The second run fails halfway, with other numbers, and is tried again.
    at = sources.scratch(spark)
    readings = op.quality_report(_readings(spark, sf_dir), ["device_id"], ["temperature"])
    first, other = quality_report(spark, sf_dir), quality_thresholds(spark, sf_dir)
    for day, (run, report) in enumerate([("run-1", first), ("run-2", other), ("run-3", other), ("run-2", readings)]):
        op.record_run(report, at, "history", run, datetime(2024, 1, 1 + day))
    verdict = op.quality_verdict(op.recorded_runs(spark, at, "history"), by=["run_id"])
    return verdict.select("run_id", "passed", "row_count", "duplicate_ratio", F.size("null_ratios").alias("columns"), F.array_join("issues", "; ").alias("issues"))


def clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few orders out of items that are laid out by date and supplier."""
    at = sources.scratch(spark)
    sources.write_clustered(
        _table(spark, sf_dir, "lineitem").withColumn("ship_day", F.to_date("l_shipdate")),
        at, "items", ["ship_day", "l_suppkey"], lookup=["l_orderkey"], group_rows=20_000, lookup_values=20_000,
    )
    return sources.scan_parquet(spark, at, "items").where(F.col("l_orderkey").isin(*LOOKED_UP)).drop("ship_day")


def _reading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as JSON lines, some of them faulty, by status."""
    readings = _readings(spark, sf_dir)

    def line(**changed: Column) -> Column:
        return F.to_json(F.struct(*((changed | {n: F.col(n) for n in readings.columns if n not in changed})[n].alias(n) for n in readings.columns)))

    status = F.col("status")
    lines = F.when(status == 4, line(temperature=F.lit("hot"))).when(status == 5, line(status=F.lit(3_000_000_000))).when(status == 7, "not json")
    return readings.select(lines.otherwise(line()).alias("value"))


def bad_line_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sources.scratch(spark)
    _reading_lines(spark, sf_dir).write.text(at.path("lines"))
    rows, _ = sources.land_json(spark, at.path("lines"), SENSOR_SCHEMA, at, "landed")
    report = op.quality_report(rows, ["device_id", "timestamp"], ["temperature", "status"])
    return report.unionByName(op.unreadable_check(rows, position=5))


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = sources.scratch(spark)
    _reading_lines(spark, sf_dir).write.text(at.path("lines"))
    _, bad = sources.land_json(spark, at.path("lines"), SENSOR_SCHEMA, at, "landed")
    kind = F.when(F.col("bad_line") == "not json", "no object").when(F.col("bad_line").contains('"hot"'), "text").otherwise("range")
    return bad.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"))


def batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of two runs; the second brings late events and lines without JSON, and at first only some of its lines."""
    at = sources.scratch(spark)
    early = (F.to_date("ts") < F.lit(LATE_DAY).cast("date")) & (F.col("event_id") % 10 > 0)
    runs = plans.SensorRuns(sources.Location(at.path("out")), keys=("device_id", "status"))
    for try_, (run_id, events) in enumerate([("first", early), ("second", ~early & (F.col("user_id") % 2 > 0)), ("second", ~early)]):
        readings = _event_readings(spark, sf_dir, events)
        line = F.to_json(F.struct(*readings.columns))
        bad = (F.col("status") == 0) & (F.lit(run_id) == "second")
        lines = at.path(f"lines-{try_}")
        readings.select(F.when(bad, F.lit("no json")).otherwise(line).alias("value")).write.text(lines)
        runs.run(spark, lines, run_id, EVENT_TRIGGER, EVENT_MINUTES, alert_above=EVENT_ALERT, recorded_at=datetime(2024, 2, 1 + try_))
    history = runs.history(spark)
    return history.select("run_id", "position", "check_name", "column_name", "value", "threshold", "severity", "violated")


def cast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A field of a struct is read after the struct itself was cast.
    price = F.struct(F.col("o_totalprice").cast("string").alias("amount"), "o_orderpriority").alias("price")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", price)
    rules = [CastRule("price", "price", "struct<amount:int,o_orderpriority:string>"), CastRule("price.amount", "price_text", "string")]
    return op.cast_columns(orders, rules).select("o_orderkey", "price_text", F.col("price.amount").alias("amount"))


def _orders_to_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return _table(spark, sf_dir, "orders").withColumn("customer", customer)


def table_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One status is landed once more, with half its orders, which replace the others of that status alone.
    at, orders = sources.scratch(spark), _orders_to_land(spark, sf_dir)
    plans.write_table(orders, LANDED_TABLE, at)
    plans.write_table(orders.where("o_orderstatus = 'F' and o_orderkey % 2 = 0"), LANDED_TABLE, at, replace_parts=True)
    return _no_null(plans.read_table(spark, LANDED_TABLE, at).withColumnRenamed("customer.id", "customer_id"), "customer_id")


def table_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.required_report(_orders_to_land(spark, sf_dir), LANDED_TABLE)


def entry(spark: SparkSession) -> DataFrame:
    """The whole sensor job on the smallest tables."""
    return sensor_job(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        scan_parquet, scan_json, scan_json_schema, scan_csv, scan_csv_plain, scan_csv_text,
        sensor_json, sensor_view, series_hourly, series_noise, write_partitioned,
        schema_catalog, source_metadata, validate_sources,
        cast_columns, cast_chain, cast_alternating, cast_nested, parse_timestamp, format_date, parse_date, stamp_utc,
        sensor_agg, event_agg, distinct_keys, distinct_estimate, numeric_stats,
        trigger_window, trigger_window_daily, downstream_rollup,
        null_ratio, duplicate_ratio, duplicate_ratio_null_keys,
        quality_report, quality_report_single_scan, quality_report_empty, quality_verdict, quality_history,
        quality_thresholds, quality_history_verdict,
        sensor_job,
        incremental_report, incremental_quality, distinct_sketches, trigger_windows, downstream_rollups,
        series_values, exact_agg, exact_stats, history_by_run, clustered_lookup, bad_line_report, bad_lines, cast_path,
        table_landed, table_required, batch_runs,
    )
    named = {query.__name__: query for query in listed}
    if llm_queries:
        named |= {n: _with_imports(q) for n, q in (llm_queries.queries() | {"pipeline": corpus_pipeline.run}).items()}
    return named


def _with_imports(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with this folder on the path of Python workers, from whatever folder the session was started."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent)
        if here not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH")]))
        return query(spark, sf_dir)

    return run


_READINGS_SQL = """
    select l_quantity as temperature, l_extendedprice as humidity, l_discount as pressure,
           l_shipdate as "timestamp", l_suppkey::varchar as device_id, l_returnflag as location,
           l_linenumber as status
    from lineitem
"""

_DOCUMENTS_SQL = """
    select text, case when n_chars >= 200 then n_chars end as n_chars, case when lang <> 'fr' then lang end as lang
    from documents
"""

# Expected schema text per table.
_SOURCE_TYPES = {
    "region": {"r_regionkey": "integer", "r_name": "string"},
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "customer": {
        "c_custkey": "bigint", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "double"},
    "part": {
        "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
        "p_size": "integer", "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "integer",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
        "value": "double", "props": "string",
    },
    "documents": {
        "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
    },
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "integer"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "integer", "toxic": "integer"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


def _catalog_sql(database: str, table: str, columns: list[tuple[str, str, str, bool, str]]) -> str:
    return " union all ".join(
        f"select '{database}' as database_name, '{table}' as table_name, {i} as position, '{target}' as column_name, "
        f"'{source}' as source_column, '{type_}' as type_name, {nullable} as nullable, "
        f"count(*) filter (where ({cast}) is null)::double / greatest(count(*), 1) as null_ratio from {table}"
        for i, (source, target, type_, nullable, cast) in enumerate(columns, start=1)
    )


def _report_sql(
    relation: str, keys: str, columns: list[str], null_max: float = 0.05, dup_max: float = 0.01, rows_min: int = 100
) -> str:
    checks = [
        f"select {i} as position, 'null_ratio' as check_name, '{c}' as column_name, "
        f"count(*) filter (where {c} is null)::double / greatest(count(*), 1) as value, "
        f"{null_max}::double as threshold, 'error' as severity from ({relation})"
        for i, c in enumerate(columns, start=1)
    ]
    n = len(columns)
    checks.append(
        f"select {n + 1}, 'duplicate_ratio', null, "
        f"(count(*) - (select count(*) from (select distinct {keys} from ({relation}))))::double "
        f"/ greatest(count(*), 1), {dup_max}::double, 'error' from ({relation})"
    )
    checks.append(f"select {n + 2}, 'row_count', null, count(*)::double, {rows_min}::double, 'warning' from ({relation})")
    return (
        "select *, case when check_name = 'row_count' then value < threshold else value > threshold end as violated "
        f"from ({' union all '.join(checks)})"
    )


_ISSUES_SQL = """
    coalesce(string_agg(case check_name
        when 'null_ratio' then printf('Column ''%s'' null ratio %.4f exceeds threshold', column_name, value)
        when 'duplicate_ratio' then printf('Duplicate ratio %.4f exceeds threshold', value)
        else printf('Row count %d below minimum threshold (warning)', value::bigint) end,
        '; ' order by position) filter (where violated), '')
"""


def _run_verdict_sql(run: str, report: str, columns: int) -> str:
    return f"""
        select '{run}' as run_id, bool_and(not (violated and severity = 'error')) as passed,
               max(value) filter (where check_name = 'row_count')::bigint as row_count,
               max(value) filter (where check_name = 'duplicate_ratio') as duplicate_ratio,
               {columns}::integer as columns, {_ISSUES_SQL} as issues
        from ({report})
    """


def _summary_sql() -> str:
    return f"""
        select location, round(avg(temperature), 6) as avg_temperature, round(avg(humidity), 6) as avg_humidity,
               round(avg(pressure), 6) as avg_pressure, count(*) as reading_count,
               count(*) filter (where status = 1) as active_sensors
        from ({_READINGS_SQL}) group by location
    """


def _exact_sum_sql(value: str) -> str:
    """The exact sum of doubles that are not negative: digits of 60 bits added as whole numbers, put together at the end."""
    base, unit = "1152921504606846976::hugeint", "pow(2.0, -60)"
    high = f"(({value} - trunc({value})) * pow(2.0, 60))"
    sums = [f"sum({v}::bigint)" for v in (f"trunc({value})", f"trunc({high})", f"trunc(({high} - trunc({high})) * pow(2.0, 60))")]
    carried = f"({sums[1]} + {sums[2]} // {base})"
    return (
        f"(({sums[0]} + {carried} // {base})::double + (({carried} % {base})::bigint::double * {unit} "
        f"+ ({sums[2]} % {base})::bigint::double * {unit} * {unit}))"
    )


def _exact_mean_sql(value: str) -> str:
    return f"{_exact_sum_sql(value)} / count({value})::double"


_EVENT_READINGS_SQL = """
    select value as temperature, case when user_id % 7 > 0 then user_id::double end as humidity,
           case when event_id % 50 > 0 then value end as pressure, ts as "timestamp", user_id::varchar as device_id,
           event_type as location, (user_id % 3)::integer as status
    from events
"""


def _incremental_sql() -> str:
    means = {m: _exact_mean_sql(m) for m in ("temperature", "humidity", "pressure")}
    counts = {"reading_count": "count(*)::double", "active_sensors": "(count(*) filter (where status = 1))::double"}
    measures = {f"avg_{m}": sql for m, sql in means.items()} | counts
    window = (
        f"""select * from ({_EVENT_READINGS_SQL}) where "timestamp" < timestamp '{EVENT_TRIGGER}' """
        f"""and "timestamp" >= timestamp '{EVENT_TRIGGER}' - interval {EVENT_MINUTES} minutes"""
    )
    parts = [
        f"select 'summary' as section, location as subject, '{name}' as measure, {sql} as value, null::varchar as status "
        f"from ({_EVENT_READINGS_SQL}) group by location"
        for name, sql in measures.items()
    ]
    report = _report_sql(_EVENT_READINGS_SQL, "device_id", ["temperature", "humidity", "pressure"])
    parts += [
        f"select 'quality', column_name, check_name, value, case when violated then severity else 'ok' end from ({report})",
        f"select 'window', location, 'readings', count(*)::double, null from ({window}) group by location",
        f"select 'downstream', location, 'avg_temp', {means['temperature']}, "
        f"case when {means['temperature']} > {EVENT_ALERT} then 'WARNING' else 'NORMAL' end from ({window}) group by location",
    ]
    late = f"(select count(distinct ts::date)::integer from events where ts >= timestamp '{LATE_DAY}')"
    return f"select *, {late} as days_read_again from ({' union all '.join(parts)})"


_LINES_SQL = f"""
    select case when status not in (4, 7) then temperature end as temperature, status not in (4, 5, 7) as readable,
           case when status <> 7 then "timestamp" end as "timestamp", case when status <> 7 then device_id end as device_id,
           case when status not in (5, 7) then status end as status
    from ({_READINGS_SQL})
"""

def _batch_runs_sql() -> str:
    early = f"(ts < timestamp '{LATE_DAY}' and event_id % 10 > 0)"
    readings = _EVENT_READINGS_SQL.replace("select ", f"select {early} as early, user_id % 3 > 0 or {early} as readable, ", 1)
    seen = ", ".join(
        f"case when readable then {c} end as {c}" for c in ("temperature", "humidity", "pressure", "device_id", "status")
    )
    parts = []
    for run_id, which in (("first", "early"), ("second", "true")):
        rows = f"select readable, {seen} from ({readings}) where {which}"
        report = _report_sql(rows, "device_id, status", ["temperature", "humidity", "pressure"])
        parts.append(f"""
            select '{run_id}' as run_id, * from ({report}) union all
            select '{run_id}', 6, 'unreadable_ratio', null, count(*) filter (where not readable)::double / greatest(count(*), 1),
                   0.0::double, 'error', count(*) filter (where not readable) > 0 from ({rows})
        """)
    return " union all ".join(parts)


_HOURLY_UNIFORM_SQL = "(('0x' || substr(md5('hourly:7:' || event_id), {at}, 13))::bigint::double + 0.5) / 4503599627370496::double"


def _job_sql() -> str:
    measures = (*READING_MEANS, "reading_count", "active_sensors")
    window = (
        f"""select * from ({_READINGS_SQL}) where "timestamp" < timestamp '{JOB_TRIGGER}' """
        f"""and "timestamp" >= timestamp '{JOB_TRIGGER}' - interval {JOB_MINUTES} minutes"""
    )
    parts = [
        f"select 'summary' as section, location as subject, '{m}' as measure, {m}::double as value, "
        f"null::varchar as status from ({_summary_sql()})"
        for m in measures
    ]
    report = _report_sql(_READINGS_SQL, "device_id", ["temperature", "humidity", "pressure"])
    parts += [
        "select 'quality', column_name, check_name, round(value, 6), "
        f"case when violated then severity else 'ok' end from ({report})",
        f"select 'window', location, 'readings', count(*)::double, null from ({window}) group by location",
        "select 'downstream', location, 'avg_temp', round(avg(temperature), 6), "
        f"case when avg(temperature) > {JOB_ALERT} then 'WARNING' else 'NORMAL' end from ({window}) group by location",
    ]
    return " union all ".join(parts)


def oracle_sql() -> dict[str, str]:
    in_event_window = (
        f"ts < timestamp '{EVENT_TRIGGER}' and ts >= timestamp '{EVENT_TRIGGER}' - interval {EVENT_MINUTES} minutes"
    )
    documents_report = _report_sql(_DOCUMENTS_SQL, "text", ["n_chars", "lang"])
    readings_report = _report_sql(_READINGS_SQL, 'device_id, "timestamp"', ["temperature"])
    device_report = _report_sql(_READINGS_SQL, "device_id", ["temperature"])
    loose_report = _report_sql(_DOCUMENTS_SQL, "text", ["n_chars", "lang"], 0.2, 0.5, 10**9)
    in_window = f"""
        select *, timestamp '{EVENT_TRIGGER}' as trigger_time, {EVENT_MINUTES}::bigint as duration_minutes
        from events where {in_event_window}
    """
    llm_sql = llm_queries.oracle_sql() if llm_queries else {}
    schema_texts = {name: str(types).replace("'", "''") for name, types in _SOURCE_TYPES.items()}
    return {
        "scan_parquet": "select * from orders",
        "scan_json": """
            select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice from part
        """,
        "scan_csv": """
            select c_custkey::integer as c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer
        """,
        "sensor_json": f"""
            select case when status not in (4, 7) then temperature end as temperature,
                   case when status <> 7 then humidity end as humidity,
                   case when status not in (2, 7) then pressure end as pressure,
                   case when status <> 7 then "timestamp" end as "timestamp",
                   case when status <> 7 then device_id end as device_id,
                   case when status <> 7 then location end as location,
                   case when status not in (5, 7) then status else -1 end as status
            from ({_READINGS_SQL})
        """,
        "sensor_view": _READINGS_SQL,
        "series_hourly": """
            select 's_' || event_id as sensor_id, timestamp '2024-01-01' + to_hours(event_id) as "timestamp",
                   true as drawn
            from events
        """,
        "write_partitioned": _READINGS_SQL,
        "schema_catalog": _catalog_sql(
            "sales",
            "orders",
            [
                ("o_orderkey", "order_id", "string", False, "o_orderkey::varchar"),
                ("o_totalprice", "whole_price", "int", True, "try_cast(trunc(o_totalprice) as integer)"),
                ("o_orderpriority", "priority", "int", True, "try_cast(o_orderpriority as integer)"),
            ],
        )
        + " union all "
        + _catalog_sql(
            "telemetry",
            "events",
            [
                ("ts", "day", "date", True, "ts::date"),
                ("event_type", "event_type", "string", True, "event_type"),
                ("value", "level", "decimal(10,1)", True, "try_cast(value as decimal(10,1))"),
            ],
        ),
        "source_metadata": " union all ".join(
            f"""select '{name}' as source_name, '{text}' as "schema", count(*) as row_count from {name}"""
            for name, text in schema_texts.items()
        ),
        "validate_sources": " union all ".join(
            f"select '{name}' as source_name, count(*) > 0 as valid from {name}" for name in TABLES
        ),
        "cast_columns": """
            select o_orderkey, o_totalprice, trunc(o_totalprice)::integer as whole_price,
                   coalesce(try_cast(split_part(code, '.', 1) as integer), -1) as code, o_orderkey::varchar as order_id
            from (select *, case o_orderstatus when 'F' then 'no. ' || o_custkey when 'P' then o_custkey || '.75'
                                               else o_custkey::varchar end as code
                  from orders)
        """,
        "cast_chain": """
            select o_orderkey, o_totalprice, o_orderkey::double as whole_price,
                   trunc(o_totalprice)::integer::varchar as price_text
            from orders
        """,
        "parse_timestamp": """
            select event_id, given, try_cast(given as timestamp) as parsed
            from (select event_id, case when event_type = 'error' then 'at ' || ts::varchar else ts::varchar end as given
                  from events)
        """,
        "format_date": """
            select event_id, strftime(ts, '%Y-%m-%d') as "day", strftime(ts, '%Y-%m-%d %H:%M:%S') as "second" from events
        """,
        "parse_date": """
            select event_id, given, strptime(given, '%Y-%m-%d') as parsed
            from (select event_id, case when event_type = 'view' then strftime(ts, '%Y-%m-%d')
                                        else year(ts) || '-' || month(ts) || '-' || day(ts) end as given
                  from events)
        """,
        "stamp_utc": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp from events",
        "series_noise": "select count(*) as row_count, true as mean_is_0, true as deviation_is_1 from events",
        "scan_json_schema": "select * from part",
        "scan_csv_plain": "select * from customer",
        "scan_csv_text": """
            select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey,
                   c_acctbal::varchar as c_acctbal, c_mktsegment from customer
        """,
        "cast_alternating": """
            select o_orderkey, trunc(o_totalprice)::integer::varchar as price from orders
        """,
        "cast_nested": """
            select vec_id, sum(case when (i - 1) % 3 = 0 then 0 else floor(x * 1000.0) end)::bigint as total,
                   count(*) filter (where (i - 1) % 3 = 0)::integer as malformed
            from (select vec_id, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by vec_id
        """,
        "distinct_estimate": "select count(distinct text) > 0 as within_four_deviations from documents",
        "quality_thresholds": loose_report,
        "quality_history_verdict": " union all ".join(
            _run_verdict_sql(run, report, columns)
            for run, report, columns in (("run-1", documents_report, 2), ("run-2", device_report, 1), ("run-3", loose_report, 2))
        ),
        "sensor_agg": _summary_sql(),
        "event_agg": """
            select event_type, round(avg(value), 6) as avg_value, count(*) as row_count,
                   count(*) filter (where user_id = 1) as flagged
            from events group by event_type
        """,
        "distinct_keys": "select count(*) as distinct_keys from (select distinct text from documents)",
        "numeric_stats": "select round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std from events",
        "trigger_window": in_window,
        "trigger_window_daily": in_window,
        "downstream_rollup": f"""
            select timestamp '{EVENT_TRIGGER}' as trigger_time, event_type as pipeline_id,
                   case when user_id < 75 then 'processed' else 'raw' end as stage, round(avg(value), 6) as avg_temp,
                   case when avg(value) > {EVENT_ALERT} then 'WARNING' else 'NORMAL' end as alert_status,
                   {EVENT_MINUTES}::bigint as window_minutes
            from events where {in_event_window} group by 1, 2, 3
        """,
        "null_ratio": f"select position, column_name, value as null_ratio from ({documents_report}) "
        "where check_name = 'null_ratio'",
        "duplicate_ratio": """
            select row_count, distinct_keys,
                   (row_count - distinct_keys)::double / greatest(row_count, 1) as duplicate_ratio
            from (select (select count(*) from documents) as row_count,
                         (select count(*) from (select distinct text from documents)) as distinct_keys)
        """,
        "duplicate_ratio_null_keys": f"""
            select row_count, distinct_keys,
                   (row_count - distinct_keys)::double / greatest(row_count, 1) as duplicate_ratio
            from (select (select count(*) from documents) as row_count,
                         (select count(*) from (select distinct lang, n_chars from ({_DOCUMENTS_SQL}))) as distinct_keys)
        """,
        "quality_report": documents_report,
        "quality_report_single_scan": readings_report,
        "quality_report_empty": _report_sql("select * from documents where length(text) < 0", "text", ["n_chars", "lang"]),
        "quality_verdict": f"""
            select bool_and(not (violated and severity = 'error')) as passed,
                   max(value) filter (where check_name = 'row_count')::bigint as row_count,
                   max(value) filter (where column_name = 'n_chars') as n_chars_null_ratio,
                   max(value) filter (where column_name = 'lang') as lang_null_ratio,
                   max(value) filter (where check_name = 'duplicate_ratio') as duplicate_ratio, {_ISSUES_SQL} as issues
            from ({documents_report})
        """,
        "quality_history": f"""
            select *, 'run-1' as run_id from ({documents_report})
            union all select *, 'run-2' from ({readings_report})
        """,
        "sensor_job": _job_sql(),
        "incremental_report": _incremental_sql(),
        "incremental_quality": _report_sql(
            f"""select * from ({_EVENT_READINGS_SQL}) where "timestamp"::date between '{QUALITY_DAYS[0]}' and '{QUALITY_DAYS[1]}'""",
            "device_id, status",
            ["pressure", "temperature"],
        ),
        "distinct_sketches": " union all ".join(
            f"select '{kind}' as kind, {span} as span, count(*) as row_count, count(distinct (user_id, event_type)) as distinct_keys "
            "from events group by 1, 2"
            for kind, span in (
                ("day", "strftime(ts, '%Y-%m-%d')"), ("week", "strftime(date_trunc('week', ts), '%Y-%m-%d')"), ("all", "'all'"),
            )
        ),
        "trigger_windows": """
            select e.event_id, e.ts, e.value, t.event_id as trigger_id, t.ts as trigger_time, 30::bigint as duration_minutes
            from events e join events t on t.event_type = 'error' and e.ts < t.ts and e.ts >= t.ts - interval 30 minutes
        """,
        "downstream_rollups": f"""
            select trigger_time, event_type, avg_temp, case when avg_temp > {EVENT_ALERT} then 'WARNING' else 'NORMAL' end as alert_status,
                   360::bigint as window_minutes
            from (select t.ts as trigger_time, e.event_type, {_exact_mean_sql("e.value")} as avg_temp
                  from events e join (select distinct ts from events where event_type = 'error') t
                  on e.ts < t.ts and e.ts >= t.ts - interval 360 minutes group by 1, 2)
        """,
        "series_values": f"""
            select 's_' || event_id as sensor_id, timestamp '2024-01-01' + to_hours(event_id) as "timestamp",
                   round(sqrt(-2.0 * ln({_HOURLY_UNIFORM_SQL.format(at=1)})) * cos(2.0 * pi() * ({_HOURLY_UNIFORM_SQL.format(at=14)})), 9) as value
            from events
        """,
        "exact_agg": f"""
            select location, {", ".join(f"{_exact_mean_sql(m)} as avg_{m}" for m in ("temperature", "humidity", "pressure"))},
                   count(*) as reading_count, count(*) filter (where status = 1) as active_sensors
            from ({_READINGS_SQL}) group by location
        """,
        "exact_stats": f"""
            select mean, (select sqrt({_exact_mean_sql("((value - m.mean) * (value - m.mean))")}) from events) as std
            from (select {_exact_mean_sql("value")} as mean from events) m
        """,
        "history_by_run": " union all ".join(
            _run_verdict_sql(run, report, columns)
            for run, report, columns in (("run-1", documents_report, 2), ("run-2", device_report, 1), ("run-3", loose_report, 2))
        ),
        "clustered_lookup": f"select * from lineitem where l_orderkey in {LOOKED_UP}",
        "bad_line_report": _report_sql(_LINES_SQL, 'device_id, "timestamp"', ["temperature", "status"])
        + f"""
            union all select 5, 'unreadable_ratio', null, count(*) filter (where not readable)::double / greatest(count(*), 1),
                             0.0::double, 'error', bool_or(not readable) from ({_LINES_SQL})
        """,
        "bad_lines": f"""
            select case status when 4 then 'text' when 5 then 'range' else 'no object' end as kind, count(*) as lines
            from ({_READINGS_SQL}) where status in (4, 5, 7) group by 1
        """,
        "batch_runs": _batch_runs_sql(),
        "table_landed": """
            select o_orderkey::varchar as order_id, trunc(o_totalprice)::integer as whole_price,
                   coalesce(try_cast(o_orderpriority as integer), -1) as priority,
                   case when o_orderstatus <> 'P' then o_custkey else -1 end as customer_id, o_orderstatus as status
            from orders where o_orderstatus <> 'F' or o_orderkey % 2 = 0
        """,
        "table_required": """
            select 'order_id' as column_name, count(*) as rows, 0::bigint as missing, false as violated from orders
            union all select 'whole_price', count(*), 0, false from orders
            union all select 'customer.id', count(*), count(*) filter (where o_orderstatus = 'P'), bool_or(o_orderstatus = 'P') from orders
        """,
        "cast_path": """
            select o_orderkey, trunc(o_totalprice)::integer::varchar as price_text, trunc(o_totalprice)::integer as amount from orders
        """,
    } | llm_sql
