"""Run the sensor job on JSON readings:

    python -m tidegauge READINGS OUT --trigger T --alert-above X --run-id ID

The readings are parsed once, into a Parquet table in daily folders; the job
then reads from that table only the columns and days it needs. With --batches
they are one more batch: the job reads them alone, and reports on all so far.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import append_history, newest_runs, quality_verdict
from tidegauge.plans import SensorRuns, sensor_job
from tidegauge.schema import SENSOR_SCHEMA
from tidegauge.session import open_session, settings_for_input
from tidegauge.sources import Location, scan_parquet, scan_readings, write_parquet


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidegauge")
    parser.add_argument("readings", help="path of the readings, JSON lines")
    parser.add_argument("out", help="folder for the readings table, the report and the quality history")
    parser.add_argument("--trigger", required=True, help="end of the time window, e.g. '2024-01-01 10:00:00'")
    parser.add_argument("--minutes", type=int, default=60)
    parser.add_argument("--alert-above", type=float, required=True, help="mean temperature that raises an alert")
    parser.add_argument("--run-id", required=True)
    parser.add_argument("--input-bytes", type=int, help="size of the readings, to size scan splits and shuffles by")
    parser.add_argument("--shuffled-bytes", type=int, help="what the job moves, if not as much as it reads")
    parser.add_argument("--batches", action="store_true", help="add to the readings of former runs instead of replacing them")
    args = parser.parse_args(argv)

    sized = settings_for_input(args.input_bytes, args.shuffled_bytes) if args.input_bytes else None
    spark = open_session("sensor job", sized)
    out = Location(args.out)
    if args.batches:
        runs = SensorRuns(out)
        read = runs.run(spark, args.readings, args.run_id, args.trigger, args.minutes, alert_above=args.alert_above)
        verdict = runs.verdicts(spark).where(F.col("run_id") == args.run_id)
        print("Days read:", ", ".join(read))
        _show(("Quality", verdict), ("Report", runs.last_report(spark)))
        return
    by_day = scan_readings(spark, args.readings).withColumn("day", F.to_date("timestamp"))
    write_parquet(by_day, out, "readings", partition_by=["day"], rebalance=True)
    readings = spark.read.schema(f"{SENSOR_SCHEMA.toDDL()}, day date").parquet(out.path("readings"))

    job = sensor_job(readings, args.trigger, args.minutes, alert_above=args.alert_above, date_column="day")
    append_history(job.quality, out, "history", args.run_id)
    this_run = newest_runs(scan_parquet(spark, out, "history").where(F.col("run_id") == args.run_id))
    write_parquet(job.report(), out, "report")

    _show(
        ("Readings", readings),
        ("Trigger window", job.window),
        ("Quality", quality_verdict(this_run)),
        ("Report", scan_parquet(spark, out, "report")),
    )


def _show(*tables: tuple[str, DataFrame]) -> None:
    for title, table in tables:
        print(title)
        table.show(truncate=False)


if __name__ == "__main__":
    main()
