"""Flows made of several operators."""

from tidegauge.plans.catalog import schema_catalog
from tidegauge.plans.daily import DailyStates
from tidegauge.plans.sensor_job import SensorJob, sensor_job
from tidegauge.plans.sensor_runs import SensorRuns
from tidegauge.plans.tables import as_table, read_table, required_report, write_table

__all__ = [
    "DailyStates",
    "SensorJob",
    "SensorRuns",
    "as_table",
    "read_table",
    "required_report",
    "schema_catalog",
    "sensor_job",
    "write_table",
]
