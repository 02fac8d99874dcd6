"""DataFrame to DataFrame operators."""

from tidegauge.operators.aggregates import distinct_keys, grouped_summary, numeric_stats, summarize_readings
from tidegauge.operators.casting import cast_columns
from tidegauge.operators.quality import (
    QualityResult,
    Thresholds,
    append_history,
    duplicate_ratio,
    newest_runs,
    null_ratio,
    quality_report,
    quality_result,
    quality_verdict,
    record_run,
    recorded_runs,
    report_from_counts,
    unreadable_check,
)
from tidegauge.operators.sketches import distinct_sketches, error_bound, store_sketches, stored_sketches, united
from tidegauge.operators.windows import downstream_rollup, downstream_rollups, trigger_window, trigger_windows

__all__ = [
    "QualityResult",
    "Thresholds",
    "append_history",
    "cast_columns",
    "distinct_keys",
    "distinct_sketches",
    "downstream_rollup",
    "downstream_rollups",
    "duplicate_ratio",
    "error_bound",
    "grouped_summary",
    "newest_runs",
    "null_ratio",
    "numeric_stats",
    "quality_report",
    "quality_result",
    "quality_verdict",
    "record_run",
    "recorded_runs",
    "report_from_counts",
    "store_sketches",
    "stored_sketches",
    "summarize_readings",
    "trigger_window",
    "trigger_windows",
    "united",
    "unreadable_check",
]
