"""Column expressions."""

from tidegauge.functions.casts import lenient_cast
from tidegauge.functions.dates import format_date, parse_date, parse_timestamp, utc_stamp
from tidegauge.functions.draws import normal_draw, uniform_draw
from tidegauge.functions.keys import row_key

__all__ = ["format_date", "lenient_cast", "normal_draw", "parse_date", "parse_timestamp", "row_key", "uniform_draw", "utc_stamp"]
