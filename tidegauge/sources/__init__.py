"""Readers, the sink, and descriptions of sources."""

from tidegauge.sources.catalog import has_rows, source_metadata, validate_sources
from tidegauge.sources.files import (
    land_json,
    scan_csv,
    scan_json,
    scan_marking,
    scan_parquet,
    scan_readings,
    write_clustered,
    write_parquet,
    write_parts,
)
from tidegauge.sources.locations import Location, scratch
from tidegauge.sources.readings import generate_series, hourly_series, readings_view

__all__ = [
    "Location",
    "generate_series",
    "has_rows",
    "hourly_series",
    "land_json",
    "readings_view",
    "scan_csv",
    "scan_json",
    "scan_marking",
    "scan_parquet",
    "scan_readings",
    "scratch",
    "source_metadata",
    "validate_sources",
    "write_clustered",
    "write_parquet",
    "write_parts",
]
