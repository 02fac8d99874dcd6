"""Sample tables and what must come out of them."""

from datetime import datetime

READINGS = [
    # device_id, location, temperature, humidity, pressure, timestamp, status
    ("sensor_001", "warehouse_A", 23.5, 65.2, 1013.25, "2024-01-01 10:00:00", 1),
    ("sensor_002", "warehouse_B", 21.8, 70.1, 1012.8, "2024-01-01 10:00:00", 1),
    ("sensor_003", "warehouse_A", 25.1, 55.8, 1014.1, "2024-01-01 10:01:00", 0),
    ("sensor_004", "warehouse_C", 19.3, 80.5, 1011.5, "2024-01-01 10:01:00", 1),
    ("sensor_005", "warehouse_B", 22.7, 68.9, 1013.0, "2024-01-01 10:02:00", 1),
]
READING_COLUMNS = ["device_id", "location", "temperature", "humidity", "pressure", "timestamp", "status"]

SUMMARY = {
    "warehouse_A": (24.3, 60.5, 1013.675, 2, 1),
    "warehouse_B": (22.25, 69.5, 1012.9, 2, 2),
    "warehouse_C": (19.3, 80.5, 1011.5, 1, 1),
}

TRIGGER = "2024-01-01 10:00:00"
TRIGGER_TIME = datetime(2024, 1, 1, 10)

HISTORY = [
    # device_id, zone, temperature, humidity
    ("sensor_hs_001", "zone_A", 22.5, 60.0),
    ("sensor_hs_002", "zone_B", 24.1, 55.3),
    ("sensor_hs_003", "zone_A", 21.8, 62.7),
    ("sensor_hs_004", "zone_C", 26.3, 48.9),
]

DOWNSTREAM = [
    # pipeline_id, stage, avg_temp, alert_status
    ("ds_001", "processed", 23.2, "NORMAL"),
    ("ds_002", "processed", 25.8, "WARNING"),
    ("ds_003", "raw", 20.1, "NORMAL"),
]
