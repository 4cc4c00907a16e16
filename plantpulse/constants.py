"""Values shared by the whole package."""

# --- Fixed values: texts, formats and names that results and tables must carry exactly. ---
EVENT_TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"
EVENT_TIME_STRFTIME = "%Y-%m-%d %H:%M:%S"
SEVERITY_HIGH = "CRITICAL"
SEVERITY_LOW = "WARNING"
CONDITION_HIGH = ">"
CONDITION_LOW = "<"
ALERT_TYPE = "Sensor Threshold Breach"
TOPIC = "iot_sensor_stream"
LOOKBACK_MINUTES = 6000
WAREHOUSE_BATCH_ROWS = 5000
ARCHIVE_THRESHOLD_MB = 300
ARCHIVE_KEEP_MINUTES = 15
ARCHIVE_CHUNK_DOCS = 20_000
ARCHIVE_MAX_CHUNKS = 10
ARCHIVE_POLICY_TEXT = (
    "archive if size > {mb}MB; keep newest {minutes} min; chunk={docs} docs/file; max_chunks_per_run={chunks}"
)
DUMP_MIN_AGE_HOURS = 1
EVENT_INTERVAL_SECONDS = 5
# --- End of fixed values. ---

#: Grain of the per-minute KPI table, without the minute itself.
KPI_KEYS = ("factory_id", "machine_id", "product_id", "operator_id", "sensor_type_id")
