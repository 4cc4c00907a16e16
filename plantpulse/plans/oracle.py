"""SQL counterparts of the catalog, for an engine that sees only the test tables.

Every statement starts with the same named subqueries: readings and dimensions derived from the
test tables, then the steps to enriched readings. They are written from the definitions, not from
the Spark code.
"""

from __future__ import annotations

from plantpulse.plans import catalog as c
from plantpulse.sources import testdata as td

_SENSORS = ",\n    ".join(
    f"({i}, '{code}', '{name}', '{unit}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))"
    for i, code, name, unit, lo, hi in td.SENSORS
)

_SOURCES = f"""
src AS (
  SELECT event_id, event_type, "value", ts, user_id // 10 AS unit, epoch_us(ts) % 7200000000 AS us,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
readings AS (
  SELECT
    CAST(event_id AS VARCHAR) AS _id,
    'FCT' || lpad(CAST(k % 25 AS VARCHAR), 3, '0') AS factory_id,
    CASE WHEN event_id % 7 = 0
         THEN ' mac' || lpad(CAST(unit * 8 AS VARCHAR), 10, '0') || ' '
         ELSE 'MAC' || lpad(CAST(unit * 8 AS VARCHAR), 10, '0') END AS machine_id,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                    WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS sensor_type_id,
    CASE WHEN event_id % 97 <> 0
         THEN 'OPR' || lpad(CAST((unit + us // 3600000000) * 125 AS VARCHAR), 10, '0') END AS operator_id,
    CASE WHEN event_id % 101 <> 0 THEN CAST(us // 420000000 AS INTEGER) END AS product_id,
    CASE WHEN event_id % 211 = 0 THEN 'bad'
         ELSE strftime(make_timestamp(1704067200000000 + us), '%Y-%m-%d %H:%M:%S') END AS event_timestamp,
    "value" AS reading_value,
    event_id % 33 = 0 AS is_downtime,
    event_id % 66 = 0 AS planned_downtime,
    CASE WHEN event_id % 211 = 0 THEN NULL ELSE CAST(date_trunc('day', ts) AS DATE) END AS real_date
  FROM src
),
dim_machine AS (
  SELECT 'MAC' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS machine_id,
         'FCT' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS factory_id,
         'Line ' || CAST(s_suppkey % 5 AS VARCHAR) AS line_name,
         CASE (s_suppkey // 8) % 4 WHEN 0 THEN 'Oven' WHEN 1 THEN 'Mixer' WHEN 2 THEN 'Cutter' ELSE 'Packer' END AS machine_type,
         CASE WHEN s_acctbal < 2500 THEN 'Low' WHEN s_acctbal < 7000 THEN 'Medium' ELSE 'High' END AS criticality
  FROM supplier
),
dim_factory AS (
  SELECT 'FCT' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS factory_id, n_name AS city, r_name AS country,
         CASE n_nationkey % 3 WHEN 0 THEN 'Pilot' WHEN 1 THEN 'Line' ELSE 'Campus' END AS capacity_class
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
dim_operator AS (
  SELECT 'OPR' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS operator_id,
         CASE c_custkey % 3 WHEN 0 THEN 'Trainee' WHEN 1 THEN 'Skilled' ELSE 'Lead' END AS experience_level,
         CASE c_custkey % 4 WHEN 0 THEN 'Early' WHEN 1 THEN 'Late'
                            WHEN 2 THEN 'Night' ELSE 'Mixed' END AS shift_pattern
  FROM customer
),
dim_product AS (
  SELECT CAST(p_partkey AS INTEGER) AS product_id, p_type AS category, p_brand AS brand FROM part
),
dim_sensor_type(sensor_type_id, sensor_type_code, sensor_type_name, unit, typical_min, typical_max) AS (
  VALUES
    {_SENSORS}
)"""


def _steps(normalise: bool) -> str:
    machine = "upper(trim(machine_id))" if normalise else "machine_id"
    return f""",
conformed AS (
  SELECT * REPLACE ({machine} AS machine_id),
         try_strptime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_timestamp_utc
  FROM (SELECT * EXCLUDE (real_date) FROM readings)
),
recent AS (
  SELECT * FROM conformed
  WHERE event_timestamp_utc >= TIMESTAMP '{td.AS_OF}' - INTERVAL {td.LOOKBACK} MINUTE
),
joined AS (
  SELECT e.* EXCLUDE (factory_id), m.factory_id, s.sensor_type_name, s.typical_min, s.typical_max, s.unit
  FROM recent e
  LEFT JOIN dim_machine m ON e.machine_id = m.machine_id
  LEFT JOIN dim_sensor_type s ON e.sensor_type_id = s.sensor_type_id
),
enriched AS (
  SELECT *, date_trunc('minute', event_timestamp_utc) AS minute_ts FROM joined WHERE factory_id IS NOT NULL
),
breaches AS (
  SELECT *, reading_value > typical_max AS over FROM enriched
  WHERE reading_value > typical_max OR reading_value < typical_min
)"""


def _sql(body: str, normalise: bool = True, *ctes: str) -> str:
    extra = "".join(f",\n{cte.strip()}" for cte in ctes)
    return f"WITH {_SOURCES.strip()}{_steps(normalise)}{extra}\n{body.strip()}"


_KPI_KEYS = "factory_id, machine_id, product_id, operator_id, sensor_type_id"
_KPI_MEASURES = """
    round(avg(reading_value), 6) AS avg_reading, max(reading_value) AS max_reading,
    min(reading_value) AS min_reading, count(*) AS num_events,
    CAST(count(*) FILTER (is_downtime AND planned_downtime) AS INTEGER) AS planned_downtime_sec,
    CAST(count(*) FILTER (is_downtime AND NOT planned_downtime) AS INTEGER) AS unplanned_downtime_sec"""
_ALERT_COUNT = "count(*) FILTER (reading_value > typical_max OR reading_value < typical_min) AS num_alerts"
_KPI = f"""
kpi AS (
  SELECT minute_ts AS kpi_minute_start_utc, {_KPI_KEYS}, {_KPI_MEASURES}, {_ALERT_COUNT}
  FROM enriched GROUP BY minute_ts, {_KPI_KEYS}
)"""
_ALERT_COUNTS = f"""
alert_counts AS (
  SELECT minute_ts AS kpi_minute_start_utc, {_KPI_KEYS}, count(*) AS num_alerts
  FROM breaches GROUP BY minute_ts, {_KPI_KEYS}
)"""
_ALERT_COMMON = """
    reading_value AS actual_value,
    CASE WHEN over THEN typical_max ELSE typical_min END AS threshold_value,
    CASE WHEN over THEN '>' ELSE '<' END AS threshold_condition,
    CASE WHEN over THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
    'Sensor Threshold Breach' AS alert_type,
    FALSE AS resolved_flag, CAST(NULL AS TIMESTAMP) AS resolved_at"""
_SHORT = "'Sensor ' || sensor_type_name || ' breached: ' || CAST(round(reading_value, 2) AS VARCHAR) || ' ' || unit"
_LONG = (
    "'Sensor ' || sensor_type_name || ' breached. Value=' || CAST(round(reading_value, 2) AS VARCHAR) || "
    "' Threshold=' || CAST(round(CASE WHEN over THEN typical_max ELSE typical_min END, 2) AS VARCHAR) || ' ' || unit"
)
_ALERTS_B = f"""
SELECT event_timestamp_utc AS alert_time_utc, factory_id, machine_id, sensor_type_id, product_id, operator_id,
    {_ALERT_COMMON}, {_SHORT} AS alert_message"""


def _stats(keys: str, where: str = "") -> str:
    return _sql(f"""
SELECT minute_ts{keys}, count(*) AS event_count, round(avg(reading_value), 6) AS avg_value,
       min(reading_value) AS min_value, max(reading_value) AS max_value
FROM enriched {where} GROUP BY minute_ts{keys}""")


_BI_FROM = """
FROM kpi k
LEFT JOIN dim_factory f ON k.factory_id = f.factory_id
LEFT JOIN dim_machine m ON k.machine_id = m.machine_id
LEFT JOIN dim_operator o ON k.operator_id = o.operator_id
LEFT JOIN dim_product p ON k.product_id = p.product_id
LEFT JOIN dim_sensor_type s ON k.sensor_type_id = s.sensor_type_id"""


def _bi(by: str, where: str = "", having: str = "") -> str:
    return _sql(f"""
SELECT {by}, count(*) AS kpi_rows, CAST(sum(num_events) AS BIGINT) AS num_events,
       CAST(sum(num_alerts) AS BIGINT) AS num_alerts,
       CAST(sum(planned_downtime_sec) AS BIGINT) AS planned_downtime,
       CAST(sum(unplanned_downtime_sec) AS BIGINT) AS unplanned_downtime,
       min(min_reading) AS min_reading, max(max_reading) AS max_reading
{_BI_FROM} {where} GROUP BY {by} {having}""", True, _KPI)


_RAW = "SELECT * EXCLUDE (real_date) FROM"
_NEWEST_CUTOFF = f"""
cutoff AS (
  SELECT strftime(max(event_timestamp_utc) - INTERVAL {c.KEEP_MINUTES} MINUTE, '%Y-%m-%d %H:%M:%S') AS t FROM conformed
)"""
_LEAVING = """
leaving AS (SELECT * FROM readings WHERE event_timestamp < (SELECT t FROM cutoff))"""
_BATCH = f"""
batch AS (SELECT * FROM leaving ORDER BY event_timestamp, _id LIMIT {c.RUN_POLICY.run_cap})"""
_ARCHIVED = """
archived AS (
  SELECT * EXCLUDE (real_date), CAST(year(event_ts) AS INTEGER) AS year,
         CAST(month(event_ts) AS INTEGER) AS month, CAST(day(event_ts) AS INTEGER) AS day,
         CAST(hour(event_ts) AS INTEGER) AS hour
  FROM (SELECT *, try_strptime(event_timestamp, '%Y-%m-%d %H:%M:%S') AS event_ts FROM readings)
)"""


def _orphans(key: str, dim: str) -> str:
    return f"""
SELECT '{key}' AS key_column, count(DISTINCT e.{key}) AS orphan_keys, count(*) AS orphan_events
FROM conformed e WHERE e.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{key} = e.{key})"""


def oracle_sql() -> dict[str, str]:
    conformed = _sql("SELECT * FROM conformed")
    enriched = _sql("SELECT * FROM enriched")
    minute_kpi = _sql("SELECT * FROM kpi", True, _KPI)
    raw = _sql(f"{_RAW} readings")
    sets = {
        "overall": "(minute_ts)",
        "factory": "(minute_ts, factory_id)",
        "machine": "(minute_ts, factory_id, machine_id)",
        "product": "(minute_ts, factory_id, product_id)",
    }
    return {
        "readings_conformed": conformed,
        "readings_unique": raw,
        "events_enriched": enriched,
        "minute_kpi": minute_kpi,
        "minute_kpi_parity": _sql(f"""
SELECT k.* EXCLUDE (num_alerts), coalesce(a.num_alerts, 0) AS num_alerts
FROM kpi k LEFT JOIN alert_counts a ON k.kpi_minute_start_utc = a.kpi_minute_start_utc
  AND k.factory_id = a.factory_id AND k.machine_id = a.machine_id AND k.product_id = a.product_id
  AND k.operator_id = a.operator_id AND k.sensor_type_id = a.sensor_type_id""", False, _KPI, _ALERT_COUNTS),
        "minute_kpi_downtime_estimate": _sql("""
SELECT *, planned_downtime_sec * 5 AS planned_downtime_est_sec,
       unplanned_downtime_sec * 5 AS unplanned_downtime_est_sec FROM kpi""", True, _KPI),
        "alerts_per_minute": _sql("SELECT * FROM alert_counts", False, _ALERT_COUNTS),
        "alerts_a": _sql(f"""
SELECT event_timestamp_utc AS alert_time_utc, machine_id, sensor_type_id, product_id,
    {_ALERT_COMMON}, {_LONG} AS alert_message FROM breaches"""),
        "alerts_b": _sql(f"{_ALERTS_B} FROM breaches", False),
        "agg_overall_minute": _stats(""),
        "agg_factory_minute": _stats(", factory_id"),
        "agg_machine_minute": _stats(", factory_id, machine_id"),
        "agg_product_minute": _stats(", factory_id, product_id", "WHERE product_id IS NOT NULL"),
        "agg_minute_grouping_sets": _sql(f"""
SELECT * FROM (
  SELECT minute_ts, factory_id, machine_id, product_id, count(*) AS event_count,
         round(avg(reading_value), 6) AS avg_value, min(reading_value) AS min_value, max(reading_value) AS max_value,
         CASE grouping(minute_ts, factory_id, machine_id, product_id)
              WHEN 7 THEN 'overall' WHEN 3 THEN 'factory' WHEN 1 THEN 'machine' WHEN 2 THEN 'product' END AS level
  FROM enriched GROUP BY GROUPING SETS ({", ".join(sets.values())})
) WHERE level <> 'product' OR product_id IS NOT NULL"""),
        "daily_machine": _sql("""
SELECT machine_id, real_date AS event_date, round(avg(reading_value), 6) AS avg_reading,
       max(reading_value) AS max_reading, min(reading_value) AS min_reading, count(*) AS total_readings
FROM readings GROUP BY machine_id, real_date"""),
        "kpi_freshness": _sql(
            'SELECT max(kpi_minute_start_utc) AS latest_minute, count(*) AS "rows" FROM kpi', True, _KPI),
        "kpi_table_range": _sql(f"""
SELECT * FROM kpi WHERE kpi_minute_start_utc >= TIMESTAMP '{c.BI_START}'
  AND kpi_minute_start_utc < TIMESTAMP '{c.BI_END}'""", True, _KPI),
        "dq_report": _sql(f"""
SELECT count(*) AS total_rows, count(*) FILTER (event_timestamp_utc IS NULL) AS unparsed_time,
       count(*) FILTER (reading_value IS NULL) AS missing_value, count(*) FILTER (isnan(reading_value)) AS nan_value,
       count(*) FILTER (product_id IS NULL) AS missing_product, count(*) FILTER (operator_id IS NULL) AS missing_operator,
       count(*) FILTER (late_enough) AS in_lookback,
       count(*) FILTER (late_enough AND machine IS NOT NULL) AS matched,
       count(*) FILTER (late_enough AND machine IS NULL) AS unmatched
FROM (SELECT e.*, d.machine_id AS machine,
             event_timestamp_utc >= TIMESTAMP '{td.AS_OF}' - INTERVAL {td.LOOKBACK} MINUTE AS late_enough
      FROM conformed e LEFT JOIN dim_machine d ON e.machine_id = d.machine_id)"""),
        "dq_orphans": _sql(" UNION ALL ".join(
            _orphans(k, d) for k, d in {
                "machine_id": "dim_machine", "operator_id": "dim_operator",
                "product_id": "dim_product", "sensor_type_id": "dim_sensor_type"}.items())),
        "top_unmatched": _sql("""
SELECT machine_id, count(*) AS num_events FROM joined WHERE factory_id IS NULL
GROUP BY machine_id ORDER BY num_events DESC, machine_id NULLS FIRST LIMIT 20"""),
        "top_unmatched_sketched": _sql("""
SELECT machine_id, count(*) AS num_events FROM joined WHERE factory_id IS NULL
GROUP BY machine_id ORDER BY num_events DESC, machine_id NULLS FIRST LIMIT 20"""),
        "dim_preview": _sql("SELECT machine_id, factory_id FROM dim_machine ORDER BY machine_id, factory_id LIMIT 10"),
        "latest_events": _sql("""
SELECT _id, machine_id, event_timestamp, event_timestamp_utc FROM recent
ORDER BY event_timestamp_utc DESC, _id LIMIT 10"""),
        "max_event_ts": _sql("SELECT max(event_timestamp_utc) AS max_event_ts FROM conformed"),
        "bi_star": _sql(f"SELECT k.*, {', '.join(c.STAR_ATTRIBUTES)} {_BI_FROM}", True, _KPI),
        "bi_city_capacity": _bi(
            "city, capacity_class",
            f"WHERE kpi_minute_start_utc >= TIMESTAMP '{c.BI_START}' AND kpi_minute_start_utc < TIMESTAMP '{c.BI_END}'",
            "HAVING sum(num_events) > 10"),
        "bi_rolled": _bi("city, capacity_class", "", "HAVING sum(num_events) > 10"),
        "bi_operator_shift": _bi("experience_level, shift_pattern"),
        "bi_product_category": _bi("category, brand"),
        "bi_machine_criticality": _bi("criticality, machine_type", "WHERE capacity_class <> 'Pilot'"),
        "bi_downtime_having": _bi(
            "country, line_name, sensor_type_name", "",
            "HAVING sum(unplanned_downtime_sec) > 0 AND sum(num_alerts) > 0"),
        "bi_alert_severity": _sql("""
SELECT CASE WHEN over THEN 'CRITICAL' ELSE 'WARNING' END AS severity, sensor_type_name, city,
       count(*) AS num_alerts, max(reading_value) AS max_value, min(reading_value) AS min_value
FROM breaches b LEFT JOIN dim_factory f ON b.factory_id = f.factory_id GROUP BY 1, 2, 3"""),
        "archive_candidates": _sql(f"{_RAW} leaving", True, _NEWEST_CUTOFF, _LEAVING),
        "archive_candidates_clock": _sql(
            f"{_RAW} readings WHERE event_timestamp < "
            f"strftime(TIMESTAMP '{td.AS_OF}' - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')"),
        "archive_run_batch": _sql(f"{_RAW} batch", True, _NEWEST_CUTOFF, _LEAVING, _BATCH),
        "retention_remaining": _sql(
            f"{_RAW} readings WHERE _id NOT IN (SELECT _id FROM leaving)", True, _NEWEST_CUTOFF, _LEAVING),
        "archive_manifest": _sql(f"""
SELECT '{c.RUN_ID}' AS run_id, TIMESTAMP '{td.AS_OF}' AS archived_at_utc, 'sensor_readings' AS source,
       '{c.ALL_POLICY.describe()}' AS policy,
       (SELECT t FROM cutoff) AS cutoff_str, count(*) AS docs_archived, count(*) AS docs_deleted,
       min(event_timestamp) AS min_event_timestamp, max(event_timestamp) AS max_event_timestamp
FROM leaving""", True, _NEWEST_CUTOFF, _LEAVING),
        "archive_reconcile": _sql("""
SELECT (SELECT count(*) FROM readings) AS docs_before, count(*) AS docs_selected, count(*) AS docs_written,
       (SELECT count(*) FROM readings) - count(*) AS docs_left, TRUE AS balanced
FROM leaving""", True, _NEWEST_CUTOFF, _LEAVING),
        "size_archive_run": _sql("""
SELECT count(*) AS docs_archived, count(*) AS docs_deleted, CAST(0 AS BIGINT) AS docs_left, count(*) AS stored_ids,
       (SELECT count(*) FROM readings) - count(*) AS hot_rows FROM leaving""", True, _NEWEST_CUTOFF, _LEAVING),
        "age_dump_run": _sql(f"""
SELECT count(*) AS docs_archived, count(*) AS docs_deleted, CAST(0 AS BIGINT) AS docs_left, count(*) AS stored_ids,
       (SELECT count(*) FROM readings) - count(*) AS hot_rows
FROM readings WHERE event_timestamp < strftime(TIMESTAMP '{td.AS_OF}' - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')"""),
        "kpi_after_archive": minute_kpi,
        "hot_snapshot_read": _sql("SELECT r.*, CAST(_id AS BIGINT) % 100 <> 0 AS kept FROM (" + f"{_RAW} readings" + ") r"),
        "hot_merge_on_read": _sql(f"{_RAW} readings WHERE CAST(_id AS BIGINT) % 100 <> 0"),
        "hot_compacted": _sql(f"{_RAW} readings WHERE CAST(_id AS BIGINT) % 100 <> 0"),
        "dim_csv_load": _sql("SELECT machine_id, factory_id, line_name, criticality FROM dim_machine"),
        "dim_json_load": _sql("SELECT product_id, category, brand FROM dim_product"),
        "store_size": _sql("""
SELECT CAST(sum(strlen(concat_ws(',', _id, machine_id, event_timestamp)) + 1) AS BIGINT) AS bytes,
       sum(strlen(concat_ws(',', _id, machine_id, event_timestamp)) + 1) > 1024 * 1024 AS due FROM readings"""),
        "stream_chain": minute_kpi,
        "stream_late": minute_kpi,
        "kpi_incremental": minute_kpi,
        "dq_corrupt": _sql("""
SELECT kind, count(*) AS messages, min(n) AS first_offset, CAST(sum(n) AS BIGINT) AS offsets
FROM (SELECT CAST(_id AS BIGINT) AS n, unnest(CASE WHEN CAST(_id AS BIGINT) % 17 = 0 THEN ['unparsed']
        WHEN CAST(_id AS BIGINT) % 19 = 0 THEN ['stored', 'mistyped'] ELSE ['stored'] END) AS kind FROM readings)
GROUP BY kind"""),
        "archive_ndjson_scan": raw,
        "archive_layout_columns": _sql("SELECT * FROM archived", True, _ARCHIVED),
        "archive_partitioned": _sql("SELECT * FROM archived", True, _ARCHIVED),
        "archive_read_pruned": _sql(f"""
SELECT * FROM archived WHERE event_ts >= TIMESTAMP '{c.READ_START}' AND event_ts < TIMESTAMP '{c.READ_END}'
  AND factory_id IN ({", ".join(f"'{f}'" for f in c.READ_FACTORIES)})""", True, _ARCHIVED),
        "archive_lookup": _sql("SELECT * FROM archived WHERE CAST(_id AS BIGINT) % 997 = 0", True, _ARCHIVED),
        "hot_newest": _sql("""
SELECT epoch_us(max(event_timestamp_utc)) // 1000000 AS newest_second, (SELECT t FROM cutoff) AS cutoff
FROM conformed""", True, _NEWEST_CUTOFF),
        "history_union": raw,
        "stream_ingest": conformed,
        "stream_dedup": conformed,
        "stream_enriched": enriched,
        "stream_minute_kpi": minute_kpi,
        "stream_alerts": _sql(f"{_ALERTS_B}, _id AS reading_id FROM breaches"),
        "stream_dimension_change": _sql(f"""
SELECT * REPLACE (CASE WHEN CAST(reading_id AS BIGINT) % 2 = 0 THEN 'FCT999' ELSE factory_id END AS factory_id)
FROM ({_ALERTS_B}, _id AS reading_id FROM breaches)"""),
    }
