import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plantpulse.operators import kpi
from plantpulse.operators.alerts import threshold_alerts


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_bounds_are_no_breach_and_sides_get_their_severity(make, enriched):
    values = [10.0, 30.0, 9.99, 30.01]
    rows = threshold_alerts(enriched(make(*({"reading_value": v} for v in values)))).orderBy("actual_value").collect()
    low, high = rows
    assert (low["severity"], low["threshold_condition"], low["threshold_value"]) == ("WARNING", "<", 10.0)
    assert (high["severity"], high["threshold_condition"], high["threshold_value"]) == ("CRITICAL", ">", 30.0)
    assert high["resolved_flag"] is False and high["resolved_at"] is None


def test_messages_of_both_styles(make, enriched):
    e = enriched(make({"reading_value": 31.456}))
    machine, short = one(threshold_alerts(e, "machine")), one(threshold_alerts(e, "kpi"))
    assert machine["alert_message"] == "Sensor Temperature breached. Value=31.46 Threshold=30.0 C"
    assert short["alert_message"] == "Sensor Temperature breached: 31.46 C"
    assert "factory_id" not in machine.asDict() and short["factory_id"] == "FCT1"
    assert one(threshold_alerts(e, with_reading_id=True))["reading_id"] == "1"


def test_no_alert_without_limits_or_value_and_nan_is_critical(make, enriched):
    raw = make(
        {"sensor_type_id": 9, "reading_value": 1e9},
        {"sensor_type_id": 77, "reading_value": 1e9},
        {"reading_value": None},
        {"reading_value": math.nan},
    )
    alert = one(threshold_alerts(enriched(raw)))
    assert math.isnan(alert["actual_value"]) and alert["severity"] == "CRITICAL"


def test_downtime_counts_treat_null_flags_as_no(make, enriched):
    flags = [(True, True), (True, False), (False, True), (None, True), (True, None), (None, None)]
    row = one(kpi.minute_kpi(enriched(make(*({"is_downtime": d, "planned_downtime": p} for d, p in flags)))))
    assert (row["num_events"], row["planned_downtime_sec"], row["unplanned_downtime_sec"]) == (6, 1, 1)
    est = one(kpi.minute_kpi(enriched(make({"is_downtime": True})), downtime_estimate=True, interval_seconds=5))
    assert est["unplanned_downtime_est_sec"] == 5 and est["planned_downtime_est_sec"] == 0


@pytest.mark.parametrize("key", ["product_id", "operator_id"])
def test_null_keys_show_alerts_unless_the_older_rule_is_asked_for(make, enriched, key):
    e = enriched(make({key: None, "reading_value": 99.0}))
    assert one(kpi.minute_kpi(e))["num_alerts"] == 1
    assert one(kpi.minute_kpi(e, count_null_keys=False))["num_alerts"] == 0


def test_null_readings_count_as_events_but_not_in_the_average(make, enriched):
    row = one(kpi.minute_kpi(enriched(make({"reading_value": None}, {"reading_value": 12.0}))))
    assert (row["num_events"], row["avg_reading"]) == (2, 12.0)


def test_daily_machine_uses_codes_as_they_come(make):
    from plantpulse.operators.conform import conform_readings

    raw = make({"reading_value": 1.0}, {"reading_value": 3.0}, {"machine_id": "mac1"}, {"event_timestamp": "bad"})
    rows = kpi.daily_machine(conform_readings(raw, normalise=False)).collect()
    got = {(r["machine_id"], str(r["event_date"])): (r["avg_reading"], r["total_readings"]) for r in rows}
    assert got == {("MAC1", "2024-01-01"): (2.0, 2), ("mac1", "2024-01-01"): (20.0, 1), ("MAC1", "None"): (20.0, 1)}


reading = st.fixed_dictionaries(
    {
        "machine_id": st.sampled_from(["MAC1", "MAC2", " mac1", "MAC9"]),
        "sensor_type_id": st.sampled_from([1, 9, 77, None]),
        "product_id": st.sampled_from([1, 2, None]),
        "operator_id": st.sampled_from(["OPR1", None]),
        "event_timestamp": st.sampled_from(["2024-01-01 10:00:00", "2024-01-01 10:00:59", "2024-01-01 10:01:00", "bad"]),
        "reading_value": st.one_of(st.none(), st.floats(0, 50).map(lambda v: round(v, 2))),
        "is_downtime": st.sampled_from([True, False, None]),
        "planned_downtime": st.sampled_from([True, False, None]),
    }
)


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(reading, min_size=1, max_size=25))
def test_tables_agree_with_each_other(make, enriched, rows):
    e = enriched(make(*rows)).cache()
    k = kpi.minute_kpi(e).collect()
    assert sum(r["num_events"] for r in k) == e.count()
    assert sum(r["num_alerts"] for r in k) == threshold_alerts(e).count()
    for r in k:
        assert r["planned_downtime_sec"] + r["unplanned_downtime_sec"] <= r["num_events"]
        if r["avg_reading"] is not None:
            assert r["min_reading"] - 1e-9 <= r["avg_reading"] <= r["max_reading"] + 1e-9
    fused = kpi.minute_stats_all_levels(e).cache()
    for level in kpi.MINUTE_LEVELS:
        separate = {tuple(r)[:-3]: r for r in kpi.minute_stats(e, level).collect()}
        together = {tuple(r)[:-3]: r for r in kpi.one_level(fused, level).collect()}
        assert separate.keys() == together.keys()
        for key, a in separate.items():
            b = together[key]
            assert (a["min_value"], a["max_value"]) == (b["min_value"], b["max_value"])
            assert a["avg_value"] == b["avg_value"] or abs(a["avg_value"] - b["avg_value"]) < 1e-9
    overall = sum(r["event_count"] for r in kpi.one_level(fused, "overall").collect())
    assert overall == sum(r["event_count"] for r in kpi.one_level(fused, "factory").collect()) == e.count()
    fused.unpersist()
    e.unpersist()
