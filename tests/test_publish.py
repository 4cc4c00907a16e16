from plantpulse.operators.alerts import threshold_alerts
from plantpulse.operators.kpi import KPI_MINUTE, minute_kpi
from plantpulse.plans import publish
from plantpulse.streaming.live import ALERT_TABLE_PARTITIONS, alert_table_rows


class Recorder:
    """Stands in for a warehouse, which a test cannot start."""

    def __init__(self):
        self.appended, self.replaced = [], []

    def append(self, df, table):
        self.appended.append((table, df.collect()))

    def replace(self, df, table):
        self.replaced.append((table, df.collect()))


def test_alerts_are_appended_once_over_overlapping_runs(spark, make, enriched, tmp_path):
    w = Recorder()
    ledger = str(tmp_path / "ledger")
    rows = [{"reading_value": 99.0}, {"reading_value": 1.0}]

    def run(*readings):
        alerts = alert_table_rows(threshold_alerts(enriched(make(*readings)), with_reading_id=True))
        return publish.publish_new(
            spark, alerts, w, "alert_events", ledger, ("reading_id", *ALERT_TABLE_PARTITIONS), ALERT_TABLE_PARTITIONS
        )

    assert [run(*rows), run(*rows), run(*rows, {"reading_value": 50.0})] == [2, 0, 1]
    sent = [r["reading_id"] for _, part in w.appended for r in part]
    assert sorted(sent) == ["1", "2", "3"] and "alert_date" not in w.appended[0][1][0].asDict()


def test_only_closed_minutes_are_published(make, enriched):
    kpi = minute_kpi(enriched(make(*({"event_timestamp": f"2024-01-01 10:0{m}:30"} for m in range(5)))))
    closed = publish.closed_minutes(kpi, "2024-01-01 10:04:30", settle_minutes=1)
    assert sorted(str(r[KPI_MINUTE])[14:16] for r in closed.collect()) == ["00", "01", "02"]


def test_replacing(make, enriched):
    w = Recorder()
    publish.publish_replacing(minute_kpi(enriched(make({}))), w)
    assert w.replaced[0][0] == "minute_kpi" and len(w.replaced[0][1]) == 1


def test_kpi_table_is_read_for_a_range_of_days(spark, make, dims, tmp_path):
    import glob

    from plantpulse.plans.jobs import run_minute_kpi

    raw = make(*({"event_timestamp": f"2024-01-0{d} 10:00:00"} for d in (1, 2, 3)))
    run_minute_kpi(spark, raw, dims, "2024-01-04 00:00:00", str(tmp_path))
    for f in glob.glob(f"{tmp_path}/minute_kpi/kpi_date=2024-01-03/**/*.parquet", recursive=True):
        open(f, "w").write("no parquet")
    path = f"{tmp_path}/minute_kpi"
    rows = publish.read_kpi_table(spark, path, "2024-01-01 12:00:00", "2024-01-02 12:00:00").collect()
    assert [str(r[KPI_MINUTE]) for r in rows] == ["2024-01-02 10:00:00"]
