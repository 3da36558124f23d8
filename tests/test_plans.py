"""Plan shapes the design relies on, checked with explain() on native tables
(parquet files with real status and time columns, as in a deployment)."""

import datetime as dt

from pyspark.sql import functions as F

from careflow.operators import kpi, queues, records, registry as U
from careflow.sources.bindings import Bindings
from tests.conftest import SF_SMALL


def plan(df) -> str:
    """The text ``df.explain("formatted")`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _native(spark, tmp_dir):
    t0 = dt.datetime(2024, 1, 1)
    rx = spark.createDataFrame([(i, i % 50, t0 + dt.timedelta(hours=i), "pending" if i % 3 else "dispensed")
                                for i in range(500)], "rx_id long, patient_id long, created_at timestamp_ntz, status string")
    pats = spark.createDataFrame([(i, f"P{i}", i + 1, i % 4, t0 + dt.timedelta(days=i % 5)) for i in range(50)],
                                 "patient_id long, name string, token_number long, hospital_id int, created_at timestamp_ntz")
    rx.write.parquet(tmp_dir + "/rx")
    pats.write.parquet(tmp_dir + "/patients")
    return spark.read.parquet(tmp_dir + "/rx"), spark.read.parquet(tmp_dir + "/patients")


def test_status_and_tenant_filters_reach_the_scan(spark, tmp_dir):
    rx, pats = _native(spark, tmp_dir)
    p = plan(queues.pharmacy_pending(rx, pats, hospital_id=2))
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,pending)" in p
    assert "EqualTo(hospital_id,2)" in p
    # only the columns the queue shows are read
    assert "ReadSchema: struct<patient_id:bigint,name:string,token_number:bigint,hospital_id:int>" in p


def test_day_filter_is_a_pushed_range(spark, tmp_dir):
    _, pats = _native(spark, tmp_dir)
    p = plan(kpi.today_patients(pats, "2024-01-03"))
    assert "GreaterThanOrEqual(created_at,2024-01-03T00:00)" in p
    assert "LessThan(created_at,2024-01-04T00:00)" in p


def test_latest_per_key_is_an_aggregate_not_a_window(spark):
    b = Bindings(spark, SF_SMALL)
    p = plan(records.latest_consultation(b.consultations))
    assert "max_by" in p and "Window" not in p


def test_global_running_count_never_windows_the_whole_log(spark):
    b = Bindings(spark, SF_SMALL)
    df = U.token_numbers(b.registrations, b.patients)
    p = plan(df)
    # the only unpartitioned window runs over the per-range counts; the
    # per-row window is partitioned by the range
    windows = [line for line in p.splitlines() if line.startswith("Arguments:") and "windowspecdefinition" in line]
    assert windows and all("__bucket" in w for w in windows)


def test_building_a_plan_starts_no_job(spark):
    from careflow.plans.catalog import QUERIES

    b = Bindings(spark, SF_SMALL)
    tables = (b.patients, b.consultations, b.hospitals, b.lab_orders, b.prescriptions, b.dept_updates, b.registrations, b.items)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plans", "plans")
    records.history_with_hospital(b.consultations, b.hospitals)
    records.record_defaults(*tables[:2], b.lab_orders, b.prescriptions, b.hospitals)
    U.token_numbers(b.registrations, b.patients)
    queues.queue_position(queues.pending_queue(b.lab_orders, b.patients, "order_id"), queues.pending_queue(b.prescriptions, b.patients, "rx_id"))
    assert list(tracker.getJobIdsForGroup("plans")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "patient_timeline" in QUERIES


def test_bindings_leave_callers_views_alone(spark):
    spark.range(3).createOrReplaceTempView("orders")
    Bindings(spark, SF_SMALL).consultations.count()
    assert spark.table("orders").count() == 3
