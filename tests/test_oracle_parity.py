"""Every registered query equals its DuckDB oracle on the smallest tables
(the driver's gate runs the same check at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from careflow.sources.bindings import BASE_TABLES
from tests.compare import same
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLE[key]).df()
    same(got, want)


def test_every_key_has_a_callable_and_oracles_are_subset():
    q = E.queries()
    assert set(ORACLE) <= set(q)
    assert len(q) >= 80


def test_rows_only_keys_run(spark):
    """Keys without an oracle (none at present) must at least run."""
    from careflow.plans.catalog import QUERIES
    for key in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[key](spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["total_patients", "today_patients", "checked_in", "total_consultations",
                          "emergency_alerts", "lab_completed", "lab_pending", "pharmacy_dispensed",
                          "pharmacy_pending"]
    assert rows[0]["total_patients"] == 150


def test_nested_record_agrees_with_summary(spark):
    """The nested J6 record (rows-only key) carries the same figures as the
    scalar summary that is checked against DuckDB."""
    from pyspark.sql import functions as F
    from careflow.operators import records
    from careflow.plans.catalog import clinical
    from careflow.sources.bindings import Bindings
    b = Bindings(spark, SF_SMALL)  # the nested frame (the registered key renders its lists as JSON)
    rec = records.patient_record(b.patients, clinical(b), b.hospitals, b.lab_orders, b.prescriptions, b.dept_updates)
    derived = rec.select(
        "patient_id", "name",
        F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("n_consultations"),
        F.coalesce(F.size("lab_history"), F.lit(0)).cast("long").alias("n_lab_orders"),
        F.coalesce(F.size("prescription_history"), F.lit(0)).cast("long").alias("n_prescriptions"),
        F.coalesce(F.size("dept_updates"), F.lit(0)).cast("long").alias("n_updates"),
        F.col("consultation.consultation_id").alias("latest_consultation_id"),
        F.col("consultation.hospital_name").alias("latest_hospital_name"),
        F.to_json(F.col("consultation.prescriptions")).alias("latest_prescriptions"),
        F.col("lab_status.status").alias("lab_status"), F.col("pharmacy_status.status").alias("pharmacy_status"),
        F.col("dept_updates")[0]["update_id"].alias("latest_update_id"))
    same(derived.toPandas(), E.queries()["patient_record"](spark, SF_SMALL).toPandas())
