"""Registered queries: each key has a Spark plan and (where SQL can say it)
the DuckDB oracle statement computing the same rows.

Spark plans are built from the operator functions over the binding views of
one scale-factor folder; oracles inline the bindings they use (``oracle_with``).
Every query reads whole tables; parameters (day, hospital) are the feature of
the operator they belong to, never a device to make a check cheaper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from careflow import schemas as S
from careflow.functions import extract as X
from careflow.functions.common import dealt
from careflow.operators import kpi, partials, queues, records
from careflow.operators import predicates as P
from careflow.operators import registry as U
from careflow.sources import key_counts
from careflow.sources import lake as L
from careflow.streaming import registrations as R
from careflow.streaming import streams as T
from careflow.plans.oracle import oracle_with
from careflow.session import scratch_path
from careflow.sources.bindings import Bindings
from careflow.sources.state_tables import co_bucketed, tenant_rows, write_tenants

# Fixed parameters of the registered queries.
AS_OF = "2001-07-28"         # "today" on the order-date clock of patients
QUEUE_HOSPITAL = 3           # the caller's hospital for tenant scope
PATIENTS = (7, 11, 145)      # the patients whose files are opened
STATE_BUCKETS = 8            # of the state tables (``buckets_for`` gives a cluster's)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle_with(oracle)
        return fn
    return deco


def _day(col: str, day: str = AS_OF) -> str:
    return (f"{col} >= TIMESTAMP '{day} 00:00:00' AND "
            f"{col} < TIMESTAMP '{day} 00:00:00' + INTERVAL 1 DAY")


def _day_text(df: DataFrame, col: str) -> DataFrame:
    """Registered outputs carry days as ISO text: DATE values have no common
    client-side form across engines, text does."""
    return df.withColumn(col, F.date_format(col, "yyyy-MM-dd"))


def clinical(b: Bindings) -> DataFrame:
    return records.clinical_records(b.consultations, b.items)


# ---------------------------------------------------------------- scans
@query("scan_patients", """
SELECT * FROM b_patients ORDER BY created_at DESC NULLS LAST, patient_id""")
def q_scan_patients(spark, d):
    b = Bindings(spark, d)
    return b.patients.orderBy(F.col("created_at").desc(), "patient_id")


# ---------------------------------------------------------------- dashboard (A*)
_KPI = f"""
SELECT (SELECT count(*) FROM b_patients) AS total_patients,
       (SELECT count(*) FROM b_patients WHERE {_day('created_at')}) AS today_patients,
       (SELECT count(*) FROM b_patients WHERE checked_in = 1) AS checked_in,
       (SELECT count(*) FROM b_consultations) AS total_consultations,
       (SELECT count(*) FROM b_consultations WHERE severity IN ('emergency', 'high')) AS emergency_alerts,
       (SELECT count(*) FROM b_lab_orders WHERE status = 'completed') AS lab_completed,
       (SELECT count(*) FROM b_lab_orders WHERE status = 'pending') AS lab_pending,
       (SELECT count(*) FROM b_prescriptions WHERE status = 'dispensed') AS pharmacy_dispensed,
       (SELECT count(*) FROM b_prescriptions WHERE status = 'pending') AS pharmacy_pending"""


@query("kpi_summary", _KPI)
def q_kpi_summary(spark, d):
    b = Bindings(spark, d)
    return kpi.kpi_summary(b.patients, b.consultations, b.lab_orders, b.prescriptions, AS_OF)


def _map_json(key: str, table: str) -> str:
    return (f"(SELECT '{{' || string_agg('\"' || coalesce(CAST({key} AS VARCHAR), 'null') || '\":' || "
            f"CAST(n AS VARCHAR), ',' ORDER BY coalesce(CAST({key} AS VARCHAR), 'null')) || '}}' "
            f"FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY {key}))")


@query("analytics_summary", f"""
SELECT t.*, {_map_json('severity', 'b_consultations')} AS severity_breakdown,
       {_map_json('language', 'b_patients')} AS language_breakdown,
       (SELECT CAST(to_json(list(struct_pack(patient_id := patient_id, name := name, token_number := token_number,
               room_number := room_number, language := language,
               created_at := strftime(created_at, '%Y-%m-%d %H:%M:%S'))
               ORDER BY created_at DESC NULLS LAST, patient_id)) AS VARCHAR)
        FROM (SELECT * FROM b_patients ORDER BY created_at DESC NULLS LAST, patient_id LIMIT 10)) AS recent_patients
FROM (SELECT (SELECT count(*) FROM b_patients) AS total_patients,
             (SELECT count(*) FROM b_patients WHERE {_day('created_at')}) AS today_patients,
             (SELECT count(*) FROM b_patients WHERE checked_in = 1) AS checked_in,
             (SELECT count(*) FROM b_consultations) AS total_consultations,
             (SELECT count(*) FROM b_consultations WHERE severity IN ('emergency', 'high')) AS emergency_alerts,
             (SELECT count(*) FROM b_lab_orders WHERE status = 'completed') AS lab_completed,
             (SELECT count(*) FROM b_lab_orders WHERE status = 'pending') AS lab_pending,
             (SELECT count(*) FROM b_prescriptions WHERE status = 'dispensed') AS pharmacy_dispensed,
             (SELECT count(*) FROM b_prescriptions WHERE status = 'pending') AS pharmacy_pending) t""")
def q_analytics_summary(spark, d):
    b = Bindings(spark, d)
    s = kpi.analytics_summary(b.patients, b.consultations, b.lab_orders, b.prescriptions, AS_OF)
    recent = F.transform("recent_patients",
                         lambda x: x.withField("created_at", F.date_format(x["created_at"], "yyyy-MM-dd HH:mm:ss")))
    # maps and the list as JSON text (exact comparison with the oracle)
    return s.withColumn("severity_breakdown", F.to_json("severity_breakdown")) \
        .withColumn("language_breakdown", F.to_json("language_breakdown")) \
        .withColumn("recent_patients", F.to_json(recent, {"ignoreNullFields": "false"}))


@query("severity_breakdown", """
SELECT severity, count(*) AS n FROM b_consultations GROUP BY severity""")
def q_severity_breakdown(spark, d):
    return kpi.severity_breakdown(Bindings(spark, d).consultations)


@query("language_breakdown", """
SELECT language, count(*) AS n FROM b_patients GROUP BY language""")
def q_language_breakdown(spark, d):
    return kpi.language_breakdown(Bindings(spark, d).patients)


@query("breakdown_map", """
SELECT '{' || string_agg('"' || coalesce(severity, 'null') || '":' || CAST(n AS VARCHAR), ','
                         ORDER BY coalesce(severity, 'null')) || '}' AS severity_breakdown
FROM (SELECT severity, count(*) AS n FROM b_consultations GROUP BY severity)""")
def q_breakdown_map(spark, d):
    m = kpi.breakdown_map(kpi.severity_breakdown(Bindings(spark, d).consultations), "severity")
    return m.select(F.to_json("severity_breakdown").alias("severity_breakdown"))  # the map as JSON text


def _values(rows, names: str) -> str:
    """A fixed vocabulary of schemas.py as an inline VALUES table for the oracle."""
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS {names}"


_LANG_DIM = _values(sorted(S.DASHBOARD_LANGUAGE_LABELS.items()), "dim(language, label)")


@query("language_labels", f"""
SELECT g.language, coalesce(dim.label, g.language, 'null') AS label, g.n
FROM (SELECT language, count(*) AS n FROM b_patients GROUP BY language) g
LEFT JOIN {_LANG_DIM} ON g.language = dim.language""")
def q_language_labels(spark, d):
    return kpi.language_labels(spark, kpi.language_breakdown(Bindings(spark, d).patients))


_SEV_DIM = _values([(sev, i + 1) for i, sev in enumerate(S.SEVERITY_ORDER)], "dim(severity, ord)")


@query("severity_zero_filled", f"""
SELECT dim.severity, dim.ord, coalesce(g.n, 0) AS n FROM {_SEV_DIM}
LEFT JOIN (SELECT severity, count(*) AS n FROM b_consultations GROUP BY severity) g
ON dim.severity = g.severity""")
def q_severity_zero_filled(spark, d):
    return kpi.severity_zero_filled(spark, kpi.severity_breakdown(Bindings(spark, d).consultations))


@query("share_of_max", f"""
SELECT g.language, coalesce(dim.label, g.language, 'null') AS label, g.n,
       round(CAST(g.n AS DOUBLE) * 100 / max(g.n) OVER (), 6) AS share_pct
FROM (SELECT language, count(*) AS n FROM b_patients GROUP BY language) g
LEFT JOIN {_LANG_DIM} ON g.language = dim.language
ORDER BY g.n DESC, g.language NULLS FIRST""")
def q_share_of_max(spark, d):
    return kpi.share_of_max(spark, kpi.language_breakdown(Bindings(spark, d).patients))


@query("severity_share", f"""
SELECT dim.severity, dim.ord, coalesce(g.n, 0) AS n,
       round(CAST(coalesce(g.n, 0) AS DOUBLE) * 100 /
             (SELECT max(n) FROM (SELECT count(*) AS n FROM b_consultations GROUP BY severity)), 6) AS share_pct
FROM {_SEV_DIM}
LEFT JOIN (SELECT severity, count(*) AS n FROM b_consultations GROUP BY severity) g
ON dim.severity = g.severity""")
def q_severity_share(spark, d):
    return kpi.severity_share(spark, kpi.severity_breakdown(Bindings(spark, d).consultations))


_HOSPITAL_COUNTS = """
SELECT h.hospital_id, h.name, 'approved' AS status,
       coalesce(s.n, 0) AS staff_count, coalesce(p.n, 0) AS patient_count
FROM b_hospitals h
LEFT JOIN (SELECT hospital_id, count(*) AS n FROM b_staff GROUP BY hospital_id) s ON h.hospital_id = s.hospital_id
LEFT JOIN (SELECT hospital_id, count(*) AS n FROM b_patients GROUP BY hospital_id) p ON h.hospital_id = p.hospital_id"""


@query("hospital_counts", _HOSPITAL_COUNTS)
def q_hospital_counts(spark, d):
    b = Bindings(spark, d)
    return kpi.hospital_counts(b.hospitals, b.staff, b.patients)


@query("staff_by_role", """
SELECT hospital_id, role, count(*) AS n FROM b_staff GROUP BY hospital_id, role""")
def q_staff_by_role(spark, d):
    return kpi.staff_by_role(Bindings(spark, d).staff)


@query("platform_summary", f"""
SELECT (SELECT count(*) FROM b_applications WHERE status = 'pending') AS pending_applications,
       (SELECT count(*) FROM ({_HOSPITAL_COUNTS}) WHERE status = 'approved') AS active_hospitals,
       (SELECT CAST(coalesce(sum(patient_count), 0) AS BIGINT) FROM ({_HOSPITAL_COUNTS})) AS total_patients""")
def q_platform_summary(spark, d):
    b = Bindings(spark, d)
    return kpi.platform_summary(b.applications, kpi.hospital_counts(b.hospitals, b.staff, b.patients))


@query("dept_completion", """
SELECT dept, completed, pending,
       CASE WHEN completed + pending > 0 THEN round(CAST(completed AS DOUBLE) * 100 / (completed + pending), 6)
            ELSE 0.0 END AS percent
FROM (SELECT 'lab' AS dept, count(*) FILTER (WHERE status = 'completed') AS completed,
             count(*) FILTER (WHERE status = 'pending') AS pending FROM b_lab_orders
      UNION ALL
      SELECT 'pharmacy', count(*) FILTER (WHERE status = 'dispensed'),
             count(*) FILTER (WHERE status = 'pending') FROM b_prescriptions)""")
def q_dept_completion(spark, d):
    b = Bindings(spark, d)
    return kpi.dept_completion(b.lab_orders, b.prescriptions)


def _folded(spark, d: str) -> DataFrame:
    """The tables folded in three batches, as if they had come on different days."""
    b, path = Bindings(spark, d), scratch_path(spark, "partials")
    part = F.coalesce(F.pmod(F.month("created_at"), F.lit(3)), F.lit(0))
    for i in range(3):
        new = [t.filter(part == i) for t in (b.patients, b.consultations, b.lab_orders, b.prescriptions)]
        partials.fold(partials.daily_partials(*new), path, i)
    return partials.read_partials(spark, path)


@query("kpi_from_partials", _KPI)
def q_kpi_from_partials(spark, d):
    return partials.kpi_from_partials(_folded(spark, d), AS_OF)


@query("dept_completion_daily", """
SELECT strftime(day, '%Y-%m-%d') AS day, dept, completed, pending,
       CASE WHEN completed + pending > 0 THEN round(CAST(completed AS DOUBLE) * 100 / (completed + pending), 6)
            ELSE 0.0 END AS percent
FROM (SELECT d.day, x.dept, coalesce(any_value(l.c) FILTER (WHERE l.dept = x.dept), 0) AS completed,
             coalesce(any_value(l.p) FILTER (WHERE l.dept = x.dept), 0) AS pending
      FROM (SELECT CAST(created_at AS DATE) AS day FROM b_patients UNION SELECT CAST(created_at AS DATE) FROM b_consultations
            UNION SELECT CAST(created_at AS DATE) FROM b_lab_orders UNION SELECT CAST(created_at AS DATE) FROM b_prescriptions) d
      CROSS JOIN (VALUES ('lab'), ('pharmacy')) x(dept)
      LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, 'lab' AS dept, count(*) FILTER (WHERE status = 'completed') AS c,
                        count(*) FILTER (WHERE status = 'pending') AS p FROM b_lab_orders GROUP BY 1
                 UNION ALL
                 SELECT CAST(created_at AS DATE), 'pharmacy', count(*) FILTER (WHERE status = 'dispensed'),
                        count(*) FILTER (WHERE status = 'pending') FROM b_prescriptions GROUP BY 1) l
        ON l.day IS NOT DISTINCT FROM d.day GROUP BY d.day, x.dept)""")
def q_dept_completion_daily(spark, d):
    return _day_text(partials.dept_completion_from_partials(_folded(spark, d), by_day=True), "day")


@query("today_patients", f"""
SELECT * FROM b_patients WHERE {_day('created_at')}""")
def q_today_patients(spark, d):
    return kpi.today_patients(Bindings(spark, d).patients, AS_OF)


@query("recent_patients", """
SELECT patient_id, name, token_number, room_number, language, created_at FROM b_patients
ORDER BY created_at DESC NULLS LAST, patient_id LIMIT 10""")
def q_recent_patients(spark, d):
    return kpi.recent_patients(Bindings(spark, d).patients)


@query("active_tokens", f"""
SELECT patient_id, name, token_number, room_number, checked_in FROM b_patients
WHERE {_day('created_at')} ORDER BY token_number, patient_id""")
def q_active_tokens(spark, d):
    return kpi.active_tokens(Bindings(spark, d).patients, AS_OF)


@query("token_board", f"""
SELECT *, CAST(row_number() OVER (ORDER BY token_number, patient_id) AS BIGINT) AS slot,
       row_number() OVER (ORDER BY token_number, patient_id) = 1 AS now_serving
FROM (SELECT patient_id, name, token_number, room_number, checked_in FROM b_patients
      WHERE {_day('created_at')} ORDER BY token_number, patient_id LIMIT 6)""")
def q_token_board(spark, d):
    return kpi.token_board(Bindings(spark, d).patients, AS_OF)


@query("workflow_complete", """
SELECT patient_id, count(DISTINCT dept) AS stages FROM b_dept_updates WHERE dept IS NOT NULL
GROUP BY patient_id HAVING count(DISTINCT dept) = 3""")
def q_workflow_complete(spark, d):
    return kpi.workflow_complete(Bindings(spark, d).dept_updates)


# ---------------------------------------------------------------- queues
_RX_QUEUE = """
SELECT p.hospital_id, p.patient_id, p.name, p.token_number, rx.rx_id, rx.created_at
FROM b_prescriptions rx JOIN b_patients p ON rx.patient_id = p.patient_id WHERE rx.status = 'pending'"""
_LAB_QUEUE = """
SELECT p.hospital_id, p.patient_id, p.name, p.token_number, lo.order_id, lo.created_at
FROM b_lab_orders lo JOIN b_patients p ON lo.patient_id = p.patient_id WHERE lo.status = 'pending'"""


@query("pharmacy_pending", _RX_QUEUE + " ORDER BY p.hospital_id, rx.created_at, rx.rx_id")
def q_pharmacy_pending(spark, d):
    b = Bindings(spark, d)
    return queues.pharmacy_pending(b.prescriptions, b.patients)


@query("lab_pending", _LAB_QUEUE + " ORDER BY p.hospital_id, lo.created_at, lo.order_id")
def q_lab_pending(spark, d):
    b = Bindings(spark, d)
    return queues.lab_pending(b.lab_orders, b.patients)


@query("tenant_scope", _RX_QUEUE + f" AND p.hospital_id = {QUEUE_HOSPITAL} ORDER BY rx.created_at, rx.rx_id")
def q_tenant_scope(spark, d):
    b = Bindings(spark, d)
    return queues.tenant_scope(queues.pharmacy_pending(b.prescriptions, b.patients), QUEUE_HOSPITAL)


@query("queue_position", f"""
SELECT hospital_id, dept, patient_id, item_id, created_at,
       row_number() OVER (PARTITION BY hospital_id, dept ORDER BY created_at, item_id) AS position
FROM (SELECT hospital_id, 'lab' AS dept, patient_id, order_id AS item_id, created_at FROM ({_LAB_QUEUE})
      UNION ALL
      SELECT hospital_id, 'pharmacy', patient_id, rx_id, created_at FROM ({_RX_QUEUE}))""")
def q_queue_position(spark, d):
    b = Bindings(spark, d)
    return queues.queue_position(queues.pending_queue(b.lab_orders, b.patients, "order_id"),
                                 queues.pending_queue(b.prescriptions, b.patients, "rx_id"))


@query("queue_length", f"""
SELECT hospital_id, 'lab' AS dept, count(*) AS n FROM ({_LAB_QUEUE}) GROUP BY hospital_id
UNION ALL
SELECT hospital_id, 'pharmacy', count(*) FROM ({_RX_QUEUE}) GROUP BY hospital_id""")
def q_queue_length(spark, d):
    b = Bindings(spark, d)
    return queues.queue_length(queues.pending_queue(b.lab_orders, b.patients, "order_id"),
                               queues.pending_queue(b.prescriptions, b.patients, "rx_id"))


# ---------------------------------------------------------------- records
@query("history_with_hospital", """
SELECT c.consultation_id, c.patient_id, coalesce(nullif(h.name, ''), 'Unknown Hospital') AS hospital_name,
       c.diagnosis, c.severity, c.followup, c.created_at
FROM b_consultations c LEFT JOIN b_hospitals h ON c.hospital_id = h.hospital_id""")
def q_history_with_hospital(spark, d):
    b = Bindings(spark, d)
    return records.history_with_hospital(b.consultations, b.hospitals)


def _latest(table: str, id_col: str, cols: str) -> str:
    return f"""
SELECT patient_id, created_at, {id_col}, {cols} FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id
                               ORDER BY created_at DESC NULLS LAST, {id_col} DESC) AS rn
  FROM {table}) WHERE rn = 1"""


@query("latest_consultation", _latest("b_consultations", "consultation_id",
                                      "severity, diagnosis, followup, hospital_id"))
def q_latest_consultation(spark, d):
    return records.latest_consultation(Bindings(spark, d).consultations)


@query("latest_lab", _latest("b_lab_orders", "order_id", "status"))
def q_latest_lab(spark, d):
    return records.latest_lab(Bindings(spark, d).lab_orders)


@query("latest_rx", _latest("b_prescriptions", "rx_id", "status"))
def q_latest_rx(spark, d):
    return records.latest_rx(Bindings(spark, d).prescriptions)


@query("latest_followup", f"""
SELECT patient_id, followup FROM ({_latest('b_consultations', 'consultation_id', 'followup')})""")
def q_latest_followup(spark, d):
    return records.latest_followup(Bindings(spark, d).consultations)


@query("record_defaults", f"""
SELECT p.patient_id, coalesce(l.status, 'not_ordered') AS lab_status,
       coalesce(l.tests, '[]') AS lab_tests, coalesce(l.results, '{{}}') AS lab_results,
       coalesce(r.status, 'not_prescribed') AS pharmacy_status, coalesce(r.medicines, '[]') AS medicines,
       CASE WHEN c.consultation_id IS NOT NULL THEN coalesce(nullif(h.name, ''), 'Unknown Hospital') END
         AS hospital_name,
       CASE WHEN c.consultation_id IS NULL THEN '' ELSE c.followup END AS followup
FROM b_patients p
LEFT JOIN ({_latest('b_consultations', 'consultation_id', 'followup, hospital_id')}) c ON p.patient_id = c.patient_id
LEFT JOIN b_hospitals h ON c.hospital_id = h.hospital_id
LEFT JOIN ({_latest('b_lab_orders', 'order_id', 'status, tests, results')}) l ON p.patient_id = l.patient_id
LEFT JOIN ({_latest('b_prescriptions', 'rx_id', 'status, medicines')}) r ON p.patient_id = r.patient_id""")
def q_record_defaults(spark, d):
    b = Bindings(spark, d)
    return records.record_defaults(b.patients, b.consultations, b.lab_orders, b.prescriptions, b.hospitals)


@query("past_visits", """
SELECT patient_id, count(*) - 1 AS past_visits FROM b_consultations GROUP BY patient_id HAVING count(*) > 1""")
def q_past_visits(spark, d):
    return records.past_visits(Bindings(spark, d).consultations)


_PATIENT_RECORD = f"""
SELECT p.patient_id, p.name,
       coalesce(c.n, 0) AS n_consultations, coalesce(l.n, 0) AS n_lab_orders,
       coalesce(r.n, 0) AS n_prescriptions, coalesce(u.n, 0) AS n_updates,
       lc.consultation_id AS latest_consultation_id,
       CASE WHEN lc.consultation_id IS NULL THEN NULL
            ELSE coalesce(nullif(h.name, ''), 'Unknown Hospital') END AS latest_hospital_name,
       CAST(to_json(lc.prescriptions) AS VARCHAR) AS latest_prescriptions,
       coalesce(ll.status, 'not_ordered') AS lab_status,
       coalesce(lr.status, 'not_prescribed') AS pharmacy_status,
       lu.update_id AS latest_update_id
FROM b_patients p
LEFT JOIN (SELECT patient_id, count(*) AS n FROM b_consultations GROUP BY patient_id) c ON p.patient_id = c.patient_id
LEFT JOIN (SELECT patient_id, count(*) AS n FROM b_lab_orders GROUP BY patient_id) l ON p.patient_id = l.patient_id
LEFT JOIN (SELECT patient_id, count(*) AS n FROM b_prescriptions GROUP BY patient_id) r ON p.patient_id = r.patient_id
LEFT JOIN (SELECT patient_id, count(*) AS n FROM b_dept_updates GROUP BY patient_id) u ON p.patient_id = u.patient_id
LEFT JOIN ({_latest('b_clinical', 'consultation_id', 'hospital_id, prescriptions')}) lc ON p.patient_id = lc.patient_id
LEFT JOIN b_hospitals h ON lc.hospital_id = h.hospital_id
LEFT JOIN ({_latest('b_lab_orders', 'order_id', 'status')}) ll ON p.patient_id = ll.patient_id
LEFT JOIN ({_latest('b_prescriptions', 'rx_id', 'status')}) lr ON p.patient_id = lr.patient_id
LEFT JOIN (SELECT patient_id, update_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id
           ORDER BY updated_at DESC NULLS LAST, update_id DESC) AS rn FROM b_dept_updates) WHERE rn = 1) lu
  ON p.patient_id = lu.patient_id"""


@query("patient_record", _PATIENT_RECORD)
def q_patient_record(spark, d):
    b = Bindings(spark, d)
    return records.patient_record_summary(b.patients, b.consultations, b.items, b.hospitals, b.lab_orders,
                                          b.prescriptions, b.dept_updates)


@query("patient_record_bucketed", _PATIENT_RECORD)
def q_patient_record_bucketed(spark, d):
    """The same over state tables bucketed by patient: only hospitals are moved."""
    b = Bindings(spark, d)
    t = co_bucketed({"patients": b.patients, "clinical": clinical(b), "lab_orders": b.lab_orders, "prescriptions": b.prescriptions,
                     "updates": b.dept_updates}, STATE_BUCKETS)
    return records.patient_record_summary(t["patients"], t["clinical"], None, b.hospitals, t["lab_orders"], t["prescriptions"], t["updates"])


def _ts_text(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


_NESTED_LIST = """(SELECT patient_id, CAST(to_json(list(struct_pack({fields}) ORDER BY {order})) AS VARCHAR) AS {name}
  FROM {src} GROUP BY patient_id) {alias} ON p.patient_id = {alias}.patient_id"""


def _one(table: str, alias: str, order: str, fields: str, name: str) -> str:
    return (f"(SELECT patient_id, CAST(to_json(first(struct_pack({fields}) ORDER BY {order})) AS VARCHAR) AS {name} "
            f"FROM {table} GROUP BY patient_id) {alias} ON p.patient_id = {alias}.patient_id")


_VISITS = ("(SELECT c.*, coalesce(nullif(h.name, ''), 'Unknown Hospital') AS hospital_name FROM b_clinical c "
           "LEFT JOIN b_hospitals h ON c.hospital_id = h.hospital_id)")
_VISIT_FIELDS = ("hospital_name := hospital_name, diagnosis := diagnosis, severity := severity, symptoms := symptoms, "
                 "prescriptions := prescriptions, lab_tests := lab_tests, followup := followup, "
                 "clinical_notes := clinical_notes")


@query("patient_record_nested", f"""
SELECT p.patient_id, p.name,
       coalesce(ll.lab_status, '{{"status":"not_ordered","tests":"[]","results":"{{}}"}}') AS lab_status,
       coalesce(lr.pharmacy_status, '{{"status":"not_prescribed","medicines":"[]"}}') AS pharmacy_status,
       lc.consultation, hh.history, lh.lab_history, rh.prescription_history, uh.dept_updates
FROM b_patients p
LEFT JOIN {_NESTED_LIST.format(
    name="history", alias="hh", order="created_at DESC, consultation_id DESC", src=_VISITS,
    fields=f"created_at := {_ts_text('created_at')}, consultation_id := consultation_id, {_VISIT_FIELDS}")}
LEFT JOIN {_NESTED_LIST.format(
    name="lab_history", alias="lh", order="created_at DESC, order_id DESC", src="b_lab_orders",
    fields=f"created_at := {_ts_text('created_at')}, order_id := order_id, status := status, tests := tests, "
           "results := results")}
LEFT JOIN {_NESTED_LIST.format(
    name="prescription_history", alias="rh", order="created_at DESC, rx_id DESC", src="b_prescriptions",
    fields=f"created_at := {_ts_text('created_at')}, rx_id := rx_id, status := status, medicines := medicines")}
LEFT JOIN {_NESTED_LIST.format(
    name="dept_updates", alias="uh", order="updated_at DESC, update_id DESC", src="b_dept_updates",
    fields=f"updated_at := {_ts_text('updated_at')}, update_id := update_id, dept := dept, action := action, "
           "data := data")}
LEFT JOIN {_one("b_lab_orders", "ll", "created_at DESC, order_id DESC",
                "status := status, tests := tests, results := results", "lab_status")}
LEFT JOIN {_one("b_prescriptions", "lr", "created_at DESC, rx_id DESC",
                "status := status, medicines := medicines", "pharmacy_status")}
LEFT JOIN {_one(_VISITS, "lc", "created_at DESC, consultation_id DESC",
                f"created_at := {_ts_text('created_at')}, consultation_id := consultation_id, {_VISIT_FIELDS}, "
                "route_to := list_filter([CASE WHEN len(lab_tests) > 0 THEN 'lab' END, "
                "CASE WHEN len(prescriptions) > 0 THEN 'pharmacy' END], lambda x: x IS NOT NULL)", "consultation")}
WHERE p.patient_id IN (SELECT patient_id FROM b_checkins)""")
def q_patient_record_nested(spark, d):
    """The nested form, for the patients a batch of requests names."""
    b = Bindings(spark, d)
    rec = records.patient_record(b.patients, clinical(b), b.hospitals, b.lab_orders, b.prescriptions, b.dept_updates,
                                 requests=b.checkins)
    keep = {"ignoreNullFields": "false"}

    def as_json(col: str, ts: str):
        # each list as JSON text: times as 'yyyy-MM-dd HH:mm:ss', NULL fields kept
        texts = F.transform(col, lambda x: x.withField(ts, F.date_format(x[ts], "yyyy-MM-dd HH:mm:ss")))
        return F.to_json(texts, keep).alias(col)

    last = F.col("consultation").withField("created_at", F.date_format("consultation.created_at", "yyyy-MM-dd HH:mm:ss"))
    return rec.select("patient_id", "name", F.to_json("lab_status", keep).alias("lab_status"),
                      F.to_json("pharmacy_status", keep).alias("pharmacy_status"), F.to_json(last, keep).alias("consultation"),
                      as_json("history", "created_at"), as_json("lab_history", "created_at"),
                      as_json("prescription_history", "created_at"), as_json("dept_updates", "updated_at"))


def _entries(src: str, kind: str, at: str, key: str, fields: str) -> str:
    return (f"SELECT patient_id, '{kind}' AS kind, {at} AS at, {key} AS item_id, "
            f"CAST(to_json(struct_pack({fields})) AS VARCHAR) AS detail FROM {src}")


@query("patient_timeline", "\nUNION ALL\n".join([
    _entries(_VISITS, "history", "created_at", "consultation_id", _VISIT_FIELDS),
    _entries("b_lab_orders", "lab", "created_at", "order_id", "status := status, tests := tests, results := results"),
    _entries("b_prescriptions", "prescription", "created_at", "rx_id", "status := status, medicines := medicines"),
    _entries("b_dept_updates", "update", "updated_at", "update_id", "dept := dept, action := action, data := data")]))
def q_patient_timeline(spark, d):
    b = Bindings(spark, d)
    return records.patient_timeline(clinical(b), b.hospitals, b.lab_orders, b.prescriptions, b.dept_updates)


@query("record_sheet", f"""
SELECT lc.patient_id, p.name, lc.consultation_id, lc.diagnosis,
       CASE WHEN len(lc.symptoms) > 0 THEN array_to_string(lc.symptoms, ', ') ELSE 'None reported' END AS symptoms_text,
       CASE WHEN len(lc.prescriptions) > 0 THEN array_to_string(lc.prescriptions, ', ') ELSE 'None' END
         AS prescriptions_text,
       CASE WHEN len(lc.lab_tests) > 0 THEN array_to_string(lc.lab_tests, ', ') ELSE 'None' END AS lab_tests_text,
       upper(lc.severity) AS severity_label,
       CASE lower(lc.severity) WHEN 'emergency' THEN 'red' WHEN 'high' THEN 'orange' ELSE 'green' END AS band,
       lc.followup, lc.clinical_notes
FROM ({_latest('b_clinical', 'consultation_id',
               'diagnosis, severity, followup, symptoms, prescriptions, lab_tests, clinical_notes')}) lc
JOIN b_patients p ON lc.patient_id = p.patient_id""")
def q_record_sheet(spark, d):
    b = Bindings(spark, d)
    # lists only for each patient's latest consultation (the sheet shows no other)
    latest = records.latest_by(b.consultations, "patient_id", ["created_at", "consultation_id"],
                               ["severity", "diagnosis", "followup", "hospital_id", "clinical_notes"])
    return records.record_sheet(b.patients, records.clinical_records(latest, b.items, only_these=True))


@query("medicine_lines", """
SELECT c.consultation_id, c.patient_id,
       row_number() OVER (PARTITION BY i.consultation_id ORDER BY i.line, i.part_id) AS line_no, i.medicine
FROM b_items i JOIN b_consultations c ON i.consultation_id = c.consultation_id""")
def q_medicine_lines(spark, d):
    b = Bindings(spark, d)
    return records.medicine_lines(b.consultations, b.items)


# ---------------------------------------------------------------- predicates & lookups (P*, J7, J8, J11)


@query("applications_by_status", "SELECT * FROM b_applications WHERE status = 'pending'")
def q_applications_by_status(spark, d):
    return P.applications_by_status(Bindings(spark, d).applications)


_PAYLOAD_FIELDS = ["name", "license_number", "phone", "email", "pincode", "address", "city", "state",
                   "admin_name", "admin_email"]


@query("applications_flat", "SELECT " + ", ".join(
    f"json_extract_string(data, '$.{f}') AS {f}" for f in _PAYLOAD_FIELDS)
    + ", app_id AS hospital_id, status FROM b_applications WHERE status = 'pending'")
def q_applications_flat(spark, d):
    return P.applications_flat(Bindings(spark, d).applications)


@query("publish_staff", "SELECT staff_id, hospital_id, name, username, role FROM b_staff_accounts")
def q_publish_staff(spark, d):
    return P.publish(Bindings(spark, d).staff_accounts)


_SCAN_DECODE = """
SELECT event_id, coalesce(CASE json_type(j, '$.patient_id') WHEN 'VARCHAR' THEN nullif(json_extract_string(j, '$.patient_id'), '')
         WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN nullif(json_extract_string(j, '$.patient_id'), 'false')
         WHEN 'OBJECT' THEN CAST(json_extract(j, '$.patient_id') AS VARCHAR)
         WHEN 'ARRAY' THEN CAST(json_extract(j, '$.patient_id') AS VARCHAR)
         ELSE CASE WHEN TRY_CAST(json_extract_string(j, '$.patient_id') AS DOUBLE) <> 0
                   THEN json_extract_string(j, '$.patient_id') END END, payload) AS patient_id
FROM (SELECT event_id, payload, CASE WHEN json_valid(payload) THEN payload ELSE '{}' END AS j FROM b_scans)"""


@query("ci_lookup", f"""
SELECT s.event_id, s.patient_id AS requested, p.patient_id, p.name
FROM ({_SCAN_DECODE}) s JOIN b_patients p
  ON upper(trim(s.patient_id)) = upper(trim('vk-' || CAST(p.patient_id AS VARCHAR)))""")
def q_ci_lookup(spark, d):
    b = Bindings(spark, d)
    req = X.scan_decode(b.scans).withColumnRenamed("patient_id", "requested")
    codes = b.patients.select("patient_id", "name", F.concat(F.lit("vk-"), F.col("patient_id")).alias("code"))
    return P.ci_lookup(req, "requested", codes, "code").select("event_id", "requested", "patient_id", "name")


@query("alert_candidates", "SELECT * FROM b_consultations WHERE severity IN ('emergency', 'high')")
def q_alert_candidates(spark, d):
    return P.alert_candidates(Bindings(spark, d).consultations)


@query("lookup_ids", "SELECT * FROM b_patients WHERE patient_id IN (SELECT patient_id FROM b_checkins)")
def q_lookup_ids(spark, d):
    b = Bindings(spark, d)
    return P.lookup_ids(b.patients, b.checkins)


@query("unknown_ids", """
SELECT * FROM b_checkins c WHERE NOT EXISTS (SELECT 1 FROM b_patients p WHERE p.patient_id = c.patient_id)""")
def q_unknown_ids(spark, d):
    b = Bindings(spark, d)
    return P.unknown_ids(b.checkins, b.patients)


@query("missing_results", """
SELECT order_id, CAST(len(m) AS BIGINT) AS n_missing, CAST(to_json(m) AS VARCHAR) AS missing_tests FROM (
  SELECT order_id, list_filter(from_json(tests, '["VARCHAR"]'),
         lambda t: coalesce(trim(json_extract_string(results, '$."' || t || '"')), '') = '') AS m
  FROM b_results) WHERE len(m) > 0""")
def q_missing_results(spark, d):
    return P.missing_results(Bindings(spark, d).results)


@query("registration_rejects", """
SELECT event_id, patient_id, CASE
  WHEN name IS NULL OR regexp_matches(name, '^\\s*$') THEN 'name_required'
  WHEN coalesce(age_text, '') = '' THEN 'age_required'
  WHEN NOT regexp_matches(age_text, '^\\s*[+-]?[0-9]') THEN 'age_not_integer' END AS reason
FROM b_register_requests
WHERE name IS NULL OR regexp_matches(name, '^\\s*$') OR coalesce(age_text, '') = ''
   OR NOT regexp_matches(age_text, '^\\s*[+-]?[0-9]')""")
def q_registration_rejects(spark, d):
    return P.registration_rejects(Bindings(spark, d).register_requests)


@query("patients_with_orders", "SELECT * FROM b_patients WHERE patient_id IN (SELECT patient_id FROM b_lab_orders)")
def q_patients_with_orders(spark, d):
    b = Bindings(spark, d)
    return P.patients_with_orders(b.patients, b.lab_orders)


_ALERT_FEED = """
SELECT c.consultation_id, c.patient_id, p.name, p.room_number, c.severity, c.diagnosis, c.created_at
FROM b_consultations c JOIN b_patients p ON c.patient_id = p.patient_id
WHERE c.severity IN ('emergency', 'high')"""


@query("alert_feed", _ALERT_FEED)
def q_alert_feed(spark, d):
    b = Bindings(spark, d)
    return P.alert_feed(b.consultations, b.patients)


def _sha_id(prefix: str, expr: str) -> str:
    return f"'{prefix}' || upper(sha256(CAST({expr} AS VARCHAR)))"


_PRINCIPALS = f"""
SELECT k.key, k.owner_id, k.role,
       CASE WHEN k.role = 'hospital_admin' THEN k.owner_id WHEN k.role = 'system_admin' THEN NULL
            ELSE CAST(s.hospital_id AS VARCHAR) END AS hospital_id
FROM (SELECT {_sha_id('sk_staff_', 'staff_id')} AS key, CAST(staff_id AS VARCHAR) AS owner_id, role FROM b_staff
      UNION ALL
      SELECT {_sha_id('sk_hosp_', 'hospital_id')}, CAST(hospital_id AS VARCHAR), 'hospital_admin' FROM b_hospitals
      UNION ALL
      SELECT {_sha_id('sk_sys_', 'admin_id')}, CAST(admin_id AS VARCHAR), 'system_admin' FROM b_admins) k
LEFT JOIN b_staff s ON k.owner_id = CAST(s.staff_id AS VARCHAR)"""


def _principals(b: Bindings) -> DataFrame:
    return P.principal_hospital(P.api_keys_from(b.staff, b.hospitals, b.admins), b.staff)


@query("principal_hospital", _PRINCIPALS)
def q_principal_hospital(spark, d):
    return _principals(Bindings(spark, d))


def _tenant_rows(spark, d: str, role: str, owner: str) -> DataFrame:
    path, b = scratch_path(spark, "tenants"), Bindings(spark, d)
    write_tenants(b.patients, path)
    caller = _principals(b).filter((F.col("role") == role) & (F.col("owner_id") == owner))
    return tenant_rows(spark, path, caller).select("key", "patient_id", "name", "hospital_id")


@query("tenant_rows", f"""
SELECT k.key, p.patient_id, p.name, p.hospital_id FROM ({_PRINCIPALS}) k JOIN b_patients p
  ON k.hospital_id = CAST(p.hospital_id AS VARCHAR) WHERE k.role = 'hospital_admin' AND k.owner_id = '{QUEUE_HOSPITAL}'""")
def q_tenant_rows(spark, d):
    """T1 for a hospital admin: only that hospital's partition is read."""
    return _tenant_rows(spark, d, "hospital_admin", str(QUEUE_HOSPITAL))


@query("tenant_rows_admin", f"""
SELECT k.key, p.patient_id, p.name, p.hospital_id FROM ({_PRINCIPALS}) k, b_patients p
WHERE k.role = 'system_admin' AND k.owner_id = '0'""")
def q_tenant_rows_admin(spark, d):
    """T1 for a system admin, who sees every hospital."""
    return _tenant_rows(spark, d, "system_admin", "0")


# ---------------------------------------------------------------- state folds (U*, J4, J5, W7, T5)
_ACCEPTED = f"""
SELECT r.* FROM (SELECT event_id, ts, coalesce(CAST(patient_id AS VARCHAR), {_sha_id('VK-', 'event_id')}) AS patient_id,
                        name, age, gender, language, hospital_id, aadhaar_last4, patient_id IS NULL AS is_new
                 FROM b_registrations) r
WHERE is_new OR patient_id IN (SELECT CAST(patient_id AS VARCHAR) FROM b_patients)"""
# the count at each registration is taken row by row, as the statements do
_TOKENS = f"""
SELECT r.event_id, r.ts, x.patient_id, r.name, r.age, r.gender, r.language, r.hospital_id, r.aadhaar_last4, r.is_new,
       n.c + 1 AS token_number, n.c % 3 + 1 AS room_number
FROM ({_ACCEPTED}) r JOIN (
  SELECT a.event_id, (SELECT count(*) FROM b_patients) + count(e.event_id) AS c FROM ({_ACCEPTED}) a
  LEFT JOIN b_registrations e ON e.patient_id IS NULL AND (e.ts < a.ts OR (e.ts = a.ts AND e.event_id < a.event_id))
  GROUP BY a.event_id) n ON r.event_id = n.event_id
JOIN ({_ACCEPTED}) x ON x.event_id = r.event_id"""


@query("token_numbers", f"SELECT event_id, ts, CASE WHEN is_new THEN NULL ELSE patient_id END AS patient_id, "
       f"name, age, gender, language, hospital_id, aadhaar_last4, is_new, token_number, room_number FROM ({_TOKENS})")
def q_token_numbers(spark, d):
    b = Bindings(spark, d)
    out = U.token_numbers(b.registrations, b.patients)
    # the id a new patient was given is a hash; shown as NULL, like the request
    return out.withColumn("patient_id", F.when(F.col("is_new"), F.lit(None)).otherwise(F.col("patient_id")))


_UPSERT = f"""
SELECT patient_id, name, age, gender, language, hospital_id, aadhaar_last4, token_number, room_number, ts AS created_at,
       event_id, 0 AS checked_in, visits
FROM (SELECT *, count(*) OVER (PARTITION BY patient_id) AS visits,
             row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, event_id DESC) AS rn FROM ({_TOKENS}))
WHERE rn = 1
UNION ALL
SELECT CAST(patient_id AS VARCHAR), name, NULL, NULL, language, hospital_id, NULL, token_number, room_number, created_at,
       NULL, checked_in, 0
FROM b_patients WHERE CAST(patient_id AS VARCHAR) NOT IN (SELECT patient_id FROM ({_ACCEPTED}))"""


@query("patients_upsert", _UPSERT)
def q_patients_upsert(spark, d):
    b = Bindings(spark, d)
    return U.patients_upsert(U.token_numbers(b.registrations, b.patients), b.patients)


@query("checkin_state", f"""
SELECT u.patient_id, u.created_at, (SELECT max(ts) FROM b_checkins k WHERE CAST(k.patient_id AS VARCHAR) = u.patient_id) AS last_checkin,
       CASE WHEN u.event_id IS NULL THEN
              CASE WHEN u.patient_id IN (SELECT CAST(patient_id AS VARCHAR) FROM b_checkins) THEN 1 ELSE u.checked_in END
            WHEN EXISTS (SELECT 1 FROM b_checkins k WHERE CAST(k.patient_id AS VARCHAR) = u.patient_id
                         AND (k.ts > u.created_at OR (k.ts = u.created_at AND k.event_id > u.event_id))) THEN 1
            ELSE 0 END AS checked_in
FROM ({_UPSERT}) u""")
def q_checkin_state(spark, d):
    b = Bindings(spark, d)
    state = U.patients_upsert(U.token_numbers(b.registrations, b.patients), b.patients)
    return U.checkin_state(state, b.checkins)


def _fold_sql(orders: str, key: str, dept: str, action: str, done: str, with_results: bool) -> str:
    res = ("CASE WHEN u.last_update >= o.created_at THEN u.last_data ELSE '{}' END AS results,"
           if with_results else "")
    return f"""
SELECT o.{key}, o.patient_id, o.created_at,
       CASE WHEN u.last_update >= o.created_at THEN '{done}' ELSE 'pending' END AS status, {res}
       CASE WHEN u.last_update >= o.created_at THEN u.last_update ELSE o.created_at END AS updated_at
FROM {orders} o LEFT JOIN (
  SELECT patient_id, arg_max(data, (updated_at, update_id)) AS last_data, max(updated_at) AS last_update
  FROM b_dept_updates WHERE dept = '{dept}' AND action = '{action}' GROUP BY patient_id) u
ON o.patient_id = u.patient_id"""


@query("lab_state", _fold_sql("b_lab_order_events", "order_id", "lab", "submitted_results", "completed", True))
def q_lab_state(spark, d):
    b = Bindings(spark, d)
    return U.lab_state(b.lab_order_events, b.dept_updates)


@query("rx_state", _fold_sql("b_rx_events", "rx_id", "pharmacy", "dispensed", "dispensed", False))
def q_rx_state(spark, d):
    b = Bindings(spark, d)
    return U.rx_state(b.rx_events, b.dept_updates)


@query("dedup_updates", """
SELECT update_id, patient_id, dept, action, data, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY update_id ORDER BY updated_at) AS rn
  FROM (SELECT * FROM b_dept_updates UNION ALL SELECT * FROM b_dept_updates)) WHERE rn = 1""")
def q_dedup_updates(spark, d):
    b = Bindings(spark, d)
    replayed = b.dept_updates.unionByName(b.dept_updates)  # every event delivered twice (a retry)
    return U.dedup_updates(replayed)


@query("append_updates", "SELECT * FROM b_dept_updates")
def q_append_updates(spark, d):
    u = Bindings(spark, d).dept_updates
    held = u.filter(F.col("update_id") % 2 == 0)  # the log so far; then everything arrives, twice
    return U.append_updates(held, u.unionByName(u))


def _py_list(expr: str) -> str:
    return f"'[' || array_to_string(list_transform({expr}, lambda x: CAST(to_json(x) AS VARCHAR)), ', ') || ']'"


@query("fanout_orders", f"""
SELECT {_sha_id('LAB-', 'consultation_id')} AS order_id, consultation_id, patient_id,
       {_py_list('lab_tests')} AS tests, 'pending' AS status, '{{}}' AS results, created_at, created_at AS updated_at
FROM b_clinical WHERE len(lab_tests) > 0""")
def q_fanout_orders(spark, d):
    return U.fanout_orders(clinical(Bindings(spark, d)))


@query("fanout_rx", f"""
SELECT {_sha_id('RX-', 'consultation_id')} AS rx_id, consultation_id, patient_id,
       {_py_list('prescriptions')} AS medicines, 'pending' AS status, created_at, created_at AS updated_at
FROM b_clinical WHERE len(prescriptions) > 0""")
def q_fanout_rx(spark, d):
    return U.fanout_rx(clinical(Bindings(spark, d)))


@query("alert_log", f"""
SELECT {_sha_id('ALERT-', 'f.consultation_id')} AS alert_id, f.consultation_id, f.patient_id, f.severity,
       f.diagnosis, CASE WHEN s.sent THEN 1 ELSE 0 END AS sms_sent, f.created_at
FROM ({_ALERT_FEED}) f LEFT JOIN (SELECT consultation_id, bool_or(status = 'sent') AS sent FROM b_deliveries
GROUP BY consultation_id) s ON f.consultation_id = s.consultation_id""")
def q_alert_log(spark, d):
    b = Bindings(spark, d)
    return U.alert_log(P.alert_feed(b.consultations, b.patients), b.deliveries)


def _first_visits(b: Bindings) -> DataFrame:
    """Each patient's first consultation with its lists (the only event the
    workflow can act on); lists are built for those consultations only."""
    first = b.consultations.groupBy("patient_id").agg(
        F.min_by(F.struct(*b.consultations.columns), F.struct("created_at", "consultation_id")).alias("__f")
    ).select("__f.*")
    return records.clinical_records(first, b.items, only_these=True)


def _backfill_sql(prefix: str, id_col: str, list_col: str, out_col: str, extra: str, prior: str) -> str:
    return f"""
SELECT {_sha_id(prefix, 'consultation_id')} AS {id_col}, patient_id, consultation_id,
       {_py_list(list_col)} AS {out_col}, 'pending' AS status, {extra} created_at, created_at AS updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY created_at, consultation_id) AS rn FROM b_clinical)
WHERE rn = 1 AND patient_id NOT IN (SELECT patient_id FROM {prior} WHERE patient_id IS NOT NULL)"""


@query("orders_backfill", _backfill_sql("WFLAB-", "order_id", "lab_tests", "tests", "'{}' AS results,", "b_prior_orders"))
def q_orders_backfill(spark, d):
    b = Bindings(spark, d)
    return U.orders_backfill(_first_visits(b), b.prior_orders)


@query("rx_backfill", _backfill_sql("WFRX-", "rx_id", "prescriptions", "medicines", "", "b_prior_rx"))
def q_rx_backfill(spark, d):
    b = Bindings(spark, d)
    return U.rx_backfill(_first_visits(b), b.prior_rx)


@query("status_normalised", """
SELECT app_id, data, CASE WHEN status = 'approve' THEN 'approved' ELSE status END AS status FROM b_applications""")
def q_status_normalised(spark, d):
    return U.status_normalised(Bindings(spark, d).applications)


_HOSPITAL_FIELDS = ", ".join(f"json_extract_string(data, '$.{f}') AS {f}" for f in U.HOSPITAL_FIELDS)


@query("hospital_backfill", f"""
SELECT {_sha_id('HOSP-', 'app_id')} AS hospital_id, app_id, {_HOSPITAL_FIELDS} FROM (
  SELECT app_id, data, json_extract_string(data, '$.email') AS mail,
         row_number() OVER (PARTITION BY json_extract_string(data, '$.email') ORDER BY app_id) AS rn
  FROM b_applications WHERE status IN ('approve', 'approved'))
WHERE mail IS NULL OR (rn = 1 AND mail NOT IN (SELECT email FROM b_hospitals))""")
def q_hospital_backfill(spark, d):
    b = Bindings(spark, d)
    return U.hospital_backfill(b.applications, b.hospitals)


# an approval fails if the email is taken, by a hospital or an earlier approval
_JUDGED = """
SELECT d.*, a.data, d.status = 'approved' AND (json_extract_string(a.data, '$.email') IS NULL OR (
         json_extract_string(a.data, '$.email') NOT IN (SELECT email FROM b_hospitals)
         AND row_number() OVER (PARTITION BY d.status, json_extract_string(a.data, '$.email')
                                ORDER BY d.decided_at, d.decision_id) = 1)) AS creates
FROM b_decisions d JOIN b_applications a ON d.app_id = a.app_id"""


@query("apply_decisions", f"""
SELECT a.app_id, coalesce(t.status, a.status) AS status, t.comments, h.hospital_id, coalesce(t.n, 0) AS n_applied
FROM b_applications a
LEFT JOIN (SELECT app_id, arg_max(status, (decided_at, decision_id)) AS status,
                  arg_max(comments, (decided_at, decision_id)) AS comments, count(*) AS n
           FROM ({_JUDGED}) WHERE creates OR status <> 'approved' GROUP BY app_id) t ON a.app_id = t.app_id
LEFT JOIN (SELECT app_id, {_sha_id('HOSP-', 'arg_min(decision_id, (decided_at, decision_id))')} AS hospital_id
           FROM ({_JUDGED}) WHERE creates GROUP BY app_id) h ON a.app_id = h.app_id""")
def q_apply_decisions(spark, d):
    b = Bindings(spark, d)
    return U.apply_decisions(b.applications, b.decisions, b.hospitals)


@query("decided_hospitals", f"""
SELECT {_sha_id('HOSP-', 'decision_id')} AS hospital_id, app_id, {_HOSPITAL_FIELDS}, decided_at AS created_at
FROM ({_JUDGED}) WHERE creates""")
def q_decided_hospitals(spark, d):
    b = Bindings(spark, d)
    return U.decided_hospitals(b.applications, b.decisions, b.hospitals)


@query("applications_append", f"""
SELECT {_sha_id('APP-', 'app_id')} AS app_id,
       '{{' || {" || ',' || ".join(
           f"'\"{f}\":' || coalesce(CAST(to_json(json_extract_string(data, '$.{f}')) AS VARCHAR), 'null')"
           for f in _PAYLOAD_FIELDS + ['password'])} || '}}' AS data,
       'pending' AS status, '' AS comments, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(app_id AS BIGINT)) AS created_at
FROM b_applications""")
def q_applications_append(spark, d):
    b = Bindings(spark, d)
    # Every stored application re-submitted as a request (its payload parsed back), one a second.
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("app_id"))
    req = b.applications.select(F.col("app_id").alias("request_id"), at.alias("requested_at"),
                                F.from_json("data", P.APPLICATION_PAYLOAD).alias("__p")).select("request_id", "requested_at", "__p.*")
    return U.applications_append(req)


@query("staff_after_removal", """
SELECT * FROM b_staff s WHERE NOT EXISTS (
  SELECT 1 FROM b_tombstones t WHERE t.staff_id = s.staff_id AND t.hospital_id = s.hospital_id)""")
def q_staff_after_removal(spark, d):
    b = Bindings(spark, d)
    return U.staff_after_removal(b.staff, b.tombstones)


@query("staff_append", f"""
SELECT {_sha_id('STAFF-', 'username')} AS staff_id, hospital_id, name, username, role FROM (
  SELECT *, row_number() OVER (PARTITION BY username ORDER BY request_id) AS rn FROM (
    SELECT staff_id AS request_id, hospital_id, name, role, 'u' || CAST(staff_id % 37 AS VARCHAR) AS username
    FROM b_staff)) WHERE rn = 1 AND username NOT IN (SELECT username FROM b_staff_accounts)""")
def q_staff_append(spark, d):
    b = Bindings(spark, d)
    req = b.staff.select(F.col("staff_id").alias("request_id"), "hospital_id", "name", "role",
                         F.concat(F.lit("u"), (F.col("staff_id") % 37).cast("string")).alias("username"))
    return U.staff_append(req, b.staff_accounts)


# ---------------------------------------------------------------- extraction jobs (E*)
@query("json_decode", """
SELECT row_id,
       CASE WHEN symptoms IS NULL THEN 'null'
            WHEN NOT json_valid(symptoms) OR json_type(symptoms) <> 'ARRAY' THEN 'malformed' ELSE 'ok' END AS status,
       CAST(len(l) AS BIGINT) AS n_items, CAST(to_json(l) AS VARCHAR) AS items
FROM (SELECT row_id, symptoms,
             CASE WHEN json_valid(symptoms) AND json_type(symptoms) = 'ARRAY'
                  THEN from_json(symptoms, '["VARCHAR"]') END AS l FROM b_json_lists)""")
def q_json_decode(spark, d):
    return X.json_decode(Bindings(spark, d).json_lists, "symptoms", "row_id")


@query("json_decode_map", """
SELECT order_id, CASE WHEN results IS NULL THEN 'null' ELSE 'ok' END AS status,
       CAST(len(json_keys(results)) AS BIGINT) AS n_items, CAST(json(results) AS VARCHAR) AS items FROM b_results""")
def q_json_decode_map(spark, d):
    return X.json_decode(Bindings(spark, d).results, "results", "order_id", kind="OBJECT")


_RECORD_FIELDS = [("patient_id", "s"), ("symptoms", "l"), ("diagnosis", "s"), ("prescriptions", "l"),
                  ("lab_tests", "l"), ("severity", "s"), ("followup", "s"), ("clinical_notes", "s")]


def _str_list_ok(f: str) -> str:
    return (f"(json_type(c, '$.{f}') = 'ARRAY' AND "
            f"len(list_filter(json_type(c, '$.{f}[*]'), lambda t: t <> 'VARCHAR')) = 0)")


def _record_reason() -> str:
    parts = ["WHEN coalesce(c, '') = '' THEN 'empty'", "WHEN NOT json_valid(c) THEN 'malformed'",
             "WHEN json_type(c) <> 'OBJECT' THEN 'not_object'"]
    for f, k in _RECORD_FIELDS:
        ok = f"json_type(c, '$.{f}') = 'VARCHAR'" if k == "s" else _str_list_ok(f)
        parts += [f"WHEN json_type(c, '$.{f}') IS NULL THEN 'missing:{f}'",
                  f"WHEN json_type(c, '$.{f}') = 'NULL' THEN 'null:{f}'",
                  f"WHEN NOT ({ok}) THEN 'type:{f}'"]
    parts.append(f"WHEN route_given AND NOT {_str_list_ok('route_to')} THEN 'type:route_to'")
    return "CASE " + " ".join(parts) + " END"


_RECORDS = f"""
SELECT request_id, c, {_record_reason()} AS reason, route_given FROM (
  SELECT request_id, c, CASE WHEN json_valid(c) AND json_type(c) = 'OBJECT' THEN
           CASE json_type(c, '$.route_to') WHEN 'ARRAY' THEN json_array_length(c, '$.route_to') > 0
                WHEN 'VARCHAR' THEN json_extract_string(c, '$.route_to') <> ''
                WHEN 'BOOLEAN' THEN json_extract_string(c, '$.route_to') = 'true'
                WHEN 'OBJECT' THEN json_extract(c, '$.route_to')::VARCHAR <> '{{}}'
                WHEN 'NULL' THEN false
                ELSE coalesce(TRY_CAST(json_extract_string(c, '$.route_to') AS DOUBLE) <> 0, false) END
         ELSE false END AS route_given
  FROM (SELECT request_id, regexp_replace(replace(replace(raw, '```json', ''), '```', ''), '^\\s+|\\s+$', '', 'g')
               AS c FROM b_records))"""


@query("record_extract", f"""
SELECT request_id, json_extract_string(c, '$.patient_id') AS patient_id,
       CAST(json_extract(c, '$.symptoms') AS VARCHAR) AS symptoms,
       json_extract_string(c, '$.diagnosis') AS diagnosis,
       CAST(json_extract(c, '$.prescriptions') AS VARCHAR) AS prescriptions,
       CAST(json_extract(c, '$.lab_tests') AS VARCHAR) AS lab_tests,
       json_extract_string(c, '$.severity') AS severity,
       CASE WHEN route_given THEN CAST(json_extract(c, '$.route_to') AS VARCHAR)
            ELSE CAST(to_json(list_filter([
              CASE WHEN json_array_length(c, '$.lab_tests') > 0 THEN 'lab' END,
              CASE WHEN json_array_length(c, '$.prescriptions') > 0 THEN 'pharmacy' END],
              lambda x: x IS NOT NULL)) AS VARCHAR) END AS route_to,
       json_extract_string(c, '$.followup') AS followup,
       json_extract_string(c, '$.clinical_notes') AS clinical_notes
FROM ({_RECORDS}) WHERE reason IS NULL""")
def q_record_extract(spark, d):
    return X.record_extract(dealt(Bindings(spark, d).records))


@query("record_quarantine", f"SELECT request_id, reason FROM ({_RECORDS}) WHERE reason IS NOT NULL")
def q_record_quarantine(spark, d):
    return X.record_quarantine(dealt(Bindings(spark, d).records))


@query("route_derive", """
SELECT consultation_id, CAST(to_json(list_filter([CASE WHEN len(lab_tests) > 0 THEN 'lab' END,
       CASE WHEN len(prescriptions) > 0 THEN 'pharmacy' END], lambda x: x IS NOT NULL)) AS VARCHAR) AS route_to
FROM b_clinical""")
def q_route_derive(spark, d):
    b = Bindings(spark, d)
    return X.route_derive(b.consultations, b.items)


@query("first_answer", """
SELECT i.request_id, b.priority, b.answer, CASE WHEN b.answer IS NULL THEN 'no_provider' ELSE 'ok' END AS status
FROM (SELECT DISTINCT request_id FROM b_answers) i LEFT JOIN (
  SELECT request_id, priority, answer FROM (
    SELECT request_id, priority, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS answer,
           row_number() OVER (PARTITION BY request_id ORDER BY priority) AS rn
    FROM b_answers WHERE regexp_replace(raw, '^\\s+|\\s+$', '', 'g') <> '') WHERE rn = 1) b
ON i.request_id = b.request_id""")
def q_first_answer(spark, d):
    return X.first_answer(Bindings(spark, d).answers)


@query("triage_rules", r"""
SELECT doc_id, CASE rank WHEN 1 THEN 'emergency' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END AS severity, rank
FROM (SELECT doc_id, CASE
    WHEN regexp_matches(t, '(^|[^a-z])chest pain([^a-z]|$)') AND regexp_matches(t, '(^|[^a-z])(arm|jaw) pain([^a-z]|$)') THEN 1
    WHEN regexp_matches(t, '(^|[^a-z])(breathing difficulty|stroke|unconscious)([^a-z]|$)') THEN 1
    WHEN regexp_matches(t, '(^|[^a-z])(high fever|severe pain|abnormal vitals)([^a-z]|$)') THEN 2
    WHEN regexp_matches(t, '(^|[^a-z])(moderate|monitoring)([^a-z]|$)') THEN 3 ELSE 4 END AS rank
  FROM (SELECT doc_id, lower(text) AS t FROM b_complaints))""")
def q_triage_rules(spark, d):
    return X.triage_rules(dealt(Bindings(spark, d).complaints))


@query("transcripts", """
SELECT conv_id,
       string_agg(line, chr(10) ORDER BY turn, line) AS transcript, count(*) AS n_turns
FROM (SELECT conv_id, turn, CASE WHEN role = 'doctor' THEN 'Doctor' ELSE 'Patient' END || ': ' ||
             coalesce(nullif(original, ''), translated, '') AS line FROM b_turns)
GROUP BY conv_id""")
def q_transcripts(spark, d):
    return X.transcripts(Bindings(spark, d).turns)


@query("translate_worklist", """
SELECT sha256(text) AS text_key, source_lang, 'en-IN' AS target_lang, text, count(*) AS n_requests
FROM b_transcripts
WHERE source_lang <> 'en-IN' AND source_lang NOT IN ('en-IN', 'en')
  AND NOT (text IS NULL OR regexp_matches(text, '^\\s*$'))
GROUP BY text, source_lang""")
def q_translate_worklist(spark, d):
    return X.translate_worklist(Bindings(spark, d).transcripts)


def _translations(worklist: DataFrame) -> DataFrame:
    """Answers to a work-list: every text but those whose length four divides."""
    return worklist.filter(F.char_length("text") % 4 != 0).select(
        "text_key", "source_lang", "target_lang", F.concat(F.lit("EN: "), "text").alias("translated"))


@query("translate_apply", """
SELECT doc_id, text, source_lang, CASE WHEN source_lang NOT IN ('en-IN', 'en') AND length(text) % 4 <> 0
       AND NOT regexp_matches(text, '^\\s*$') THEN 'EN: ' || text ELSE text END AS english FROM b_transcripts""")
def q_translate_apply(spark, d):
    docs = Bindings(spark, d).transcripts
    return X.translate_apply(docs, _translations(X.translate_worklist(docs)))


@query("scan_decode", _SCAN_DECODE)
def q_scan_decode(spark, d):
    return X.scan_decode(Bindings(spark, d).scans)


def _jv(expr: str) -> str:
    return f"coalesce(CAST(to_json({expr}) AS VARCHAR), 'null')"


@query("scan_encode", f"""
SELECT patient_id, '{{"patient_id": ' || {_jv('patient_id')} || ', "name": ' || {_jv('name')} ||
       ', "token": ' || {_jv('token_number')} || ', "room": ' || {_jv('room_number')} || '}}' AS payload
FROM b_patients""")
def q_scan_encode(spark, d):
    return X.scan_encode(Bindings(spark, d).patients)


@query("discharge_messages", f"""
SELECT p.patient_id, p.language,
       printf('%s, your consultation is complete. Your medicines have been dispensed. Important: %s. '
              || 'Please take care and get well soon.', p.name, coalesce(f.followup, 'Follow up with your doctor'))
       AS message
FROM b_patients p LEFT JOIN ({_latest('b_consultations', 'consultation_id', 'followup')}) f
ON p.patient_id = f.patient_id""")
def q_discharge_messages(spark, d):
    b = Bindings(spark, d)
    return X.discharge_messages(b.patients, records.latest_followup(b.consultations))


@query("welcome_messages", """
SELECT patient_id, language,
       printf('Welcome %s. You are Token %s. Please go to Room %s.', name, CAST(token_number AS VARCHAR),
              CAST(room_number AS VARCHAR)) AS message
FROM b_patients WHERE checked_in = 1""")
def q_welcome_messages(spark, d):
    return X.welcome_messages(Bindings(spark, d).patients)


@query("alert_messages", f"""
SELECT consultation_id, patient_id,
       printf('ALERT' || chr(10) || 'Patient: %s (%s)' || chr(10) || 'Severity: %s' || chr(10) || 'Diagnosis: %s'
              || chr(10) || 'Room: %s' || chr(10) || 'Immediate attention required.',
              name, CAST(patient_id AS VARCHAR), upper(severity), diagnosis, CAST(room_number AS VARCHAR)) AS message
FROM ({_ALERT_FEED})""")
def q_alert_messages(spark, d):
    b = Bindings(spark, d)
    return X.alert_messages(P.alert_feed(b.consultations, b.patients))


@query("make_ids", f"SELECT patient_id, {_sha_id('PT-', 'patient_id')} AS code FROM b_patients")
def q_make_ids(spark, d):
    return X.make_ids(Bindings(spark, d).patients, "patient_id", "PT-")


def _iso(expr: str) -> str:
    return (f"CASE WHEN {expr} IS NULL THEN NULL WHEN microsecond({expr}) % 1000000 = 0 "
            f"THEN strftime({expr}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f') END")


@query("iso_parse", f"""
SELECT event_id, iso_text, TRY_CAST(iso_text AS TIMESTAMP) AS parsed,
       strftime(CAST(TRY_CAST(iso_text AS TIMESTAMP) AS DATE), '%Y-%m-%d') AS day FROM (SELECT event_id, {_iso('ts')} AS iso_text FROM events)""")
def q_iso_parse(spark, d):
    return _day_text(X.iso_parse(Bindings(spark, d).table("events"), "ts", "event_id"), "day")


# ---------------------------------------------------------------- lake and sources
def _lake_rows(b: Bindings) -> DataFrame:
    return L.with_route(clinical(b))


@query("lake_encode", f"""
SELECT CAST(consultation_id AS VARCHAR) AS consultation_id, CAST(patient_id AS VARCHAR) AS patient_id,
       {_py_list('symptoms')} AS symptoms, coalesce(diagnosis, '') AS diagnosis,
       {_py_list('prescriptions')} AS prescriptions, {_py_list('lab_tests')} AS lab_tests,
       coalesce(severity, '') AS severity,
       {_py_list("list_filter([CASE WHEN len(lab_tests) > 0 THEN 'lab' END, "
                 "CASE WHEN len(prescriptions) > 0 THEN 'pharmacy' END], lambda x: x IS NOT NULL)")} AS route_to,
       coalesce(followup, '') AS followup, coalesce(clinical_notes, '') AS clinical_notes, coalesce({_iso('created_at')}, '') AS created_at
FROM b_clinical""")
def q_lake_encode(spark, d):
    return L.lake_encode(_lake_rows(Bindings(spark, d)))


@query("lake_roundtrip", """
SELECT consultation_id, patient_id, CAST(to_json(symptoms) AS VARCHAR) AS symptoms, diagnosis,
       CAST(to_json(prescriptions) AS VARCHAR) AS prescriptions, CAST(to_json(lab_tests) AS VARCHAR) AS lab_tests,
       severity, followup, created_at, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS created_date FROM b_clinical""")
def q_lake_roundtrip(spark, d):
    path = scratch_path(spark, "lake")
    b = Bindings(spark, d)
    L.write_consultations(_lake_rows(b), path, L.day_counts(b.consultations))
    lake = L.read_consultations(spark, path)
    return lake.select("consultation_id", "patient_id", F.to_json("symptoms").alias("symptoms"), "diagnosis",
                       F.to_json("prescriptions").alias("prescriptions"), F.to_json("lab_tests").alias("lab_tests"),
                       "severity", "followup", "created_at",
                       F.date_format("created_date", "yyyy-MM-dd").alias("created_date"))


@query("patient_history", """
SELECT consultation_id, patient_id, diagnosis, severity, created_at,
       CAST(to_json(prescriptions) AS VARCHAR) AS prescriptions, CAST(to_json(lab_tests) AS VARCHAR) AS lab_tests
FROM b_clinical WHERE patient_id IN (SELECT patient_id FROM b_checkins)""")
def q_patient_history(spark, d):
    b = Bindings(spark, d)
    wanted = L.patient_history(b.consultations, b.checkins)  # lists only for requested patients
    h = records.clinical_records(wanted, b.items, only_these=True)
    return h.select("consultation_id", "patient_id", "diagnosis", "severity", "created_at",
                    F.to_json("prescriptions").alias("prescriptions"), F.to_json("lab_tests").alias("lab_tests"))


@query("patient_rows", f"""
SELECT consultation_id, patient_id, diagnosis, severity, created_at FROM b_consultations WHERE patient_id IN {PATIENTS}""")
def q_patient_rows(spark, d):
    """One patient file as the front desk opens it: a pruned read of the whole lake."""
    path = scratch_path(spark, "lake")
    b = Bindings(spark, d)
    L.write_consultations(b.consultations, path, L.day_counts(b.consultations))
    return L.patient_rows(L.read_consultations(spark, path), PATIENTS).select("consultation_id", "patient_id", "diagnosis", "severity", "created_at")


@query("schema_evolve", """
SELECT patient_id, name, language, token_number, room_number, checked_in, CAST(NULL AS INTEGER) AS hospital_id,
       CAST(NULL AS TIMESTAMP) AS created_at FROM b_patients WHERE checked_in = 0
UNION ALL
SELECT patient_id, name, language, token_number, room_number, checked_in, hospital_id, created_at
FROM b_patients WHERE checked_in = 1""")
def q_schema_evolve(spark, d):
    p = Bindings(spark, d).patients
    old = p.filter(F.col("checked_in") == 0).drop("hospital_id", "created_at")  # table before the migration
    new = p.filter(F.col("checked_in") == 1)
    return L.schema_evolve(old, new)


@query("schema_generations", """
SELECT CAST(patient_id AS BIGINT) AS patient_id, CAST(token_number AS BIGINT) AS token_number,
       CASE WHEN era > 1 THEN CAST(room_number AS BIGINT) END AS room_number, CASE WHEN era > 2 THEN hospital_id END AS hospital_id,
       name AS note, CASE WHEN era > 1 THEN language END AS note_language, CASE WHEN era > 2 THEN created_at END AS created_at
FROM (SELECT *, CASE WHEN created_at IS NULL OR created_at < TIMESTAMP '1996-01-01' THEN 1
                     WHEN created_at < TIMESTAMP '2000-01-01' THEN 2 ELSE 3 END AS era FROM b_patients)""")
def q_schema_generations(spark, d):
    """Three generations of the patients table: the visit struct grows and its numbers
    widen, the notes (a list of structs) take a language, a time comes last."""
    p, path = Bindings(spark, d).patients, scratch_path(spark, "generations")
    era = F.when(F.col("created_at").isNull() | (F.col("created_at") < "1996-01-01"), 1).when(F.col("created_at") < "2000-01-01", 2).otherwise(3)
    token, room = F.col("token_number").cast("int").alias("token"), F.col("room_number").cast("int").alias("room")
    text, language = F.col("name").alias("text"), F.col("language").alias("language")
    forms = [
        [F.col("patient_id").cast("int").alias("patient_id"), F.struct(token).alias("visit"), F.array(F.struct(text)).alias("notes")],
        [F.col("patient_id").cast("long").alias("patient_id"), F.struct(token, room).alias("visit"), F.array(F.struct(text, language)).alias("notes")],
        [F.col("patient_id").cast("long").alias("patient_id"),
         F.struct(F.col("hospital_id"), F.col("token_number").cast("long").alias("token"), F.col("room_number").cast("long").alias("room")).alias("visit"),
         F.array(F.struct(language, text)).alias("notes"), F.col("created_at")],
    ]
    paths = [f"{path}/{k}" for k in (1, 2, 3)]
    for k, (columns, folder) in enumerate(zip(forms, paths), 1):
        p.filter(era == k).select(columns).write.parquet(folder)
    whole = L.read_generations(spark, paths)
    note = F.get("notes", F.lit(0))
    return whole.select("patient_id", F.col("visit.token").alias("token_number"), F.col("visit.room").alias("room_number"),
                        F.col("visit.hospital_id").alias("hospital_id"), note["text"].alias("note"), note["language"].alias("note_language"), "created_at")


@query("ingest_defaults", """
SELECT patient_id, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS INTEGER) AS age, CAST(NULL AS VARCHAR) AS gender,
       CAST(NULL AS VARCHAR) AS language, CAST(NULL AS BIGINT) AS token_number, CAST(1 AS BIGINT) AS room_number,
       0 AS checked_in, CAST(NULL AS INTEGER) AS hospital_id, ts AS created_at FROM b_registrations""")
def q_ingest_defaults(spark, d):
    src = Bindings(spark, d).registrations.select("patient_id", F.col("ts").alias("created_at"))
    return L.ingest_defaults(src, _parse_datatype_string(S.PATIENT_TABLE), S.PATIENT_DEFAULTS)


def _defaults(key: str, source: str, sql: str, table: str, defaults: dict, columns: list[str]):
    """S6 for one more table: a source with ``columns`` only, shaped to ``table``."""
    @query(key, f"SELECT {sql} FROM {source}")
    def run(spark, d):
        src = getattr(Bindings(spark, d), source.removeprefix("b_")).select(*columns)
        return L.ingest_defaults(src, _parse_datatype_string(table), defaults)


_NO = "CAST(NULL AS BIGINT)"
_defaults("ingest_lab_orders", "b_lab_order_events", f"order_id, patient_id, {_NO} AS consultation_id, CAST(NULL AS VARCHAR) AS tests, "
          "'pending' AS status, '{}' AS results, created_at, CAST(NULL AS TIMESTAMP) AS updated_at",
          S.LAB_ORDER_TABLE, S.LAB_ORDER_DEFAULTS, ["order_id", "patient_id", "created_at"])
_defaults("ingest_prescriptions", "b_rx_events", f"rx_id, patient_id, {_NO} AS consultation_id, CAST(NULL AS VARCHAR) AS medicines, "
          "'pending' AS status, created_at, CAST(NULL AS TIMESTAMP) AS updated_at",
          S.RX_TABLE, S.RX_DEFAULTS, ["rx_id", "patient_id", "created_at"])
_defaults("ingest_alerts", "b_consultations", f"{_NO} AS alert_id, consultation_id, patient_id, severity, diagnosis, 0 AS sms_sent, created_at",
          S.ALERT_TABLE, S.ALERT_DEFAULTS, ["consultation_id", "patient_id", "severity", "diagnosis", "created_at"])
_defaults("ingest_applications", "b_applications", "CAST(app_id AS BIGINT) AS app_id, data, 'pending' AS status, "
          "CAST(NULL AS VARCHAR) AS comments, CAST(NULL AS TIMESTAMP) AS created_at",
          S.APPLICATION_TABLE, S.APPLICATION_DEFAULTS, ["app_id", "data"])


def _audit_sql() -> str:
    tables = {"patients": "b_patients", "consultations": "b_consultations", "lab_orders": "b_lab_orders",
              "prescriptions": "b_prescriptions", "hospitals": "b_hospitals", "staff": "b_staff_accounts",
              "items": "b_items", "applications": "b_applications", "dept_updates": "b_dept_updates",
              "alerts": f"({_ALERT_FEED})"}
    pk = [("patients", "patient_id"), ("consultations", "consultation_id"), ("lab_orders", "order_id"),
          ("prescriptions", "rx_id"), ("hospitals", "hospital_id"), ("staff", "staff_id"), ("items", "consultation_id,line"),
          ("applications", "app_id"), ("dept_updates", "update_id"), ("alerts", "consultation_id")]
    unique = [("hospitals", "email"), ("staff", "username")]
    nn = [("patients", "name"), ("hospitals", "name")]
    fk = [("staff", "hospital_id", "b_hospitals", "hospital_id", "hospitals"),
          ("patients", "hospital_id", "b_hospitals", "hospital_id", "hospitals"),
          ("consultations", "patient_id", "b_patients", "patient_id", "patients"),
          ("lab_orders", "patient_id", "b_patients", "patient_id", "patients"),
          ("prescriptions", "patient_id", "b_patients", "patient_id", "patients")]
    parts = [f"SELECT '{n}' AS table_name, 'pk_duplicate:{k}' AS rule, (SELECT count(*) FROM (SELECT {k} FROM {tables[n]} "
             f"GROUP BY {k} HAVING count(*) > 1)) AS violations" for n, k in pk]
    parts += [f"SELECT '{n}', 'unique:{c}', (SELECT count(*) FROM (SELECT {c} FROM {tables[n]} WHERE {c} IS NOT NULL "
              f"GROUP BY {c} HAVING count(*) > 1))" for n, c in unique]
    parts += [f"SELECT '{n}', 'not_null:{c}', (SELECT count(*) FROM {tables[n]} WHERE {c} IS NULL)" for n, c in nn]
    parts += [f"SELECT '{n}', 'fk:{c}->{pn}', (SELECT count(*) FROM {tables[n]} x WHERE x.{c} IS NOT NULL AND NOT EXISTS "
              f"(SELECT 1 FROM {p} y WHERE y.{pc} = x.{c}))" for n, c, p, pc, pn in fk]
    return "\nUNION ALL\n".join(parts)


def _audited(b: Bindings) -> dict[str, DataFrame]:
    return {"patients": b.patients, "consultations": b.consultations, "lab_orders": b.lab_orders,
            "prescriptions": b.prescriptions, "hospitals": b.hospitals, "staff": b.staff_accounts,
            "items": b.items, "applications": b.applications, "dept_updates": b.dept_updates,
            "alerts": P.alert_feed(b.consultations, b.patients)}


@query("key_audit", _audit_sql())
def q_key_audit(spark, d):
    return L.key_audit(_audited(Bindings(spark, d)))


@query("key_audit_increments", _audit_sql())
def q_key_audit_increments(spark, d):
    """Parents and children come in different batches; the second one is folded twice, as
    after a lost driver."""
    path, tables = scratch_path(spark, "key-counts"), _audited(Bindings(spark, d))
    late = {name: tables.pop(name) for name in ("patients", "hospitals")}
    key_counts.fold(tables, path, 0)
    for _ in range(2):
        key_counts.fold(late, path, 1)
    return key_counts.audit(spark, path)


# ---------------------------------------------------------------- streams (T6 and its batch twin)

_DAILY = ("SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events "
          "GROUP BY 1, 2")


@query("daily_counts", _DAILY)
def q_daily_counts(spark, d):
    return _day_text(T.daily_counts(Bindings(spark, d).table("events")), "day")


@query("stream_daily_counts", _DAILY)
def q_stream_daily_counts(spark, d):
    return _day_text(T.stream_daily_counts(spark, d), "day")


# ---------------------------------------------------------------- streams over the given tables
_FANOUT_ORDERS_SQL = ORACLE["fanout_orders"]
_FANOUT_RX_SQL = ORACLE["fanout_rx"]
ORACLE["stream_alert_feed"] = oracle_with(_ALERT_FEED)
ORACLE["stream_fanout_orders"] = _FANOUT_ORDERS_SQL
ORACLE["stream_fanout_rx"] = _FANOUT_RX_SQL
ORACLE["stream_lab_state"] = ORACLE["lab_state"]
ORACLE["stream_dedup_updates"] = ORACLE["dedup_updates"]


@query("stream_alert_feed")
def q_stream_alert_feed(spark, d):
    return T.stream_alert_feed(spark, d)


@query("stream_fanout_orders")
def q_stream_fanout_orders(spark, d):
    return T.stream_fanout(spark, d, "lab")


@query("stream_fanout_rx")
def q_stream_fanout_rx(spark, d):
    return T.stream_fanout(spark, d, "rx")


@query("stream_lab_state")
def q_stream_lab_state(spark, d):
    return T.stream_lab_state(spark, d)


@query("stream_dedup_updates")
def q_stream_dedup_updates(spark, d):
    return T.stream_dedup_updates(spark, d)


@query("stream_daily_counts_whole", _DAILY)
def q_stream_daily_counts_whole(spark, d):
    return _day_text(T.stream_daily_counts_whole(spark, d), "day")


@query("stream_patients_upsert", _UPSERT)
def q_stream_patients_upsert(spark, d):
    return R.stream_registry(spark, d, "patients")


ORACLE["stream_checkin_state"] = ORACLE["checkin_state"]


@query("stream_checkin_state")
def q_stream_checkin_state(spark, d):
    return R.stream_registry(spark, d, "checkins")


@query("stream_token_board", f"""
SELECT hospital_id, strftime(day, '%Y-%m-%d') AS day, slot, slot = 1 AS now_serving, token_number, patient_id, name, room_number FROM (
  SELECT *, row_number() OVER (PARTITION BY hospital_id, day ORDER BY token_number, patient_id) AS slot
  FROM (SELECT *, CAST(created_at AS DATE) AS day FROM ({_UPSERT}) u) v) w WHERE slot <= 6""")
def q_stream_token_board(spark, d):
    """The first six tokens of every hospital and day: the board's own limit."""
    return _day_text(R.stream_registry(spark, d, "boards"), "day")
