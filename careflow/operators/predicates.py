"""Filters, lookups and projections.

Request-shaped lookups of the reference (one id per HTTP call) are re-aimed
to batches: a frame of requested ids is semi/anti-joined to the table, so a
million lookups cost one shuffle join instead of a million scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow import schemas as S
from careflow.functions.common import is_blank, make_id

# Payload fields of a hospital application (secrets are not published).
APPLICATION_PAYLOAD = (
    "name string, license_number string, phone string, email string, pincode string, address string, "
    "city string, state string, admin_name string, admin_email string, password string"
)
SECRET_COLUMNS = ("password", "aadhaar_last4", "qr_code")


def applications_by_status(applications: DataFrame, status: str = "pending") -> DataFrame:
    """Applications with one status (default 'pending')."""
    return applications.filter(F.col("status") == F.lit(status))


def applications_flat(applications: DataFrame, status: str = "pending") -> DataFrame:
    """P1, then the JSON payload flattened to top-level columns.

    Table metadata wins a name clash (the payload's own ``status`` is
    dropped); ``app_id`` is published as ``hospital_id`` and ``created_at``
    as ``applied_at``; the payload password is never published.
    """
    rows = applications_by_status(applications, status)
    parsed = rows.withColumn("__p", F.from_json("data", APPLICATION_PAYLOAD))
    meta = {"hospital_id": F.col("app_id"), "status": F.col("status")}
    if "comments" in rows.columns:
        meta["comments"] = F.col("comments")
    if "created_at" in rows.columns:
        meta["applied_at"] = F.col("created_at")
    payload_cols = [f.split(" ")[0] for f in APPLICATION_PAYLOAD.split(", ")]
    keep = [F.col("__p." + c).alias(c) for c in payload_cols if c not in meta and c not in SECRET_COLUMNS]
    return parsed.select(*keep, *[v.alias(k) for k, v in meta.items()])


def publish(df: DataFrame) -> DataFrame:
    """Drop secret columns (passwords, id suffixes, QR images) if present."""
    return df.drop(*[c for c in SECRET_COLUMNS if c in df.columns])


def normalised_key(c) -> F.Column:
    """Case- and blank-insensitive key for equi-joins (P5)."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def ci_lookup(requests: DataFrame, req_key: str, table: DataFrame, table_key) -> DataFrame:
    """P5: case-insensitive key match as an equi-join on a normalised key.

    A function on the key cannot use file statistics, so both sides carry the
    normalised key as a column and join on it (hash partitioned by it).
    """
    r = requests.withColumn("__k", normalised_key(req_key))
    t = table.withColumn("__k", normalised_key(table_key))
    return r.join(t, "__k", "inner").drop("__k")


def alert_candidates(consultations: DataFrame) -> DataFrame:
    """Severity in {emergency, high}, case-sensitive (so 'High' is not)."""
    return consultations.filter(F.col("severity").isin(S.ALERT_SEVERITIES))


def lookup_ids(table: DataFrame, requests: DataFrame, key: str = "patient_id") -> DataFrame:
    """P10: rows of the requested ids (semi-join; duplicates in requests are harmless)."""
    return table.join(requests.select(key), key, "left_semi")


def unknown_ids(requests: DataFrame, table: DataFrame, key: str = "patient_id") -> DataFrame:
    """P10: requests naming an id the table does not have (anti-join)."""
    return requests.join(table.select(key), key, "left_anti")


def missing_results(results: DataFrame) -> DataFrame:
    """Ordered tests whose result is missing or blank, per order.

    A higher-order filter over the decoded lists; no explode, no shuffle.
    """
    tests = F.from_json("tests", "array<string>")
    res = F.from_json("results", "map<string,string>")
    df = results.select("order_id", tests.alias("__t"), res.alias("__r"))
    missing = F.filter("__t", lambda t: F.coalesce(F.trim(F.col("__r")[t]), F.lit("")) == "")
    out = df.select("order_id", missing.alias("__m"))
    return (out.filter(F.size("__m") > 0)
            .select("order_id", F.size("__m").cast("long").alias("n_missing"),
                    F.to_json("__m").alias("missing_tests")))


def registration_rejects(requests: DataFrame) -> DataFrame:
    """Registration requests the reception form or the model refuse.

    Name must not be blank; age text must not be empty; the form sends
    ``parseInt(age)``, so the text must start with an optional sign and a
    digit after leading blanks, else the integer check fails. First failing
    rule is the reason.
    """
    age_ok = F.regexp_like(F.coalesce(F.col("age_text"), F.lit("")), F.lit(r"^\s*[+-]?[0-9]"))
    reason = (F.when(is_blank("name"), F.lit("name_required"))
              .when(F.coalesce(F.col("age_text"), F.lit("")) == "", F.lit("age_required"))
              .when(~age_ok, F.lit("age_not_integer")))
    return requests.select("event_id", "patient_id", reason.alias("reason")).filter(F.col("reason").isNotNull())


def patients_with_orders(patients: DataFrame, orders: DataFrame) -> DataFrame:
    """Patients having at least one order (existence test as semi-join)."""
    return patients.join(orders.select("patient_id"), "patient_id", "left_semi")


def alert_feed(consultations: DataFrame, patients: DataFrame) -> DataFrame:
    """Alerting consultations with the patient's name and room; no patient, no alert."""
    people = patients.select("patient_id", "name", "room_number")
    return alert_candidates(consultations).join(people, "patient_id", "inner").select(
        "consultation_id", "patient_id", "name", "room_number", "severity", "diagnosis", "created_at")


def api_keys_from(staff: DataFrame, hospitals: DataFrame, admins: DataFrame | None = None) -> DataFrame:
    """Principals as issued at login: one key per staff member (owner = staff
    id, role = staff role), one per hospital admin (owner = hospital id) and
    one per system admin (owner = admin id), if there are any."""
    s = staff.select(make_id("sk_staff_", F.col("staff_id")).alias("key"),
                     F.col("staff_id").cast("string").alias("owner_id"), "role")
    h = hospitals.select(make_id("sk_hosp_", F.col("hospital_id")).alias("key"),
                         F.col("hospital_id").cast("string").alias("owner_id"),
                         F.lit("hospital_admin").alias("role"))
    keys = s.unionByName(h)
    if admins is not None:
        keys = keys.unionByName(admins.select(make_id("sk_sys_", F.col("admin_id")).alias("key"),
                                              F.col("admin_id").cast("string").alias("owner_id"), F.lit("system_admin").alias("role")))
    return keys


def principal_hospital(api_keys: DataFrame, staff: DataFrame) -> DataFrame:
    """Hospital of each principal; admins own theirs, staff inherit it,
    system admins resolve to NULL (they see every hospital)."""
    st = staff.select(F.col("staff_id").cast("string").alias("owner_id"),
                      F.col("hospital_id").cast("string").alias("staff_hospital"))
    j = api_keys.join(st, "owner_id", "left")
    hosp = (F.when(F.col("role") == "hospital_admin", F.col("owner_id"))
            .when(F.col("role") == "system_admin", F.lit(None).cast("string"))
            .otherwise(F.col("staff_hospital")))
    return j.select("key", "owner_id", "role", hosp.alias("hospital_id"))
