"""State folds: registrations, check-ins, orders, applications, staff
(U1-U11, J4, J5, W7, T5 batch twin).

Parquet has no MERGE and no Delta jar is present, so every fold is a pure
function *state + changes -> new state*; callers write the result as a new
snapshot and never overwrite the input they read. Per-key "latest" values are
``max_by`` aggregates (map-side partial), never a sort of the whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow import schemas as S
from careflow.functions.common import json_list_text, make_id, prefix_position
from careflow.operators.predicates import APPLICATION_PAYLOAD


# ---------------------------------------------------------------- registrations
VISIT_FIELDS = ["name", "age", "gender", "language", "hospital_id", "aadhaar_last4"]


def accepted_registrations(requests: DataFrame, patients: DataFrame) -> DataFrame:
    """W7, first step: requests with the id they concern, rejected ones left out.

    A request without ``patient_id`` registers a new patient, whose id comes
    from the event. One with an id is a return; it counts only if the id is in
    the table or was given to a new patient earlier in the log ((ts, event_id)
    order). Rejects are dropped before anything is counted. Ids are text.
    """
    r = requests.withColumn("is_new", F.col("patient_id").isNull()) \
        .withColumn("patient_id", F.coalesce(F.col("patient_id").cast("string"), make_id("VK-", "event_id")))
    known = patients.select(F.col("patient_id").cast("string").alias("patient_id"), F.lit(True).alias("__known")).distinct()
    born = r.filter("is_new").select("patient_id", F.struct("ts", "event_id").alias("__born"))
    j = r.join(known, "patient_id", "left").join(born, "patient_id", "left")
    ok = F.col("is_new") | F.col("__known") | (F.col("__born") < F.struct("ts", "event_id"))
    return j.filter(F.coalesce(ok, F.lit(False))).drop("__known", "__born")


def token_numbers(requests: DataFrame, patients: DataFrame) -> DataFrame:
    """Token and room of every accepted registration, all its fields kept.

    The patients table counts one row per patient, so at each registration
    the count is the table's rows plus the *new* registrations strictly
    before it (global order ts, event_id); token = count + 1, room = count
    % 3 + 1. A returning patient does not raise the count, so the next new
    patient gets the same token.

    The running count is a prefix sum over ranges that follow the data, so no
    single task ever orders the whole log, however busy one hour is. The ranges'
    sums come from the bare log: a rejected request counts nothing.
    """
    r = accepted_registrations(requests, patients).withColumn("__new", F.col("is_new").cast("long"))
    log = requests.select("ts", "event_id", F.col("patient_id").isNull().cast("long").alias("__new"))
    pos = prefix_position(r, [], "ts", "event_id", weight_col="__new", inclusive=False, out="__prior", counted=log)
    count = F.col("__prior") + patients.agg(F.count(F.lit(1))).scalar()
    return pos.select(*requests.columns, "is_new", (count + 1).alias("token_number"), (count % 3 + 1).alias("room_number"))


def patients_upsert(tokens: DataFrame, patients: DataFrame) -> DataFrame:
    """The patients table after replaying every accepted registration.

    A registration writes every visit field (name, age, gender, language,
    hospital, id suffix), token, room, ``checked_in = 0`` and ``created_at``;
    the last one per id wins. Patients nobody registered again stay as they
    are. Columns a frame lacks are NULL; ``visits`` counts the registrations
    replayed and ``event_id`` is the last one's (NULL for untouched rows).
    """
    def column(df, c):
        return F.col(c) if c in df.columns else F.lit(None)

    kinds = {"age": "int", "hospital_id": "int"}
    written = F.struct(*[column(tokens, c).cast(kinds.get(c, "string")).alias(c) for c in VISIT_FIELDS],
                       "token_number", "room_number", F.col("ts").alias("created_at"), "event_id")
    last = (tokens.groupBy("patient_id").agg(F.max_by(written, F.struct("ts", "event_id")).alias("__l"),
                                             F.count(F.lit(1)).alias("visits"))
            .select("patient_id", "__l.*", F.lit(0).alias("checked_in"), "visits"))
    old = patients.select(F.col("patient_id").cast("string").alias("patient_id"),
                          *[column(patients, c).cast(kinds.get(c, "string")).alias(c) for c in VISIT_FIELDS],
                          "token_number", "room_number", "created_at", F.lit(None).cast("long").alias("event_id"),
                          "checked_in", F.lit(0).cast("long").alias("visits"))
    untouched = old.join(last.select("patient_id"), "patient_id", "left_anti")
    return last.unionByName(untouched)


def checkin_state(state: DataFrame, checkins: DataFrame) -> DataFrame:
    """checked_in after every check-in of the log.

    Set by a check-in after the patient's last registration, in (ts, event_id)
    order, so a later registration resets it; a patient without a registration
    in the log keeps the old flag unless a check-in sets it. Check-ins of
    unknown ids change nothing.
    """
    ck = checkins.groupBy(F.col("patient_id").cast("string").alias("patient_id")).agg(
        F.max(F.struct("ts", "event_id")).alias("__c"))
    j = state.join(ck, "patient_id", "left")
    after = F.when(F.col("event_id").isNull(), F.col("__c").isNotNull()).otherwise(
        F.col("__c") > F.struct(F.col("created_at").alias("ts"), "event_id"))
    flag = F.when(F.coalesce(after, F.lit(False)), F.lit(1)).when(F.col("event_id").isNull(), F.col("checked_in")).otherwise(0)
    return j.select("patient_id", "created_at", F.col("__c.ts").alias("last_checkin"), flag.alias("checked_in"))


# ---------------------------------------------------------------- department fold (U4)
def dept_fold_state(updates: DataFrame, dept: str, action: str) -> DataFrame:
    """Per patient, the latest closing update (time, data). One row per
    patient; this is all the fold needs to remember."""
    return (updates.filter((F.col("dept") == dept) & (F.col("action") == action))
            .groupBy("patient_id")
            .agg(F.max_by("data", F.struct("updated_at", "update_id")).alias("last_data"),
                 F.max("updated_at").alias("last_update")))


def apply_dept_state(orders: DataFrame, state: DataFrame, done_status: str, with_results: bool) -> DataFrame:
    """Order rows under a per-patient fold state: closed iff the patient's
    latest closing update is at or after the order's creation."""
    key = "order_id" if "order_id" in orders.columns else "rx_id"
    j = orders.select(key, "patient_id", "created_at").join(
        state.select("patient_id", "last_data", "last_update"), "patient_id", "left")
    closed = F.coalesce(F.col("last_update") >= F.col("created_at"), F.lit(False))
    cols = [key, "patient_id", "created_at",
            F.when(closed, F.lit(done_status)).otherwise(F.lit("pending")).alias("status")]
    if with_results:
        cols.append(F.when(closed, F.col("last_data")).otherwise(F.lit(S.LAB_ORDER_DEFAULTS["results"]))
                    .alias("results"))
    cols.append(F.when(closed, F.col("last_update")).otherwise(F.col("created_at")).alias("updated_at"))
    return j.select(*cols)


def _dept_fold(orders: DataFrame, updates: DataFrame, dept: str, action: str,
               done_status: str, with_results: bool) -> DataFrame:
    return apply_dept_state(orders, dept_fold_state(updates, dept, action), done_status, with_results)


def lab_state(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """U4: a lab 'submitted_results' update completes every order of the
    patient that exists at that time, and later results overwrite all.

    Hence an order is closed iff the patient's latest such update is at or
    after the order's creation, and its results are that latest update's.
    """
    return _dept_fold(orders, updates, S.LAB_DEPT, S.LAB_DONE_ACTION, "completed", True)


def rx_state(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """U4: pharmacy 'dispensed' closes every prescription existing at that time."""
    return _dept_fold(orders, updates, S.RX_DEPT, S.RX_DONE_ACTION, "dispensed", False)


def dedup_updates(updates: DataFrame, key: str = "update_id", order: str = "updated_at") -> DataFrame:
    """T5 (batch twin): one row per update id, however often it was retried:
    the earliest delivery (ties: the smallest row), whichever task sees it.

    An aggregate with a map-side partial step, so a hot id is collapsed
    before the shuffle.
    """
    rest = [c for c in updates.columns if c != key]
    first = sorted(rest, key=lambda c: c != order)  # the time leads
    row = F.struct(*first)
    return (updates.groupBy(key).agg(F.min(row).alias("__r")).select(key, "__r.*").select(*updates.columns))


def append_updates(log: DataFrame, incoming: DataFrame, key: str = "update_id") -> DataFrame:
    """The log after appending a delivery. Idempotent: ids the log already
    holds, and repeats within the delivery, add nothing."""
    fresh = dedup_updates(incoming, key).join(log.select(key), key, "left_anti")
    return log.unionByName(fresh.select(*log.columns))


# ---------------------------------------------------------------- consultation fan-out
def fanout_orders(clinical: DataFrame) -> DataFrame:
    """A pending lab order for every consultation with lab tests."""
    return clinical.filter(F.size("lab_tests") > 0).select(
        make_id("LAB-", "consultation_id").alias("order_id"), "consultation_id", "patient_id",
        json_list_text("lab_tests").alias("tests"), F.lit("pending").alias("status"),
        F.lit("{}").alias("results"), "created_at", F.col("created_at").alias("updated_at"))


def fanout_rx(clinical: DataFrame) -> DataFrame:
    """A pending prescription for every consultation with medicines."""
    return clinical.filter(F.size("prescriptions") > 0).select(
        make_id("RX-", "consultation_id").alias("rx_id"), "consultation_id", "patient_id",
        json_list_text("prescriptions").alias("medicines"), F.lit("pending").alias("status"),
        "created_at", F.col("created_at").alias("updated_at"))


def alert_log(feed: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One alert row per alerting consultation; sms_sent = 1 only if 'sent'."""
    sent = deliveries.groupBy("consultation_id").agg(F.max(F.col("status") == "sent").alias("__sent"))
    j = feed.join(sent, "consultation_id", "left")
    return j.select(make_id("ALERT-", "consultation_id").alias("alert_id"), "consultation_id", "patient_id",
                    "severity", "diagnosis",
                    F.when(F.col("__sent"), F.lit(1)).otherwise(F.lit(0)).alias("sms_sent"), "created_at")


def _first_per_patient(clinical: DataFrame, list_col: str) -> DataFrame:
    return (clinical.groupBy("patient_id")
            .agg(F.min_by(F.struct("consultation_id", "created_at", list_col),
                          F.struct("created_at", "consultation_id")).alias("__f"))
            .select("patient_id", "__f.*"))


def orders_backfill(clinical: DataFrame, prior_orders: DataFrame) -> DataFrame:
    """The workflow inserts a lab order for a patient who has none of any
    status, even with an empty test list. Within one batch the earliest
    event per patient wins (the serial workflow would see its own insert)."""
    first = _first_per_patient(clinical, "lab_tests").join(prior_orders.select("patient_id"),
                                                          "patient_id", "left_anti")
    return first.select(make_id("WFLAB-", "consultation_id").alias("order_id"), "patient_id", "consultation_id",
                        json_list_text("lab_tests").alias("tests"), F.lit("pending").alias("status"),
                        F.lit("{}").alias("results"), "created_at", F.col("created_at").alias("updated_at"))


def rx_backfill(clinical: DataFrame, prior_orders: DataFrame) -> DataFrame:
    """The pharmacy twin of ``orders_backfill``."""
    first = _first_per_patient(clinical, "prescriptions").join(prior_orders.select("patient_id"),
                                                              "patient_id", "left_anti")
    return first.select(make_id("WFRX-", "consultation_id").alias("rx_id"), "patient_id", "consultation_id",
                        json_list_text("prescriptions").alias("medicines"), F.lit("pending").alias("status"),
                        "created_at", F.col("created_at").alias("updated_at"))


# ---------------------------------------------------------------- applications
def status_normalised(applications: DataFrame) -> DataFrame:
    """Legacy 'approve' becomes 'approved'."""
    st = F.when(F.col("status") == "approve", F.lit("approved")).otherwise(F.col("status"))
    return applications.withColumn("status", st)


def _payload(applications: DataFrame) -> DataFrame:
    return applications.withColumn("__p", F.from_json("data", APPLICATION_PAYLOAD))


HOSPITAL_FIELDS = ["name", "license_number", "phone", "email", "pincode", "address", "city", "state", "admin_email"]


def _existing_emails(hospitals: DataFrame | None) -> DataFrame | None:
    if hospitals is None or "email" not in hospitals.columns:
        return None
    return hospitals.select("email").filter(F.col("email").isNotNull())


def _hospital_rows(winners: DataFrame, key: str) -> DataFrame:
    """Hospital rows (without the password) from application payloads."""
    return winners.select(make_id("HOSP-", key).alias("hospital_id"), "app_id", *[F.col("__p." + f).alias(f) for f in HOSPITAL_FIELDS])


def hospital_backfill(applications: DataFrame, hospitals: DataFrame | None = None) -> DataFrame:
    """Approved applications (after U9) without a hospital of the same
    email become hospitals, whole rows; the first application per email wins.
    A NULL email equals no other, so each such application makes one."""
    apps = _payload(status_normalised(applications)).filter(F.col("status") == "approved") \
        .select("app_id", "__p", F.col("__p.email").alias("__email"))
    first = (apps.filter(F.col("__email").isNotNull()).groupBy("__email")
             .agg(F.min_by(F.struct("app_id", "__p"), F.col("app_id")).alias("__f")))
    existing = _existing_emails(hospitals)
    if existing is not None:
        first = first.join(existing.withColumnRenamed("email", "__email"), "__email", "left_anti")
    nameless = apps.filter(F.col("__email").isNull()).select("app_id", "__p")
    return _hospital_rows(first.select("__f.*").unionByName(nameless), "app_id")


def _judged(applications: DataFrame, decisions: DataFrame, hospitals: DataFrame | None) -> DataFrame:
    """Decisions with their application's payload and whether they took effect."""
    apps = _payload(applications).select("app_id", "__p")
    d = decisions.select("decision_id", "app_id", F.col("status").alias("__status"), F.col("comments").alias("__comments"),
                         "decided_at").join(apps, "app_id")
    d = d.withColumn("__at", F.struct("decided_at", "decision_id")).withColumn("__email", F.col("__p.email"))
    approvals = d.filter((F.col("__status") == "approved") & F.col("__email").isNotNull())
    winners = approvals.groupBy("__email").agg(F.min("__at").alias("__first"))
    existing = _existing_emails(hospitals)
    if existing is not None:
        winners = winners.join(existing.withColumnRenamed("email", "__email"), "__email", "left_anti")
    j = d.join(winners, "__email", "left")
    creates = (F.col("__status") == "approved") & (F.col("__email").isNull() | (F.col("__at") == F.col("__first")))
    creates = F.coalesce(creates, F.lit(False))
    return j.withColumn("creates", creates).withColumn(
        "applied", F.col("creates") | F.coalesce(F.col("__status") != "approved", F.lit(True)))


def apply_decisions(applications: DataFrame, decisions: DataFrame, hospitals: DataFrame | None = None) -> DataFrame:
    """Applications after every decision (decision_id, app_id, status,
    comments, decided_at) in order of (decided_at, decision_id).

    A decision sets status and comments; an 'approved' one (exact word) also
    creates a hospital, in the same transaction. Hospital emails are unique,
    so an approval whose email is taken (by an earlier approval of any
    application, or by an existing hospital) fails as a whole. The last
    decision that took effect shows; ``hospital_id`` is the (first) hospital
    the application made. ``decided_hospitals`` gives the hospital rows.
    """
    took = _judged(applications, decisions, hospitals).filter("applied")
    last = took.groupBy("app_id").agg(
        F.max_by(F.struct("__status", "__comments"), "__at").alias("__d"), F.count(F.lit(1)).alias("__n"),
        F.min(F.when(F.col("creates"), F.col("__at"))).alias("__h"))
    j = applications.join(last, "app_id", "left")
    old_comments = F.col("comments") if "comments" in applications.columns else F.lit(None).cast("string")
    done = F.col("__n").isNotNull()
    return j.select(
        "app_id", F.when(done, F.col("__d.__status")).otherwise(F.col("status")).alias("status"),
        F.when(done, F.col("__d.__comments")).otherwise(old_comments).alias("comments"),
        F.when(F.col("__h").isNotNull(), make_id("HOSP-", F.col("__h.decision_id"))).alias("hospital_id"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_applied"))


def decided_hospitals(applications: DataFrame, decisions: DataFrame, hospitals: DataFrame | None = None) -> DataFrame:
    """The hospital rows that approvals create, whole (see ``apply_decisions``)."""
    made = _judged(applications, decisions, hospitals).filter("creates")
    return _hospital_rows(made, "decision_id").join(
        made.select(make_id("HOSP-", "decision_id").alias("hospital_id"), F.col("decided_at").alias("created_at")), "hospital_id")


def applications_append(requests: DataFrame, key: str = "request_id", at: str = "requested_at") -> DataFrame:
    """New applications: payload kept as JSON (nulls written), status
    'pending', empty comment, deterministic id from the request key, created
    when the request came (``at``; NULL where the requests do not tell)."""
    fields = [f.split(" ")[0] for f in APPLICATION_PAYLOAD.split(", ")]
    payload = F.to_json(F.struct(*[F.col(c) if c in requests.columns else F.lit(None).cast("string").alias(c)
                                   for c in fields]), {"ignoreNullFields": "false"})
    return requests.select(make_id("APP-", key).alias("app_id"), payload.alias("data"),
                           F.lit("pending").alias("status"), F.lit("").alias("comments"),
                           (F.col(at) if at in requests.columns else F.lit(None)).cast("timestamp_ntz").alias("created_at"))


# ---------------------------------------------------------------- staff
def staff_after_removal(staff: DataFrame, tombstones: DataFrame) -> DataFrame:
    """U8: delete by (staff_id, hospital); a tombstone naming another hospital deletes nothing."""
    return staff.join(tombstones.select("staff_id", "hospital_id"), ["staff_id", "hospital_id"], "left_anti")


def staff_append(requests: DataFrame, taken_usernames: DataFrame | None = None,
                 order_col: str = "request_id") -> DataFrame:
    """New staff rows under the caller's hospital; usernames stay unique:
    the first request per username wins and taken usernames are refused."""
    first = (requests.groupBy("username")
             .agg(F.min_by(F.struct(order_col, "hospital_id", "name", "role"), F.col(order_col)).alias("__f"))
             .select("username", "__f.*"))
    if taken_usernames is not None:
        first = first.join(taken_usernames.select("username"), "username", "left_anti")
    return first.select(make_id("STAFF-", "username").alias("staff_id"), "hospital_id", "name", "username", "role")
