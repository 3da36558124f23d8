"""Patient records: history, latest rows, the nested record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow import schemas as S
from careflow.functions.common import latest_by, nonblank_or


def clinical_records(consultations: DataFrame, items: DataFrame, only_these: bool = False) -> DataFrame:
    """Consultations with their lists (prescriptions, lab tests, symptoms).

    One aggregate per list, so a query that reads only some lists computes
    only those (column pruning drops unused aggregates). Prescriptions keep
    (line, part_id) order; tests and symptom words are de-duplicated and
    sorted. A consultation without items has empty lists.

    ``only_these``: ``consultations`` is a selection (latest per patient,
    requested patients, ...); items are semi-joined to it before grouping,
    so lists are built only where they are used. The semi-join is keyed like
    the grouping, so the grouping reuses its partitioning.
    """
    if only_these:
        items = items.join(consultations.select("consultation_id"), "consultation_id", "left_semi")
    lists = (items.groupBy("consultation_id")
             .agg(F.array_sort(F.collect_list(F.struct("line", "part_id", "medicine"))).alias("__rx"),
                  F.array_sort(F.collect_set("test")).alias("lab_tests"),
                  F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set("medicine"),
                                                                      lambda m: F.split(m, " "))))).alias("symptoms"))
             .select("consultation_id", F.transform("__rx", lambda x: x["medicine"]).alias("prescriptions"),
                     "lab_tests", "symptoms"))
    empty = F.array().cast("array<string>")
    return (consultations.join(lists, "consultation_id", "left")
            .withColumn("prescriptions", F.coalesce("prescriptions", empty))
            .withColumn("lab_tests", F.coalesce("lab_tests", empty))
            .withColumn("symptoms", F.coalesce("symptoms", empty)))


def history_with_hospital(consultations: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Consultations with the hospital name, 'Unknown Hospital' when absent."""
    h = hospitals.select("hospital_id", F.col("name").alias("hospital_name"))
    out = consultations.join(h, "hospital_id", "left")
    return (out.select("consultation_id", "patient_id",
                       nonblank_or("hospital_name", S.UNKNOWN_HOSPITAL).alias("hospital_name"),
                       "diagnosis", "severity", "followup", "created_at")
            .orderBy("patient_id", F.col("created_at").desc(), F.col("consultation_id").desc()))


def latest_consultation(consultations: DataFrame) -> DataFrame:
    """Latest consultation per patient (created_at, then id, descending)."""
    return latest_by(consultations, "patient_id", ["created_at", "consultation_id"],
                     ["severity", "diagnosis", "followup", "hospital_id"])


def latest_lab(lab_orders: DataFrame) -> DataFrame:
    """Latest lab order per patient."""
    return latest_by(lab_orders, "patient_id", ["created_at", "order_id"], ["status"])


def latest_rx(prescriptions: DataFrame) -> DataFrame:
    """Latest prescription per patient."""
    return latest_by(prescriptions, "patient_id", ["created_at", "rx_id"], ["status"])


def latest_followup(consultations: DataFrame) -> DataFrame:
    """The follow-up of each patient's latest consultation (may be NULL)."""
    return latest_by(consultations, "patient_id", ["created_at", "consultation_id"], ["followup"]) \
        .select("patient_id", "followup")


def record_defaults(patients: DataFrame, consultations: DataFrame, lab_orders: DataFrame,
                    prescriptions: DataFrame, hospitals: DataFrame) -> DataFrame:
    """Per patient, latest statuses with the record defaults.

    Lab and pharmacy status default to 'not_ordered' / 'not_prescribed', tests
    and medicines (JSON text) to [] and results to {}. The
    hospital name ('Unknown Hospital' when blank or absent) and the follow-up
    belong to the latest consultation: without one, the follow-up is '' and
    there is no hospital name; with one, a NULL follow-up stays NULL.
    """
    lc = latest_consultation(consultations).select("patient_id", "consultation_id", "hospital_id", "followup")
    h = hospitals.select("hospital_id", F.col("name").alias("hospital_name"))
    lc = lc.join(h, "hospital_id", "left").drop("hospital_id")
    ll = latest_by(lab_orders, "patient_id", ["created_at", "order_id"], ["status", "tests", "results"]).select(
        "patient_id", F.col("status").alias("lab_status"), F.col("tests").alias("lab_tests"),
        F.col("results").alias("lab_results"))
    lr = latest_by(prescriptions, "patient_id", ["created_at", "rx_id"], ["status", "medicines"]).select(
        "patient_id", F.col("status").alias("pharmacy_status"), "medicines")
    base = patients.select("patient_id")
    out = base.join(lc, "patient_id", "left").join(ll, "patient_id", "left").join(lr, "patient_id", "left")
    return out.select(
        "patient_id",
        F.coalesce("lab_status", F.lit(S.NO_LAB_STATUS)).alias("lab_status"),
        F.coalesce("lab_tests", F.lit(S.EMPTY_LIST)).alias("lab_tests"),
        F.coalesce("lab_results", F.lit(S.EMPTY_MAP)).alias("lab_results"),
        F.coalesce("pharmacy_status", F.lit(S.NO_RX_STATUS)).alias("pharmacy_status"),
        F.coalesce("medicines", F.lit(S.EMPTY_LIST)).alias("medicines"),
        F.when(F.col("consultation_id").isNotNull(), nonblank_or("hospital_name", S.UNKNOWN_HOSPITAL))
        .alias("hospital_name"),
        F.when(F.col("consultation_id").isNull(), F.lit("")).otherwise(F.col("followup")).alias("followup"),
    )


def patient_record(patients: DataFrame, clinical: DataFrame, hospitals: DataFrame,
                   lab_orders: DataFrame, prescriptions: DataFrame, updates: DataFrame,
                   requests: DataFrame | None = None) -> DataFrame:
    """J6 + W8: the nested record of every patient (or of the requested
    ``patient_id``s) in one pass: lists of history, lab, prescription and
    department rows, newest first, the latest lab and pharmacy state as
    objects, and the latest consultation with its route. ``patient_timeline``
    is the flat form, which gathers nothing per patient.

    Four pre-aggregations (one list per patient and kind) are left-joined on
    patient_id, so rows never multiply across kinds. The latest of each kind
    is element 0 of its list, with the record defaults. Each output row holds
    a patient's whole history by definition, so its size is that history;
    the figures derived from it are in ``patient_record_summary``, which
    needs no lists.
    """
    if requests is not None:
        ids = requests.select("patient_id").distinct()
        patients, clinical, lab_orders, prescriptions, updates = (
            t.join(ids, "patient_id", "left_semi") for t in (patients, clinical, lab_orders, prescriptions, updates))
    h = hospitals.select("hospital_id", F.col("name").alias("hospital_name"))
    hist = (clinical.join(h, "hospital_id", "left")
            .groupBy("patient_id")
            .agg(F.sort_array(F.collect_list(F.struct(
                "created_at", "consultation_id",
                nonblank_or("hospital_name", S.UNKNOWN_HOSPITAL).alias("hospital_name"),
                "diagnosis", "severity", "symptoms", "prescriptions", "lab_tests", "followup", "clinical_notes"))
                , asc=False).alias("history")))
    labs = (lab_orders.groupBy("patient_id")
            .agg(F.sort_array(F.collect_list(F.struct("created_at", "order_id", "status", "tests", "results")),
                             asc=False)
                 .alias("lab_history")))
    rxs = (prescriptions.groupBy("patient_id")
           .agg(F.sort_array(F.collect_list(F.struct("created_at", "rx_id", "status", "medicines")), asc=False)
                .alias("prescription_history")))
    ups = (updates.groupBy("patient_id")
           .agg(F.sort_array(F.collect_list(F.struct("updated_at", "update_id", "dept", "action", "data")),
                             asc=False).alias("dept_updates")))
    rec = (patients.join(hist, "patient_id", "left").join(labs, "patient_id", "left")
           .join(rxs, "patient_id", "left").join(ups, "patient_id", "left"))
    return rec.select(
        "*",
        F.struct(F.coalesce(F.col("lab_history")[0]["status"], F.lit(S.NO_LAB_STATUS)).alias("status"),
                 F.coalesce(F.col("lab_history")[0]["tests"], F.lit(S.EMPTY_LIST)).alias("tests"),
                 F.coalesce(F.col("lab_history")[0]["results"], F.lit(S.EMPTY_MAP)).alias("results"))
        .alias("lab_status"),
        F.struct(F.coalesce(F.col("prescription_history")[0]["status"], F.lit(S.NO_RX_STATUS)).alias("status"),
                 F.coalesce(F.col("prescription_history")[0]["medicines"], F.lit(S.EMPTY_LIST)).alias("medicines"))
        .alias("pharmacy_status"),
        F.when(F.col("history").isNotNull(), F.col("history")[0].withField("route_to", F.array_compact(F.array(
            F.when(F.size(F.col("history")[0]["lab_tests"]) > 0, F.lit("lab")),
            F.when(F.size(F.col("history")[0]["prescriptions"]) > 0, F.lit("pharmacy"))))))
        .alias("consultation"),
    )


def patient_record_summary(patients: DataFrame, consultations: DataFrame, items: DataFrame | None, hospitals: DataFrame,
                           lab_orders: DataFrame, prescriptions: DataFrame, updates: DataFrame) -> DataFrame:
    """Scalar projection of J6: history sizes and latest values per patient.

    Built from partial aggregates only (``count``, ``max_by``); unlike the
    nested record it never gathers a patient's history into one row, so a
    patient with a third of all consultations costs no more than others.
    The prescription list is built for each patient's latest consultation
    only; without ``items`` the consultations hold their lists themselves (as
    stored clinical rows do). Over tables bucketed by patient
    (``state_tables.co_bucketed``) nothing but the hospitals is moved.
    """
    h = hospitals.select("hospital_id", F.col("name").alias("hospital_name"))
    own = ["prescriptions"] if items is None else []
    c = (consultations.groupBy("patient_id")
         .agg(F.count(F.lit(1)).alias("n_consultations"),
              F.max_by(F.struct("consultation_id", "hospital_id", *own),
                       F.struct("created_at", "consultation_id")).alias("__c"))
         .select("patient_id", "n_consultations", F.col("__c.consultation_id").alias("latest_consultation_id"),
                 F.col("__c.hospital_id").alias("__hid"), *[F.col("__c." + x).alias("__rx") for x in own]))
    if items is not None:
        latest_lists = clinical_records(c.select(F.col("latest_consultation_id").alias("consultation_id")),
                                        items, only_these=True) \
            .select(F.col("consultation_id").alias("latest_consultation_id"), F.col("prescriptions").alias("__rx"))
        c = c.join(latest_lists, "latest_consultation_id", "left")
    c = c.join(h, c["__hid"] == h["hospital_id"], "left").drop("hospital_id", "__hid")
    lab = (lab_orders.groupBy("patient_id")
           .agg(F.count(F.lit(1)).alias("n_lab_orders"),
                F.max_by("status", F.struct("created_at", "order_id")).alias("__lab")))
    rx = (prescriptions.groupBy("patient_id")
          .agg(F.count(F.lit(1)).alias("n_prescriptions"),
               F.max_by("status", F.struct("created_at", "rx_id")).alias("__rxs")))
    up = (updates.groupBy("patient_id")
          .agg(F.count(F.lit(1)).alias("n_updates"),
               F.max_by("update_id", F.struct("updated_at", "update_id")).alias("latest_update_id")))
    rec = (patients.select("patient_id", "name").join(c, "patient_id", "left").join(lab, "patient_id", "left")
           .join(rx, "patient_id", "left").join(up, "patient_id", "left"))
    zero = F.lit(0).cast("long")
    return rec.select(
        "patient_id", "name",
        F.coalesce("n_consultations", zero).alias("n_consultations"),
        F.coalesce("n_lab_orders", zero).alias("n_lab_orders"),
        F.coalesce("n_prescriptions", zero).alias("n_prescriptions"),
        F.coalesce("n_updates", zero).alias("n_updates"),
        "latest_consultation_id",
        F.when(F.col("latest_consultation_id").isNotNull(), nonblank_or("hospital_name", S.UNKNOWN_HOSPITAL))
        .alias("latest_hospital_name"),
        F.to_json("__rx").alias("latest_prescriptions"),
        F.coalesce("__lab", F.lit(S.NO_LAB_STATUS)).alias("lab_status"),
        F.coalesce("__rxs", F.lit(S.NO_RX_STATUS)).alias("pharmacy_status"),
        "latest_update_id",
    )


def past_visits(consultations: DataFrame) -> DataFrame:
    """Past visits = history length - 1, for patients with more than one."""
    return (consultations.groupBy("patient_id").agg(F.count(F.lit(1)).alias("visits"))
            .filter(F.col("visits") > 1)
            .select("patient_id", (F.col("visits") - 1).alias("past_visits")))


def record_sheet(patients: DataFrame, clinical: DataFrame) -> DataFrame:
    """Data of the printable record from each patient's latest consultation."""
    latest = latest_by(clinical, "patient_id", ["created_at", "consultation_id"],
                       ["diagnosis", "severity", "followup", "symptoms", "prescriptions", "lab_tests",
                        "clinical_notes"])
    sev = F.lower(F.col("severity"))
    band = F.lit(S.OTHER_BAND)
    for name, colour in reversed(list(S.SEVERITY_BANDS.items())):
        band = F.when(sev == name, F.lit(colour)).otherwise(band)
    people = patients.select("patient_id", "name")
    return latest.join(people, "patient_id", "inner").select(
        "patient_id", "name", "consultation_id", "diagnosis",
        F.when(F.size("symptoms") > 0, F.array_join("symptoms", ", ")).otherwise(F.lit(S.NO_SYMPTOMS))
        .alias("symptoms_text"),
        F.when(F.size("prescriptions") > 0, F.array_join("prescriptions", ", ")).otherwise(F.lit(S.NO_ITEMS))
        .alias("prescriptions_text"),
        F.when(F.size("lab_tests") > 0, F.array_join("lab_tests", ", ")).otherwise(F.lit(S.NO_ITEMS))
        .alias("lab_tests_text"),
        F.upper("severity").alias("severity_label"),
        band.alias("band"),
        "followup", "clinical_notes",
    )


def medicine_lines(consultations: DataFrame, items: DataFrame) -> DataFrame:
    """One row per prescribed medicine, numbered from 1 in (line, part) order.

    Items are ranked where they are; no list is built.
    """
    rank = F.row_number().over(Window.partitionBy("consultation_id").orderBy("line", "part_id"))
    ranked = items.select("consultation_id", rank.cast("long").alias("line_no"), "medicine")
    return consultations.select("consultation_id", "patient_id").join(ranked, "consultation_id")


def patient_timeline(clinical: DataFrame, hospitals: DataFrame, lab_orders: DataFrame, prescriptions: DataFrame,
                     updates: DataFrame) -> DataFrame:
    """J6 + W8, flat: one row per history, lab, prescription and department
    entry of every patient, keyed (patient_id, kind, at, item_id), its fields
    as JSON. No patient's history is gathered into one row, so a patient with
    a third of all rows is spread like the rest; sort or group as needed.
    """
    h = hospitals.select("hospital_id", F.col("name").alias("hospital_name"))
    visits = clinical.join(h, "hospital_id", "left").select(
        "patient_id", F.lit("history").alias("kind"), F.col("created_at").alias("at"),
        F.col("consultation_id").alias("item_id"),
        _json(nonblank_or("hospital_name", S.UNKNOWN_HOSPITAL).alias("hospital_name"), "diagnosis", "severity",
              "symptoms", "prescriptions", "lab_tests", "followup", "clinical_notes"))
    labs = lab_orders.select("patient_id", F.lit("lab").alias("kind"), F.col("created_at").alias("at"),
                             F.col("order_id").alias("item_id"), _json("status", "tests", "results"))
    rxs = prescriptions.select("patient_id", F.lit("prescription").alias("kind"), F.col("created_at").alias("at"),
                               F.col("rx_id").alias("item_id"), _json("status", "medicines"))
    ups = updates.select("patient_id", F.lit("update").alias("kind"), F.col("updated_at").alias("at"),
                         F.col("update_id").alias("item_id"), _json("dept", "action", "data"))
    return visits.unionByName(labs).unionByName(rxs).unionByName(ups)


def _json(*fields):
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("detail")
