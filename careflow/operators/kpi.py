"""Dashboard figures.

Every figure is a partial + final hash aggregate; the windows that remain
(shares of the maximum, the six-row token board) run over already aggregated
or already limited frames whose size does not grow with the data.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow import schemas as S
from careflow.functions.common import literal_frame


def _day_bounds(df: DataFrame, col: str, as_of):
    """[as_of, as_of + 1 day) as literals of the column's own timestamp type."""
    day = as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(str(as_of))
    t = df.schema[col].dataType
    lo = F.lit(day.isoformat() + " 00:00:00").cast(t)
    hi = F.lit((day + _dt.timedelta(days=1)).isoformat() + " 00:00:00").cast(t)
    return lo, hi


def on_day(df: DataFrame, col: str, as_of) -> F.Column:
    """P3 predicate: a half-open range, so it reaches the parquet scan."""
    lo, hi = _day_bounds(df, col, as_of)
    return (F.col(col) >= lo) & (F.col(col) < hi)


def today_patients(patients: DataFrame, as_of) -> DataFrame:
    """Patients registered on ``as_of`` (an argument, never the clock)."""
    return patients.filter(on_day(patients, "created_at", as_of))


def kpi_summary(patients: DataFrame, consultations: DataFrame, lab_orders: DataFrame,
                prescriptions: DataFrame, as_of) -> DataFrame:
    """A1: the dashboard totals in one row.

    One conditional aggregation per table (each a single scan with partial
    aggregation), combined as scalar subqueries of a one-row frame.
    """
    p = patients.agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.count_if(on_day(patients, "created_at", as_of)).alias("today_patients"),
        F.count_if(F.col("checked_in") == 1).alias("checked_in"))
    c = consultations.agg(
        F.count(F.lit(1)).alias("total_consultations"),
        F.count_if(F.col("severity").isin(S.ALERT_SEVERITIES)).alias("emergency_alerts"))
    lab = lab_orders.agg(
        F.count_if(F.col("status") == "completed").alias("lab_completed"),
        F.count_if(F.col("status") == "pending").alias("lab_pending"))
    rx = prescriptions.agg(
        F.count_if(F.col("status") == "dispensed").alias("pharmacy_dispensed"),
        F.count_if(F.col("status") == "pending").alias("pharmacy_pending"))
    # one struct-valued scalar subquery per table: each table is aggregated once
    cs, ls, rs = (x.select(F.struct(*x.columns)).scalar() for x in (c, lab, rx))
    return p.select(
        "total_patients", "today_patients", "checked_in",
        cs["total_consultations"].alias("total_consultations"),
        cs["emergency_alerts"].alias("emergency_alerts"),
        ls["lab_completed"].alias("lab_completed"),
        ls["lab_pending"].alias("lab_pending"),
        rs["pharmacy_dispensed"].alias("pharmacy_dispensed"),
        rs["pharmacy_pending"].alias("pharmacy_pending"),
    )


def severity_breakdown(consultations: DataFrame) -> DataFrame:
    """A2: consultations per severity; NULL is its own group."""
    return consultations.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def language_breakdown(patients: DataFrame) -> DataFrame:
    """A3: patients per language; NULL is its own group."""
    return patients.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def breakdown_map(breakdown: DataFrame, key: str, value: str = "n") -> DataFrame:
    """A4: a breakdown as one map; the NULL key becomes 'null' as in JSON.

    Collects an aggregated frame, whose size is the vocabulary, not the data.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return breakdown.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, F.col(value)))))
                         .alias(f"{key}_breakdown"))


def language_labels(spark: SparkSession, breakdown: DataFrame) -> DataFrame:
    """Language code to its dashboard label, falling back to the code."""
    dim = F.broadcast(literal_frame(spark, sorted(S.DASHBOARD_LANGUAGE_LABELS.items()),
                                    "language string, label string"))
    out = breakdown.join(dim, "language", "left")
    return out.select("language", F.coalesce("label", "language", F.lit("null")).alias("label"), "n")


def severity_zero_filled(spark: SparkSession, breakdown: DataFrame) -> DataFrame:
    """The four chart severities in order, 0 when absent; others dropped."""
    dim = F.broadcast(literal_frame(spark, [(s, i + 1) for i, s in enumerate(S.SEVERITY_ORDER)],
                                    "severity string, ord int"))
    out = dim.join(breakdown, "severity", "left")
    return out.select("severity", "ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def share_of_max(spark: SparkSession, breakdown: DataFrame) -> DataFrame:
    """Each language's share of the largest group, largest first.

    The window runs over the aggregated frame only (one row per language).
    """
    labelled = language_labels(spark, breakdown)
    w = Window.partitionBy()
    out = labelled.withColumn("share_pct", F.round(F.col("n").cast("double") * 100 / F.max("n").over(w), 6))
    return out.orderBy(F.col("n").desc(), F.col("language").asc_nulls_first())


def severity_share(spark: SparkSession, breakdown: DataFrame) -> DataFrame:
    """A10: zero-filled severities as a share of the maximum over *all* groups."""
    zf = severity_zero_filled(spark, breakdown)
    mx = breakdown.agg(F.max("n").alias("mx"))
    return zf.select("severity", "ord", "n",
                     F.round(F.col("n").cast("double") * 100 / mx.select("mx").scalar(), 6).alias("share_pct"))


def hospital_counts(hospitals: DataFrame, staff: DataFrame, patients: DataFrame) -> DataFrame:
    """A5: staff and patient count per hospital, 0 when none (one pass each)."""
    sc = staff.groupBy("hospital_id").agg(F.count(F.lit(1)).alias("staff_count"))
    pc = patients.groupBy("hospital_id").agg(F.count(F.lit(1)).alias("patient_count"))
    out = hospitals.join(sc, "hospital_id", "left").join(pc, "hospital_id", "left")
    return out.select("hospital_id", "name", F.lit("approved").alias("status"),
                      F.coalesce("staff_count", F.lit(0)).cast("long").alias("staff_count"),
                      F.coalesce("patient_count", F.lit(0)).cast("long").alias("patient_count"))


def staff_by_role(staff: DataFrame) -> DataFrame:
    """Staff per hospital and role."""
    return staff.groupBy("hospital_id", "role").agg(F.count(F.lit(1)).alias("n"))


def platform_summary(applications: DataFrame, hospital_counts_df: DataFrame) -> DataFrame:
    """Pending applications, approved hospitals, patients of those hospitals."""
    h = hospital_counts_df.agg(
        F.count_if(F.col("status") == "approved").alias("active_hospitals"),
        F.coalesce(F.sum("patient_count"), F.lit(0)).cast("long").alias("total_patients"))
    a = applications.agg(F.count_if(F.col("status") == "pending").alias("pending_applications"))
    hs = h.select(F.struct(*h.columns)).scalar()
    return a.select("pending_applications", hs["active_hospitals"].alias("active_hospitals"),
                    hs["total_patients"].alias("total_patients"))


def dept_percent() -> F.Column:
    """Percent of ``completed`` in completed and ``pending``; 0 when there is neither."""
    total = F.col("completed") + F.col("pending")
    return F.when(total > 0, F.round(F.col("completed").cast("double") * 100 / total, 6)).otherwise(F.lit(0.0))


def dept_completion(lab_orders: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """Completion percent per department; 0 when nothing is open or done."""
    lab = lab_orders.agg(F.count_if(F.col("status") == "completed").alias("completed"),
                         F.count_if(F.col("status") == "pending").alias("pending")) \
        .withColumn("dept", F.lit("lab"))
    rx = prescriptions.agg(F.count_if(F.col("status") == "dispensed").alias("completed"),
                           F.count_if(F.col("status") == "pending").alias("pending")) \
        .withColumn("dept", F.lit("pharmacy"))
    return lab.unionByName(rx).select("dept", "completed", "pending", dept_percent().alias("percent"))


def recent_patients(patients: DataFrame, k: int = 10) -> DataFrame:
    """The k most recent patients (top-k; patient_id breaks ties)."""
    return (patients.orderBy(F.col("created_at").desc(), F.col("patient_id").asc())
            .limit(k)
            .select("patient_id", "name", "token_number", "room_number", "language", "created_at"))


def active_tokens(patients: DataFrame, as_of) -> DataFrame:
    """today's tokens by number."""
    return (today_patients(patients, as_of)
            .select("patient_id", "name", "token_number", "room_number", "checked_in")
            .orderBy("token_number", "patient_id"))


def token_board(patients: DataFrame, as_of, k: int = 6) -> DataFrame:
    """The first six tokens of the day, the first one 'now serving'.

    The limit is the feature (a six-slot board); the ranking runs on those
    six rows only.
    """
    top = active_tokens(patients, as_of).limit(k)
    w = Window.partitionBy().orderBy("token_number", "patient_id")
    return (top.withColumn("slot", F.row_number().over(w).cast("long"))
            .withColumn("now_serving", F.col("slot") == 1))


def workflow_complete(updates: DataFrame, stages: int = 3) -> DataFrame:
    """Patients whose every workflow stage has reported.

    The distinct count is planned as a two-level aggregate (dedup on
    (patient, dept) first), so a hot patient does not stop map-side combine.
    """
    per = updates.filter(F.col("dept").isNotNull()).select("patient_id", "dept").distinct()
    out = per.groupBy("patient_id").agg(F.count(F.lit(1)).alias("stages"))
    return out.filter(F.col("stages") == stages)


def analytics_summary(patients: DataFrame, consultations: DataFrame, lab_orders: DataFrame,
                      prescriptions: DataFrame, as_of) -> DataFrame:
    """The whole dashboard response in one row and one plan: the A1 totals,
    both breakdowns (A2, A3 as maps with the NULL key as 'null') and the ten
    most recent patients (W3, newest first).

    Every part is an aggregate or a top-k; they meet as scalar subqueries,
    so nothing grows with the data except the scans.
    """
    totals = kpi_summary(patients, consultations, lab_orders, prescriptions, as_of)
    sev = breakdown_map(severity_breakdown(consultations), "severity")
    lang = breakdown_map(language_breakdown(patients), "language")
    top = recent_patients(patients)
    w = Window.partitionBy().orderBy(F.col("created_at").desc(), F.col("patient_id").asc())
    recent = (top.withColumn("__slot", F.row_number().over(w))
              .agg(F.sort_array(F.collect_list(F.struct("__slot", *top.columns))).alias("__r"))
              .select(F.transform("__r", lambda x: x.dropFields("__slot")).alias("recent_patients")))
    return totals.select(
        "*",
        sev.select("severity_breakdown").scalar().alias("severity_breakdown"),
        lang.select("language_breakdown").scalar().alias("language_breakdown"),
        recent.select("recent_patients").scalar().alias("recent_patients"))
