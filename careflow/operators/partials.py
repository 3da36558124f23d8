"""A1 / A8 from mergeable daily partials.

A batch of new rows becomes one small row of counts per (day, hospital), appended
under the batch's own folder; the dashboard adds up these rows. A new day costs the
reading of that day; a batch that is folded again replaces its own rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow import schemas as S
from careflow.operators.kpi import dept_percent

COUNTS = ["total_patients", "checked_in", "total_consultations", "emergency_alerts", "lab_completed", "lab_pending",
          "pharmacy_dispensed", "pharmacy_pending"]


def daily_partials(patients: DataFrame, consultations: DataFrame, lab_orders: DataFrame, prescriptions: DataFrame) -> DataFrame:
    """day, hospital_id and the counts of the rows created that day.

    Orders have no hospital of their own: theirs is NULL. A NULL day holds rows
    without a time. Each table is aggregated once, with a map-side partial step.
    """
    rules = [
        (patients, {"total_patients": F.lit(True), "checked_in": F.col("checked_in") == 1}),
        (consultations, {"total_consultations": F.lit(True), "emergency_alerts": F.col("severity").isin(S.ALERT_SEVERITIES)}),
        (lab_orders, {"lab_completed": F.col("status") == "completed", "lab_pending": F.col("status") == "pending"}),
        (prescriptions, {"pharmacy_dispensed": F.col("status") == "dispensed", "pharmacy_pending": F.col("status") == "pending"}),
    ]
    parts = []
    for table, counts in rules:
        hospital = F.col("hospital_id").cast("int") if "hospital_id" in table.columns else F.lit(None).cast("int")
        keyed = table.withColumn("day", F.to_date("created_at")).withColumn("__hospital", hospital)
        zero = [F.lit(0).cast("long").alias(c) for c in COUNTS if c not in counts]
        agg = keyed.groupBy("day", "__hospital").agg(*[F.count_if(rule).alias(c) for c, rule in counts.items()])
        parts.append(agg.select("day", F.col("__hospital").alias("hospital_id"), *counts, *zero))
    return merged(reduce(DataFrame.unionByName, parts))


def merged(partials: DataFrame) -> DataFrame:
    """One row per (day, hospital): partials are sums, so any may be added up in any order."""
    return partials.groupBy("day", "hospital_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def fold(partials: DataFrame, path: str, batch: int) -> None:
    """Store a batch's partials; the same batch again replaces them."""
    partials.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return merged(spark.read.parquet(path).drop("batch"))


def compact(spark: SparkSession, path: str, into: str) -> None:
    """All batches as one, in a new folder (the old one is left as it is)."""
    fold(read_partials(spark, path), into, 0)


def kpi_from_partials(partials: DataFrame, as_of) -> DataFrame:
    """A1: ``kpi_summary`` of all rows folded so far."""
    today = F.sum(F.when(F.col("day") == F.lit(as_of).cast("date"), F.col("total_patients")))
    totals = [F.sum(c).alias(c) for c in COUNTS]
    out = partials.agg(*totals, today.alias("today_patients"))
    return out.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*COUNTS, "today_patients"]])


def dept_completion_from_partials(partials: DataFrame, by_day: bool = False) -> DataFrame:
    """Completion percent per department (and day, if asked for)."""
    keys = ["day"] if by_day else []
    sums = partials.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS[4:]])
    rows = F.inline(F.array(
        F.struct(F.lit("lab").alias("dept"), F.col("lab_completed").alias("completed"), F.col("lab_pending").alias("pending")),
        F.struct(F.lit("pharmacy").alias("dept"), F.col("pharmacy_dispensed").alias("completed"), F.col("pharmacy_pending").alias("pending"))))
    return sums.select(*keys, rows).select(*keys, "dept", "completed", "pending", dept_percent().alias("percent"))
