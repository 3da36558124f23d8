"""Work queues of the lab and the pharmacy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.functions.common import prefix_position


def pending_queue(orders: DataFrame, patients: DataFrame, id_col: str,
                  hospital_id=None) -> DataFrame:
    """Pending orders joined to their patient, oldest first.

    The hospital is the patient's current one. The status filter sits under
    the join and reaches the scan; only five patient columns are read. Both
    sides are keyed by patient_id, so at scale this is one shuffle join (AQE
    turns it into a broadcast when the pending side is small, and splits a
    hot patient's partition when one patient is skewed).
    """
    pending = orders.filter(F.col("status") == F.lit("pending")).select("patient_id", id_col, "created_at")
    people = patients.select("patient_id", "name", "token_number", "hospital_id")
    if hospital_id is not None:
        people = people.filter(F.col("hospital_id") == F.lit(hospital_id))
    q = pending.join(people, "patient_id", "inner")
    return q.select("hospital_id", "patient_id", "name", "token_number", id_col, "created_at")


def pharmacy_pending(prescriptions: DataFrame, patients: DataFrame, hospital_id=None) -> DataFrame:
    """Pending prescriptions for every hospital (or one, if given)."""
    q = pending_queue(prescriptions, patients, "rx_id", hospital_id)
    return q.orderBy("hospital_id", "created_at", "rx_id")


def lab_pending(lab_orders: DataFrame, patients: DataFrame, hospital_id=None) -> DataFrame:
    """Pending lab orders for every hospital (or one, if given)."""
    q = pending_queue(lab_orders, patients, "order_id", hospital_id)
    return q.orderBy("hospital_id", "created_at", "order_id")


def queue_position(lab_queue: DataFrame, rx_queue: DataFrame) -> DataFrame:
    """1-based FIFO position per (hospital, department).

    Takes unsorted queues (``pending_queue``). Ranges of the prefix count
    follow the data, so one hospital or day holding a third of all pending
    orders is still ranked by many tasks.
    """
    both = (lab_queue.select("hospital_id", F.lit("lab").alias("dept"), "patient_id",
                             F.col("order_id").alias("item_id"), "created_at")
            .unionByName(rx_queue.select("hospital_id", F.lit("pharmacy").alias("dept"), "patient_id",
                                         F.col("rx_id").alias("item_id"), "created_at")))
    return prefix_position(both, ["hospital_id", "dept"], "created_at", "item_id")


def queue_length(lab_queue: DataFrame, rx_queue: DataFrame) -> DataFrame:
    """Queue length per hospital and department (partial aggregation)."""
    lab = lab_queue.groupBy("hospital_id").agg(F.count(F.lit(1)).alias("n")).withColumn("dept", F.lit("lab"))
    rx = rx_queue.groupBy("hospital_id").agg(F.count(F.lit(1)).alias("n")).withColumn("dept", F.lit("pharmacy"))
    return lab.unionByName(rx).select("hospital_id", "dept", "n")


def tenant_scope(df: DataFrame, hospital_id, col: str = "hospital_id") -> DataFrame:
    """Rows of one hospital; ``None`` (system admin) sees everything."""
    if hospital_id is None:
        return df
    return df.filter(F.col(col) == F.lit(hospital_id))
