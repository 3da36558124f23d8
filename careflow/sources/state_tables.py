"""Layouts of the state tables that let a query read and move less.

``co_bucketed``: tables bucketed and sorted by patient, so that joins and
aggregations on patient_id need no shuffle (J6, J1, J2). ``write_tenants`` and
``tenant_rows``: a table partitioned by hospital, of which a caller's rows are
read only, by partition pruning at run time (T1, J11).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.session import scratch_path

NO_TENANT = -1  # the partition of rows without a hospital


def co_bucketed(tables: dict[str, DataFrame], buckets: int, key: str = "patient_id") -> dict[str, DataFrame]:
    """The tables written in ``buckets`` buckets of ``key``, one sorted file each.

    All have the same number of buckets, so a join of any two on the key, or an
    aggregation by it, takes each bucket as it is. A bucket is as large as its
    patients' rows: take their number from the largest table (see ``buckets_for``).
    Rows whose key is NULL share a bucket. The catalog entries are dropped again;
    the files stay under the shared folder and the frames read them.
    """
    out = {}
    for name, df in tables.items():
        spark, entry = df.sparkSession, f"state_{name}_{uuid.uuid4().hex}"
        (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
         .option("path", scratch_path(spark, f"state-{name}")).saveAsTable(entry))
        out[name] = spark.table(entry)
        spark.sql(f"DROP TABLE {entry}")
    return out


def buckets_for(rows: int, rows_per_bucket: int = 2_000_000) -> int:
    """Buckets for the largest of the tables: a power of two, so that a table
    written with fewer buckets still divides evenly."""
    return 1 << max(0, (rows - 1) // rows_per_bucket).bit_length()


def write_tenants(df: DataFrame, path: str, hospital: str = "hospital_id") -> None:
    """Append rows partitioned by ``tenant``, the hospital (-1 for none), and note
    the tenants that the batch has in a small table beside them.

    A hospital's rows are written by as many tasks as had them: none is gathered
    into one task.
    """
    rows = df.withColumn("tenant", F.coalesce(F.col(hospital).cast("long"), F.lit(NO_TENANT)))
    rows.write.mode("append").partitionBy("tenant").parquet(f"{path}/rows")
    rows.select("tenant").distinct().coalesce(1).write.mode("append").parquet(f"{path}/tenants")


def tenant_rows(spark: SparkSession, path: str, principals: DataFrame) -> DataFrame:
    """T1 for callers (key, role, hospital_id): the rows each may see, with its key.

    A system admin sees every row, those without a hospital included; others see
    their hospital's; a caller without a hospital sees nothing. The callers decide
    at run time which partitions are read. Tenants are a small dimension: each is
    listed under its own id and under ``*``, so callers meet theirs by an equal key.
    """
    tenants = spark.read.schema("tenant long").parquet(f"{path}/tenants").distinct()
    scopes = tenants.select("tenant", F.explode(F.array(F.col("tenant").cast("string"), F.lit("*"))).alias("scope"))
    scope = F.when(F.col("role") == "system_admin", F.lit("*")).otherwise(F.col("hospital_id").cast("string"))
    seen = principals.select("key", scope.alias("scope")).filter(F.col("scope").isNotNull() & (F.col("scope") != str(NO_TENANT)))
    seen = seen.join(scopes, "scope").select("key", "tenant")
    return spark.read.parquet(f"{path}/rows").join(seen, "tenant").drop("tenant")
