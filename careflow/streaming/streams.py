"""Structured Streaming forms of the event-driven operators.

Sources are file streams over a folder (one file per arriving batch on a
real cluster; the driver tables are single files, picked out with a
file-name filter). Watermarks need TIMESTAMP, the data holds zone-less
TIMESTAMP_NTZ: the wall clock is turned into the instant of that wall clock
in UTC (independent of the session zone), so day windows are local days.

Sinks are idempotent per micro-batch: ``foreachBatch`` writes every output of
a batch under its batch id with mode overwrite, so a batch replayed after a
lost executor or a restart replaces its own files instead of duplicating
them. Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import IntegerType, StructField, StructType, TimestampNTZType

from careflow.operators import predicates as P
from careflow.operators import records
from careflow.operators import registry as U
from careflow.session import scratch_path


# ---------------------------------------------------------------- S8 source
def event_stream(spark: SparkSession, folder: str, schema: StructType, file_glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming parquet source over a folder (schema given, never inferred)."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(folder)


def wall_clock_instant(col: str):
    """A zone-less wall-clock time as the TIMESTAMP of that wall clock in UTC.

    Built from the fields, so it does not depend on the session time zone:
    one-day windows (aligned to UTC midnight) are then exactly the local
    days written in the data, whatever zone the cluster's session uses.
    """
    c = F.col(col)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def day_of_instant(col):
    """Calendar day (UTC) of an instant, by epoch arithmetic (zone-free)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_from_unix_date(F.floor(F.unix_micros(c) / F.lit(86_400_000_000)).cast("int"))


def with_event_time(df: DataFrame, col: str) -> DataFrame:
    """Make a zone-less event time a TIMESTAMP so a watermark can use it."""
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        return df.withColumn(col, wall_clock_instant(col))
    return df


def _run(writer, checkpoint: str, available_now: bool = True):
    w = writer.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    q.awaitTermination()
    return q


def _batch_writer(targets: dict[str, str]):
    """foreachBatch body writing each named frame under <target>/batch_id=<id>."""
    def write(outputs: dict[str, DataFrame], batch_id: int):
        for name, df in outputs.items():
            df.write.mode("overwrite").parquet(os.path.join(targets[name], f"batch_id={batch_id}"))
    return write


# ---------------------------------------------------------------- T2 fan-out
FANOUT = {"lab": U.fanout_orders, "rx": U.fanout_rx}


def stream_fanout_to(consultations: DataFrame, dirs: dict[str, str], checkpoint: str, items: DataFrame | None = None,
                     available_now: bool = True):
    """Every micro-batch of consultation records yields its lab orders and
    prescriptions (U6); each sink of ``dirs`` ('lab', 'rx') is written under
    the batch id.

    Records that carry their lists need nothing else. With ``items``, lists
    are built for the batch's consultations only (items are semi-joined to
    the batch first), so a batch never groups the whole item table.
    """
    sink = _batch_writer(dirs)

    def body(batch: DataFrame, batch_id: int):
        batch.persist()
        try:
            full = batch if items is None else records.clinical_records(batch, items, only_these=True)
            sink({k: FANOUT[k](full) for k in dirs}, batch_id)
        finally:
            batch.unpersist()

    return _run(consultations.writeStream.foreachBatch(body), checkpoint, available_now)


# ---------------------------------------------------------------- T3 alerts
def alert_stream(consultations: DataFrame, patients: DataFrame) -> DataFrame:
    """Stateless filter + stream-static join (J8); append-only."""
    return P.alert_feed(consultations, patients)


# ---------------------------------------------------------------- T4 live department state
def dept_state_stream(updates: DataFrame, dept: str, action: str) -> DataFrame:
    """T4: per patient, the latest closing update and its time, kept as
    streaming state (update mode emits only the patients that changed)."""
    return U.dept_fold_state(updates, dept, action)


def run_dept_state(updates: DataFrame, dept: str, action: str, out_dir: str, checkpoint: str,
                   available_now: bool = True, compact_every: int = 32):
    """T4: write the changed per-patient fold states of every micro-batch
    under its batch id. The work per batch is proportional to the batch (one
    row per changed patient), never to the orders table; order rows are
    derived when read (``orders_under_state``)."""
    q = (dept_state_stream(updates, dept, action).writeStream.outputMode("update")
         .foreachBatch(keyed_sink(out_dir, ["patient_id"], compact_every)))
    return _run(q, checkpoint, available_now)


def run_lab_state(updates: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True):
    """T4 for the lab: 'submitted_results' updates."""
    return run_dept_state(updates, "lab", "submitted_results", out_dir, checkpoint, available_now)


def orders_under_state(spark: SparkSession, orders: DataFrame, state_dir: str, done_status: str = "completed",
                       with_results: bool = True, schema: StructType | None = None) -> DataFrame:
    """Current order rows: the newest state per patient joined to the orders
    (the same rule as the batch fold, U4)."""
    state = latest_snapshot(spark, state_dir, "patient_id", schema)
    return U.apply_dept_state(orders, state, done_status, with_results)


def read_sink(spark: SparkSession, out_dir: str, schema: StructType | None = None) -> DataFrame:
    """Rows of a per-batch sink; an empty frame when no batch ever ran (a
    stream over empty input writes nothing). Works on any file system."""
    try:
        return spark.read.parquet(out_dir)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) or schema is None:
            raise
        return spark.createDataFrame([], StructType(list(schema.fields) + [StructField("batch_id", IntegerType())]))


def _snapshots(out_dir: str) -> str:
    return out_dir.rstrip("/") + "-snapshot"


def keyed_sink(out_dir: str, key: list[str], compact_every: int):
    """foreachBatch body of an update-mode sink: changed rows under the batch
    id, and after every ``compact_every`` batches a snapshot of the newest row
    per key, made of the last snapshot and the batches since. A reader then
    reads one snapshot and fewer than ``compact_every`` batches, however long
    the history; a replayed batch rewrites its own folders."""
    sink = _batch_writer({"out": out_dir})

    def body(changed: DataFrame, batch_id: int):
        sink({"out": changed}, batch_id)
        if (batch_id + 1) % compact_every == 0:
            snap = latest_snapshot(changed.sparkSession, out_dir, key, changed.schema)
            snap.write.mode("overwrite").parquet(os.path.join(_snapshots(out_dir), f"upto={batch_id}"))

    return body


def latest_snapshot(spark: SparkSession, out_dir: str, key: str | list[str], schema: StructType | None = None,
                    before: int | None = None) -> DataFrame:
    """Newest row per key of a foreachBatch sink: the last snapshot, if there
    is one, and the batch folders after it (the others are pruned). ``before``:
    as it was before that batch, for batches that merge into what is there."""
    df = read_sink(spark, out_dir, schema)
    if before is not None:
        df = df.filter(F.col("batch_id") < before)
    cols = [c for c in df.columns if c != "batch_id"]
    keys = [key] if isinstance(key, str) else list(key)
    try:
        snaps = spark.read.parquet(_snapshots(out_dir))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        snaps = snaps if before is None else snaps.filter(F.col("upto") < before)
        upto = snaps.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]  # from folder names
        old = snaps.filter(F.col("upto") == upto).select(*cols, F.col("upto").cast("int").alias("batch_id"))
        df = df.filter(F.col("batch_id") > upto).select(*cols, "batch_id").unionByName(old)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("__r")).select("__r.*")


# ---------------------------------------------------------------- T5 de-duplication
def dedup_stream(updates: DataFrame, delay: str = "1 day", ts: str = "updated_at",
                 key: str = "update_id") -> DataFrame:
    """T5: retried deliveries of one update id are dropped while the
    watermark still remembers the id. The watermark runs on a zone-free copy
    of the event time; the output keeps the original column."""
    if isinstance(updates.schema[ts].dataType, TimestampNTZType):
        u = updates.withColumn("__et", wall_clock_instant(ts))
        return u.withWatermark("__et", delay).dropDuplicatesWithinWatermark([key]).drop("__et")
    return updates.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


# ---------------------------------------------------------------- T6 / T7 daily counters
def daily_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """T6 batch twin: events per (day, type)."""
    return events.groupBy(F.to_date(ts).alias("day"), F.col(kind).alias(kind)).agg(F.count(F.lit(1)).alias("n"))


def daily_counts_stream(events: DataFrame, ts: str = "ts", kind: str = "event_type",
                        delay: str = "1 day") -> DataFrame:
    """Tumbling one-day windows with a one-day watermark. Rows older than
    the watermark are late and dropped (T7); in update mode every open day
    is emitted as it changes."""
    e = with_event_time(events, ts).withWatermark(ts, delay)
    return (e.groupBy(F.window(ts, "1 day").alias("w"), F.col(kind))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(day_of_instant("w.start").alias("day"), kind, "n"))


def run_daily_counts(events: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True,
                     compact_every: int = 32):
    """Update-mode counters into a compacted per-batch sink (see ``keyed_sink``)."""
    body = keyed_sink(out_dir, ["day", "event_type"], compact_every)
    q = daily_counts_stream(events).writeStream.outputMode("update").foreachBatch(body)
    return _run(q, checkpoint, available_now)


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered form of T6: run the stream over the events table to the end
    (availableNow), then read the newest counter per (day, type)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    src = event_stream(spark, sf_dir, schema, file_glob="events.parquet").select("ts", "event_type")
    base = scratch_path(spark, "daily-counts")
    run_daily_counts(src, base + "/out", base + "/checkpoint")
    return latest_snapshot(spark, base + "/out", ["day", "event_type"], daily_counts_stream(src).schema)


# ---------------------------------------------------------------- T7 late rows kept
DAY_MICROS = 86_400_000_000


def late_folder(base: str, ts: str = "ts", kind: str = "event_type", delay: dt.timedelta = dt.timedelta(days=1)):
    """foreachBatch body: daily counts of the rows in time, and the late rows themselves.

    A row is late if its day had ended ``delay`` before the newest event of the earlier
    batches. ``counts`` and ``late`` together hold every row of the input once; a row
    without a time is never late. ``marks`` has a row a batch: the edge that the next
    batch is judged by, and how many rows were late and in time, observed while the
    counts are made. All of it lies under the batch id, so a replay writes the same.
    """
    sink = _batch_writer({name: f"{base}/{name}" for name in ("counts", "late", "marks")})

    def body(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        edge = spark.read.parquet(f"{base}/marks/batch_id={batch_id - 1}").first()["edge"] if batch_id else None
        zone_free = isinstance(batch.schema[ts].dataType, TimestampNTZType)
        at = F.unix_micros(wall_clock_instant(ts) if zone_free else F.col(ts))
        day = F.floor(F.col("__at") / F.lit(DAY_MICROS))
        rows = batch.withColumn("__at", at).withColumn(
            "__late", F.coalesce((day + 1) * DAY_MICROS <= F.lit(edge).cast("long"), F.lit(False)))
        seen = Observation()
        met = rows.observe(seen, F.count_if("__late").alias("late"), F.count_if(~F.col("__late")).alias("in_time"),
                           F.max("__at").alias("newest"))
        counts = met.filter("not __late").groupBy(F.date_from_unix_date(day.cast("int")).alias("day"), kind).agg(
            F.count(F.lit(1)).alias("n"))
        sink({"counts": counts}, batch_id)
        # over no rows the planner leaves the observation out
        got = {"late": 0, "in_time": 0, "newest": None} if batch.isEmpty() else seen.get
        sink({"late": rows.filter("__late").drop("__at", "__late")}, batch_id)
        newest = got["newest"]
        edges = [edge, None if newest is None else newest - delay // dt.timedelta(microseconds=1)]
        mark = [(max((e for e in edges if e is not None), default=None), got["late"], got["in_time"])]
        sink({"marks": spark.createDataFrame(mark, "edge long, late long, in_time long")}, batch_id)

    return body


def run_counts_with_late(events: DataFrame, base: str, ts: str = "ts", kind: str = "event_type",
                         delay: dt.timedelta = dt.timedelta(days=1), available_now: bool = True):
    """T6 / T7 without loss: see ``late_folder``."""
    return _run(events.writeStream.foreachBatch(late_folder(base, ts, kind, delay)), base + "/checkpoint", available_now)


def counts_with_late(spark: SparkSession, base: str, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """day, kind, in_time and late: how many rows came before and after their day was closed."""
    zero = F.lit(0).cast("long")
    counts = spark.read.parquet(f"{base}/counts").select("day", kind, F.col("n").alias("in_time"), zero.alias("late"))
    late = daily_counts(spark.read.parquet(f"{base}/late"), ts, kind).select("day", kind, zero.alias("in_time"), F.col("n").alias("late"))
    return counts.unionByName(late).groupBy("day", kind).agg(F.sum("in_time").alias("in_time"), F.sum("late").alias("late"))


def stream_daily_counts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered form: the events arrive out of order (four files dealt by hash), so
    many are late; counts and late rows together are the daily counts."""
    base = scratch_path(spark, "counts-with-late")
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("ts", "event_type")
    events.repartition(4, F.xxhash64("ts", "event_type")).write.parquet(base + "/in")
    src = event_stream(spark, base + "/in", events.schema, max_files_per_trigger=1)
    run_counts_with_late(src, base)
    return counts_with_late(spark, base).select("day", "event_type", (F.col("in_time") + F.col("late")).alias("n"))


# ---------------------------------------------------------------- registered stream runs
def _run_to_sink(df: DataFrame, spark: SparkSession, name: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming frame to the end of its input (availableNow) into a
    per-batch sink under the shared folder, and read the rows back."""
    base = scratch_path(spark, name)
    sink = _batch_writer({"out": base + "/out"})
    _run(df.writeStream.outputMode(output_mode).foreachBatch(lambda b, i: sink({"out": b}, i)),
         base + "/checkpoint")
    return read_sink(spark, base + "/out", df.schema).drop("batch_id")


def stream_alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 registered: consultations arrive as a stream, patients are static."""
    from careflow.sources.bindings import Bindings
    b = Bindings(spark, sf_dir)
    return _run_to_sink(alert_stream(b.stream_view("b_consultations", "orders"), b.patients), spark, "t3-alerts")


def stream_fanout(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """T2 registered: streaming consultations, whose lists come from the item
    rows of each batch; the sink asked for is written per batch and read back."""
    from careflow.sources.bindings import Bindings
    b = Bindings(spark, sf_dir)
    base = scratch_path(spark, "t2-fanout")
    stream_fanout_to(b.stream_view("b_consultations", "orders"), {which: base + "/" + which}, base + "/checkpoint", b.items)
    out = FANOUT[which](records.clinical_records(b.consultations, b.items))
    return read_sink(spark, base + "/" + which, out.schema).drop("batch_id")


def stream_lab_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 registered: department updates arrive as a stream; the per-patient
    state it maintains is applied to the lab orders when read."""
    from careflow.sources.bindings import Bindings
    b = Bindings(spark, sf_dir)
    base = scratch_path(spark, "t4-lab-state")
    updates = b.stream_view("b_dept_updates", "events")
    run_lab_state(updates, base + "/state", base + "/checkpoint")
    return orders_under_state(spark, b.lab_order_events, base + "/state",
                              schema=dept_state_stream(updates, "lab", "submitted_results").schema)


def stream_dedup_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 registered: the department log delivered twice (two streams of the
    same files, as after a retry); the stream keeps one row per update id."""
    from careflow.sources.bindings import Bindings
    b = Bindings(spark, sf_dir)
    twice = b.stream_view("b_dept_updates", "events").unionByName(b.stream_view("b_dept_updates", "events"))
    return _run_to_sink(dedup_stream(twice), spark, "t5-dedup")
