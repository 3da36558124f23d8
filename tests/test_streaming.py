"""Streaming forms agree with their batch twins (T2-T7). Inputs are binding
frames written as several parquet files and read one file per trigger, so
every query runs over several micro-batches."""

import datetime as dt
import os

from pyspark.sql import functions as F

from careflow.operators import predicates as P, records, registry as U
from careflow.sources.bindings import Bindings
from careflow.streaming import streams as T
from tests.compare import same
from tests.conftest import SF_SMALL


def _as_stream(spark, df, folder, parts=3, order=None):
    """Write ``df`` as ``parts`` files and stream them one file per trigger.

    With ``order``, the files are written one after another in time order
    (a file source takes files by modification time), so no row is late.
    """
    import time
    if order is None:
        df.repartition(parts).write.parquet(folder)
    else:
        key = F.unix_micros(F.col(order).cast("timestamp"))
        cuts = df.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.0)
        bounds = [None] + cuts + [None]
        for i in range(parts):
            cond = F.lit(True)
            if bounds[i] is not None:
                cond = cond & (key > bounds[i])
            if bounds[i + 1] is not None:
                cond = cond & (key <= bounds[i + 1])
            df.filter(cond).coalesce(1).write.parquet(f"{folder}/p{i}")
            time.sleep(1.1)
    return spark.readStream.schema(spark.read.parquet(folder if order is None else folder + "/p0").schema) \
        .option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(folder)


def test_fanout_stream_equals_batch(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    clin = records.clinical_records(b.consultations, b.items)
    src = _as_stream(spark, clin, tmp_dir + "/in")
    T.stream_fanout_to(src, {"lab": tmp_dir + "/lab", "rx": tmp_dir + "/rx"}, tmp_dir + "/ck")
    lab = spark.read.parquet(tmp_dir + "/lab").drop("batch_id")
    rx = spark.read.parquet(tmp_dir + "/rx").drop("batch_id")
    assert spark.read.parquet(tmp_dir + "/lab").select("batch_id").distinct().count() >= 2
    same(lab.toPandas(), U.fanout_orders(clin).toPandas())
    same(rx.toPandas(), U.fanout_rx(clin).toPandas())


def test_fanout_replayed_batch_is_idempotent(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    clin = records.clinical_records(b.consultations, b.items).limit(50)
    sink = T._batch_writer({"lab": tmp_dir + "/lab"})
    sink({"lab": U.fanout_orders(clin)}, 7)
    sink({"lab": U.fanout_orders(clin)}, 7)  # the same batch again after a failure
    assert spark.read.parquet(tmp_dir + "/lab").count() == U.fanout_orders(clin).count()


def test_alert_stream_equals_batch(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    src = _as_stream(spark, b.consultations, tmp_dir + "/in")
    q = (T.alert_stream(src, b.patients).writeStream.format("memory").queryName("alerts_t3")
         .option("checkpointLocation", tmp_dir + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    same(spark.table("alerts_t3").toPandas(), P.alert_feed(b.consultations, b.patients).toPandas())


def test_lab_state_stream_equals_batch(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    orders, updates = b.lab_order_events, b.dept_updates
    src = _as_stream(spark, updates, tmp_dir + "/in", order="updated_at")
    T.run_lab_state(src, tmp_dir + "/state", tmp_dir + "/ck")
    assert spark.read.parquet(tmp_dir + "/state").select("batch_id").distinct().count() >= 2
    same(T.orders_under_state(spark, orders, tmp_dir + "/state").toPandas(),
         U.lab_state(orders, updates).toPandas())


def test_dedup_stream_drops_retries(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    u = b.dept_updates
    replay = u.unionByName(u).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    # in time order: out-of-order rows beyond the watermark are late (T7), not duplicates
    src = _as_stream(spark, replay, tmp_dir + "/in", parts=4, order="updated_at")
    q = (T.dedup_stream(src).writeStream.format("memory").queryName("dedup_t5")
         .option("checkpointLocation", tmp_dir + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("dedup_t5").count() == u.count()


def test_daily_counts_stream_equals_batch_without_late_rows(spark, tmp_dir):
    ev = Bindings(spark, SF_SMALL).table("events").select("ts", "event_type")
    src = _as_stream(spark, ev, tmp_dir + "/in", order="ts")
    T.run_daily_counts(src, tmp_dir + "/out", tmp_dir + "/ck")
    snap = T.latest_snapshot(spark, tmp_dir + "/out", "day").limit(0)  # shape check only
    assert snap.columns == ["day", "event_type", "n"]
    s = spark.read.parquet(tmp_dir + "/out")
    got = s.groupBy("day", "event_type").agg(F.max_by("n", "batch_id").alias("n"))
    same(got.toPandas(), T.daily_counts(ev).toPandas())


def test_late_rows_are_dropped_exactly(spark, tmp_dir):
    import time
    d0 = dt.datetime(2024, 1, 10, 12)
    first = [(d0 + dt.timedelta(hours=h), "view") for h in range(0, 48, 6)]
    second = [(d0 + dt.timedelta(hours=h), "click") for h in range(48, 60, 6)]
    late = [(dt.datetime(2024, 1, 2, 9), "view"), (dt.datetime(2024, 1, 3, 9), "click")]
    schema = "ts timestamp_ntz, event_type string"
    folder = tmp_dir + "/in"
    # one file per micro-batch, in this arrival order; late rows are judged
    # against the watermark of the batch before (Spark's late-event rule), so
    # they arrive third
    for name, part in (("a", first), ("b", second), ("c", late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{name}")
        time.sleep(1.1)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1") \
        .option("recursiveFileLookup", "true").parquet(folder)
    T.run_daily_counts(src, tmp_dir + "/out", tmp_dir + "/ck")
    s = spark.read.parquet(tmp_dir + "/out")
    got = s.groupBy("day", "event_type").agg(F.max_by("n", "batch_id").alias("n"))
    batch_all = T.daily_counts(spark.createDataFrame(first + second + late, schema))
    batch_on_time = T.daily_counts(spark.createDataFrame(first + second, schema))
    same(got.toPandas(), batch_on_time.toPandas())
    assert batch_all.agg(F.sum("n")).first()[0] - got.agg(F.sum("n")).first()[0] == len(late)


def test_registered_stream_query_matches_batch(spark):
    from careflow.plans.catalog import QUERIES
    same(QUERIES["stream_daily_counts"](spark, SF_SMALL).toPandas(),
         QUERIES["daily_counts"](spark, SF_SMALL).toPandas())
    assert os.path.isdir(spark.conf.get("spark.checkpoint.dir"))


def test_stream_days_do_not_depend_on_session_zone(spark):
    from careflow.plans.catalog import QUERIES
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = QUERIES["stream_daily_counts"](spark, SF_SMALL).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    same(got, QUERIES["daily_counts"](spark, SF_SMALL).toPandas())


def test_empty_stream_gives_empty_result(spark, tmp_dir):
    schema = "ts timestamp_ntz, event_type string"
    os.makedirs(tmp_dir + "/in")
    src = spark.readStream.schema(schema).parquet(tmp_dir + "/in")
    T.run_daily_counts(src, tmp_dir + "/out", tmp_dir + "/ck")
    out = T.latest_snapshot(spark, tmp_dir + "/out", "day", T.daily_counts_stream(src).schema)
    assert out.count() == 0 and out.columns == ["day", "event_type", "n"]


def test_record_extraction_runs_on_a_stream(spark, tmp_dir):
    from careflow.functions import extract as X
    b = Bindings(spark, SF_SMALL)
    src = _as_stream(spark, b.records, tmp_dir + "/in")
    q = (X.record_extract(src).writeStream.format("memory").queryName("records_stream")
         .option("checkpointLocation", tmp_dir + "/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    same(spark.table("records_stream").toPandas(), X.record_extract(b.records).toPandas())
