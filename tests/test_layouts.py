"""Layouts of stored tables: what a reader skips, what a join need not move, what a
batch adds; each held against the plain form of the same result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from careflow.functions import common as C
from careflow.operators import kpi, partials, predicates as P, queues, records, registry as U
from careflow.sources import lake as L
from careflow.sources import state_tables as ST
from careflow.sources.bindings import Bindings
from tests.conftest import SF_SMALL
from tests.test_plans import plan

T0 = dt.datetime(2024, 5, 1)


def scanned_rows(df) -> int:
    """Rows that the parquet reader gave out: whole row groups it did not skip."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def all_rows(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- S2 / S4
def test_lake_skips_row_groups_for_one_patient(spark, tmp_dir):
    n = 60_000
    rows = spark.range(n).select(F.col("id").alias("consultation_id"), (F.col("id") * 7919 % 20_000 * 2).alias("patient_id"),
                                 F.lit(T0).cast("timestamp_ntz").alias("created_at"), F.concat(F.lit("note "), F.col("id")).alias("note"))
    L.write_consultations(rows, tmp_dir + "/lake", L.day_counts(rows), row_group_bytes=1 << 16)
    lake = L.read_consultations(spark, tmp_dir + "/lake")
    one = L.patient_rows(lake, [4444])
    assert "PushedFilters: [IsNotNull(patient_id), EqualTo(patient_id,4444)]" in plan(one).replace("In(patient_id, [4444])", "IsNotNull(patient_id), EqualTo(patient_id,4444)")
    assert all_rows(one.select("consultation_id")) == all_rows(rows.filter("patient_id = 4444").select("consultation_id"))
    assert 0 < scanned_rows(L.patient_rows(lake, [4444])) < n / 10


def test_bloom_filter_skips_an_absent_patient(spark, tmp_dir):
    """An odd id lies inside the range of every file, which hold even ids only."""
    rows = spark.range(20_000).select(F.col("id").alias("consultation_id"), (F.col("id") * 2).alias("patient_id"),
                                      F.lit(T0).cast("timestamp_ntz").alias("created_at"))
    L.write_consultations(rows, tmp_dir + "/lake", ids_per_group=20_000)
    lake = L.read_consultations(spark, tmp_dir + "/lake")
    assert scanned_rows(L.patient_rows(lake, [4445])) == 0 < scanned_rows(L.patient_rows(lake, [4444]))


# ---------------------------------------------------------------- J6 / J1 / J2
@pytest.fixture(scope="module")
def state(spark):
    b = Bindings(spark, SF_SMALL)
    return ST.co_bucketed({"patients": b.patients, "clinical": records.clinical_records(b.consultations, b.items), "lab_orders": b.lab_orders,
                           "prescriptions": b.prescriptions, "updates": b.dept_updates}, 4)


def shuffles(df) -> int:
    return plan(df).count("hashpartitioning")


def test_patient_record_over_buckets_moves_nothing(spark, state):
    b = Bindings(spark, SF_SMALL)
    rest = (state["lab_orders"], state["prescriptions"], state["updates"])
    summary = records.patient_record_summary(state["patients"], state["clinical"], None, b.hospitals, *rest)
    nested = records.patient_record(state["patients"], state["clinical"], b.hospitals, *rest)
    assert shuffles(summary) == shuffles(nested) == 0
    plain = records.patient_record_summary(b.patients, b.consultations, b.items, b.hospitals, b.lab_orders, b.prescriptions, b.dept_updates)
    assert shuffles(plain) > 0
    assert all_rows(summary) == all_rows(plain.select(summary.columns))


def test_pending_queues_over_buckets_move_nothing_to_join(spark, state):
    b = Bindings(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, key in (("prescriptions", "rx_id"), ("lab_orders", "order_id")):
            local = queues.pending_queue(state[name], state["patients"], key)
            assert shuffles(local) == 0
            assert all_rows(local) == all_rows(queues.pending_queue(getattr(b, name), b.patients, key))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_co_bucketed_keeps_null_and_repeated_keys(spark):
    rows = [(None, 1), (None, 2), (5, 3), (5, 3)]
    t = ST.co_bucketed({"x": spark.createDataFrame(rows, "patient_id long, v int")}, 4)["x"]
    assert all_rows(t) == sorted(rows, key=str)
    assert [ST.buckets_for(n, 10) for n in (0, 10, 11, 20, 21, 41)] == [1, 1, 2, 2, 4, 8]


# ---------------------------------------------------------------- T1 / J11
def test_tenants_are_pruned_at_run_time(spark, tmp_dir):
    rows = [(i, i % 5 if i % 7 else None) for i in range(70)]
    ST.write_tenants(spark.createDataFrame(rows[:40], "patient_id long, hospital_id int"), tmp_dir + "/t")
    ST.write_tenants(spark.createDataFrame(rows[40:], "patient_id long, hospital_id int"), tmp_dir + "/t")
    keys = spark.createDataFrame([("a", "hospital_admin", "3"), ("b", "doctor", "4"), ("s", "system_admin", None), ("n", "doctor", None), ("m", "doctor", "-1")],
                                 "key string, role string, hospital_id string")
    keys.write.parquet(tmp_dir + "/keys")
    keys = spark.read.parquet(tmp_dir + "/keys")

    def seen(key):
        df = ST.tenant_rows(spark, tmp_dir + "/t", keys.filter(F.col("key") == key))
        assert "dynamicpruning" in plan(df)
        return sorted((r.patient_id for r in df.collect()))

    assert seen("a") == [i for i, h in rows if h == 3] and seen("b") == [i for i, h in rows if h == 4]
    assert seen("s") == [i for i, _ in rows]  # rows without a hospital too
    assert seen("n") == seen("m") == []


def test_system_admins_resolve_to_no_hospital(spark):
    b = Bindings(spark, SF_SMALL)
    got = P.principal_hospital(P.api_keys_from(b.staff, b.hospitals, b.admins), b.staff).filter("role = 'system_admin'").collect()
    assert len(got) == b.admins.count() and all(r.hospital_id is None for r in got)


# ---------------------------------------------------------------- A1 / A8
def test_partials_equal_the_whole_after_each_batch(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    tables = (b.patients, b.consultations, b.lab_orders, b.prescriptions)
    half = F.coalesce(F.month("created_at") <= 6, F.lit(True))
    for i, part in enumerate((half, ~half)):
        for _ in range(2):  # a batch that comes again changes nothing
            partials.fold(partials.daily_partials(*[t.filter(part) for t in tables]), tmp_dir + "/p", i)
        so_far = [t.filter(half) if i == 0 else t for t in tables]
        stored = partials.read_partials(spark, tmp_dir + "/p")
        expected = kpi.kpi_summary(*so_far, "1998-03-02")
        assert all_rows(partials.kpi_from_partials(stored, "1998-03-02").select(expected.columns)) == all_rows(expected)
        assert all_rows(partials.dept_completion_from_partials(stored)) == all_rows(kpi.dept_completion(*so_far[2:]))
    partials.compact(spark, tmp_dir + "/p", tmp_dir + "/one")
    assert all_rows(partials.read_partials(spark, tmp_dir + "/one")) == all_rows(stored)


def test_partials_of_nothing(spark):
    b = Bindings(spark, SF_SMALL)
    none = partials.daily_partials(*[t.limit(0) for t in (b.patients, b.consultations, b.lab_orders, b.prescriptions)])
    assert all(v == 0 for v in partials.kpi_from_partials(none, "1998-03-02").first())


# ---------------------------------------------------------------- W7 / W6 plans
def test_prefix_scan_plans_stay_small_and_ranges_follow_the_rows(spark):
    b = Bindings(spark, SF_SMALL)
    tokens = U.token_numbers(b.registrations, b.patients)
    both = queues.queue_position(queues.pending_queue(b.lab_orders, b.patients, "order_id"), queues.pending_queue(b.prescriptions, b.patients, "rx_id"))
    state_ = U.checkin_state(U.patients_upsert(tokens, b.patients), b.checkins)
    assert all(len(plan(df)) < 100_000 for df in (tokens, both, state_))
    ranges = lambda n: C.placed(spark.range(n).select("id", F.timestamp_seconds(F.col("id") % 100).alias("t")), "t", "id").select("__bucket").distinct().count()
    assert ranges(100_000) > 9 * ranges(10_000) > 0


def test_prefix_position_over_kinds_of_times(spark):
    """Negative, missing and fractional times; text times are one range, still in order."""
    times = ["1969-12-31 23:59:58.5", "1969-12-31 23:59:59.1", "1970-01-01 00:00:00", None, "2024-03-31 02:30:00", "2024-03-31 03:10:00"]
    rows = [(i, t, "g" if i % 2 else None) for i, t in enumerate(times * 3)]
    df = spark.createDataFrame(rows, "id long, s string, g string")
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0])))}
    for kind in ("timestamp_ntz", "timestamp", "string"):
        got = C.prefix_position(df.withColumn("t", F.col("s").cast(kind)), [], "t", "id")
        assert {r.id: r.position for r in got.collect()} == want
    assert got.columns == ["id", "s", "g", "t", "position"]


# ---------------------------------------------------------------- J4 / U10
def test_backfilled_rows_and_applications_carry_their_times(spark):
    clin = spark.createDataFrame([(1, 10, T0, ["a"], ["m"])], "consultation_id long, patient_id long, created_at timestamp_ntz, lab_tests array<string>, prescriptions array<string>")
    none = spark.createDataFrame([], "patient_id long")
    for out in (U.orders_backfill(clin, none), U.rx_backfill(clin, none)):
        r = out.first()
        assert r.created_at == r.updated_at == T0
    req = spark.createDataFrame([(1, "H", T0)], "request_id long, name string, requested_at timestamp_ntz")
    assert U.applications_append(req).first().created_at == T0
    assert U.applications_append(req.drop("requested_at")).first().created_at is None


# ---------------------------------------------------------------- text work
def test_dealt_spreads_a_table_of_few_files_only(spark, tmp_dir):
    spark.range(100).coalesce(1).write.parquet(tmp_dir + "/one")
    spark.range(100).repartition(16).write.parquet(tmp_dir + "/many")
    cores = spark.sparkContext.defaultParallelism
    assert C.dealt(spark.read.parquet(tmp_dir + "/one")).rdd.getNumPartitions() == cores
    assert "Exchange" not in plan(C.dealt(spark.read.parquet(tmp_dir + "/many")))


def test_with_whole_json_parses_once(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":1} x'), (3, None), (4, ""), (5, "[1]")], "id long, t string")
    out = C.with_whole_json(df, "t", "v")
    assert plan(out.select("id", F.try_variant_get("v", "$.a", "int"), F.schema_of_variant("v"))).count("tryparsejson") + \
        plan(out).lower().count("try_parse_json") <= 2
    got = {r.id: r.s for r in out.select("id", F.to_json("v").alias("s")).collect()}
    assert got == {1: '{"a":1}', 2: None, 3: None, 4: None, 5: "[1]"}
