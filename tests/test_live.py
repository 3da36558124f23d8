"""Live forms: the registration fold, boards, late rows, key counts and schema
generations equal their batch twins however the input is split into batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from careflow.operators import registry as U
from careflow.sources import key_counts, lake as L
from careflow.sources.bindings import Bindings
from careflow.streaming import registrations as R
from careflow.streaming import streams as T
from tests.compare import same
from tests.conftest import SF_SMALL
from tests.test_replay import at, new_id
from tests.test_streaming import _as_stream

REG = "event_id long, ts timestamp_ntz, patient_id string, name string, age int, hospital_id int"
#: event, minute, id: returns of table rows, of new patients, of one nowhere, a return before its birth
LOG = [(0, 5, None, 1), (1, 5, "1", 1), (2, 7, "9", 2), (3, 8, "new:0", 2), (4, 8, "new:6", 1), (5, 9, None, 1), (6, 9, None, None),
       (7, 10, "2", 1), (8, 11, "new:6", 1), (9, 12, None, 2), (10, 13, "1", 2), (11, 14, "new:9", 2), (12, 1500, None, 1), (13, 1501, "new:5", None)]
CHECKINS = [(100, 6, "1"), (101, 9, "new:0"), (102, 10, "3"), (103, 13, "1"), (104, 13, "77"), (105, 1600, "new:12"), (106, 4, "new:9")]


def _id(p):
    return new_id(int(p[4:])) if p and p[:4] == "new:" else p


def _frames(spark):
    table = spark.createDataFrame([(i, f"old{i}", "en-IN", 9, 40 + i, 1, i % 2, at(-60)) for i in (1, 2, 3)],
                                  "patient_id long, name string, language string, hospital_id int, token_number long, "
                                  "room_number long, checked_in int, created_at timestamp_ntz")
    regs = spark.createDataFrame([(e, at(m), _id(p), f"n{e}", e, h) for e, m, p, h in LOG], REG)
    came = spark.createDataFrame([(e, at(m), _id(p)) for e, m, p in CHECKINS], "event_id long, ts timestamp_ntz, patient_id string")
    return table, regs, came


def _expected_boards(upsert, slots):
    boards = {}
    for r in upsert.collect():
        boards.setdefault((r.hospital_id, r.created_at.date()), []).append((r.token_number, r.patient_id, r["name"], r.room_number))
    return {k: sorted(v)[:slots] for k, v in boards.items()}


@pytest.mark.parametrize("cuts", [[8, 10, 13]])
def test_registrations_in_any_split(spark, tmp_dir, cuts):
    table, regs, came = _frames(spark)
    log = R.request_log(regs, came)
    base = tmp_dir + "/live"
    fold, show = R.registration_folder(table, base, compact_every=2), R.board_folder(table, base, 2, compact_every=2)
    edges = [at(-1), *[at(m) for m in cuts], at(10 ** 6)]
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        batch = log.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
        for _ in range(1 + (i == 2)):  # a replay of a batch changes nothing
            fold(batch, i)
            show(batch, i)
    tokens = U.token_numbers(regs, table)
    upsert = U.patients_upsert(tokens, table)
    same(R.tokens_so_far(spark, base).select("event_id", "patient_id", "token_number", "room_number", "is_new").toPandas(),
         tokens.select("event_id", "patient_id", "token_number", "room_number", "is_new").toPandas())
    same(R.patients_now(spark, table, base).toPandas(), upsert.toPandas())
    same(R.checkins_now(spark, table, base).toPandas(), U.checkin_state(upsert, came).toPandas())
    got = {(r.hospital_id, r.day): [tuple(s) for s in r.slots] for r in R.boards(spark, base).collect()}
    assert all(len(v) <= 2 for v in got.values())
    assert {k: v for k, v in got.items() if v} == _expected_boards(upsert, 2)


def test_registrations_as_a_stream(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    log = R.request_log(b.registrations, b.checkins)
    src = _as_stream(spark, log, tmp_dir + "/in", order="ts")
    base = tmp_dir + "/live"
    R.run_registrations(src, b.patients, base)
    assert spark.read.parquet(base + "/state").select("batch_id").distinct().count() >= 2
    upsert = U.patients_upsert(U.token_numbers(b.registrations, b.patients), b.patients)
    same(R.patients_now(spark, b.patients, base).toPandas(), upsert.toPandas())
    same(R.checkins_now(spark, b.patients, base).toPandas(), U.checkin_state(upsert, b.checkins).toPandas())


def test_no_requests_leave_the_table(spark, tmp_dir):
    table, _, _ = _frames(spark)
    rows = R.patients_now(spark, table, tmp_dir + "/never")
    assert rows.count() == 3 and {r.visits for r in rows.collect()} == {0}
    assert R.boards(spark, tmp_dir + "/never").count() == 0


def test_late_rows_are_kept(spark, tmp_dir):
    d0 = dt.datetime(2024, 1, 10, 12)
    batches = [[(d0 + dt.timedelta(hours=h), "view") for h in range(0, 72, 6)],
               [(dt.datetime(2024, 1, 2, 9), "view"), (dt.datetime(2024, 1, 3, 9), "click"), (None, "click"), (d0 + dt.timedelta(hours=60), "view")],
               [],
               [(dt.datetime(2024, 1, 11, 23, 59), "view"), (dt.datetime(2024, 1, 12, 0, 0), "view")]]
    schema = "ts timestamp_ntz, event_type string"
    frames = [spark.createDataFrame(b, schema) for b in batches]
    body = T.late_folder(tmp_dir + "/out")
    for i, f in enumerate(frames):
        body(f, i)
        body(f, i)
    late = {r.ts for r in spark.read.parquet(tmp_dir + "/out/late").collect()}
    # the newest event of the first batch is 13 January 06:00: the edge is a day before
    assert late == {dt.datetime(2024, 1, 2, 9), dt.datetime(2024, 1, 3, 9), dt.datetime(2024, 1, 11, 23, 59)}
    marks = {r.batch_id: (r.late, r.in_time) for r in spark.read.parquet(tmp_dir + "/out/marks").collect()}
    assert marks == {0: (0, 12), 1: (2, 2), 2: (0, 0), 3: (1, 1)}
    whole = T.counts_with_late(spark, tmp_dir + "/out").selectExpr("day", "event_type", "in_time + late AS n")
    same(whole.toPandas(), T.daily_counts(spark.createDataFrame(sum(batches, []), schema)).toPandas())


def test_late_rows_of_a_stream(spark, tmp_dir):
    ev = Bindings(spark, SF_SMALL).table("events").select("ts", "event_type")
    T.run_counts_with_late(_as_stream(spark, ev, tmp_dir + "/in"), tmp_dir + "/out")
    got = T.counts_with_late(spark, tmp_dir + "/out")
    assert got.agg(F.sum("late")).first()[0] > 0
    same(got.selectExpr("day", "event_type", "in_time + late AS n").toPandas(), T.daily_counts(ev).toPandas())


def test_key_counts_after_each_batch(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    full = {"patients": b.patients, "consultations": b.consultations, "lab_orders": b.lab_orders, "prescriptions": b.prescriptions,
            "hospitals": b.hospitals, "staff": b.staff_accounts, "items": b.items, "applications": b.applications,
            "dept_updates": b.dept_updates, "alerts": b.alerts if "b_alerts" in dir(b) else b.consultations.select("consultation_id")}
    part = lambda df, i: df.filter(F.pmod(F.hash(*df.columns[:1]), F.lit(3)) == i)
    again = full["patients"].filter("patient_id = 7")
    batches = [{n: part(df, i) for n, df in full.items()} for i in range(3)]
    batches[2]["patients"] = batches[2]["patients"].unionByName(again)
    for i, batch in enumerate(batches):
        key_counts.fold(batch, tmp_dir + "/keys", i)
        so_far = {n: df for n, df in batches[0].items()}
        for more in batches[1:i + 1]:
            so_far = {n: so_far[n].unionByName(more[n]) for n in so_far}
        same(key_counts.audit(spark, tmp_dir + "/keys").toPandas(), L.key_audit(so_far).toPandas())
    before = key_counts.audit(spark, tmp_dir + "/keys").toPandas()
    key_counts.fold(batches[2], tmp_dir + "/keys", 2)  # a replay
    key_counts.compact(spark, tmp_dir + "/keys", tmp_dir + "/compact")
    same(key_counts.audit(spark, tmp_dir + "/compact").toPandas(), before)
    found = [r for r in key_counts.repeated(spark, tmp_dir + "/keys", 2).collect() if r.table_name == "patients"]
    assert [(r.rule, r.key, r.n_before + r.n_batch) for r in found] == [("pk_duplicate:patient_id", '{"c0":7}', 2)]


def test_key_counts_are_read_and_shuffled_once(spark, tmp_dir):
    b = Bindings(spark, SF_SMALL)
    full = {"patients": b.patients, "consultations": b.consultations, "lab_orders": b.lab_orders, "prescriptions": b.prescriptions,
            "hospitals": b.hospitals, "staff": b.staff_accounts, "items": b.items, "applications": b.applications,
            "dept_updates": b.dept_updates, "alerts": b.consultations.select("consultation_id")}
    full["items"] = spark.createDataFrame([(1, None), (1, None), (None, 2), (None, None), (1, 2)], "consultation_id long, line int")
    full["patients"] = spark.createDataFrame([(1, None, 1), (None, None, 99), (None, "x", None), (7, "y", 2)], "patient_id int, name string, hospital_id long")
    full["staff"] = spark.createDataFrame([(1, "u", 1), (2, "u", 1), (3, None, None), (4, None, 98)], "staff_id long, username string, hospital_id short")
    key_counts.fold(full, tmp_dir + "/keys", 0)
    report = key_counts.audit(spark, tmp_dir + "/keys")
    same(report.toPandas(), L.key_audit(full).toPandas())
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    stored = key_counts.read_counts(spark, tmp_dir + "/keys")
    keys = {(r.key, r.n) for r in stored.filter("rule = 'pk_duplicate:consultation_id,line'").collect()}
    assert keys == {('{"c0":1}', 2), ('{"c1":2}', 1), ("{}", 1), ('{"c0":1,"c1":2}', 1)}
    assert {(r.key, r.n) for r in stored.filter("rule = 'unique:username'").collect()} == {('{"c0":"u"}', 2)}


def test_generations_of_nested_columns(spark):
    a = spark.createDataFrame([(1, (5,), [("x",)], {"k": 1}), (2, None, None, None)],
                              "id int, visit struct<token: int>, notes array<struct<text: string>>, m map<string, int>")
    b = spark.createDataFrame([(3 << 40, (6 << 40, 2), [("y", "en"), None], 1.5)],
                              "id long, visit struct<token: long, room: int>, notes array<struct<text: string, language: string>>, score float")
    c = spark.createDataFrame([(((3, 4), 7), [("hi", "z")], {"k": 1 << 40}, 2.5)],
                              "visit struct<room: struct<x: int, y: int>, token: int>, notes array<struct<language: string, text: string>>, m map<string, bigint>, score double")
    two = L.evolve(a, b)
    assert two.schema.simpleString() == ("struct<id:bigint,visit:struct<token:bigint,room:int>,notes:array<struct<text:string,language:string>>,"
                                         "m:map<string,int>,score:float>")
    rows = {r.id: r.asDict(recursive=True) for r in two.collect()}
    assert rows[1] == {"id": 1, "visit": {"token": 5, "room": None}, "notes": [{"text": "x", "language": None}], "m": {"k": 1}, "score": None}
    assert rows[2] == {"id": 2, "visit": None, "notes": None, "m": None, "score": None}
    assert rows[3 << 40]["notes"] == [{"text": "y", "language": "en"}, None] and rows[3 << 40]["visit"] == {"token": 6 << 40, "room": 2}
    with pytest.raises(TypeError, match="visit.room"):
        L.evolve(a, b, c)
    three = L.evolve(a, b.withColumn("visit", F.struct("visit.token")), c.withColumn("visit", F.struct("visit.token"))).collect()
    last = [r.asDict(recursive=True) for r in three if r.score == 2.5][0]
    assert last == {"id": None, "visit": {"token": 7}, "notes": [{"text": "z", "language": "hi"}], "m": {"k": 1 << 40}, "score": 2.5}


def test_generations_refuse_what_loses_values(spark):
    with pytest.raises(TypeError):
        L.evolve(spark.range(1), spark.createDataFrame([("1",)], "id string"))
    with pytest.raises(TypeError):
        L.evolve(spark.range(1), spark.createDataFrame([(1.0,)], "id double"))
