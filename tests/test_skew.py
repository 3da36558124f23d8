"""One key holding a third of all rows: results stay exact (brute force in
pandas on the same fixture) for the operators built to spread such keys."""

import datetime as dt
import random

import pandas as pd

from careflow.functions import common as C
from careflow.operators import registry as U

T0 = dt.datetime(2024, 3, 1)
N = 3000


def _rows(seed=7):
    rnd = random.Random(seed)
    out = []
    for i in range(N):
        key = 0 if i % 3 == 0 else rnd.randint(1, 400)  # key 0 holds a third of the rows
        out.append((i, key, T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 20))))
    return out


def test_latest_by_hot_key(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, k long, t timestamp_ntz").withColumn("v", (C.F.col("id") * 7) % 13)
    got = {r.k: (r.t, r.id) for r in C.latest_by(df, "k", ["t", "id"], ["v"]).collect()}
    pdf = pd.DataFrame(rows, columns=["id", "k", "t"]).sort_values(["t", "id"])
    want = {k: (g.iloc[-1].t.to_pydatetime(), int(g.iloc[-1].id)) for k, g in pdf.groupby("k")}
    assert got == want


def test_prefix_position_hot_group(spark):
    rows = _rows(11)
    df = spark.createDataFrame(rows, "id long, k long, t timestamp_ntz")
    got = {r.id: r.position for r in C.prefix_position(df, ["k"], "t", "id").collect()}
    pdf = pd.DataFrame(rows, columns=["id", "k", "t"]).sort_values(["k", "t", "id"])
    pdf["pos"] = pdf.groupby("k").cumcount() + 1
    assert got == dict(zip(pdf.id, pdf.pos))


def test_prefix_position_hot_hour_and_hot_instant(spark):
    """90 % of the rows in one hour, a third at one instant, some without a time:
    positions stay exact and no range holds more than a few percent of the rows."""
    rnd = random.Random(2)
    rows = []
    for i in range(20000):
        m = rnd.random()
        t = T0 if m < 0.33 else None if m < 0.36 else T0 + dt.timedelta(microseconds=rnd.randint(0, 3_600_000_000)) if m < 0.93 \
            else T0 + dt.timedelta(minutes=rnd.randint(0, 40_000))
        rows.append((i, t))
    df = spark.createDataFrame(rows, "id long, t timestamp_ntz").repartition(8)
    out = C.prefix_position(df, [], "t", "id")
    got = {r.id: r.position for r in out.collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[0]))
    assert got == {r[0]: k + 1 for k, r in enumerate(want)}
    placed = [r for r in C.placed(df, "t", "id").groupBy("__bucket").count().collect()]
    assert len(placed) > 300 and max(r["count"] for r in placed) < 20000 * 0.03


def test_token_numbers_hot_hour(spark):
    rows = [(i, None if i % 3 else "1", T0 + dt.timedelta(seconds=(i * 7919) % 3600)) for i in range(3000)]
    df = spark.createDataFrame([(i, t, k) for i, k, t in rows], "event_id long, ts timestamp_ntz, patient_id string")
    table = spark.createDataFrame([(1,), (2,)], "patient_id long")
    got = {r.event_id: r.token_number for r in U.token_numbers(df, table).collect()}
    count, want = 2, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = count + 1
        count += k is None
    assert got == want


def test_lab_state_hot_patient(spark):
    rnd = random.Random(3)
    orders = [(i, 0 if i % 3 == 0 else rnd.randint(1, 50), T0 + dt.timedelta(hours=rnd.randint(0, 500)))
              for i in range(900)]
    ups = [(1000 + i, 0 if i % 3 == 0 else rnd.randint(1, 50), "lab", "submitted_results", f"d{i}",
            T0 + dt.timedelta(hours=rnd.randint(0, 500))) for i in range(300)]
    o = spark.createDataFrame(orders, "order_id long, patient_id long, created_at timestamp_ntz")
    u = spark.createDataFrame(ups, "update_id long, patient_id long, dept string, action string, data string, "
                                   "updated_at timestamp_ntz")
    got = {r.order_id: (r.status, r.results) for r in U.lab_state(o, u).collect()}
    last = {}
    for uid, p, _, _, d, t in sorted(ups, key=lambda r: (r[5], r[0])):
        last[p] = (t, d)
    want = {}
    for oid, p, c in orders:
        if p in last and last[p][0] >= c:
            want[oid] = ("completed", last[p][1])
        else:
            want[oid] = ("pending", "{}")
    assert got == want
