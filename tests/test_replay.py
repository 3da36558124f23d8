"""Property tests: the set-based folds equal a row-by-row replay of the
statement sequence they stand for (register, check in, update department)."""

import datetime as dt
import hashlib
import json

from hypothesis import given, settings, strategies as st, HealthCheck

from careflow.operators import registry as U

T0 = dt.datetime(2024, 1, 1)
SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))

# minutes spread over a few days so the hour/day buckets of the prefix count are exercised
minute = st.integers(min_value=0, max_value=60 * 24 * 3)


def at(m):
    return T0 + dt.timedelta(minutes=m)


@st.composite
def registrations(draw):
    """(event, minute, id): None registers a new patient, 1-3 are in the table, 7-8 nowhere;
    'new:k' returns the patient whom event k registered (before or after this one)."""
    n = draw(st.integers(1, 20))
    some = st.one_of(st.none(), st.sampled_from(["1", "2", "3", "7", "8"]), st.integers(0, n - 1).map(lambda k: f"new:{k}"))
    return [(i, draw(minute), draw(some)) for i in range(n)]


def new_id(event):
    return "VK-" + hashlib.sha256(str(event).encode()).hexdigest().upper()


def frames(spark, regs):
    table = spark.createDataFrame([(i, f"old{i}", "en-IN", 9, 40 + i, 1, i % 2, at(-60)) for i in (1, 2, 3)],
                                  "patient_id long, name string, language string, hospital_id int, token_number long, "
                                  "room_number long, checked_in int, created_at timestamp_ntz")
    rows = [(e, at(m), new_id(int(p[4:])) if p and p[:4] == "new:" else p, f"n{e}", e) for e, m, p in regs]
    return table, spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, patient_id string, name string, age int")


def replay(regs):
    """The registration statements, one by one: (tokens by event, table)."""
    table = {str(i): {"name": f"old{i}", "checked_in": i % 2, "created_at": at(-60), "age": None} for i in (1, 2, 3)}
    tokens = {}
    for e, m, p in sorted(regs, key=lambda r: (r[1], r[0])):
        count = len(table)  # SELECT COUNT(*) FROM patients
        pid = new_id(int(p[4:])) if p and p[:4] == "new:" else p
        if pid is not None and pid not in table:
            continue  # 404
        tokens[e] = (count + 1, count % 3 + 1)
        table[pid or new_id(e)] = {"name": f"n{e}", "checked_in": 0, "created_at": at(m), "age": e}
    return tokens, table


@SETTINGS
@given(regs=registrations())
def test_token_numbers_replay(spark, regs):
    table, requests = frames(spark, regs)
    got = {r.event_id: (r.token_number, r.room_number) for r in U.token_numbers(requests, table).collect()}
    assert got == replay(regs)[0]


@SETTINGS
@given(regs=registrations())
def test_upsert_replay(spark, regs):
    table, requests = frames(spark, regs)
    got = {r.patient_id: (r.name, r.checked_in, r.created_at, r.age)
           for r in U.patients_upsert(U.token_numbers(requests, table), table).collect()}
    assert got == {k: (v["name"], v["checked_in"], v["created_at"], v["age"]) for k, v in replay(regs)[1].items()}


@st.composite
def dept_log(draw):
    orders = [(i, draw(st.integers(1, 4)), draw(minute)) for i in range(draw(st.integers(0, 12)))]
    kinds = [("lab", "submitted_results"), ("pharmacy", "dispensed"), ("lab", "note")]
    ups = [(100 + i, draw(st.integers(1, 4)), *draw(st.sampled_from(kinds)), f'{{"v":{i}}}', draw(minute))
           for i in range(draw(st.integers(0, 12)))]
    return orders, ups


@SETTINGS
@given(log=dept_log())
def test_lab_state_replay(spark, log):
    orders, ups = log
    o = spark.createDataFrame([(i, p, at(m)) for i, p, m in orders],
                              "order_id long, patient_id long, created_at timestamp_ntz")
    u = spark.createDataFrame([(i, p, d, a, data, at(m)) for i, p, d, a, data, m in ups],
                              "update_id long, patient_id long, dept string, action string, data string, "
                              "updated_at timestamp_ntz")
    got = {r.order_id: (r.status, r.results, r.updated_at) for r in U.lab_state(o, u).collect()}
    # replay: orders are inserted before updates of the same instant; updates in (time, id) order
    events = [(m, 0, i, ("order", i, p)) for i, p, m in orders] + \
             [(m, 1, i, ("update", p, d, a, data)) for i, p, d, a, data, m in ups]
    table = {}
    for m, _, _, ev in sorted(events):
        if ev[0] == "order":
            table[ev[1]] = {"patient": ev[2], "status": "pending", "results": "{}", "updated_at": at(m)}
        elif ev[2] == "lab" and ev[3] == "submitted_results":
            for row in table.values():
                if row["patient"] == ev[1]:
                    row.update(status="completed", results=ev[4], updated_at=at(m))
    want = {k: (v["status"], v["results"], v["updated_at"]) for k, v in table.items()}
    assert got == want


@st.composite
def visits(draw):
    few = st.integers(0, 4)  # minutes: many equal times
    ids = iter(draw(st.permutations(range(30))))  # one id sequence for both kinds of event
    regs = [(next(ids), draw(few), draw(st.sampled_from(["1", "2", "3"]))) for _ in range(draw(st.integers(0, 6)))]
    cks = [(next(ids), draw(few), draw(st.sampled_from(["1", "2", "3", "7"]))) for _ in range(draw(st.integers(0, 8)))]
    return regs, cks


@SETTINGS
@given(v=visits())
def test_checkin_replay(spark, v):
    """Events in (time, id) order: a registration resets the flag, a check-in sets it."""
    regs, cks = v
    table, requests = frames(spark, regs)
    c = spark.createDataFrame([(e, p, at(m)) for e, m, p in cks], "event_id long, patient_id string, ts timestamp_ntz")
    state = U.patients_upsert(U.token_numbers(requests, table), table)
    got = {x.patient_id: x.checked_in for x in U.checkin_state(state, c).collect()}
    want = {str(i): i % 2 for i in (1, 2, 3)}
    for m, e, kind, p in sorted([(m, e, "reg", p) for e, m, p in regs] + [(m, e, "ck", p) for e, m, p in cks]):
        if p in want:
            want[p] = int(kind == "ck")
    assert got == want


@st.composite
def decision_log(draw):
    apps = [(i, draw(st.sampled_from([None, "e1", "e2", "e3"]))) for i in range(5)]
    word = st.sampled_from(["approved", "rejected", "Approved", "pending"])
    return apps, [(i, draw(st.integers(0, 5)), draw(word), draw(st.integers(0, 3))) for i in range(draw(st.integers(0, 12)))]


@SETTINGS
@given(log=decision_log())
def test_decisions_replay(spark, log):
    apps, decisions = log
    a = spark.createDataFrame([(i, json.dumps({"name": f"N{i}", "email": e, "city": "C"}), "new") for i, e in apps],
                              "app_id long, data string, status string")
    d = spark.createDataFrame([(i, app, w, f"c{i}", at(m)) for i, app, w, m in decisions],
                              "decision_id long, app_id long, status string, comments string, decided_at timestamp_ntz")
    h = spark.createDataFrame([("e3",), (None,)], "email string")
    email, state, taken, made = dict(apps), {i: ("new", None) for i, _ in apps}, {"e3"}, []
    for m, i, app, w in sorted((m, i, app, w) for i, app, w, m in decisions):
        if app not in email:
            continue
        if w == "approved":
            if email[app] in taken:
                continue  # the UNIQUE email fails, and the update with it
            taken |= {email[app]} - {None}
            made.append((app, f"N{app}", email[app], at(m)))
        state[app] = (w, f"c{i}")
    got = {r.app_id: (r.status, r.comments) for r in U.apply_decisions(a, d, h).collect()}
    assert got == state
    rows = U.decided_hospitals(a, d, h).collect()
    assert sorted(map(str, ((r.app_id, r.name, r.email, r.created_at) for r in rows))) == sorted(map(str, made))
    assert len({r.hospital_id for r in rows}) == len(rows)
