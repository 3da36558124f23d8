"""Edge rows on small literal frames: NULL, empty string, empty list,
malformed JSON, unknown id, equal timestamps, duplicate ids, returning
patient, 'High' in capitals, hospital without staff, empty table."""

import datetime as dt
import json

from pyspark.sql import functions as F

from careflow.functions import common as C
from careflow.functions import extract as X
from careflow.operators import kpi, predicates as P, queues, records, registry as U
from careflow.sources import lake as L

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def ts(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---------------------------------------------------------------- latest rows, ties, NULL
def test_latest_breaks_ties_by_id_and_ignores_null_time(spark):
    df = spark.createDataFrame(
        [(1, 10, ts(5), "a"), (1, 11, ts(5), "b"), (1, 9, None, "c"), (2, 20, None, "d")],
        "patient_id long, consultation_id long, created_at timestamp_ntz, followup string")
    got = rows(records.latest_followup(df.withColumn("severity", F.lit(None).cast("string"))
                                       .withColumn("diagnosis", F.lit("x")).withColumn("hospital_id", F.lit(1))),
               "patient_id")
    # equal times: the larger id wins; a NULL time sorts last in DESC order
    assert got == [(1, "b"), (2, "d")]


def test_record_defaults_for_patient_without_rows(spark):
    patients = spark.createDataFrame([(1,), (2,)], "patient_id long")
    cons = spark.createDataFrame([(1, 100, ts(0), "high", "dx", "", 99)],
                                 "patient_id long, consultation_id long, created_at timestamp_ntz, severity string, "
                                 "diagnosis string, followup string, hospital_id int")
    lab = spark.createDataFrame([], "patient_id long, order_id long, created_at timestamp_ntz, status string, "
                                    "tests string, results string")
    rx = spark.createDataFrame([(1, 7, ts(1), "pending", '["m"]')],
                               "patient_id long, rx_id long, created_at timestamp_ntz, status string, medicines string")
    hosp = spark.createDataFrame([(1, "H1")], "hospital_id int, name string")
    got = rows(records.record_defaults(patients, cons, lab, rx, hosp), "patient_id")
    assert got == [(1, "not_ordered", "[]", "{}", "pending", '["m"]', "Unknown Hospital", ""),
                   (2, "not_ordered", "[]", "{}", "not_prescribed", "[]", None, "")]
    nulls = cons.withColumn("followup", F.lit(None).cast("string"))
    got2 = rows(records.record_defaults(patients, nulls, lab, rx, hosp), "patient_id")
    assert got2[0][7] is None and got2[1][7] == ""


# ---------------------------------------------------------------- queues
def test_queue_drops_unknown_patient_and_other_status(spark):
    rx = spark.createDataFrame([(1, 1, ts(2), "pending"), (2, 99, ts(1), "pending"), (3, 1, ts(0), "dispensed")],
                               "rx_id long, patient_id long, created_at timestamp_ntz, status string")
    pats = spark.createDataFrame([(1, "A", 5, 3)], "patient_id long, name string, token_number long, hospital_id int")
    assert rows(queues.pharmacy_pending(rx, pats)) == [(3, 1, "A", 5, 1, ts(2))]
    assert rows(queues.tenant_scope(queues.pharmacy_pending(rx, pats), 4)) == []


def test_queue_position_ties_and_many_days(spark):
    lab = spark.createDataFrame(
        [(1, 1, "A", 1, 10, ts(0)), (1, 2, "B", 2, 11, ts(0)), (1, 3, "C", 3, 12, ts(60 * 24 * 3)),
         (2, 4, "D", 4, 13, ts(1))],
        "hospital_id int, patient_id long, name string, token_number long, order_id long, created_at timestamp_ntz")
    rx = spark.createDataFrame([], lab.schema.simpleString().replace("order_id", "rx_id")[7:-1])
    got = rows(queues.queue_position(lab, rx).select("hospital_id", "item_id", "position"), "hospital_id", "item_id")
    assert got == [(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 13, 1)]


def test_prefix_position_keeps_null_time_and_group(spark):
    df = spark.createDataFrame([(1, None, 1), (1, ts(0), 2), (None, ts(0), 3), (None, None, 4), (1, ts(90), 5)],
                               "g int, t timestamp_ntz, id long")
    got = rows(C.prefix_position(df, ["g"], "t", "id").select("id", "position"), "id")
    # NULL times sort first (ascending), NULL groups rank among themselves
    assert got == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 3)]


# ---------------------------------------------------------------- dashboard
def test_severity_case_sensitive_and_zero_fill(spark):
    cons = spark.createDataFrame([("High",), ("high",), (None,), ("emergency",), ("odd",)], "severity string")
    assert P.alert_candidates(cons).count() == 2
    zf = rows(kpi.severity_zero_filled(spark, kpi.severity_breakdown(cons)), "ord")
    assert zf == [("emergency", 1, 1), ("high", 2, 1), ("medium", 3, 0), ("low", 4, 0)]
    share = rows(kpi.severity_share(spark, kpi.severity_breakdown(cons)), "ord")
    assert [r[3] for r in share] == [100.0, 100.0, 0.0, 0.0]


def test_hospital_without_staff_or_patients_counts_zero(spark):
    h = spark.createDataFrame([(1, "H1"), (2, "H2")], "hospital_id int, name string")
    s = spark.createDataFrame([(1, 1)], "staff_id long, hospital_id int")
    p = spark.createDataFrame([], "patient_id long, hospital_id int")
    got = rows(kpi.hospital_counts(h, s, p), "hospital_id")
    assert got == [(1, "H1", "approved", 1, 0), (2, "H2", "approved", 0, 0)]


def test_dept_completion_of_empty_tables_is_zero(spark):
    e = spark.createDataFrame([], "status string")
    got = rows(kpi.dept_completion(e, e), "dept")
    assert got == [("lab", 0, 0, 0.0), ("pharmacy", 0, 0, 0.0)]


def test_breakdown_map_null_key(spark):
    b = spark.createDataFrame([(None, 2), ("en-IN", 3)], "language string, n long")
    m = kpi.breakdown_map(b, "language").collect()[0][0]
    assert m == {"en-IN": 3, "null": 2}


def test_token_board_marks_first(spark):
    p = spark.createDataFrame([(i, f"P{i}", 10 - i, 1, 0, dt.datetime(2024, 1, 2, 8)) for i in range(8)],
                              "patient_id long, name string, token_number long, room_number long, checked_in int, "
                              "created_at timestamp_ntz")
    got = rows(kpi.token_board(p, "2024-01-02"), "slot")
    assert [r[2] for r in got] == [3, 4, 5, 6, 7, 8]
    assert [r[-1] for r in got] == [True] + [False] * 5


# ---------------------------------------------------------------- predicates / lookups
def test_missing_results_blank_missing_complete(spark):
    df = spark.createDataFrame([(1, '["a","b"]', '{"a":"5","b":"  "}'), (2, '["a"]', '{}'), (3, '["a"]', '{"a":"1"}')],
                               "order_id long, tests string, results string")
    got = rows(P.missing_results(df), "order_id")
    assert got == [(1, 1, '["b"]'), (2, 1, '["a"]')]


def test_registration_rejects_rules(spark):
    df = spark.createDataFrame([(1, 1, "  ", "30"), (2, 2, "A", ""), (3, 3, "B", "abc"), (4, 4, "C", " 12y"),
                                (5, 5, "D", "0"), (6, 6, None, "1")],
                               "event_id long, patient_id long, name string, age_text string")
    got = rows(P.registration_rejects(df), "event_id")
    assert got == [(1, 1, "name_required"), (2, 2, "age_required"), (3, 3, "age_not_integer"),
                   (6, 6, "name_required")]


def test_lookup_and_unknown_ids(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "patient_id long, name string")
    r = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, None)], "event_id long, patient_id long")
    assert rows(P.lookup_ids(t, r), "patient_id") == [(1, "a")]
    assert rows(P.unknown_ids(r, t), "event_id") == [(3, 12), (None, 13)]


def test_ci_lookup_matches_case_insensitively(spark):
    r = spark.createDataFrame([("vk-1 ",), ("VK-2",), ("x",)], "code string")
    t = spark.createDataFrame([("VK-1", 1), ("vk-2", 2)], "key string, id long")
    assert sorted(x[-1] for x in P.ci_lookup(r, "code", t, "key").collect()) == [1, 2]


def test_principal_resolution(spark):
    staff = spark.createDataFrame([(5, 3, "S", "doctor")], "staff_id long, hospital_id int, name string, role string")
    keys = spark.createDataFrame([("k1", "5", "doctor"), ("k2", "7", "hospital_admin"), ("k3", "x", "system_admin"),
                                  ("k4", "99", "pharmacist")], "key string, owner_id string, role string")
    got = rows(P.principal_hospital(keys, staff).select("key", "hospital_id"), "key")
    assert got == [("k1", "3"), ("k2", "7"), ("k3", None), ("k4", None)]


# ---------------------------------------------------------------- state folds
def test_lab_fold_closes_existing_orders_only(spark):
    orders = spark.createDataFrame([(1, 1, ts(0)), (2, 1, ts(10)), (3, 1, ts(30)), (4, 2, ts(0))],
                                   "order_id long, patient_id long, created_at timestamp_ntz")
    ups = spark.createDataFrame(
        [(1, 1, "lab", "submitted_results", '{"r":1}', ts(10)), (2, 1, "lab", "submitted_results", '{"r":2}', ts(20)),
         (3, 1, "pharmacy", "dispensed", "{}", ts(40)), (4, 2, "lab", "note", "{}", ts(50))],
        "update_id long, patient_id long, dept string, action string, data string, updated_at timestamp_ntz")
    got = rows(U.lab_state(orders, ups), "order_id")
    # order 2 was created at the same instant as an update: closed (>=)
    # order 3 arrived after every update: still pending
    assert got == [(1, 1, ts(0), "completed", '{"r":2}', ts(20)), (2, 1, ts(10), "completed", '{"r":2}', ts(20)),
                   (3, 1, ts(30), "pending", "{}", ts(30)), (4, 2, ts(0), "pending", "{}", ts(0))]
    rx = rows(U.rx_state(orders, ups), "order_id")
    assert [r[3] for r in rx] == ["dispensed", "dispensed", "dispensed", "pending"]


def test_returning_patient_keeps_count_and_unknown_ids_are_rejected(spark):
    table = spark.createDataFrame([(100, "A", 1, 1, 1, ts(-9))], "patient_id long, name string, token_number long, "
                                  "room_number long, checked_in int, created_at timestamp_ntz")
    regs = spark.createDataFrame([(1, ts(0), None, "N"), (2, ts(1), "999", "X"), (3, ts(2), "100", "A2"), (4, ts(3), None, "M")],
                                 "event_id long, ts timestamp_ntz, patient_id string, name string")
    tok = U.token_numbers(regs, table)
    got = rows(tok.select("event_id", "is_new", "token_number", "room_number"), "event_id")
    # one row in the table already; event 2 names nobody and is not counted; the
    # return (3) takes token 3 without raising the count, so event 4 gets 3 too
    assert got == [(1, True, 2, 2), (3, False, 3, 3), (4, True, 3, 3)]
    state = U.patients_upsert(tok, table)
    assert state.count() == 3 and state.filter("patient_id = '100'").first().name == "A2"
    same = U.patients_upsert(tok.filter("event_id = 1"), table)
    assert same.filter("patient_id = '100'").first().checked_in == 1  # untouched rows stay


def test_dedup_keeps_one_per_update(spark):
    u = spark.createDataFrame([(1, "late", ts(5)), (1, "first", ts(1)), (2, "b", ts(0)), (1, "also", ts(1))],
                              "update_id long, data string, updated_at timestamp_ntz")
    assert rows(U.dedup_updates(u), "update_id") == [(1, "also", ts(1)), (2, "b", ts(0))]
    log = spark.createDataFrame([(1, "held", ts(9))], u.schema)
    assert rows(U.append_updates(log, u), "update_id") == [(1, "held", ts(9)), (2, "b", ts(0))]
    assert U.append_updates(U.append_updates(log, u), u).count() == 2


def test_fanout_and_backfill(spark):
    clin = spark.createDataFrame(
        [(1, 10, ts(0), ["t"], []), (2, 10, ts(1), [], ["m"]), (3, 20, ts(0), [], []), (4, 30, ts(0), ["x"], ["y"])],
        "consultation_id long, patient_id long, created_at timestamp_ntz, lab_tests array<string>, "
        "prescriptions array<string>")
    assert [r.consultation_id for r in U.fanout_orders(clin).orderBy("consultation_id").collect()] == [1, 4]
    assert [r.consultation_id for r in U.fanout_rx(clin).orderBy("consultation_id").collect()] == [2, 4]
    prior = spark.createDataFrame([(1, 30)], "order_id long, patient_id long")
    got = rows(U.orders_backfill(clin, prior).select("patient_id", "consultation_id", "tests"), "patient_id")
    # empty lists still create an order; earliest event per patient wins
    assert got == [(10, 1, '["t"]'), (20, 3, "[]")]


def test_hospital_backfill_normalises_and_dedups(spark):
    apps = spark.createDataFrame([(1, '{"name":"A","email":"e@x"}', "approve"), (2, '{"name":"B","email":"e@x"}', "approved"),
                                  (3, '{"name":"C"}', "approved"), (4, '{"name":"D","email":"g@x"}', "approved"),
                                  (5, '{"name":"E","email":"f@x"}', "rejected"), (6, '{"name":"F"}', "approve")],
                                 "app_id long, data string, status string")
    hosp = spark.createDataFrame([("g@x",), (None,)], "email string")
    got = rows(U.hospital_backfill(apps, hosp).select("app_id", "email", "name"), "app_id")
    # g@x is taken; NULL emails equal nothing, so both make a hospital
    assert got == [(1, "e@x", "A"), (3, None, "C"), (6, None, "F")]


def test_staff_removal_needs_both_keys(spark):
    s = spark.createDataFrame([(1, 1), (2, 1)], "staff_id long, hospital_id int")
    t = spark.createDataFrame([(1, 1), (2, 9)], "staff_id long, hospital_id int")
    assert rows(U.staff_after_removal(s, t)) == [(2, 1)]


def test_staff_append_unique_usernames(spark):
    req = spark.createDataFrame([(1, 3, "A", "doctor", "u1"), (2, 3, "B", "doctor", "u1"), (3, 3, "C", "lab_tech", "u2")],
                                "request_id long, hospital_id int, name string, role string, username string")
    taken = spark.createDataFrame([("u2",)], "username string")
    assert rows(U.staff_append(req, taken).select("name", "username")) == [("A", "u1")]


# ---------------------------------------------------------------- extraction
def test_parse_records_strictness(spark):
    good = {"patient_id": "p", "symptoms": [], "diagnosis": "d", "prescriptions": ["m"], "lab_tests": [],
            "severity": "low", "followup": "", "clinical_notes": "", "extra": 1}
    cases = [
        (1, "```json " + json.dumps(good) + " ```"),
        (2, "no json here"),
        (3, json.dumps({k: v for k, v in good.items() if k != "diagnosis"})),
        (4, json.dumps({**good, "diagnosis": None})),
        (5, json.dumps({**good, "symptoms": ["a", 1]})),
        (6, json.dumps({**good, "severity": 3})),
        (7, "   "),
        (8, json.dumps([good])),
        (9, json.dumps({**good, "route_to": ["x"]})),
        (10, json.dumps({**good, "route_to": "lab"})),
        (11, json.dumps({**good, "symptoms": [None]})),
    ]
    df = spark.createDataFrame(cases, "request_id long, raw string")
    got = {r.request_id: r.reason for r in X.parse_records(df).collect()}
    assert got == {1: None, 2: "malformed", 3: "missing:diagnosis", 4: "null:diagnosis", 5: "type:symptoms",
                   6: "type:severity", 7: "empty", 8: "not_object", 9: None, 10: "type:route_to",
                   11: "type:symptoms"}
    ok = {r.request_id: r.route_to for r in X.record_extract(df).collect()}
    assert ok == {1: '["pharmacy"]', 9: '["x"]'}


def test_first_answer_skips_blank(spark):
    df = spark.createDataFrame([(1, 1, "  "), (1, 2, " b "), (2, 1, None), (2, 2, ""), (3, 2, "x"), (3, 1, "y")],
                               "request_id long, priority int, raw string")
    got = rows(X.first_answer(df), "request_id")
    assert got == [(1, 2, "b", "ok"), (2, None, None, "no_provider"), (3, 1, "y", "ok")]


def test_scan_decode_fallbacks(spark):
    df = spark.createDataFrame([(1, '{"patient_id":"P1"}'), (2, '{"k": 1}'), (3, "VK-9"), (4, "[1]"),
                                (5, '{"patient_id":""}'), (6, '{"patient_id":"5"} trailing'), (7, '{"patient_id":0}'),
                                (8, '{"patient_id":7}'), (9, '{"patient_id":null}'), (10, '{"patient_id":false}'), (11, None),
                                (12, '{"patient_id":[]}')], "event_id long, payload string")
    assert rows(X.scan_decode(df), "event_id") == [
        (1, "P1"), (2, '{"k": 1}'), (3, "VK-9"), (4, "[1]"), (5, '{"patient_id":""}'), (6, '{"patient_id":"5"} trailing'),
        (7, '{"patient_id":0}'), (8, "7"), (9, '{"patient_id":null}'), (10, '{"patient_id":false}'), (11, None), (12, "[]")]


def test_scan_encode_matches_python_json(spark):
    p = spark.createDataFrame([(1, 'A "q"', 2, 3), (2, None, 3, None)],
                              "patient_id long, name string, token_number long, room_number long")
    got = [r.payload for r in X.scan_encode(p).orderBy("patient_id").collect()]
    assert got == [json.dumps({"patient_id": 1, "name": 'A "q"', "token": 2, "room": 3}),
                   json.dumps({"patient_id": 2, "name": None, "token": 3, "room": None})]


def test_transcript_order_and_fallback(spark):
    t = spark.createDataFrame([(1, 2, "doctor", "", "tr2"), (1, 0, "patient", "hi", "x"), (1, 1, "nurse", None, "tr1")],
                              "conv_id long, turn long, role string, original string, translated string")
    assert X.transcripts(t).collect()[0].transcript == "Patient: hi\nPatient: tr1\nDoctor: tr2"


def test_translate_worklist_and_apply(spark):
    docs = spark.createDataFrame([(1, "bonjour", "fr"), (2, "bonjour", "fr"), (3, "hello", "en-IN"), (4, "  ", "de"),
                                  (5, "hallo", "de")], "doc_id long, text string, source_lang string")
    wl = X.translate_worklist(docs)
    assert sorted((r.text, r.n_requests) for r in wl.collect()) == [("bonjour", 2), ("hallo", 1)]
    res = wl.filter(F.col("text") == "bonjour").select("text_key", "source_lang", "target_lang",
                                                        F.lit("hello").alias("translated"))
    got = rows(X.translate_apply(docs, res).select("doc_id", "english"), "doc_id")
    assert got == [(1, "hello"), (2, "hello"), (3, "hello"), (4, "  "), (5, "hallo")]


def test_json_list_and_iso_text_match_python(spark):
    data = [(["a", 'b"c', "é"],), ([],), (None,), ([None, "x"],)]
    df = spark.createDataFrame(data, "l array<string>")
    got = [r[0] for r in df.select(C.json_list_text("l")).collect()]
    assert got == [json.dumps(["a", 'b"c', "é"], ensure_ascii=False), "[]", "null", json.dumps([None, "x"])]
    t = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 2, 3, 4, 5, 120),)],
                              "t timestamp_ntz")
    assert [r[0] for r in t.select(C.iso_text("t")).collect()] == ["2024-01-02T03:04:05",
                                                                   "2024-01-02T03:04:05.000120"]


def test_make_id_is_deterministic(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    ids = [r[0] for r in df.select(C.make_id("X-", "k")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 66


def test_triage_first_rule_wins(spark):
    df = spark.createDataFrame([(1, "Severe pain and CHEST PAIN, arm pain"), (2, "moderate"), (3, "fine"), (4, None),
                                (5, "chest pain"), (6, "works on a farm painting, chest pain"), (7, "jaw pain; chest pain"),
                                (8, "strokes"), (9, "a stroke"), (10, "severe pain")], "doc_id long, text string")
    assert rows(X.triage_rules(df), "doc_id") == [
        (1, "emergency", 1), (2, "medium", 3), (3, "low", 4), (4, "low", 4), (5, "low", 4), (6, "low", 4),
        (7, "emergency", 1), (8, "low", 4), (9, "emergency", 1), (10, "high", 2)]


def test_json_decode_takes_whole_values_only(spark):
    df = spark.createDataFrame([(1, '["a"]'), (2, '["a"] x'), (3, None), (4, '{"a":1}'), (5, "[]"), (6, "")], "k long, t string")
    assert [(r[1], r[3]) for r in rows(X.json_decode(df, "t", "k"), "k")] == [
        ("ok", '["a"]'), ("malformed", None), ("null", None), ("malformed", None), ("ok", "[]"), ("malformed", None)]
    assert [r[1] for r in rows(X.json_decode(df, "t", "k", kind="OBJECT"), "k")] == [
        "malformed", "malformed", "null", "ok", "malformed", "malformed"]


def test_repeated_json_keys_keep_the_last(spark):
    good = ('{"patient_id":"p","symptoms":[],"diagnosis":"x","diagnosis":"d","prescriptions":[],"lab_tests":[],'
            '"severity":"low","followup":"","clinical_notes":""}')
    df = spark.createDataFrame([(1, good)], "request_id long, raw string")
    assert X.record_extract(df).first().diagnosis == "d"


def test_wall_clock_times_ignore_the_session_zone(spark):
    t = spark.createDataFrame([(1, dt.datetime(2024, 3, 10, 2, 30)), (2, dt.datetime(2024, 11, 3, 1, 30, 0, 5)), (3, None)],
                              "k long, ts timestamp_ntz")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = rows(X.iso_parse(t, "ts", "k").select("iso_text", F.col("parsed").cast("string"), F.col("day").cast("string"), "k"), "k")
        assert got == [("2024-03-10T02:30:00", "2024-03-10 02:30:00", "2024-03-10", 1),
                       ("2024-11-03T01:30:00.000005", "2024-11-03 01:30:00.000005", "2024-11-03", 2), (None, None, None, 3)]
        enc = L.lake_encode(t.withColumnRenamed("ts", "created_at"))
        dec = L.lake_decode(enc.select("created_at"))
        assert sorted(str(r[0]) for r in dec.select(F.col("created_at").cast("string")).collect()) == [
            "2024-03-10 02:30:00", "2024-11-03 01:30:00.000005", "None"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_local_checkpoint_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from careflow.session import checkpoint_root

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d),
                              sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        checkpoint_root(cluster)


# ---------------------------------------------------------------- lake and sources
def test_lake_write_read_and_encode_inverse(spark, tmp_dir):
    rec = spark.createDataFrame(
        [(1, 10, ["s"], "d", ["m1", "m2"], [], None, ["pharmacy"], "f", "", dt.datetime(2024, 1, 1, 8)),
         (2, 11, [], "e", [], ["t"], "high", ["lab"], None, "n", dt.datetime(2024, 1, 2, 8, 0, 0, 5))],
        "consultation_id long, patient_id long, symptoms array<string>, diagnosis string, "
        "prescriptions array<string>, lab_tests array<string>, severity string, route_to array<string>, "
        "followup string, clinical_notes string, created_at timestamp_ntz")
    path = tmp_dir + "/lake"
    L.write_consultations(rec, path)
    L.write_consultations(rec.filter("consultation_id = 2"), path, L.day_counts(rec), rows_per_slice=1)  # append
    back = L.read_consultations(spark, path)
    assert back.count() == 3
    assert sorted(r.created_date.isoformat() for r in back.select("created_date").distinct().collect()) == \
        ["2024-01-01", "2024-01-02"]
    one = L.patient_history(back, spark.createDataFrame([(10,)], "patient_id long"))
    assert one.count() == 1
    enc = L.lake_encode(rec)
    e1 = enc.filter("consultation_id = '1'").collect()[0]
    assert e1.prescriptions == '["m1", "m2"]' and e1.severity == "" and e1.created_at == "2024-01-01T08:00:00"
    dec = L.lake_decode(enc.drop("consultation_id", "patient_id", "diagnosis", "followup", "clinical_notes"))
    assert [r.created_at for r in dec.orderBy("created_at").collect()] == \
        [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 2, 8, 0, 0, 5)]


def test_ingest_defaults_only_for_absent_columns(spark):
    from pyspark.sql.types import _parse_datatype_string
    from careflow import schemas as S
    src = spark.createDataFrame([(1, None)], "patient_id long, checked_in int")
    out = L.ingest_defaults(src, _parse_datatype_string(S.PATIENT_TABLE), S.PATIENT_DEFAULTS).collect()[0]
    assert out.room_number == 1 and out.checked_in is None and out.name is None


def test_key_audit_counts(spark):
    p = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, None, 9)], "patient_id long, name string, hospital_id int")
    h = spark.createDataFrame([(1, "H", "e"), (2, "I", "e"), (3, "J", None), (4, "K", None)], "hospital_id int, name string, email string")
    c = spark.createDataFrame([(1, 5), (2, 7)], "consultation_id long, patient_id long")
    e = spark.createDataFrame([], "order_id long, rx_id long, patient_id long, app_id long, update_id long, consultation_id long")
    s = spark.createDataFrame([(1, 9, "u"), (2, 1, "u")], "staff_id long, hospital_id int, username string")
    items = spark.createDataFrame([(1, 1), (1, 1)], "consultation_id long, line int")
    rep = {(r.table_name, r.rule): r.violations for r in L.key_audit(
        {"patients": p, "consultations": c, "lab_orders": e, "prescriptions": e, "hospitals": h, "staff": s,
         "items": items, "applications": e, "dept_updates": e, "alerts": e}).collect()}
    assert rep[("patients", "pk_duplicate:patient_id")] == 1
    assert rep[("patients", "not_null:name")] == 1
    assert rep[("patients", "fk:hospital_id->hospitals")] == 1
    assert rep[("consultations", "fk:patient_id->patients")] == 2
    assert rep[("staff", "fk:hospital_id->hospitals")] == 1
    assert rep[("staff", "unique:username")] == 1 and rep[("hospitals", "unique:email")] == 1
    assert rep[("items", "pk_duplicate:consultation_id,line")] == 1
    assert rep[("lab_orders", "pk_duplicate:order_id")] == 0


def test_schema_evolve_fills_null(spark):
    old = spark.createDataFrame([(1, "a")], "patient_id long, name string")
    new = spark.createDataFrame([(2, "b", 3)], "patient_id long, name string, hospital_id int")
    assert rows(L.schema_evolve(old, new), "patient_id") == [(1, "a", None), (2, "b", 3)]


def test_applications_flat_table_wins_clash_and_hides_password(spark):
    apps = spark.createDataFrame([(1, '{"name":"A","status":"payload","password":"pw"}', "pending", "c",
                                   dt.datetime(2024, 1, 1))],
                                 "app_id long, data string, status string, comments string, created_at timestamp_ntz")
    r = P.applications_flat(apps).collect()[0].asDict()
    assert r["status"] == "pending" and r["hospital_id"] == 1 and "password" not in r
    assert r["applied_at"] == dt.datetime(2024, 1, 1) and r["comments"] == "c"
    assert "password" not in P.publish(spark.createDataFrame([(1, "x")], "id long, password string")).columns


def test_cluster_conf_sizes_partitions():
    from careflow.session import cluster_conf
    c = cluster_conf(100 * 2**40, executors=1000, cores_per_executor=8)
    assert int(c["spark.sql.shuffle.partitions"]) == 102400  # 25 TB shuffle / 256 MB
    small = cluster_conf(2**30, executors=10, cores_per_executor=4)
    assert int(small["spark.sql.shuffle.partitions"]) == 120  # at least three waves
