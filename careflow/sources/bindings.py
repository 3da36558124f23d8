"""Hospital tables bound onto the driver's parquet tables.

Each binding is a plain SELECT that runs unchanged on Spark SQL and DuckDB
(FIXTURES.md section 4). On Spark it is analysed against temp views of the
base parquet tables, so Catalyst sees straight through it: filters on a
binding column reach the parquet scan and unused columns are pruned. The
temp views behind it carry folder-specific names, so a caller's own views are
left alone.

The oracle side inlines the same text as ``WITH`` clauses (``oracle_with``).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Fixed binding texts (FIXTURES.md section 4), shared by Spark and the oracle.
BINDING_SQL: dict[str, str] = {
    "b_hospitals": """
SELECT n_nationkey AS hospital_id, n_name AS name, concat('h', n_nationkey, '@x.org') AS email FROM nation WHERE
n_regionkey <> 4""",
    "b_admins": """
SELECT r_regionkey AS admin_id FROM region""",
    "b_staff": """
SELECT s_suppkey AS staff_id, s_nationkey AS hospital_id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN
'doctor' WHEN 1 THEN 'receptionist' WHEN 2 THEN 'lab_tech' ELSE 'pharmacist' END AS role FROM supplier""",
    "b_patients": """
SELECT c_custkey AS patient_id, c_name AS name, CASE c_custkey % 11 WHEN 0 THEN 'hi-IN' WHEN 1 THEN 'ta-IN'
WHEN 2 THEN 'te-IN' WHEN 3 THEN 'kn-IN' WHEN 4 THEN 'ml-IN' WHEN 5 THEN 'bn-IN' WHEN 6 THEN 'mr-IN' WHEN 7
THEN 'gu-IN' WHEN 8 THEN 'pa-IN' WHEN 9 THEN 'en-IN' ELSE NULL END AS language, c_custkey + 1 AS token_number,
(c_custkey % 3) + 1 AS room_number, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 1 ELSE 0 END AS
checked_in, c_nationkey AS hospital_id, v.created_at FROM customer LEFT JOIN (SELECT o_custkey,
max(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) v ON c_custkey = v.o_custkey""",
    "b_consultations": """
SELECT o_orderkey AS consultation_id, o_custkey AS patient_id, CASE o_orderpriority WHEN '1-URGENT' THEN
'emergency' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE NULL END AS
severity, concat('DX-', o_orderstatus) AS diagnosis, CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN ''
ELSE 'Review in 3 days' END AS followup, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('Note ',
o_orderkey) END AS clinical_notes, o_orderdate AS created_at, c_nationkey AS hospital_id FROM orders JOIN customer ON o_custkey = c_custkey""",
    "b_lab_orders": """
SELECT o_orderkey AS order_id, o_custkey AS patient_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F'
THEN 'completed' ELSE 'cancelled' END AS status, concat('["T', o_orderkey % 9, '"]') AS tests, CASE
o_orderstatus WHEN 'F' THEN concat('{"T', o_orderkey % 9, '":"5.1"}') ELSE '{}' END AS results, o_orderdate AS
created_at FROM orders""",
    "b_prescriptions": """
SELECT o_orderkey AS rx_id, o_custkey AS patient_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN
'dispensed' ELSE 'on_hold' END AS status, concat('["M', o_orderkey % 11, '"]') AS medicines, o_orderdate AS
created_at FROM orders""",
    "b_registrations": """
SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 11 = 0 THEN user_id + 1000000000 ELSE
user_id END AS patient_id, concat('R', event_id) AS name, CAST(event_id % 90 AS INT) AS age, CASE event_id % 2
WHEN 0 THEN 'F' ELSE 'M' END AS gender, CASE event_id % 4 WHEN 0 THEN 'hi-IN' WHEN 1 THEN 'ta-IN' ELSE 'en-IN'
END AS language, CAST(event_id % 25 AS INT) AS hospital_id, CAST(1000 + event_id % 9000 AS STRING) AS
aadhaar_last4 FROM events WHERE event_type = 'signup'""",
    "b_lab_order_events": """
SELECT event_id AS order_id, user_id AS patient_id, ts AS created_at FROM events WHERE event_type = 'purchase'""",
    "b_rx_events": """
SELECT event_id AS rx_id, user_id AS patient_id, ts AS created_at FROM events WHERE event_type = 'signup'""",
    "b_dept_updates": """
SELECT event_id AS update_id, user_id AS patient_id, CASE event_type WHEN 'click' THEN 'lab' WHEN 'error' THEN
'pharmacy' ELSE 'other' END AS dept, CASE event_type WHEN 'click' THEN 'submitted_results' WHEN 'error' THEN
'dispensed' ELSE 'note' END AS action, props AS data, ts AS updated_at FROM events WHERE event_type IN
('click', 'error', 'view')""",
    "b_applications": """
SELECT s_suppkey AS app_id, concat('{"name":"', s_name, '","license_number":"L', s_suppkey, '","phone":"',
900000 + s_suppkey, '","email":', CASE WHEN s_suppkey % 23 = 0 THEN 'null' ELSE concat('"h', s_suppkey % 40, '@x.org"')
END, ',"pincode":"', 100000 + s_suppkey, '","city":"C', s_nationkey, '","state":"S', s_nationkey % 5,
'","admin_email":"a', s_suppkey, '@x.org","password":"pw","status":"payload"}') AS data, CASE s_suppkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'approved'
WHEN 2 THEN 'pending' ELSE 'rejected' END AS status FROM supplier""",
    "b_staff_accounts": """
SELECT s_suppkey AS staff_id, s_nationkey AS hospital_id, s_name AS name, concat('u', s_suppkey * 5) AS username,
concat('pw', s_suppkey) AS password, CASE s_suppkey % 4 WHEN 0 THEN 'doctor' WHEN 1 THEN 'receptionist' WHEN 2
THEN 'lab_tech' ELSE 'pharmacist' END AS role FROM supplier""",
    # one payload of each kind: a code, JSON with an id, without one, with a
    # false one, with a number, and JSON that text follows
    "b_scans": """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('{"patient_id":"', user_id, '","token":1}') WHEN 1 THEN
concat('VK-', user_id) WHEN 2 THEN '{"patient_id":0}' WHEN 3 THEN concat('{"patient_id":"', user_id, '"} x') WHEN
4 THEN concat('{"patient_id":', user_id + 1, '}') ELSE props END AS payload FROM events""",
    "b_answers": """
SELECT o_orderkey AS request_id, 1 AS priority, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1
THEN NULL ELSE concat('```json', '{"diagnosis":"D', o_orderkey, '"}', '```') END AS raw FROM orders UNION ALL
SELECT o_orderkey, 2, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('{"diagnosis":"B', o_orderkey, '"}')
END FROM orders""",
    "b_turns": """
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'doctor' ELSE 'patient' END AS role, CASE WHEN turn % 4
= 3 THEN '' ELSE text END AS original, text AS translated FROM conversations""",
    "b_transcripts": """
SELECT doc_id, text, CASE lang WHEN 'en' THEN 'en-IN' ELSE lang END AS source_lang FROM documents""",
    # complaints of every triage class, and phrases that only look like them
    "b_complaints": """
SELECT doc_id, concat(text, CASE doc_id % 10 WHEN 0 THEN ' Chest pain and some jaw pain.' WHEN 1 THEN
' chest pain only' WHEN 2 THEN ' works on a farm painting' WHEN 3 THEN ' Breathing difficulty!' WHEN 4 THEN
' HIGH FEVER since Monday' WHEN 5 THEN ' moderate cough' WHEN 6 THEN ' heatstrokes are known' WHEN 7 THEN
' needs monitoring, severe pain' WHEN 8 THEN '' ELSE ' arm pain, then chest pain' END) AS text FROM documents""",
    "b_items": """
SELECT l_orderkey AS consultation_id, l_linenumber AS line, l_partkey AS part_id, p_name AS medicine, p_type
AS test FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "b_json_lists": """
SELECT p_partkey AS row_id, CASE p_partkey % 10 WHEN 0 THEN '[]' WHEN 1 THEN NULL WHEN 2 THEN 'not json' WHEN
3 THEN '["a"] x' WHEN 4 THEN '{"a":1}' ELSE concat('["', p_name, '","', p_type, '"]') END AS symptoms FROM part""",
    "b_results": """
SELECT p_partkey AS order_id, concat('["', p_name, '","', p_type, '"]') AS tests, CASE p_partkey % 4 WHEN 0
THEN '{}' WHEN 1 THEN concat('{"', p_name, '":"5.1"}') WHEN 2 THEN concat('{"', p_name, '":"5.1","', p_type,
'":"  "}') ELSE concat('{"', p_name, '":"5.1","', p_type, '":"7"}') END AS results FROM part""",
    "b_records": """
SELECT o_orderkey AS request_id, CASE o_orderkey % 6 WHEN 0 THEN 'no json here' WHEN 1 THEN
concat('{"patient_id":"', o_custkey, '"}') ELSE concat('```json {"patient_id":"', o_custkey,
'","symptoms":["s', o_orderkey % 7, '"],"diagnosis":', CASE WHEN o_orderkey % 6 = 2 THEN 'null' ELSE
concat('"D', o_orderkey % 9, '"') END, ',"prescriptions":', CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE
'["m1","m2"]' END, ',"lab_tests":', CASE WHEN o_orderkey % 5 = 0 THEN '[]' ELSE '["t1"]' END,
',"severity":"low"', CASE WHEN o_orderkey % 6 = 3 THEN ',"route_to":["lab"]' ELSE '' END,
',"followup":"f","clinical_notes":""} ```') END AS raw FROM orders""",
    # several decisions per application, approvals of one email by several
    # applications, and equal times
    "b_decisions": """
SELECT event_id AS decision_id, user_id AS app_id, CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN
'rejected' ELSE 'pending' END AS status, concat('c', event_id) AS comments, ts AS decided_at FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "b_checkins": """
SELECT event_id, user_id + CASE WHEN event_id % 11 = 0 THEN 100000 ELSE 0 END AS patient_id, ts FROM events
WHERE event_type = 'view'""",
    "b_tombstones": """
SELECT s_suppkey AS staff_id, s_nationkey + CASE WHEN s_suppkey % 20 = 0 THEN 1 ELSE 0 END AS hospital_id FROM
supplier WHERE s_suppkey % 10 = 0""",
    "b_deliveries": """
SELECT o_orderkey AS consultation_id, CASE o_orderkey % 3 WHEN 0 THEN 'sent' ELSE 'failed' END AS status FROM
orders WHERE o_orderkey % 3 <> 2""",
    # Registration requests as the reception form sends them (name, age text):
    # one blank name in 17 and three kinds of bad age text in 19.
    "b_register_requests": """
SELECT e.event_id, e.user_id AS patient_id, CASE WHEN e.event_id % 17 = 0 THEN '  ' ELSE c.c_name END AS name,
CASE e.event_id % 19 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN ' 12y' ELSE CAST(CAST(floor(e.value) AS BIGINT)
AS STRING) END AS age_text FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type =
'signup'""",
    "b_prior_rx": """
SELECT event_id AS rx_id, user_id AS patient_id FROM events WHERE event_type = 'click' AND event_id % 50 = 1""",
    "b_prior_orders": """
SELECT event_id AS order_id, user_id AS patient_id FROM events WHERE event_type = 'purchase' AND event_id % 50
= 1""",
}

_WORD = re.compile(r"\b([a-z_]+)\b")


def tables_in(sql: str) -> list[str]:
    words = set(_WORD.findall(sql))
    return [t for t in BASE_TABLES if t in words]


class Bindings:
    """Binding views of one scale-factor folder as lazily built DataFrames.

    ``b.patients`` is the DataFrame of ``b_patients``. Base tables are read
    once per object; their temp views are re-pointed to this folder right
    before each binding is analysed, so two objects on different folders
    never see each other's data.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._base: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}
        # temp views get names of their own (per folder), so a caller's views
        # called 'orders' or 'customer' are never replaced
        self._prefix = "cf_" + hashlib.sha1(self.sf_dir.encode()).hexdigest()[:10] + "_"

    def table(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._base[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            sql = BINDING_SQL[name]
            used = tables_in(sql)
            for t in used:
                self.table(t).createOrReplaceTempView(self._prefix + t)
            pattern = re.compile(r"\b(" + "|".join(used) + r")\b")
            self._views[name] = self.spark.sql(pattern.sub(lambda m: self._prefix + m.group(1), sql))
        return self._views[name]

    def stream_view(self, name: str, streaming_table: str, max_files_per_trigger: int | None = None) -> DataFrame:
        """The binding ``name`` as a streaming DataFrame: ``streaming_table``
        is read as a file stream (the folder, filtered to its file), every
        other table it joins stays static (stream-static joins)."""
        schema = self.table(streaming_table).schema
        r = self.spark.readStream.schema(schema).option("pathGlobFilter", f"{streaming_table}.parquet")
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
        sql = BINDING_SQL[name]
        used = tables_in(sql)
        stream_prefix = self._prefix + "s_"
        r.parquet(self.sf_dir).createOrReplaceTempView(stream_prefix + streaming_table)
        for t in used:
            if t != streaming_table:
                self.table(t).createOrReplaceTempView(self._prefix + t)
        pattern = re.compile(r"\b(" + "|".join(used) + r")\b")
        return self.spark.sql(pattern.sub(
            lambda m: (stream_prefix if m.group(1) == streaming_table else self._prefix) + m.group(1), sql))

    def __getattr__(self, item: str) -> DataFrame:
        if item.startswith("_"):
            raise AttributeError(item)
        key = "b_" + item
        if key in BINDING_SQL:
            return self.view(key)
        raise AttributeError(item)
