"""U1, U2, W7 and W4 / W5 live: registrations and check-ins folded batch by batch.

The log is one stream of ``register`` and ``check_in`` rows (``request_log``). Each
micro-batch numbers its registrations from the count that the batch before left, and
merges one state row per patient it concerns:

``last``    the last registration, a struct that begins with (ts, event_id)
``visits``  registrations so far
``seen``    the last check-in, (ts, event_id)

Merging takes the greatest ``last`` and ``seen`` and adds ``visits``, so rows of one
patient may be merged in any grouping, and a hot patient is reduced before the shuffle.
The work of a batch follows its own rows: the patients table and the state are
semi-joined to the ids the batch names.

Every output of a batch lies under its id, and a batch reads only what earlier ones
wrote; a replayed batch (lost executor, restart) thus writes the same rows again.

Batches come in log order, split anywhere. A row that arrives late takes its number at
its arrival; ``last`` and ``seen`` still go by (ts, event_id). The patients table is the
one from before the log: it must stay as it was while the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.functions.common import make_id, prefix_position
from careflow.operators import registry as U
from careflow.session import scratch_path
from careflow.streaming.streams import _batch_writer, _run, keyed_sink, latest_snapshot, read_sink

KINDS = {"age": "int", "hospital_id": "int"}
FIELDS = ", ".join(f"{c}: {KINDS.get(c, 'string')}" for c in U.VISIT_FIELDS)
LAST = f"struct<ts: timestamp_ntz, event_id: bigint, {FIELDS}, token_number: bigint, room_number: bigint>"
SEEN = "struct<ts: timestamp_ntz, event_id: bigint>"
STATE = ["patient_id", "last", "visits", "seen"]


def request_log(registrations: DataFrame, checkins: DataFrame | None = None) -> DataFrame:
    """One log of both kinds of request. Visit fields that a frame lacks are NULL."""
    def shaped(df: DataFrame, kind: str) -> DataFrame:
        fields = [(F.col(c) if c in df.columns else F.lit(None)).cast(KINDS.get(c, "string")).alias(c) for c in U.VISIT_FIELDS]
        return df.select(F.lit(kind).alias("kind"), "event_id", "ts", F.col("patient_id").cast("string").alias("patient_id"), *fields)

    log = shaped(registrations, "register")
    return log if checkins is None else log.unionByName(shaped(checkins, "check_in"))


def _ids(df: DataFrame) -> DataFrame:
    return df.select(F.col("patient_id").cast("string").alias("patient_id"))


def merged(rows: DataFrame) -> DataFrame:
    """One state row per patient. Any grouping of the rows gives the same state."""
    return rows.groupBy("patient_id").agg(F.max("last").alias("last"), F.sum("visits").alias("visits"), F.max("seen").alias("seen"))


def batch_tokens(requests: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """W7 for one batch: ``known`` are the ids registered before it, ``count`` how many
    patients there were."""
    r = U.accepted_registrations(requests, known).withColumn("__new", F.col("is_new").cast("long"))
    log = requests.select("ts", "event_id", F.col("patient_id").isNull().cast("long").alias("__new"))
    pos = prefix_position(r, [], "ts", "event_id", weight_col="__new", inclusive=False, out="__prior", counted=log)
    before = F.col("__prior") + F.lit(count).cast("long")
    return pos.select(*requests.columns, "is_new", (before + 1).alias("token_number"), (before % 3 + 1).alias("room_number"))


def registration_folder(patients: DataFrame, base: str, compact_every: int = 32):
    """foreachBatch body: ``tokens``, ``state`` and ``count`` under ``base``."""
    sink = _batch_writer({"tokens": f"{base}/tokens", "count": f"{base}/count"})
    keep = keyed_sink(f"{base}/state", ["patient_id"], compact_every)

    def body(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        batch.persist()
        try:
            state = registration_state(spark, base, before=batch_id)
            # a new patient's id may have been named before: by a check-in that came too early
            given = F.coalesce("patient_id", F.when(F.col("kind") == "register", make_id("VK-", "event_id")))
            named = batch.select(given.alias("patient_id")).filter("patient_id is not null").distinct()
            mine = state.join(named, "patient_id", "left_semi")
            known = _ids(patients).unionByName(_ids(state.filter("last is not null"))).join(named, "patient_id", "left_semi")
            # the count of patients is one row a batch
            count = patients.count() if batch_id == 0 else spark.read.parquet(f"{base}/count/batch_id={batch_id - 1}").first()["patients"]
            requests = batch.filter("kind = 'register'").drop("kind")
            sink({"tokens": batch_tokens(requests, known, count)}, batch_id)
            tokens = spark.read.parquet(f"{base}/tokens/batch_id={batch_id}")
            sink({"count": tokens.agg((F.count_if("is_new") + F.lit(count)).cast("long").alias("patients"))}, batch_id)
            last = F.struct("ts", "event_id", *U.VISIT_FIELDS, "token_number", "room_number").cast(LAST)
            seen = F.struct("ts", "event_id").cast(SEEN)
            rows = tokens.select("patient_id", last.alias("last"), F.lit(1).cast("long").alias("visits"), F.lit(None).cast(SEEN).alias("seen"))
            came = batch.filter("kind = 'check_in' and patient_id is not null").select(
                "patient_id", F.lit(None).cast(LAST).alias("last"), F.lit(0).cast("long").alias("visits"), seen.alias("seen"))
            keep(merged(mine.select(STATE).unionByName(rows).unionByName(came)), batch_id)
        finally:
            batch.unpersist()

    return body


def run_registrations(log: DataFrame, patients: DataFrame, base: str, available_now: bool = True, compact_every: int = 32,
                      slots: int = 0):
    """Fold the stream ``log`` (see ``request_log``) into the tables under ``base``; with
    ``slots`` token boards of that many slots are kept as well."""
    fold = registration_folder(patients, base, compact_every)
    show = board_folder(patients, base, slots, compact_every) if slots else None

    def body(batch: DataFrame, batch_id: int):
        fold(batch, batch_id)
        if show:
            show(batch, batch_id)

    return _run(log.writeStream.foreachBatch(body), f"{base}/checkpoint", available_now)


def registration_state(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The newest state row of each patient the log has named."""
    schema = spark.createDataFrame([], f"patient_id string, last {LAST}, visits bigint, seen {SEEN}").schema
    return latest_snapshot(spark, f"{base}/state", "patient_id", schema, before)


def tokens_so_far(spark: SparkSession, base: str) -> DataFrame:
    """W7 live: token and room of every accepted registration."""
    return read_sink(spark, f"{base}/tokens").drop("batch_id")


def patients_now(spark: SparkSession, patients: DataFrame, base: str, upto: int | None = None) -> DataFrame:
    """U1 live: the rows of ``registry.patients_upsert`` (after batch ``upto``)."""
    state = registration_state(spark, base, None if upto is None else upto + 1).filter("last is not null")
    rows = U.patients_upsert(state.select("patient_id", "last.*"), patients).drop("visits")
    visits = state.select("patient_id", F.col("visits").alias("__visits"))
    return rows.join(visits, "patient_id", "left").withColumn("visits", F.coalesce("__visits", F.lit(0).cast("long"))).drop("__visits")


def checkins_now(spark: SparkSession, patients: DataFrame, base: str) -> DataFrame:
    """U2 live: the rows of ``registry.checkin_state``. Check-ins of ids that are neither
    in the table nor registered change nothing."""
    came = registration_state(spark, base).filter("seen is not null").select("patient_id", "seen.*")
    return U.checkin_state(patients_now(spark, patients, base), came)


# ---------------------------------------------------------------- W4 / W5 live boards
BOARD = "hospital_id int, day date, slots array<struct<token_number: bigint, patient_id: string, name: string, room_number: bigint>>"
SLOT = ["token_number", "patient_id", "name", "room_number"]


def _entries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("hospital_id").cast("int").alias("hospital_id"), F.to_date("created_at").alias("day"), "token_number",
                       "patient_id", "name", F.col("room_number").cast("long").alias("room_number"))


def _at_boards(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    # null-safe: patients without a hospital or a time have a board of their own
    return rows.alias("r").join(keys.alias("k"), F.expr("r.hospital_id <=> k.hospital_id AND r.day <=> k.day"), how)


def _boards_of(rows: DataFrame, keys: DataFrame, slots: int) -> DataFrame:
    """One row a board: its first tokens. The limit is the feature; it is applied before
    the shuffle too, so a hot hospital sends few rows a task. ``keys``: boards that are
    written even if nothing is left on them."""
    order = Window.partitionBy("hospital_id", "day").orderBy("token_number", "patient_id")
    first = rows.withColumn("__slot", F.row_number().over(order)).filter(F.col("__slot") <= slots)
    lines = first.select("hospital_id", "day", F.struct(*SLOT).alias("s"))
    none = keys.select("hospital_id", "day", F.lit(None).cast(lines.schema["s"].dataType).alias("s"))
    return lines.unionByName(none).groupBy("hospital_id", "day").agg(F.array_sort(F.collect_list("s")).alias("slots"))


def board_folder(patients: DataFrame, base: str, slots: int, compact_every: int = 32):
    """foreachBatch body (after ``registration_folder``): the ``slots`` first tokens of
    each hospital and day, by (token_number, patient_id), of the patients as they are now.

    A board is exact after every batch: one with a free slot holds all of its patients,
    and one that was full and lost a patient (who registered again, perhaps elsewhere) is
    filled anew from the patients' rows. All others need the batch and their slots only."""
    keep = keyed_sink(f"{base}/boards", ["hospital_id", "day"], compact_every)

    def body(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        now = _entries(patients_now(spark, patients, base, upto=batch_id))
        if batch_id == 0:
            keep(_boards_of(now, now.select("hospital_id", "day").distinct(), slots), 0)
            return
        named = spark.read.parquet(f"{base}/tokens/batch_id={batch_id}").select("patient_id").distinct()
        changed = spark.read.parquet(f"{base}/state/batch_id={batch_id}").filter("last is not null")
        came = _entries(changed.join(named, "patient_id", "left_semi").select("patient_id", "last.*").withColumnRenamed("ts", "created_at"))
        shown = boards(spark, base, before=batch_id).select("hospital_id", "day", (F.size("slots") >= slots).alias("full"), F.inline("slots"))
        shown = shown.select("hospital_id", "day", "full", *SLOT)
        gone = shown.join(named, "patient_id", "left_semi")
        touched = came.select("hospital_id", "day").unionByName(gone.select("hospital_id", "day")).distinct()
        rows = _at_boards(shown.join(named, "patient_id", "left_anti"), touched, "left_semi").select(came.columns).unionByName(came)
        short = gone.filter("full").select("hospital_id", "day").distinct()
        if not short.isEmpty():
            rows = _at_boards(rows, short, "left_anti").unionByName(_at_boards(now, short, "left_semi"))
        keep(_boards_of(rows, touched, slots), batch_id)

    return body


def boards(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """hospital_id, day and its slots in order. Empty until the stream has run."""
    schema = spark.createDataFrame([], BOARD).schema
    return latest_snapshot(spark, f"{base}/boards", ["hospital_id", "day"], schema, before)


def token_board_now(spark: SparkSession, base: str, as_of=None) -> DataFrame:
    """W5 live, a board a hospital: hospital_id, day, slot, now_serving and the patient.
    Whether patients have checked in is U2's to tell (``checkins_now``)."""
    now = boards(spark, base)
    now = now if as_of is None else now.filter(F.col("day") == F.lit(as_of).cast("date"))
    rows = now.select("hospital_id", "day", F.posexplode("slots").alias("pos", "s"))
    return rows.select("hospital_id", "day", (F.col("pos") + 1).cast("long").alias("slot"), (F.col("pos") == 0).alias("now_serving"), "s.*")


def stream_registry(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Registered forms: the log arrives as a stream and is read back as 'patients' (U1),
    'checkins' (U2) or 'boards' (W5)."""
    from careflow.sources.bindings import Bindings
    b = Bindings(spark, sf_dir)
    base = scratch_path(spark, "registrations")
    came = b.stream_view("b_checkins", "events") if which == "checkins" else None
    log = request_log(b.stream_view("b_registrations", "events"), came)
    run_registrations(log, b.patients, base, slots=6 if which == "boards" else 0)
    if which == "boards":
        return token_board_now(spark, base)
    return {"patients": patients_now, "checkins": checkins_now}[which](spark, b.patients, base)
