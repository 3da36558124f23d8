"""Lake table of consultation records and table hygiene.

The lake is parquet partitioned by consultation day, appended a whole batch
at a time (never one-row files). A reader's key filter reaches the scan as a
pushed filter, and a day filter prunes partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.functions.common import iso_text, json_list_text

LAKE_COLUMNS = ["consultation_id", "patient_id", "symptoms", "diagnosis", "prescriptions", "lab_tests",
                "severity", "route_to", "followup", "clinical_notes", "created_at"]
LIST_COLUMNS = ("symptoms", "prescriptions", "lab_tests", "route_to")


def with_route(clinical: DataFrame) -> DataFrame:
    """Give a clinical frame the lake's columns (route derived, notes empty when absent)."""
    from careflow.functions.extract import derive_route
    df = clinical
    if "route_to" not in df.columns:
        df = df.withColumn("route_to", derive_route(F.col("lab_tests"), F.col("prescriptions")))
    if "clinical_notes" not in df.columns:
        df = df.withColumn("clinical_notes", F.lit("").cast("string"))
    return df.select(*LAKE_COLUMNS)


def day_counts(consultations: DataFrame) -> DataFrame:
    """Rows per consultation day, from the narrow table (one column is read)."""
    return consultations.groupBy(F.to_date("created_at").alias("created_date")).agg(F.count(F.lit(1)).alias("__n"))


def write_consultations(records: DataFrame, path: str, days: DataFrame | None = None,
                        rows_per_slice: int = 5_000_000, row_group_bytes: int = 32 << 20, ids_per_group: int = 10_000) -> None:
    """Append a batch of records, partitioned by day.

    Rows are dealt by (day, slice), a slice being a hash of the id modulo the
    number of slices the day's rows need (``days``: rows per day, see
    ``day_counts``; without it every day is one slice). A hot day is written
    by many tasks, files hold about ``rows_per_slice`` rows (and never more),
    and the records are read once: nothing is sampled. Within its day a task's
    rows are sorted by patient, so a row group holds a narrow range of ids, and
    each column chunk of ids carries a bloom filter: a reader of one patient
    opens only the row groups that may hold it (``patient_rows``). The filter
    is sized for ``ids_per_group`` different patients (16 KB).
    """
    out = records.withColumn("created_date", F.to_date("created_at"))
    # a fixed number of tasks: by bytes alone, many small days would be one task's files
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if days is None:
        out = out.repartition(tasks, "created_date")
    else:
        slices = days.select("created_date", F.ceil(F.col("__n") / rows_per_slice).cast("int").alias("__slices"))
        out = out.join(slices, "created_date", "left")
        out = out.withColumn("__slice", F.pmod(F.xxhash64("consultation_id"), F.coalesce("__slices", F.lit(1))))
        out = out.repartition(tasks, "created_date", "__slice").drop("__slices", "__slice")
    out = out.sortWithinPartitions("created_date", "patient_id")
    (out.write.mode("append").option("maxRecordsPerFile", rows_per_slice)
     .option("parquet.bloom.filter.enabled#patient_id", "true")
     .option("parquet.bloom.filter.expected.ndv#patient_id", ids_per_group)
     .option("parquet.block.size", row_group_bytes)
     .partitionBy("created_date").parquet(path))


def read_consultations(spark: SparkSession, path: str) -> DataFrame:
    """S3: the whole lake table."""
    return spark.read.parquet(path)


def patient_rows(lake: DataFrame, patient_ids: list) -> DataFrame:
    """S4 / P10 for a few patients: the ids go to the parquet reader, which skips
    row groups by their range of ids and by their bloom filter."""
    return lake.filter(F.col("patient_id").isin(list(patient_ids)))


def patient_history(lake: DataFrame, requests: DataFrame) -> DataFrame:
    """Lake rows of the requested patients (a batch of ids; semi-join).

    For a few ids see ``patient_rows``; for many, the semi-join shuffles only the id column of
    the requests (or broadcasts it once AQE has seen its size).
    """
    return lake.join(requests.select("patient_id").distinct(), "patient_id", "left_semi")


def schema_evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union two generations of a table; missing columns read as NULL."""
    return old.unionByName(new, allowMissingColumns=True)


#: Kinds of numbers, each holding all values of those before it.
WIDER = [["byte", "short", "integer", "long"], ["float", "double"]]


def wider_type(a: T.DataType, b: T.DataType, where: str = "") -> T.DataType:
    """The type that holds the values of both: structs by name (fields of either),
    lists and maps by element, whole numbers and fractions each to the wider one,
    decimals to the digits of both. Other differences raise, as any cast could lose values."""
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        theirs, mine = {f.name: f for f in b.fields}, {f.name for f in a.fields}
        fields = [T.StructField(f.name, wider_type(f.dataType, theirs[f.name].dataType, f"{where}.{f.name}") if f.name in theirs else f.dataType)
                  for f in a.fields]
        return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in b.fields if f.name not in mine])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider_type(a.elementType, b.elementType, where + "[]"))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(wider_type(a.keyType, b.keyType, where + "{}"), wider_type(a.valueType, b.valueType, where + "{}"))
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale, whole = max(a.scale, b.scale), max(a.precision - a.scale, b.precision - b.scale)
        if whole + scale <= 38:
            return T.DecimalType(whole + scale, scale)
    for kinds in WIDER:
        if a.typeName() in kinds and b.typeName() in kinds:
            return a if kinds.index(a.typeName()) >= kinds.index(b.typeName()) else b
    if a.typeName() == b.typeName() and a.simpleString() == b.simpleString():
        return a
    raise TypeError(f"{where.lstrip('.')}: {a.simpleString()} and {b.simpleString()} have no common type without loss")


def conformed(col: Column, has: T.DataType, want: T.DataType) -> Column:
    """``col`` as ``want``: absent fields are NULL at every depth, a NULL stays NULL."""
    if has.simpleString() == want.simpleString():
        return col
    if isinstance(want, T.StructType) and isinstance(has, T.StructType):
        mine = {f.name: f.dataType for f in has.fields}
        fields = [(conformed(col.getField(f.name), mine[f.name], f.dataType) if f.name in mine else F.lit(None).cast(f.dataType)).alias(f.name)
                  for f in want.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(has, T.ArrayType):
        return F.transform(col, lambda x: conformed(x, has.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(has, T.MapType):
        col = F.transform_keys(col, lambda k, v: conformed(k, has.keyType, want.keyType))
        return F.transform_values(col, lambda k, v: conformed(v, has.valueType, want.valueType))
    return col.cast(want)


def evolve(*generations: DataFrame) -> DataFrame:
    """Generations of one table as one frame, oldest first. Columns and fields that a
    generation lacks are NULL, at any depth; numbers take the widest kind. Columns keep
    the order they first appear in. Narrow: no shuffle, each generation is read once."""
    want = reduce(wider_type, [g.schema for g in generations])

    def shaped(g: DataFrame) -> DataFrame:
        has = {f.name: f.dataType for f in g.schema.fields}
        return g.select(*[(conformed(F.col(f"`{f.name}`"), has[f.name], f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name)
                          for f in want.fields])

    return reduce(DataFrame.unionAll, [shaped(g) for g in generations])


def read_generations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Folders written under different schemas, each read by its own (parquet's own
    schema merging neither widens nor completes fields in lists)."""
    return evolve(*[spark.read.parquet(p) for p in paths])


def ingest_defaults(source: DataFrame, target: T.StructType, defaults: dict) -> DataFrame:
    """Shape ``source`` to ``target``: columns the source lacks take the
    DDL default (or NULL); columns it has keep their values, NULL included,
    as SQL defaults apply to absent columns only."""
    cols = []
    for f in target.fields:
        if f.name in source.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name in defaults:
            cols.append(F.lit(defaults[f.name]).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return source.select(*cols)


def lake_encode(records: DataFrame) -> DataFrame:
    """Every value as text: lists as ``json.dumps`` writes them, NULL as
    '', timestamps in ISO form, everything else ``str()``."""
    out = []
    for c in records.columns:
        dt = records.schema[c].dataType
        if isinstance(dt, T.ArrayType):
            v = json_list_text(c)
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            v = iso_text(c)
        else:
            v = F.col(c).cast("string")
        out.append(F.coalesce(v, F.lit("")).alias(c))
    return records.select(*out)


def lake_decode(encoded: DataFrame) -> DataFrame:
    """Inverse of S7 for the lake columns: typed lists and timestamps back."""
    cols = []
    for c in encoded.columns:
        if c in LIST_COLUMNS:
            cols.append(F.from_json(c, "array<string>").alias(c))
        elif c == "created_at":
            cols.append(F.nullif(F.col(c), F.lit("")).try_cast("timestamp_ntz").alias(c))
        else:
            cols.append(F.nullif(F.col(c), F.lit("")).alias(c))
    return encoded.select(*cols)


# ---------------------------------------------------------------- key audit
#: table: primary key, UNIQUE columns, NOT NULL columns, (column, parent table, parent key)
CONSTRAINTS = {
    "patients": (["patient_id"], [], ["name"], [("hospital_id", "hospitals", "hospital_id")]),
    "consultations": (["consultation_id"], [], [], [("patient_id", "patients", "patient_id")]),
    "lab_orders": (["order_id"], [], [], [("patient_id", "patients", "patient_id")]),
    "prescriptions": (["rx_id"], [], [], [("patient_id", "patients", "patient_id")]),
    "hospitals": (["hospital_id"], ["email"], ["name"], []),
    "staff": (["staff_id"], ["username"], [], [("hospital_id", "hospitals", "hospital_id")]),
    "items": (["consultation_id", "line"], [], [], []),
    "applications": (["app_id"], [], [], []),
    "dept_updates": (["update_id"], [], [], []),
    "alerts": (["consultation_id"], [], [], []),
}


def _report(name: str, violations: DataFrame, rules: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{r}', `{r}`" for r in rules)
    return violations.select(F.lit(name).alias("table_name"), F.expr(f"stack({len(rules)}, {pairs}) AS (rule, violations)"))


def key_audit(t: dict[str, DataFrame]) -> DataFrame:
    """One report row per constraint: duplicate primary keys and UNIQUE
    values (keys seen more than once; NULLs are not equal), NOT NULL
    violations, orphan foreign keys. One aggregation per table counts its
    key and its NULLs together; nothing reaches the driver."""
    parts = []
    for name, (pk, unique, required, parents) in CONSTRAINTS.items():
        df = t[name]
        nulls = [F.count_if(F.col(c).isNull()).alias(f"not_null:{c}") for c in required]
        by_key = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("__n"), *nulls)
        rules = ["pk_duplicate:" + ",".join(pk), *(f"not_null:{c}" for c in required)]
        zero = F.lit(0).cast("long")
        parts.append(_report(name, by_key.agg(F.count_if(F.col("__n") > 1).alias(rules[0]),
                                              *[F.coalesce(F.sum(F.col(f"`{r}`")), zero).alias(r) for r in rules[1:]]), rules))
        for c in unique:
            seen = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
            parts.append(_report(name, seen.agg(F.count_if(F.col("__n") > 1).alias(f"unique:{c}")), [f"unique:{c}"]))
        for c, parent, key in parents:
            orphans = df.filter(F.col(c).isNotNull()).join(t[parent].select(F.col(key).alias(c)), c, "left_anti")
            parts.append(_report(name, orphans.agg(F.count(F.lit(1)).alias(f"fk:{c}->{parent}")), [f"fk:{c}->{parent}"]))
    return reduce(DataFrame.unionByName, parts)
