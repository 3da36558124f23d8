"""S9 by increments: the key audit kept as a table of counts.

Each batch of new rows becomes counts per (table, rule, key) under the batch's own
folder. Counts are sums: they may be added up in any order, folded again (a replayed
batch replaces its folder) and compacted. The audit of everything so far, and the keys a
new batch repeats, come from this table; the rows of earlier batches are not read again.

A key is the JSON text of its columns by position, so a child's value and its parent's
key are written alike. NULLs are keys of a primary key, as in ``lake.key_audit``; UNIQUE
and foreign-key columns skip them. Counting has a map-side partial step, so a key that a
third of the rows refer to is a few rows in the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.sources.lake import CONSTRAINTS

COUNTS = ["table_name", "rule", "key"]


def _key(rows: DataFrame, columns: list[str]) -> Column:
    text = F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)]))
    if any(not isinstance(rows.schema[c].dataType, T.IntegralType) for c in columns):
        return text
    # the same text without a JSON writer for each key; a NULL leaves its column out
    parts = [x for i, c in enumerate(columns) for x in (F.lit(f'{"," if i else "{"}"c{i}":'), F.col(c).cast("string"))]
    return F.coalesce(F.concat(*parts, F.lit("}")), text)


def _primary(table: str) -> str:
    return "pk_duplicate:" + ",".join(CONSTRAINTS[table][0])


def table_counts(name: str, rows: DataFrame) -> DataFrame:
    """table_name, rule, key, n of a batch of rows of one table; the rows are read once.

    The rules are grouping sets over the columns themselves; a key's text is written once."""
    pk, unique, required, parents = CONSTRAINTS[name]
    rules = [(_primary(name), pk), *((f"unique:{c}", [c]) for c in unique), *((f"fk:{c}->{parent}", [c]) for c, parent, _ in parents)]
    own = [[f"k{i}_{j}" for j in range(len(columns))] for i, (_, columns) in enumerate(rules)]
    nulls = [f"null_{i}" for i in range(len(required))]
    each = rows.select(*[F.col(c).alias(o) for (_, columns), some in zip(rules, own) for c, o in zip(columns, some)],
                       *[F.col(c).isNull().alias(o) for c, o in zip(required, nulls)])
    sets = [*own, *([o] for o in nulls)]
    flat = [c for some in sets for c in some]
    counts = each.groupingSets([[F.col(c) for c in some] for some in sets], *flat).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(some[0]).alias(f"not_{i}") for i, some in enumerate(sets)])
    rule, key, keep = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False)
    for i, some in enumerate(sets):
        here = F.col(f"not_{i}") == 0
        if i < len(own):
            label, text, wanted = rules[i][0], _key(each, some), F.col(some[0]).isNotNull() if i else F.lit(True)
        else:
            label, text, wanted = f"not_null:{required[i - len(own)]}", F.lit(""), F.col(some[0])
        rule, key, keep = F.when(here, label).otherwise(rule), F.when(here, text).otherwise(key), F.when(here, wanted).otherwise(keep)
    return counts.filter(keep).select(F.lit(name).alias("table_name"), rule.alias("rule"), key.alias("key"), "n")


def _write(counts: DataFrame, folder: str) -> None:
    """One folder a table. A task holds few tables, so it keeps their files open rather
    than sort its rows by table first."""
    spark, name = counts.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(len(CONSTRAINTS)))
    try:
        counts.write.mode("overwrite").partitionBy("table_name").parquet(folder)
    finally:
        spark.conf.set(name, before)


def fold(tables: dict[str, DataFrame], path: str, batch: int) -> None:
    """Store the counts of a batch (any of the tables); the same batch again replaces them."""
    counts = reduce(DataFrame.unionByName, [table_counts(name, rows) for name, rows in tables.items()])
    _write(counts, f"{path}/batch={batch}")


def merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*COUNTS).agg(F.sum("n").alias("n"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return merged(spark.read.parquet(path))


def compact(spark: SparkSession, path: str, into: str) -> None:
    """All batches as one, in a new folder (the old one is left as it is)."""
    _write(read_counts(spark, path), f"{into}/batch=0")


def repeated(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """table_name, rule, key, n_before, n_batch: the primary and unique keys of a batch
    that it holds twice or that earlier batches hold."""
    rows = spark.read.parquet(path).filter("rule LIKE 'pk_duplicate:%' OR rule LIKE 'unique:%'")
    mine = rows.filter(F.col("batch") == batch).select(*COUNTS, F.col("n").alias("n_batch"))
    # only the batch's keys pass the join; the rest of the history is not grouped
    old = rows.filter(F.col("batch") < batch).join(mine.select(COUNTS), COUNTS, "left_semi")
    old = old.groupBy(*COUNTS).agg(F.sum("n").alias("n_before"))
    out = mine.join(old, COUNTS, "left").select(*COUNTS, F.coalesce("n_before", F.lit(0).cast("long")).alias("n_before"), "n_batch")
    return out.filter("n_before + n_batch > 1")


def audit(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``lake.key_audit`` over all batches folded so far.

    A child row counts as an orphan while its parent is absent, whichever of them comes
    first. A parent's key and its children's values meet in one group, each side in a
    place of its own, so the counts are read and shuffled once."""
    places, group, children = [], {}, {}
    for name, (_, unique, required, _) in CONSTRAINTS.items():
        for r in (_primary(name), *(f"unique:{c}" for c in unique), *(f"not_null:{c}" for c in required)):
            group[name, r] = len(group)
            places.append((name, r, group[name, r], 0))
    for name, (_, _, _, parents) in CONSTRAINTS.items():
        for c, parent, _ in parents:
            meets = group[parent, _primary(parent)]
            children[meets] = children.get(meets, 0) + 1
            places.append((name, f"fk:{c}->{parent}", meets, children[meets]))
    places = spark.createDataFrame(places, "table_name string, rule string, meets int, place int")  # the fixed list of rules
    own = range(1, max(children.values(), default=0) + 1)
    rows = spark.read.parquet(path).join(F.broadcast(places), ["table_name", "rule"])
    keys = rows.groupBy("meets", "key").agg(*[F.sum(F.when(F.col("place") == i, F.col("n"))).alias(f"n{i}") for i in (0, *own)])
    found = keys.groupBy("meets").agg(F.count_if(F.col("n0") > 1).alias("twice"), F.sum("n0").alias("all"),
                                      F.array(*[F.sum(F.when(F.col("n0").isNull(), F.col(f"n{i}"))) for i in own]).alias("orphans"))
    v = F.when(F.col("place") > 0, F.get("orphans", F.col("place") - 1)).when(F.col("rule").startswith("not_null:"), F.col("all")).otherwise(F.col("twice"))
    return places.join(found, "meets", "left").select("table_name", "rule", F.coalesce(v, F.lit(0).cast("long")).alias("violations"))
