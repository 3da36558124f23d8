"""Operator 8, benchmark decontamination by size-partitioned MinHash containment search,
in DataFrame functions.

A document contains a test item when it holds at least ``percent`` of the item's
distinct 5-word shingles, however long the document is. Items are partitioned by size
(powers of two). An item's signature holds its smallest hashes (its bottom-k MinHash):
of n shingles a document may lack n - ceil(0.75 n), so it must hold one of any
n - ceil(0.75 n) + 1; k is that number for the largest size of the item's partition.
The search therefore misses nothing, whatever the lengths. Documents that hold a hash
of a signature are candidates, which are then verified by exact shingle containment on
the words themselves.

The signatures are written before the search, so the planner knows their size and
broadcasts them only below its threshold; beyond it, it shuffles.

Rules: words are A-Z lower-cased and separated by ASCII white space; with fewer than
five words the whole sequence is one shingle; without words nothing is contained. For
an item of fewer than five words every run of as many words of a document is looked at,
so it is found inside a long text too (the lengths that occur, four at most, are asked
of the benchmark first). Null or empty texts and items give no rows. Rows that share a
doc_id or item_id count as one, with the larger share. Rows without doc_id are not
reported by ``contained_items``, which could not name them; ``decontaminate`` judges each
by its text. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import SPACE_CLASS, ascii_lower, written

WIDTH = 5


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+"), lambda x: x != "")


def _starts(size: Column) -> Column:
    return F.when(size > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), size - (WIDTH - 1))))


def _runs(size: Column, n: int) -> Column:
    """Where runs of ``n`` words start."""
    return F.when(size >= n, F.sequence(F.lit(1), size - (n - 1)))


def _joined(n: int):
    return lambda i: F.array_join(F.slice("words", i, F.lit(n)), " ")


def shingles(rows: DataFrame, key: str, short: tuple[int, ...] = ()) -> DataFrame:
    """key, shingles: the distinct shingles as strings, and runs of ``short`` lengths."""
    rows = rows.select(key, words(F.col("text")).alias("words"))
    every = F.transform(_starts(F.size("words")), _joined(WIDTH))
    for n in short:
        more = F.transform(_runs(F.size("words"), n), _joined(n))
        every = F.coalesce(F.concat(every, more), every)
    # no filter on them here: pushed down, it would cut the words anew for each shingle
    return rows.select(key, F.coalesce(F.array_distinct(every), F.array().cast("array<string>")).alias("shingles"))


def _hash(shingle: Column) -> Column:
    """Of a shingle as a string: chained over its words, as ``hashes`` has them."""
    parts = F.split(shingle, " ")
    return F.xxhash64(*(F.xxhash64(F.get(parts, F.lit(i))) for i in range(WIDTH)))


def hashes(rows: DataFrame, key: str, short: tuple[int, ...] = ()) -> DataFrame:
    """key, hash: a row for each shingle and each run of a ``short`` length, without making its string."""
    rows = rows.select(key, F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    none = F.xxhash64(F.lit(None).cast("string"))
    part = lambda i, k: F.coalesce(F.get("w", i + (k - 1)), none)
    every = F.transform(_starts(F.size("w")), lambda i: F.xxhash64(*(part(i, k) for k in range(WIDTH))))
    chained = lambda n: lambda i: F.xxhash64(*(part(i, k) for k in range(n)), *[none] * (WIDTH - n))
    for n in short:
        more = F.transform(_runs(F.size("w"), n), chained(n))
        every = F.coalesce(F.concat(every, more), every)
    return rows.select(key, F.explode(every).alias("hash"))


def signatures(items: DataFrame, percent: int) -> DataFrame:
    """hash, item_id: each item's smallest hashes, as many as its size partition asks for."""
    least = lambda n: F.ceil(n * percent / 100)
    top = F.pow(F.lit(2), F.floor(F.log2(F.size("shingles"))) + 1) - 1  # largest size of the partition
    k = F.greatest(F.size("shingles") - least(F.size("shingles")), top - least(top)) + 1
    smallest = F.slice(F.array_sort(F.transform("shingles", _hash)), F.lit(1), k.cast("int"))
    return items.select("item_id", F.explode(smallest).alias("hash")).distinct()


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: every document that holds at least
    ``percent`` of an item's shingles."""
    items = written(shingles(benchmark, "item_id"), "items").filter(F.size("shingles") > 0)
    marks = written(signatures(items, percent), "marks")
    length = F.size(F.split(F.element_at("shingles", 1), " "))
    short = tuple(sorted(r.n for r in items.select(length.alias("n")).distinct().filter(F.col("n") < WIDTH).collect()))
    found = hashes(docs, "doc_id", short).join(marks, "hash").select("doc_id", "item_id").distinct()
    found = written(found, "candidates")
    suspects = docs.select("doc_id", "text").join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    pairs = shingles(suspects, "doc_id", short).withColumnRenamed("shingles", "held").join(found, "doc_id").join(items, "item_id")
    shared = F.size(F.array_intersect("held", "shingles"))
    pairs = pairs.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
    pairs = pairs.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    best = F.max_by(F.struct("n_item", "n_shared"), F.col("n_shared") / F.col("n_item"))
    return (pairs.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
            .withColumn("containment", F.col("n_shared") / F.col("n_item")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without the documents that contain a test item. All rows of a doc_id go
    together; a row without doc_id goes by its own text."""
    named = contained_items(docs, benchmark, percent).select("doc_id").distinct()
    kept = docs.join(named, "doc_id", "left_anti").select(docs.columns)
    nameless = docs.filter(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return kept
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    texts = contained_items(nameless.select(key.alias("doc_id"), "text").distinct(), benchmark, percent).select(F.col("doc_id").alias("_text_key")).distinct()
    clean = nameless.withColumn("_text_key", key).join(texts, "_text_key", "left_anti").select(docs.columns)
    return kept.filter(F.col("doc_id").isNotNull()).unionByName(clean)
