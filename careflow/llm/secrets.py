"""Operator 10, secret scan with multipart credential linking, in DataFrame functions.

Base spans are the regular matches of three patterns (``BASE``), leftmost and without
overlap per kind. Their positions come from the gaps between matches: a text split at
a pattern and the pattern's matches alternate, so running lengths give each start.

The method adds weak parts: names of endpoints (URLs), user or client identifiers, and
long mixed tokens. Alone they mean little; one is reported only when parts that complete
a credential (identifier, secret, endpoint) co-occur in its scope, at most ``REACH``
characters apart. That interval join runs over the starts and ends of a document's spans
in order: the nearest part of each role that ends at or before a span's start, and the
nearest that starts at or after its end, are carried along by windows, so no pairs are
made, however many parts a text holds. A part that overlaps a span does not complete it
(an identifier's value may itself be a long mixed token), nor does it hide other parts;
a part inside another one still completes spans that it does not overlap.

Rules: a null text counts as empty. Offsets are code points, ends exclusive. Documents
are rows: rows that share a doc_id are scanned one by one (repeated rows are told apart
by a row number of their own). Other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH = 200
_NAME = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: kind: pattern, and the characters its group 1 must have. Fixed values of the contract.
BASE = {
    "assign": (_NAME + r"([A-Za-z0-9+/_.=-]+)", 8),
    "access": (r"(AKIA[A-Z0-9]{12,})", 16),
    "hex": (r"([0-9a-f]{32,})", 32),
}
WEAK = {
    "endpoint": (r"""((?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+)""", 1),
    "ident": (r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 3),
    "opaque": (r"([A-Za-z0-9+/_-]{20,}+=*)", 20),
}
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "endpoint": "endpoint", "ident": "identifier", "opaque": "secret"}
#: Roles that complete a role.
WITH = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}
KINDS = (*BASE, *WEAK)


def _matches(text: Column, kind: str) -> Column:
    """The matches of one kind in order, as lengths: the gap before, the match, its group."""
    pattern, _ = (BASE | WEAK)[kind]
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("v"),
                          F.split(text, pattern, -1).alias("g"))

    def lengths(x: Column, i: Column) -> Column:
        m = x["m"]
        mixed = (m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")) if kind == "opaque" else F.lit(True)
        return F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("i"), F.char_length(x["g"]).cast("long").alias("gap"),
                        F.char_length(m).cast("long").alias("size"), F.char_length(x["v"]).alias("value"), mixed.alias("mixed"))

    # most texts hold no match of most kinds: one look then spares the three passes
    return F.when(text.rlike(pattern), F.transform(zipped, lengths))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (start, rank, end, kind) in order: base ones, and
    weak ones that complementary parts within ``REACH`` characters complete."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<rank:int,i:int,gap:long,size:long,value:int,mixed:boolean>>")
    found = F.concat(*(F.coalesce(_matches(text, k), none) for k in KINDS))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), found.alias("found"))
    rows = rows.select("doc_id", "row", F.explode_outer("found").alias("x")).select("doc_id", "row", "x.*").repartition("row")
    run = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(run))
    least = F.element_at(F.array(*(F.lit((BASE | WEAK)[k][1]) for k in KINDS)), F.col("rank") + 1)
    # a document without spans keeps one row, whose start is null
    good = F.col("size").isNotNull() & F.col("mixed") & (F.col("value") >= least)
    rows = rows.filter(good | F.col("rank").isNull() | (F.col("size").isNull()))
    rows = rows.withColumn("start", F.when(good, F.col("end") - F.col("size")))
    is_in = lambda kinds: F.col("rank").isin([KINDS.index(k) for k in kinds]) & F.col("start").isNotNull()
    # each span as two events; at one place ends come before starts
    at = F.array(F.struct(F.col("end").alias("pos"), F.lit(0).alias("opens")), F.struct(F.col("start").alias("pos"), F.lit(1).alias("opens")))
    rows = rows.select("row", "doc_id", "rank", "start", "end", F.explode_outer(F.when(F.col("start").isNotNull(), at)).alias("x"))
    rows = rows.select("row", "doc_id", "rank", "start", "end", "x.*")
    line, to_here = Window.partitionBy("row"), (Window.unboundedPreceding, Window.currentRow)
    back, on = line.orderBy("pos", "opens").rowsBetween(*to_here), line.orderBy(F.desc("pos"), F.desc("opens")).rowsBetween(*to_here)
    opens, near = F.col("opens") == 1, {}
    for role in WITH:
        own = is_in([k for k in KINDS if ROLE[k] == role])
        before, after = F.max(F.when(own & ~opens, F.col("pos"))).over(back), F.min(F.when(own & opens, F.col("pos"))).over(on)
        near[role] = F.when(opens, F.col("pos") - before <= REACH).otherwise(after - F.col("pos") <= REACH)
    base = is_in(BASE)
    count = lambda which: F.sum(F.when(base & which, 1).otherwise(0)).over(back)
    rows = rows.select("row", "doc_id", "rank", "start", "end", "opens", count(opens).alias("begun"), count(~opens).alias("done"), *(c.alias(f"near_{r}") for r, c in near.items()))
    # a base span overlaps if it begins before the end and is not done at the start
    covered = F.max(F.when(~opens, F.col("begun"))) > F.max(F.when(opens, F.col("done")))
    rows = rows.groupBy("row", "doc_id", "rank", "start", "end").agg(covered.alias("covered"), *(F.coalesce(F.max(f"near_{r}"), F.lit(False)).alias(f"near_{r}") for r in WITH))
    linked = F.lit(False)
    for role, others in WITH.items():
        weak = is_in([k for k in WEAK if ROLE[k] == role])
        linked = linked | (weak & ~F.col("covered") & functools.reduce(Column.__or__, (F.col(f"near_{o}") for o in others)))
    span = F.struct("start", "rank", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1).alias("kind"))
    return (rows.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(is_in(BASE) | linked, span))).alias("spans"))
            .select("doc_id", "spans"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    spans = secret_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return spans.select("doc_id", *map(count, BASE), F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))
