"""Operator 3, line de-duplication over sharded minimal perfect hashes.

Lines that recur in enough documents are indexed, not joined: their 128-bit hashes are
split into shards, each with a minimal perfect hash (levels of bit arrays, each holding
the hashes that fell alone into a slot) that numbers its hashes 0..n-1, and arrays of
fingerprints, document counts and last holders in that order. Documents probe the
arrays; only hashes travel, never lines.

Two kinds of shard. Hashes held by at least 1 / 2**16 of all (line, document) pairs in
the index are at most 2**16 by that rule; they form one shard that every task holds, so
the commonest lines are answered where they are read. The other hashes are rarer than
that, so their shards, and the probes routed to them, are even.

Rules: a null or empty text is one empty line. A null doc_id counts as the smallest.
Rows that share a doc_id are separate documents for the count and lose or keep a line
together. Other columns pass through; columns named n_lines or n_dropped are replaced.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.llm.common import shuffle_partitions, written

WHITE = b" \t\n\x0b\x0c\r"
HOT = 1 << 16
SHARD_KEYS = 1 << 18
SMALLEST = -(1 << 63)
INDEX = "shard int, n int, sizes array<int>, bits binary, prints binary, counts binary, last binary"


def line_key(line: bytes, chars: int) -> bytes | None:
    """The 128-bit hash of a line's key, or None where the key is too short."""
    k = line.strip(WHITE)
    if len(k) < chars or (not k.isascii() and len(k.decode("utf-8", "replace")) < chars):
        return None
    return xxhash.xxh3_128_digest(k.lower())  # bytes.lower() knows A-Z only


def _as_words(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def _slots(words: np.ndarray, level: int, size: int) -> np.ndarray:
    x = words[:, 0] + np.uint64(2 * level + 1) * (words[:, 1] ^ np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build(words: np.ndarray, counts: np.ndarray, last: np.ndarray) -> dict:
    """Index of distinct hashes (n x 2 words), as the columns of ``INDEX``."""
    sizes, bits, order = [], [], []
    left = np.arange(len(words))
    while len(left):
        size = max(64, 2 * len(left))
        slot = _slots(words[left], len(sizes), size)
        alone = np.bincount(slot, minlength=size)[slot] == 1
        level = np.zeros(size, bool)
        level[slot[alone]] = True
        sizes.append(size)
        bits.append(np.packbits(level).tobytes())
        order.append(left[alone][np.argsort(slot[alone])])
        left = left[~alone]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return {"n": len(words), "sizes": sizes, "bits": b"".join(bits), "prints": words[order, 1].astype("<u8").tobytes(),
            "counts": counts[order].astype("<u4").tobytes(), "last": last[order].astype("<i8").tobytes()}


class Index:
    def __init__(self, row: dict):
        self.levels, at, base = [], 0, 0
        for size in row["sizes"]:
            raw = np.frombuffer(row["bits"], np.uint8, -(-size // 8), at)
            level = np.unpackbits(raw)[:size].astype(bool)
            self.levels.append((size, level, base + np.cumsum(level, dtype=np.int64) - 1))
            base, at = base + int(level.sum()), at + len(raw)
        self.prints, self.counts = np.frombuffer(row["prints"], "<u8"), np.frombuffer(row["counts"], "<u4")
        self.last = np.frombuffer(row["last"], "<i8")

    def find(self, words: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those that the index does not hold."""
        out = np.full(len(words), -1, np.int64)
        left = np.arange(len(words))
        for k, (size, level, rank) in enumerate(self.levels):
            slot = _slots(words[left], k, size)
            hit = level[slot]
            out[left[hit]] = rank[slot[hit]]
            left = left[~hit]
        found = out >= 0
        out[found] = np.where(self.prints[out[found]] == words[found, 1], out[found], -1)
        return out


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("doc"), F.col("text").cast("binary").alias("text"))


def line_counts(docs: DataFrame, chars: int, least: int) -> DataFrame:
    """key, n (documents that hold the line), last (largest doc_id), where n >= least."""

    def run(batches):
        for b in batches:
            keys, owner = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and len(text) >= chars:
                    own = {k for line in text.split(b"\n") if len(line) >= chars and (k := line_key(line, chars))}
                    keys += own
                    owner += [doc] * len(own)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(owner, pa.int64())], ["key", "doc"])

    found = _keys(docs).mapInArrow(run, "key binary, doc long")
    return found.groupBy("key").agg(F.count("*").alias("n"), F.max("doc").alias("last")).filter(F.col("n") >= least)


def _index_of(rows: pa.Table) -> dict:
    return build(_as_words(rows["key"].to_pylist()), rows["n"].to_numpy(), rows["last"].to_numpy())


def dropped_lines(docs: DataFrame, chars: int, least: int, hot: int = HOT) -> DataFrame:
    """doc, keys: the hashes of the lines that each document loses."""
    spark = docs.sparkSession
    lines = written(line_counts(docs, chars, least), "lines")
    n, pairs = lines.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = F.col("n") * hot >= pairs  # at most ``hot`` of them
    head = spark.sparkContext.broadcast(_index_of(lines.filter(common).toArrow()))
    shards = max(16 * shuffle_partitions(spark), -(-n // SHARD_KEYS))

    def shard_of(words):
        return (words[:, 0] % np.uint64(shards)).astype(np.int32)

    def place(batches):
        for b in batches:
            yield pa.record_batch([pa.array(shard_of(_as_words(b["key"].to_pylist()))), b["key"], b["n"], b["last"]], ["shard", "key", "n", "last"])

    def index(key, rows):
        row = {"shard": key[0].as_py(), **_index_of(rows)}
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()),
                        ("prints", pa.binary()), ("counts", pa.binary()), ("last", pa.binary())])
    rest = lines.filter(~common).mapInArrow(place, "shard int, key binary, n long, last long")
    tail = rest.groupBy("shard").applyInArrow(index, INDEX)

    def ask(batches):
        """A row for each line to look up elsewhere, or with ``lost`` for a line that goes."""
        top = Index(head.value)
        for b in batches:
            keys, owner = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and len(text) >= chars:
                    own = {k for line in text.split(b"\n") if len(line) >= chars and (k := line_key(line, chars))}
                    keys += own
                    owner += [doc] * len(own)
            words, owner = _as_words(keys), np.array(owner, np.int64)
            at = top.find(words)
            known = at >= 0
            lost = known.copy()
            lost[known] = top.last[at[known]] != owner[known]
            keep = np.flatnonzero(lost | ~known)
            where = shard_of(words)
            where[lost] = (owner[lost].astype(np.uint64) % np.uint64(shards)).astype(np.int32)
            yield pa.record_batch([pa.array(where[keep], pa.int32()), pa.array([keys[i] for i in keep], pa.binary()),
                                   pa.array(owner[keep], pa.int64()), pa.array(lost[keep], pa.bool_())], ["shard", "key", "doc", "lost"])

    def answer(batches):
        """Rows of a shard in order: its index first, then what asks for it."""
        shard, own = None, None
        for b in batches:
            where = b["shard"].to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(where)) + 1), len(where)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if where[lo] != shard:
                    shard, own = where[lo], None
                if part["n"][0].is_valid:
                    own = Index({k: part[k][0].as_py() for k in ("sizes", "bits", "prints", "counts", "last")})
                    part = part.slice(1)
                keys, doc = part["key"].to_pylist(), part["doc"].to_numpy(zero_copy_only=False)
                lost = np.array(part["lost"].to_pylist(), bool)
                if own is not None and (ask := np.flatnonzero(~lost)).size:
                    at = own.find(_as_words(keys)[ask])
                    lost[ask[at >= 0]] = own.last[at[at >= 0]] != doc[ask[at >= 0]]
                out = np.flatnonzero(lost)
                yield pa.record_batch([pa.array(doc[out], pa.int64()), pa.array([keys[i] for i in out], pa.binary())], ["doc", "key"])

    asked = _keys(docs).mapInArrow(ask, "shard int, key binary, doc long, lost boolean")
    both = tail.unionByName(asked, allowMissingColumns=True).repartition("shard").sortWithinPartitions(F.col("shard"), F.col("n").asc_nulls_last())
    return both.mapInArrow(answer, "doc long, key binary").groupBy("doc").agg(F.collect_set("key").alias("keys"))


def dedup_lines(docs: DataFrame, chars: int = 40, least: int = 5, hot: int = HOT) -> DataFrame:
    """``docs`` whose text has lost the lines held by at least ``least`` documents, except
    in the largest doc_id that holds them; with n_lines (before) and n_dropped."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    drops = written(dropped_lines(docs, chars, least, hot), "drops")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("_line_doc"), *columns)
    # one plan at every size: what is dropped grows with the documents
    drops = drops.select(F.col("doc").alias("_line_doc"), F.col("keys").alias("_line_keys")).hint("merge")
    rows = rows.join(drops, "_line_doc", "left")
    at = columns.index("text")
    rows = rows.select("_line_keys", *(F.col(c).cast("binary") if c == "text" else F.col(c) for c in columns))
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches):
        for b in batches:
            texts, total, gone = [], [], []
            for keys, text in zip(b.column(0).to_pylist(), b.column(at + 1).to_pylist()):
                text = text or b""
                n = text.count(b"\n") + 1
                total.append(n)
                if keys:
                    lose = set(keys)
                    kept = [x for x in text.split(b"\n") if len(x) < chars or line_key(x, chars) not in lose]
                    n, text = len(kept), b"\n".join(kept)
                gone.append(total[-1] - n)
                texts.append(text)
            arrays = list(b.columns[1:])
            arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
