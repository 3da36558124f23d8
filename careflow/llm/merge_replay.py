"""Operator 12, byte-level byte-pair encoding by a replay of the merges over the corpus.

Texts are cut into words in blocks of documents; each block keeps its documents as word
numbers and sends each of its distinct words once, by hash, to a shard. A shard holds
every block's words, so a word of the corpus is encoded once. There an inverted index
leads from the rank of a token pair to the word positions that hold it: the ranks are
taken in rising order, each is applied at all its positions from left to right, and only
the two neighbours of a merged pair enter the index anew. (Where a neighbour forms a pair
of a lower rank than the present one, which a rank file allows, it is merged at once,
since it comes first in its word.) The words' ids go back to the blocks that asked.

A block holds 2**24 characters or one longer text, and a shard's words are replayed in
runs of 2**20 bytes or one longer word, so a task's memory is bounded; a very common
word is one entry a block. The blocks are written as a table bucketed by block, so only
words and ids are shuffled, never documents; both travel in the order of the words, packed.

Rules: a null text is encoded as empty; special strings are plain text. Texts with code
points unknown to this Python's Unicode tables, whose classes other libraries may know,
are encoded by the tokenizer library. Repeated rows are encoded one by one, further
columns of any name are carried along, and an empty table gives an empty result. Null
ids decode to no bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.llm.bpe import has_unassigned
from careflow.llm.common import shuffle_partitions
from careflow.llm.words import PATTERN, ranges, words
from careflow.session import checkpoint_root

BLOCK_CHARS, RUN_BYTES = 1 << 24, 1 << 20
WIDTH = 20  # bits of an id in a pair's key
APART = -1  # between words
LAID = "_block long, _codes binary, _direct binary, _words binary"


class Ranks:
    """A rank file: the id and rank of a token are one number."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << WIDTH | b] = rank
        self.pairs = pairs
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for token, rank in self.rank.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        first = np.full((256, 256), -1, np.int64)
        for a, b in itertools.product(range(256), repeat=2):
            first[a, b] = pairs.get(int(self.single[a]) << WIDTH | int(self.single[b]), -1)
        self.first = first

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.start[ids], self.length[ids])].tobytes()


@functools.lru_cache(maxsize=2)
def rank_file(path: str) -> Ranks:
    return Ranks(path)


@functools.lru_cache(maxsize=1)
def library(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=rank_file(path).rank, special_tokens={})


def replay(found: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct non-empty words one after the other, and how many each has."""
    raw = np.frombuffer(b"\0".join(found), np.uint8)
    size = np.array([len(w) for w in found], np.int64)
    gaps = np.cumsum(size + 1)[:-1] - 1
    ids = ranks.single[raw]
    ids[gaps] = APART
    rank = ranks.first[raw[:-1], raw[1:]]
    rank[gaps] = rank[gaps - 1] = -1
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank[at], prepend=-2))
    index = {int(rank[p[0]]): p.tolist() for p in np.split(at, cuts[1:])} if at.size else {}
    ids, n = [*ids.tolist(), APART], len(raw)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    ranked, pair = list(index), ranks.pairs.get  # rising, so a heap
    early: list[tuple[int, int]] = []  # pairs of a lower rank than the present one

    def meet(i: int, j: int, now: int) -> None:
        r = pair(ids[i] << WIDTH | ids[j]) if ids[i] >= 0 and ids[j] >= 0 else None
        if r is None:
            return
        if r < now:
            heapq.heappush(early, (r, i))
        elif r in index:
            index[r].append(i)
        else:
            index[r] = [i]
            heapq.heappush(ranked, r)

    def merge(i: int, r: int, now: int) -> None:
        j = after[i]
        if ids[i] < 0 or ids[j] < 0 or pair(ids[i] << WIDTH | ids[j]) != r:
            return  # one of the two has been merged meanwhile
        ids[i], ids[j] = r, -2
        after[i] = k = after[j]
        before[k] = i
        meet(i, k, now)
        if (h := before[i]) >= 0:
            meet(h, i, now)

    while ranked:
        now = heapq.heappop(ranked)
        for i in sorted(index.pop(now)):
            merge(i, now, now)
            while early:
                r, p = heapq.heappop(early)
                merge(p, r, now)
    ids = np.array(ids[:-1], np.int64)
    owner = np.repeat(np.arange(len(found)), size + 1)[:-1]
    kept = ids >= 0
    return ids[kept].astype("<u4"), np.bincount(owner[kept], minlength=len(found))


def encode_words(found: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """``replay`` in runs of bounded size."""
    out, run, size = [], [], 0
    for w in found:
        run.append(w)
        size += len(w)
        if size >= RUN_BYTES:
            out.append(replay(run, ranks))
            run, size = [], 0
    if run:
        out.append(replay(run, ranks))
    none = np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out] or [none]).astype("<u4"), np.concatenate([x for _, x in out] or [none])


class Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _planes(codes) -> bytes:
    """Numbers byte by byte, first all lowest bytes: the upper ones compress to nothing."""
    return np.array(codes, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _codes(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _pack(numbers, flat: bytes = b"") -> bytes:
    """Numbers and the bytes that go with them, compressed."""
    return zstandard.compress(len(numbers).to_bytes(8, "little") + _planes(numbers) + flat)


def _unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(packed)
    at = 8 + 4 * int.from_bytes(raw[:8], "little")
    return _codes(raw[8:at]), raw[at:]


def _split(sizes: np.ndarray, flat: bytes) -> list[bytes]:
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _dealt(found: list[bytes], shards: int) -> list[tuple[int, list[int]]]:
    """The shards of a block's words, and the numbers of each one's words in their order."""
    order = np.array(sorted(range(len(found)), key=found.__getitem__), np.int64)
    shard = np.fromiter((zlib.crc32(found[k]) for k in order.tolist()), np.int64, len(found)) % shards
    by_shard = np.argsort(shard, kind="stable")
    shard, order = shard[by_shard], order[by_shard]
    cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(order)).tolist()
    return [(int(shard[i]), order[i:j].tolist()) for i, j in zip(cuts, cuts[1:])]


def _blocks(rows: DataFrame, ranks: str) -> DataFrame:
    """``rows`` (_text, _row) in blocks: a row for each document, with _codes (word numbers) or
    _direct (ids), and one with the _words of the block, as a table bucketed by block."""
    spark = rows.sparkSession
    schema = T.StructType([*T.StructType.fromDDL(LAID).fields, T.StructField("_row", rows.schema["_row"].dataType)])
    names = schema.names

    def pack(batches):
        part, serial = TaskContext.get().partitionId() << 24, 0
        known, chars, kind = Numbers(), 0, None

        def close():
            raw = [w.encode() for w in known]
            return pa.RecordBatch.from_arrays([
                pa.array([part + serial], pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                pa.array([_pack([len(w) for w in raw], b"".join(raw))], pa.binary()), pa.nulls(1, kind)], names)

        for b in batches:
            kind, held = b.column(1).type, []

            def rows_of(from_: int):
                m = len(held)
                return pa.RecordBatch.from_arrays([
                    pa.array([part + serial] * m, pa.int64()), pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.binary()),
                    pa.nulls(m, pa.binary()), b.column(1).slice(from_, m)], names)

            start = 0
            for i, text in enumerate(b.column(0).to_pylist()):
                if has_unassigned(text):
                    held.append((None, np.array(library(ranks).encode_ordinary(text), "<u4").tobytes()))
                else:
                    held.append((_planes(list(map(known.__getitem__, words(text)))), None))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield rows_of(start)
                    yield close()
                    start, held, chars, serial = i + 1, [], 0, serial + 1
                    known = Numbers()
            if held:
                yield rows_of(start)
        if chars or known:
            yield close()

    name = f"merge_replay_{uuid.uuid4().hex}"
    (rows.mapInArrow(pack, schema).write.bucketBy(shuffle_partitions(spark), "_block").option("compression", "zstd")
     .option("path", f"{checkpoint_root(spark).rstrip('/')}/llm/{name}").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files are the job's own
    return table


def encode(docs: DataFrame, ranks: str, decode: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ids (little-endian unsigned 32-bit integers) and n_tokens, and decoded
    bytes if asked for. Columns of those names in ``docs`` are replaced."""
    new = {"ids", "n_tokens", "decoded"}
    columns = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in columns), F.lit(0).alias("_")).alias("_row"))
    blocks = _blocks(rows, ranks)
    shards = 4 * shuffle_partitions(docs.sparkSession)

    def deal(batches):
        for b in batches:
            for block, packed in zip(b["_block"].to_pylist(), b["_words"].to_pylist()):
                found = _split(*_unpack(packed))
                for shard, numbers in _dealt(found, shards):
                    some = [found[k] for k in numbers]
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int64()),
                                                      pa.array([_pack([len(w) for w in some], b"".join(some))], pa.binary())], ["shard", "_block", "words"])

    def answer(table: pa.Table) -> pa.Table:
        known = Numbers()
        numbers = [np.array(list(map(known.__getitem__, _split(*_unpack(x)))), np.int64) for x in table["words"].to_pylist()]
        ids, count = encode_words(list(known), rank_file(ranks))
        begin = np.cumsum(count) - count
        out = [_pack(np.concatenate([count[n], ids[ranges(begin[n], count[n])]])) for n in numbers]
        return pa.table({"_block": table["_block"], "shard": table["shard"], "answer": pa.array(out, pa.binary())})

    asked = blocks.filter(F.col("_words").isNotNull()).select("_block", "_words")
    asked = asked.mapInArrow(deal, "shard int, _block long, words binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "_block long, shard int, answer binary")
    fields = [*(docs.schema[c] for c in columns), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decode:
        fields.append(T.StructField("decoded", T.BinaryType()))

    def finish(held: pa.Table, given: pa.Table) -> pa.Table:
        lists, answer_of = held["_words"].to_pylist(), dict(zip(given["shard"].to_pylist(), given["answer"].to_pylist()))
        found = _split(*_unpack(next(x for x in lists if x is not None)))
        count, begin = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        parts, size = [np.zeros(0, "<u4")], 0
        for shard, numbers in _dealt(found, shards):
            both, _ = _unpack(answer_of[shard])
            own, flat = both[:len(numbers)], both[len(numbers):].astype("<u4")
            count[numbers], begin[numbers] = own, size + np.cumsum(own) - own
            parts.append(flat)
            size += len(flat)
        flat = np.concatenate(parts)
        held = held.filter(pa.array([x is None for x in lists])).combine_chunks()
        out = []
        for codes, direct in zip(held["_codes"].to_pylist(), held["_direct"].to_pylist()):
            if direct is None:
                n = _codes(codes)
                direct = flat[ranges(begin[n], count[n])].tobytes()
            out.append(direct)
        row = held["_row"].combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        arrays = [*(row.field(k) for k in range(len(columns))), pa.array(out, pa.binary()), pa.array([len(x) // 4 for x in out], pa.int64())]
        if decode:
            arrays.append(pa.array([rank_file(ranks).decode(np.frombuffer(x, "<u4")) for x in out], pa.binary()))
        return pa.Table.from_arrays(arrays, [f.name for f in fields])

    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(finish, T.StructType(fields))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` with a column decoded (bytes), made from its ids."""
    columns = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(F.coalesce(F.col("ids"), F.lit(b"")).alias("_code_ids"), *(F.col(f"`{c}`") for c in columns))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        r = rank_file(ranks)
        for b in batches:
            out = pa.array([r.decode(np.frombuffer(x, "<u4")) for x in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], out], schema.names)

    return rows.mapInArrow(run, schema)
