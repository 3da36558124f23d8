"""Operator 13, alignment of two tokenizers' tokens over the same bytes.

Vocabulary A encodes a space and the text, vocabulary B the text, before which it sets a
space itself, so the tokens of both spell the same bytes. Each side's cumulative ends
lead to token numbers in a dictionary, an array by byte offset; the ends that are keys of
both, in order, slice the two id lists into groups. In a slice no inner end is shared, so every stretch between
two neighbouring ends of either side lies in one token of each: these stretches are the
links, as many as there are tokens in the slice less one.

How often each pair of ids is linked is counted over the whole corpus. Documents go in
blocks, which keep their links as numbers of the block's distinct pairs and send each
pair once, with its count, by hash to a shard. Shards add up and answer; the highest
count of each id of B, a table no longer than B's vocabulary, is broadcast. The blocks
are a table bucketed by block, so only pairs and counts are shuffled; a very common pair
is one entry a block.

Rules: special strings inside texts are plain text. Null and empty texts, and texts that
a side does not spell byte for byte (its normalizer changed them), have no tokens: zeros
and no groups. Repeated rows are documents of their own, in the counts too; further
columns of any name are carried along; an empty table gives an empty result. Texts with
code points unknown to this Python's Unicode tables are encoded by A's library itself.
A block holds 2**22 characters or one longer text, on which a task's memory depends.
"""

from __future__ import annotations

import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.llm.bpe import ID, has_unassigned, merger
from careflow.llm.common import shuffle_partitions, written
from careflow.llm.merge_replay import _codes, _planes
from careflow.llm.words import PATTERN
from careflow.session import checkpoint_root

BLOCK_CHARS, AT_ONCE = 1 << 22, 1 << 19
SIDE = 32  # bits of an id in a pair
LAID = ("_block long, _n_a long, _n_b long, _n_groups long, _n_links long, _sha string, _groups string, "
        "_numbers binary, _times binary, _pairs binary, _pair_times binary")


class ByteLevel:
    """A byte-level file's encoder. Where every token's own bytes are merged to that token by
    rising ids, as ``merges`` are listed, ids serve as ranks, and so the file does for a
    library that takes ranks; other files are refused."""

    def __init__(self, path: str):
        import tiktoken

        self.path, known = path, merger(path)
        for (a, b), to in known.rank.items():
            if to >> 20 != (to & ID) - 256 or max(a, b) >= to & ID:
                raise ValueError(f"the ids of {path} do not rise with its merges")
        special = set(known.special.values())
        self.bytes_of = known.bytes_of
        ranks = {t: i for i, t in enumerate(known.bytes_of) if i not in special}
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if has_unassigned(text):
            return _plain(self.path).encode(text, add_special_tokens=False).ids
        return self.library.encode_ordinary(text)


@functools.lru_cache(maxsize=1)
def _plain(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings are ordinary text
    return t


class Sides:
    """Both vocabularies: encoders, and the bytes of every id."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a, self.b = ByteLevel(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_a = self.a.bytes_of
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]):
        """The id lists of each text; none where a side does not spell the text."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            # A's tokens spell any text: its 256 single bytes are tokens
            spelt = text and b"".join(map(self.bytes_b.__getitem__, b)) == b" " + text.encode()
            a = self.a.encode(" " + text) if spelt else []
            yield np.array(a, np.int64), np.array(b if spelt else [], np.int64)

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])


def _until(ends: np.ndarray, last: int) -> np.ndarray:
    """The dictionary of one side: for every offset, how many tokens end at it or before."""
    return np.bincount(ends, minlength=last + 1).cumsum()


def slices_and_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many tokens of either side end with each group, and the token numbers of both
    sides for every stretch of bytes between neighbouring ends."""
    last = max(ends_a.max(initial=0), ends_b.max(initial=0))
    of_a, of_b = np.zeros(last + 1, bool), np.zeros(last + 1, bool)
    of_a[ends_a], of_b[ends_b] = True, True
    common, ends = np.flatnonzero(of_a & of_b), np.flatnonzero(of_a | of_b)
    ends = ends[ends > 0]
    until_a, until_b = _until(ends_a, last), _until(ends_b, last)
    return until_a[common], until_b[common], until_a[ends - 1], until_b[ends - 1]


@functools.lru_cache(maxsize=1)
def _digits(size: int) -> np.ndarray:
    """Every number below ``size`` in decimal and a comma, as eight bytes with zeros between."""
    names = [b"%d" % i for i in range(size)]
    return np.frombuffer(b"".join(n.ljust(7, b"\0") + b"," for n in names), np.uint64)


def group_text(a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids in the order of the groups, then their separators."""
    if not len(a):
        return b""
    in_a, in_b = np.diff(cuts_a, prepend=0), np.diff(cuts_b, prepend=0)
    # where a group's ids of A and of B end, and all ids of B
    ends_b = cuts_a + cuts_b
    ends_a = ends_b - in_b
    turn = np.zeros(len(a) + len(b) + 1, np.int8)
    turn[ends_a], turn[ends_b] = 1, -1
    of_b = np.cumsum(turn[:-1], dtype=np.int8).view(bool)
    ids = np.empty(len(a) + len(b), np.int64)
    ids[of_b], ids[~of_b] = b, a
    out = _digits(1 << 17)[ids].view(np.uint8)
    out[8 * ends_a - 1] = ord("|")
    out[8 * ends_b - 1] = ord(";")
    return out.tobytes().translate(None, b"\0")[:-1]


@functools.lru_cache(maxsize=1)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


def _portions(texts: list[str]):
    start = chars = 0
    for i, t in enumerate(texts, 1):
        chars += len(t)
        if chars >= AT_ONCE or i == len(texts):
            yield texts[start:i]
            start, chars = i, 0


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``docs`` with a_ids and b_ids (arrays) and a_cuts and b_cuts: how many tokens of either
    side end with each group. Columns of those names are replaced. No shuffle."""
    new = ("a_ids", "b_ids", "a_cuts", "b_cuts")
    columns = [c for c in docs.columns if c not in new]
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_code_text"), *(F.col(f"`{c}`") for c in columns))
    schema = T.StructType([*(docs.schema[c] for c in columns), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in new)])

    def run(batches):
        s = sides(a, b)
        for batch in batches:
            out = []
            for some in _portions(batch.column(0).to_pylist()):
                for x, y in s.encode(some):
                    out.append((x, y, *slices_and_links(*s.ends(x, y))[:2]))
            arrays = [pa.array([o[k] for o in out], pa.list_(pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], schema.names)

    return rows.mapInArrow(run, schema)


def _blocks(rows: DataFrame, a: str, b: str, keep_groups: bool) -> DataFrame:
    """``rows`` (_text, _row) in blocks, a row for each document and one with the _pairs of the
    block, as a table bucketed by block."""
    spark = rows.sparkSession
    schema = T.StructType([*T.StructType.fromDDL(LAID).fields, T.StructField("_row", rows.schema["_row"].dataType)])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.binary()] * 4

    def pack(batches):
        s, part, serial = sides(a, b), TaskContext.get().partitionId() << 24, 0
        held, rows_, chars, kind = [], [], 0, None

        def measure(x: np.ndarray, y: np.ndarray):
            if not len(x):
                return 0, 0, 0, 0, "", "", np.zeros(0, np.int64), np.zeros(0, np.int64)
            *cuts, i, j = slices_and_links(*s.ends(x, y))
            text = group_text(x, y, *cuts)
            pair, times = np.unique(x[i] << SIDE | y[j], return_counts=True)
            return len(x), len(y), len(cuts[0]), len(i), hashlib.sha256(text).hexdigest(), text.decode() if keep_groups else "", pair, times

        def close():
            every, number = np.unique(np.concatenate([h[6] for h in held]), return_inverse=True)
            times = np.concatenate([h[7] for h in held])
            total = np.bincount(number, weights=times, minlength=len(every)).astype("<i8")
            ends = np.cumsum([len(h[6]) for h in held])
            numbers = [_planes(x) for x in np.split(number, ends[:-1])]
            own = [[part + serial] * len(held), *([h[k] for h in held] for k in range(6)), numbers, [_planes(h[7]) for h in held], [None] * len(held), [None] * len(held)]
            row = pa.concat_arrays(rows_)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(own, kinds)), row], schema.names)
            last = [part + serial, *[None] * 8, every.astype("<i8").tobytes(), total.tobytes()]
            yield pa.RecordBatch.from_arrays([*(pa.array([c], k) for c, k in zip(last, kinds)), pa.nulls(1, kind)], schema.names)

        for batch in batches:
            texts, kind = batch.column(0).to_pylist(), batch.column(1).type
            done = start = 0
            for some in _portions(texts):
                for x, y in s.encode(some):
                    held.append(measure(x, y))
                done += len(some)
                chars += sum(map(len, some))
                if chars >= BLOCK_CHARS:
                    rows_.append(batch.column(1).slice(start, done - start))
                    yield from close()
                    held, rows_, chars, serial, start = [], [], 0, serial + 1, done
            if done > start:
                rows_.append(batch.column(1).slice(start, done - start))
        if held:
            yield from close()

    name = f"alignment_{uuid.uuid4().hex}"
    (rows.mapInArrow(pack, schema).write.bucketBy(shuffle_partitions(spark), "_block").option("compression", "zstd")
     .option("path", f"{checkpoint_root(spark).rstrip('/')}/llm/{name}").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only: the files are the job's own
    return table


def linked(docs: DataFrame, a: str, b: str, keep_groups: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups (as ``a1,a2|b1;a3|b2,b3``, if kept),
    groups_sha256, n_best (links whose pair has the corpus-wide highest count of its id of
    B) and count_sum (the counts of all links). Columns of those names are replaced."""
    new = {"n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "n_best", "count_sum"}
    columns = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    row = F.struct(*(F.col(f"`{c}`") for c in columns), F.lit(0).alias("_"))
    blocks = _blocks(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_text"), row.alias("_row")), a, b, keep_groups)
    spark = docs.sparkSession
    shards = 4 * shuffle_partitions(spark)

    def deal(batches):
        for batch in batches:
            for block, pairs, times in zip(*(batch[c].to_pylist() for c in ("_block", "_pairs", "_pair_times"))):
                pair, n = np.frombuffer(pairs, "<u8"), np.frombuffer(times, "<i8")
                shard = ((pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                shard = shard[order]
                cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(order)).tolist()
                take = lambda v, kind: pa.array([v[order[i:j]].astype(kind).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard[cuts[:-1]], pa.int32()), pa.array([block] * (len(cuts) - 1), pa.int64()), take(np.arange(len(pair)), "<u4"),
                    take(pair, "<u8"), take(n, "<i8")], ["shard", "_block", "at", "pairs", "times"])

    def add(table: pa.Table) -> pa.Table:
        """The totals of each asker's pairs; in a last row the highest by id of B."""
        sizes = [len(x) // 8 for x in table["pairs"].to_pylist()]
        pair = np.frombuffer(b"".join(table["pairs"].to_pylist()), "<u8")
        every, number = np.unique(pair, return_inverse=True)
        total = np.zeros(len(every), "<i8")
        np.add.at(total, number, np.frombuffer(b"".join(table["times"].to_pylist()), "<i8"))
        back = np.split(total[number], np.cumsum(sizes)[:-1])
        b_ids, where = np.unique(every & np.uint64((1 << SIDE) - 1), return_inverse=True)
        highest = np.zeros(len(b_ids), "<i8")
        np.maximum.at(highest, where, total)
        return pa.table({"_block": pa.array([*table["_block"].to_pylist(), None], pa.int64()), "at": pa.array([*table["at"].to_pylist(), b_ids.astype("<u4").tobytes()], pa.binary()),
                         "totals": pa.array([*(x.tobytes() for x in back), highest.tobytes()], pa.binary())})

    asked = blocks.filter(F.col("_pairs").isNotNull()).select("_block", "_pairs", "_pair_times")
    asked = asked.mapInArrow(deal, "shard int, _block long, at binary, pairs binary, times binary")
    answers = written(asked.groupBy("shard").applyInArrow(add, "_block long, at binary, totals binary"), "pair-totals")

    def spread(batches):
        for batch in batches:
            for at, top in zip(batch["at"].to_pylist(), batch["totals"].to_pylist()):
                yield pa.record_batch([pa.array(np.frombuffer(at, "<u4").astype(np.int64)), pa.array(np.frombuffer(top, "<i8"))], ["b", "top"])

    tops = answers.filter(F.col("_block").isNull()).select("at", "totals").mapInArrow(spread, "b long, top long").groupBy("b").agg(F.max("top").alias("top"))
    found = tops.toArrow()  # no longer than B's vocabulary
    top = np.zeros(max(found["b"].to_pylist(), default=0) + 1, np.int64)
    top[found["b"].to_numpy()] = found["top"].to_numpy()
    shared = spark.sparkContext.broadcast(top)
    fields = [*(docs.schema[c] for c in columns), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
              T.StructField("groups_sha256", T.StringType())]
    if keep_groups:
        fields.append(T.StructField("groups", T.StringType()))

    def finish(held: pa.Table, given: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(given[c].to_pylist()), kind)
        at = join("at", "<u4")
        total = np.zeros(len(at), np.int64)
        total[at] = join("totals", "<i8")
        lists = held["_pairs"].to_pylist()
        pair = np.frombuffer(next(p for p in lists if p is not None), "<u8")
        best = total == shared.value[(pair & np.uint64((1 << SIDE) - 1)).astype(np.int64)]
        documents = held.filter(pa.array([p is None for p in lists])).combine_chunks()
        n_best, sums = [], []
        for numbers, times in zip(documents["_numbers"].to_pylist(), documents["_times"].to_pylist()):
            number, n = _codes(numbers), _codes(times)
            n_best.append(int(n[best[number]].sum()))
            sums.append(int((n * total[number]).sum()))
        row = documents["_row"].combine_chunks()
        row = row.chunk(0) if isinstance(row, pa.ChunkedArray) else row
        arrays = [*(row.field(k) for k in range(len(columns))), *(documents[c] for c in ("_n_a", "_n_b", "_n_groups", "_n_links")),
                  pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), documents["_sha"], *([documents["_groups"]] if keep_groups else [])]
        return pa.Table.from_arrays(arrays, [f.name for f in fields])

    return blocks.groupBy("_block").cogroup(answers.filter(F.col("_block").isNotNull()).groupBy("_block")).applyInArrow(finish, T.StructType(fields))
