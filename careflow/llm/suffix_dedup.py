"""Operator 2, repeated passages by two-stage suffix sorting.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a document
with a smaller doc_id. Finding such strings is a suffix sort with adjacent common
prefixes; three passes over blocks of whole documents keep it distributed and exact.

1. Every window of 50 bytes is named by the smallest hash among its 25-byte strings, so
   equal windows have equal names wherever they are. Blocks send their distinct names
   to shards, which answer with a bit for each: seen in another block or not.
2. Windows whose name recurs are candidates. A run of windows of one name is a string
   of its own; each block sends one copy of each different string, with its smallest
   doc_id, to the shard of its name. There all suffixes that start a window are sorted:
   those smaller than their successors directly (``direct``), the rest by one scan over
   the buckets in order, each suffix placing its predecessor (``induce``). Neighbours
   with a common prefix of 50 bytes are equal windows; a window with a smaller doc_id
   among its equals is marked, and the marks return as bits.
3. Blocks spread the marks over the bytes and cut them out.

Blocks are written once, bucketed by block, so answers travel to the texts and texts do
not move again. A block sends a string once, however many of its documents hold it, so
a very common passage costs each block one entry.

Rules: texts are UTF-8 bytes, a null text is empty. Matches lie within one document.
Rows that share a doc_id are one document. A null doc_id counts as the smallest. Bytes
that remain are joined and may cut a character in two. Other columns are ignored.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import shuffle_partitions, written
from careflow.session import checkpoint_root

WINDOW, GRAM = 50, 25
BLOCK_BYTES, PIECE = 1 << 20, 1 << 16
SMALLEST = -(1 << 63)
SYMBOLS = 7  # symbols of 9 bits in a word
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def window_names(text: np.ndarray) -> np.ndarray:
    """For each start, the smallest hash of the 25-byte strings in the window there;
    piece by piece, so that the arrays stay in the processor's cache."""
    starts = max(0, len(text) - WINDOW + 1)
    out = np.empty(starts, np.uint64)
    for i in range(0, starts, PIECE):
        out[i:i + PIECE] = _names(np.ascontiguousarray(text[i:i + PIECE + WINDOW - 1]))
    return out


def _names(text: np.ndarray) -> np.ndarray:
    n = len(text)
    word = np.ndarray((n - 7,), "<u8", text, strides=(1,))
    m = n - GRAM + 1
    h = word[:m] * _A
    h ^= (word[8:8 + m] + _C) * _D
    h = _mix(h)
    h ^= (word[16:16 + m] + text[24:24 + m].astype(np.uint64) * _D) * _C
    h = _mix(h)
    span, need = 1, WINDOW - GRAM + 1
    while 2 * span <= need:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: n - WINDOW + 1], h[need - span: need - span + n - WINDOW + 1])


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _A), np.full(n, np.uint64(pow(int(_A), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Block:
    """The documents of a block: runs of windows of one name."""

    def __init__(self, docs: bytes, ends: bytes, text: bytes, shards: int):
        self.docs, self.ends = np.frombuffer(docs, "<i8"), np.frombuffer(ends, "<i8")
        self.text, self.shards = np.frombuffer(text, np.uint8), shards
        self.begins = np.append(0, self.ends[:-1])
        names = window_names(self.text)
        owner = np.repeat(np.arange(len(self.ends), dtype=np.int32), self.ends - self.begins)
        valid = np.zeros(len(names), bool)
        if len(names):
            valid = owner[: len(names)] == owner[WINDOW - 1:]
        at = np.flatnonzero(valid)
        name = names[at]
        cut = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))) if len(at) else np.zeros(0, np.int64)
        self.start, self.size = at[cut], np.diff(np.append(cut, len(at)))
        self.owner, run_name = owner[self.start], name[cut]
        self.names, self.of = np.unique(run_name, return_inverse=True)
        # names that two documents of this block hold
        doc = self.docs[self.owner]
        low, high = np.full(len(self.names), np.iinfo(np.int64).max), np.full(len(self.names), SMALLEST)
        np.minimum.at(low, self.of, doc)
        np.maximum.at(high, self.of, doc)
        self.twice = low != high
        self.shard = (self.names % np.uint64(shards)).astype(np.int32)
        self.order = np.lexsort((self.names, self.shard))

    def asked(self):
        """shard and names (48 bits) for each shard."""
        value = self.names[self.order] // np.uint64(self.shards) & np.uint64((1 << 48) - 1)
        for shard, i, j in _cuts(self.shard[self.order]):
            yield shard, value[i:j]

    def candidates(self, bits: dict[int, bytes]) -> None:
        """Keep the runs whose name recurs; one string stands for its copies."""
        again = np.zeros(len(self.names), bool)
        for shard, i, j in _cuts(self.shard[self.order]):
            again[self.order[i:j]] = np.unpackbits(np.frombuffer(bits[shard], np.uint8))[: j - i].astype(bool)
        run = np.flatnonzero((again | self.twice)[self.of])
        start, size = self.start[run], self.size[run]
        up, down = _powers(max(1 << 21, 1 << len(self.text).bit_length()))
        total = np.append(np.uint64(0), np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[: len(self.text)]))
        key = (total[start + size + WINDOW - 1] - total[start]) * down[start] if len(run) else np.zeros(0, np.uint64)
        doc, of = self.docs[self.owner[run]], self.of[run]
        order = np.lexsort((doc, size, key, of, self.shard[of]))
        same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1]) & (size[order][1:] == size[order][:-1])
        first = np.append(True, ~same) if len(order) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        self.run, self.group = run[order], group
        self.lead = order[first]  # the smallest doc_id that holds each string
        self.lead_doc, self.lead_size, self.lead_start = doc[self.lead], size[self.lead], start[self.lead]
        self.lead_shard = self.shard[of[self.lead]]

    def strings(self):
        """shard, doc_ids, window counts and bytes of the different strings for each shard."""
        for shard, i, j in _cuts(self.lead_shard):
            size = self.lead_size[i:j]
            yield shard, self.lead_doc[i:j], size, self.text[_ranges(self.lead_start[i:j], size + WINDOW - 1)]

    def removed(self, bits: dict[int, bytes]) -> np.ndarray:
        """Marks the bytes that go."""
        marks = np.concatenate([np.unpackbits(np.frombuffer(bits[s], np.uint8))[: self.lead_size[i:j].sum()] for s, i, j in _cuts(self.lead_shard)] or [np.zeros(0, np.uint8)]).astype(bool)
        offset = np.append(0, np.cumsum(self.lead_size))
        start, size = self.start[self.run], self.size[self.run]
        own = marks[_ranges(offset[self.group], size)]
        # a copy with a larger doc_id than its leader goes whole
        own |= np.repeat(self.docs[self.owner[self.run]] > self.lead_doc[self.group], size) if len(size) else False
        at = _ranges(start, size)[own]
        cover = np.zeros(len(self.text) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        return np.cumsum(cover[:-1]) > 0


def _cuts(shard: np.ndarray):
    """(value, first, end) of each run of equal values."""
    if len(shard):
        at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        yield from zip(shard[at].tolist(), at.tolist(), [*at[1:].tolist(), len(shard)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range."""
    if not len(size):
        return np.zeros(0, np.int64)
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _words(text: np.ndarray) -> np.ndarray:
    """Seven symbols of 9 bits from each position on."""
    one = np.append(text, np.zeros(64, text.dtype)).astype(np.int64)
    two = one << 9
    two[:-1] |= one[1:]
    three = two << 9
    three[:-2] |= one[2:]
    del one
    four = two << 18
    four[:-2] |= two[2:]
    del two
    four <<= 27
    four[:-4] |= three[4:]
    return four[:len(text) + 57]


def _stable(group: np.ndarray) -> np.ndarray:
    """Stable order of small whole numbers, 16 bits at a time: numpy counts those."""
    order = np.argsort(group.astype(np.uint16), kind="stable")
    for shift in range(16, int(group.max(initial=0)).bit_length(), 16):
        order = order[np.argsort((group[order] >> shift).astype(np.uint16), kind="stable")]
    return order


def direct(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions in order of the 56 symbols from them on."""
    at = at[np.argsort(words[at])]
    key = words[at]
    some, tied = np.arange(len(at)), np.zeros(len(at), np.int64)
    for k in range(SYMBOLS, WINDOW, SYMBOLS):
        # only positions that tie so far are looked at further
        new = np.append(True, (key[1:] != key[:-1]) | (tied[1:] != tied[:-1])) if len(key) else np.zeros(0, bool)
        inside = ~(new & np.append(new[1:], True)) if len(key) else new
        some, tied = some[inside], np.cumsum(new)[inside]
        if not some.size:
            break
        key = words[at[some] + k]
        # and of these only groups that are not in order are sorted
        falls = np.zeros(tied[-1] + 1, bool)
        falls[tied[1:][(key[1:] < key[:-1]) & (tied[1:] == tied[:-1])]] = True
        move = np.flatnonzero(falls[tied])
        if move.size:
            order = np.argsort(key[move])
            order = move[order[_stable(tied[move][order])]]
            at[some[move]] = at[some[order]]
            key[move] = key[order]
    return at


def induce(text: np.ndarray, larger: np.ndarray, inside: np.ndarray, sorted_: np.ndarray) -> list[np.ndarray]:
    """All suffixes in order, bucket by bucket. ``sorted_``: those smaller than their
    successors; ``larger``: marks the others; ``inside``: marks the suffixes wanted."""
    buckets: list[list[np.ndarray]] = [[] for _ in range(257)]
    first = text[sorted_]
    bounds = np.searchsorted(first, np.arange(258))
    out = []

    def place(own: np.ndarray, c: int) -> None:
        before = own[own > 0] - 1
        before = before[inside[before] & larger[before]]
        if not before.size:
            return
        to = text[before]
        order = np.argsort(to, kind="stable")
        for symbol, i, j in _cuts(to[order]):
            buckets[symbol].append(before[order[i:j]])

    for c in range(257):
        k = 0
        while k < len(buckets[c]):  # grows while runs of one symbol are placed
            place(buckets[c][k], c)
            k += 1
        smaller = sorted_[bounds[c]:bounds[c + 1]]
        place(smaller, c)
        out += [*buckets[c], smaller]
    return out


def equal_windows(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings that lie one after another, each with ``size`` windows: the windows'
    positions in suffix order, and the length (to 56) that each has in common with the
    one before it. ``text`` has symbols from 1 on, and a 0 after each string."""
    length = size + WINDOW  # with its end mark
    begin = np.cumsum(length) - length
    window = np.zeros(len(text), bool)
    window[_ranges(begin, size)] = True
    # a suffix is larger than its successor if the first different symbol falls
    differs = np.append(text[1:] != text[:-1], True)
    nearest = np.where(differs, np.arange(len(text)), len(text))
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    nearest = np.minimum(nearest, len(text) - 1)
    larger = np.append(text[:-1] > text[1:], text[-1:] > 0)[nearest]
    larger[text == 0] = False
    # what induces a string's last windows: up to the next suffix that is sorted directly
    smaller_at = np.where(larger, len(text), np.arange(len(text)))
    smaller_at = np.minimum.accumulate(smaller_at[::-1])[::-1]
    last = begin + size - 1
    need = larger[last]
    inside = window.copy()
    inside[_ranges(last[need] + 1, smaller_at[last[need]] - last[need])] = True
    del differs, nearest, smaller_at
    words = _words(text)
    order = np.concatenate(induce(text, larger, inside, direct(words, np.flatnonzero(inside & ~larger))))
    order = order[window[order]]
    # compared by position, as copies lie alike: neighbours' words are then neighbours too
    before = np.full(len(text), -1)
    before[order[1:]] = order[:-1]
    common = np.zeros(len(text), np.int8)
    for i in range(0, len(text), PIECE):
        at = i + np.flatnonzero(before[i:i + PIECE] >= 0)
        other = before[at]
        for k in range(0, WINDOW, SYMBOLS):
            x = words[k:][at] ^ words[k:][other]
            whole = x == 0
            differ, x = at[~whole], x[~whole]
            for s in range(1, SYMBOLS):
                common[differ] += (x >> 9 * (SYMBOLS - s)) == 0
            at, other = at[whole], other[whole]
            common[at] += SYMBOLS
    return order, common[order]


def marked(docs: np.ndarray, size: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each window of the strings: does a string of a smaller doc_id hold it?"""
    length = size + WINDOW - 1
    text = np.zeros(int((length + 1).sum()), np.uint16)
    begin = np.cumsum(length + 1) - length - 1
    text[_ranges(begin, length)] = raw.astype(np.uint16) + 1
    order, common = equal_windows(text, size)
    owner = np.repeat(np.arange(len(size)), length + 1)[order]
    doc = docs[owner]
    group = np.flatnonzero(np.append(True, common[1:] < WINDOW))
    least = np.repeat(np.minimum.reduceat(doc, group), np.diff(np.append(group, len(doc))))
    gone = np.zeros(len(text), bool)
    gone[order[doc > least]] = True
    return gone[_ranges(begin, size)]


BLOCKS = "block long, docs binary, ends binary, text binary"


def _pack(batches):
    part, serial = TaskContext.get().partitionId() << 24, 0
    docs, texts, size = [], [], 0

    def out():
        return pa.record_batch([pa.array([part + serial], pa.int64()), pa.array([np.array(docs, "<i8").tobytes()], pa.binary()),
                                pa.array([np.cumsum([len(t) for t in texts], dtype="<i8").tobytes()], pa.binary()),
                                pa.array([b"".join(texts)], pa.binary())], ["block", "docs", "ends", "text"])

    for b in batches:
        for doc, text in zip(b["doc"].to_pylist(), b["text"].to_pylist()):
            docs.append(doc)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield out()
                serial += 1
                docs, texts, size = [], [], 0
    if docs:
        yield out()


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of whole documents as a table bucketed by block."""
    spark = docs.sparkSession
    name = f"passage_blocks_{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("doc"), F.col("text").cast("binary").alias("text"))
    (rows.mapInArrow(_pack, BLOCKS).write.bucketBy(shuffle_partitions(spark), "block")
     .option("path", f"{checkpoint_root(spark).rstrip('/')}/llm/{name}").saveAsTable(name))
    return spark.table(name)


def _each(table: pa.Table, shards: int, answers: pa.Table | None = None):
    """The blocks of a table with their answers by kind and shard."""
    bits = {0: {}, 1: {}}
    if answers is not None:
        for kind, shard, x in zip(*(answers[c].to_pylist() for c in ("kind", "shard", "bits"))):
            bits[kind][shard] = x
    for docs, ends, text in zip(*(table[c].to_pylist() for c in ("docs", "ends", "text"))):
        yield Block(docs, ends, text, shards), bits


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of each removed run of bytes), kept (the bytes
    that remain): a row for each row of ``docs``."""
    spark = docs.sparkSession
    shards = 4 * shuffle_partitions(spark)
    blocks = _blocks(docs)

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                (own, _), = _each(pa.Table.from_batches([b.slice(i, 1)]), shards)
                rows = list(own.asked())
                high = [(v >> np.uint64(32)).astype(np.uint16).tobytes() for _, v in rows]
                low = [v.astype(np.uint32).tobytes() for _, v in rows]
                yield pa.record_batch([pa.array([s for s, _ in rows], pa.int32()), pa.array([b["block"][i].as_py()] * len(rows), pa.int64()),
                                       pa.array(high, pa.binary()), pa.array(low, pa.binary())], ["shard", "block", "high", "low"])

    def recur(table: pa.Table) -> pa.Table:
        high, low = table["high"].to_pylist(), table["low"].to_pylist()
        size = np.array([len(x) // 4 for x in low])
        value = np.frombuffer(b"".join(high), np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(b"".join(low), np.uint32)
        order = np.argsort(value)
        value = value[order]
        same = value[1:] == value[:-1]
        again = np.zeros(len(value), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        return _answer(table, 0, again, size)

    def send(blocks_: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for own, bits in _each(blocks_, shards, answers):
            own.candidates(bits[0])
            out += [(s, blocks_["block"][0].as_py(), d.astype("<i8").tobytes(), n.astype("<u4").tobytes(), t.tobytes()) for s, d, n, t in own.strings()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 5, (pa.int32(), pa.int64(), *[pa.binary()] * 3))], ["shard", "block", "docs", "sizes", "text"])

    def sort(table: pa.Table) -> pa.Table:
        join = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        size = join("sizes", "<u4").astype(np.int64)
        counts = [int(np.frombuffer(x, "<u4").sum()) for x in table["sizes"].to_pylist()]
        return _answer(table, 1, marked(join("docs", "<i8"), size, join("text", np.uint8)), counts)

    def cut(blocks_: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for own, bits in _each(blocks_, shards, answers):
            own.candidates(bits[0])
            gone = own.removed(bits[1])
            for doc, lo, hi in zip(own.docs.tolist(), own.begins.tolist(), own.ends.tolist()):
                here = gone[lo:hi]
                turn = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
                spans = [{"start": s, "end": e} for s, e in turn.reshape(-1, 2).tolist()]
                rows.append((None if doc == SMALLEST else doc, hi - lo, spans, own.text[lo:hi][~here].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["doc_id", "n_bytes", "spans", "kept"])

    answer = "block long, kind int, shard int, bits binary"
    asked = blocks.mapInArrow(ask, "shard int, block long, high binary, low binary")
    names = written(asked.groupBy("shard").applyInArrow(recur, answer), "names")
    sent = blocks.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(send, "shard int, block long, docs binary, sizes binary, text binary")
    marks = written(sent.groupBy("shard").applyInArrow(sort, answer), "marks")
    both = names.unionByName(marks)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _answer(table: pa.Table, kind: int, marks: np.ndarray, sizes) -> pa.Table:
    """The marks of a shard, dealt back to the blocks that asked."""
    bits, at = [], 0
    for n in sizes:
        bits.append(np.packbits(marks[at:at + n]).tobytes())
        at += n
    rows = len(bits)
    return pa.table({"block": table["block"], "kind": pa.array([kind] * rows, pa.int32()), "shard": table["shard"], "bits": pa.array(bits, pa.binary())})
