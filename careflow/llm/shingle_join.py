"""Operator 7, Jaccard join of word 5-gram sets by PartEnum signatures.

Sets of n and m shingles with Jaccard similarity 3/4 or more differ in at most
k = (n + m) / 7 shingles. The domain of shingles (64-bit hashes) is partitioned, into
2**j parts for sets of 2**j to 2**(j+1) - 1 shingles, so at most k parts differ. A
signature is a part's number with what the set holds of it. The subsets of parts that a
set enumerates are the single non-empty parts in order, up to k + t of them: then two
similar sets of a size band share t signatures at least (where a pair's t-th common part
lies, at most k parts of either set come before it). Sets in the upper half of a
band also enumerate the next band's parts, to meet larger partners there. A set with too
few non-empty parts enumerates a finer partition as well.

Stages. Equal sets are one. (1) Signatures go to shards in blocks, one of each value
from a block of sets (a value that two sets of a block hold needs no partner
elsewhere, so a very common one costs a block one entry); the shards count how many of
a set's signatures another set has, and sets with fewer than t drop out. (2) In the
same way, sets whose shingles are not three quarters shared by the remaining sets drop
out. (3) The second level: for the rest, the domain is partitioned anew, one shingle a
part, in order of how many sets hold it, the rarest first. Before the first part that a
pair has in common lie only shingles that one of them lacks: at most a quarter of the
larger set, a seventh of the smaller. So a set enumerates the parts up to there, and
what most sets of a family share comes last and is left out, unless the set has little
of its own: letters of one form, each with more than a seventh of its own, meet nowhere.
(4) Each set is verified against the one that leads most of its
signature groups, and verified pairs are united; with other leads this is repeated
while it links anything (``ROUNDS`` times at most). (5) All pairs that share a
signature but lie in different components after that are verified, unless what follows
the signature in either set is too little to be similar. So every link between
different components is found, however many rounds went before, while pairs inside a
component are not enumerated.

Rules: A-Z are lower-cased, words are split at ASCII white space; fewer than five words
make one shingle; a text without words (null, empty) has n_shingles 0 and links with
nothing. Rows that share a doc_id count as one document with several texts. A row
without doc_id links with nothing and has a null component.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import shuffle_partitions, written
from careflow.llm.components import components

WIDTH = 5
ROUNDS = 3
FLUSH, OWNERS = 1 << 20, (1 << 16) - 1
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NONE = np.zeros(0, np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= 1 << 16:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or b"").lower().split()
    if not words:
        return NONE
    ids = np.array(list(map(known.__getitem__, words)), np.uint64)
    width = min(WIDTH, len(ids))
    h = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        h ^= h >> np.uint64(29)
        h *= _A
        h += ids[k:len(ids) - width + 1 + k]
    h = mix(h)
    h.sort()
    return h[np.append(True, h[1:] != h[:-1])]


def spare(n: int) -> int:
    """t: signatures that similar sets share at least."""
    return max(1, n // 12)


def signatures(s: np.ndarray) -> np.ndarray:
    """The PartEnum signatures of a sorted set."""
    n = len(s)
    if not n:
        return NONE
    band = n.bit_length() - 1
    largest = n * 4 // 3
    out = _enumerate(s, band, (n + min(largest, (2 << band) - 1)) // 7 + spare(n))
    if largest >= 2 << band:
        out += _enumerate(s, band + 1, (n + largest) // 7 + spare(n))
    return np.concatenate(out)


def _enumerate(s: np.ndarray, band: int, most: int) -> list[np.ndarray]:
    part = s >> np.uint64(64 - band) if band else np.zeros(len(s), np.uint64)
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    # a sum of mixed hashes stands for the subset; the band and the part are mixed in
    value = np.add.reduceat(mix(s), start) + mix(part[start] * _A + np.uint64(band))
    out = [mix(value)[:most]]
    if len(start) < most:
        fine = s >> np.uint64(60 - band)
        start = np.flatnonzero(np.append(True, fine[1:] != fine[:-1]))
        value = np.add.reduceat(mix(s), start) + mix(fine[start] * _A + np.uint64(64 + band))
        out.append(mix(value)[:most])
    return out


BLOCK = "shard int, flush long, high binary, low binary, owner binary, ids binary, needs binary, credit binary"


def shared_enough(rows: DataFrame, sets, name: str) -> DataFrame:
    """id: of those sets that share as many signatures with others as they need. ``sets``
    makes (id, signatures, need) triples of a batch of ``rows``."""
    shards = 4 * shuffle_partitions(rows.sparkSession)

    def pack(batches):
        part, serial = TaskContext.get().partitionId() << 24, 0
        ids, needs, found, size = {}, [], [], 0

        def flush():
            own = np.repeat(np.arange(len(found), dtype=np.int64), [len(f) for f in found])
            sig = np.concatenate(found)
            order = np.argsort(sig)
            sig, own = sig[order], own[order]
            first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            count = np.diff(np.append(first, len(sig)))
            twice = np.repeat(count > 1, count)
            credit = np.bincount(own[twice], minlength=len(found))
            value, owner = sig[first], np.where(count > 1, OWNERS, own[first]).astype(np.uint16)
            del sig, own, twice, count, first
            shard = (value % np.uint64(shards)).astype(np.int32)
            value = value // np.uint64(shards) & np.uint64((1 << 48) - 1)
            # of few shards numpy counts; within a shard the values rise already, but for the bits cut off
            order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
            shard, value, owner = shard[order], value[order], owner[order]
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
            high, low = (value >> np.uint64(32)).astype(np.uint16), value.astype(np.uint32)
            take = lambda a: [a[i:j].tobytes() for i, j in zip(cuts, cuts[1:])] + [b""]
            m = len(cuts) - 1
            last = lambda a, kind: pa.array([None] * m + [np.array(a, kind).tobytes()], pa.binary())
            return pa.record_batch([
                pa.array([*shard[cuts[:-1]].tolist(), (part + serial) % shards], pa.int32()), pa.array([part + serial] * (m + 1), pa.int64()),
                pa.array(take(high), pa.binary()), pa.array(take(low), pa.binary()), pa.array(take(owner), pa.binary()),
                last(list(ids), "<i8"), last(needs, "<i4"), last(credit, "<i4")], [c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            for i, s, need in sets(b):
                if i in ids or not len(s):
                    continue
                ids[i] = None
                needs.append(need)
                found.append(s)
                size += len(s)
                if size >= FLUSH or len(ids) >= OWNERS - 1:
                    yield flush()
                    serial += 1
                    ids, needs, found, size = {}, [], [], 0
        if found:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        """For each block that asked, how many of each owner's values others hold."""
        high, low, owner = (table[c].to_pylist() for c in ("high", "low", "owner"))
        size = np.array([len(x) // 4 for x in low])
        value = np.frombuffer(b"".join(high), np.uint16).astype(np.uint64) << np.uint64(32) | np.frombuffer(b"".join(low), np.uint32)
        own = np.frombuffer(b"".join(owner), np.uint16)
        order = np.argsort(value)
        value = value[order]
        same = np.append(False, value[1:] == value[:-1]) if len(value) else np.zeros(0, bool)
        met = np.zeros(len(value), bool)
        met[order] = same | np.append(same[1:], False) if len(value) else same
        met &= own != OWNERS
        found = _by_block(own, met, size)
        return pa.table({"flush": table["flush"], "owners": pa.array(found, pa.binary()), "ids": table["ids"], "needs": table["needs"], "credit": table["credit"]})

    def sums(table: pa.Table) -> pa.Table:
        """The sets of a block that have as many as they need."""
        at = next(k for k, i in enumerate(table["ids"].to_pylist()) if i is not None)
        ids, needs, n = (np.frombuffer(table[c][at].as_py(), k) for c, k in (("ids", "<i8"), ("needs", "<i4"), ("credit", "<i4")))
        n = n + np.bincount(np.frombuffer(b"".join(table["owners"].to_pylist()), np.uint16), minlength=len(ids))
        return pa.table({"id": ids[n >= needs]})

    counts = rows.mapInArrow(pack, BLOCK).groupBy("shard").applyInArrow(count, "flush long, owners binary, ids binary, needs binary, credit binary")
    return counts.groupBy("flush").applyInArrow(sums, "id long").distinct()


def _by_block(own: np.ndarray, met: np.ndarray, size: np.ndarray) -> list[bytes]:
    cuts = np.cumsum(size) - size
    return [own[i:i + n][met[i:i + n]].tobytes() for i, n in zip(cuts.tolist(), size.tolist())]


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) whose sets are similar. ``sets``: doc, shingles (bytes)."""
    side = lambda c: sets.select(F.col("doc").alias(c), F.col("shingles").alias(f"s{c}")).hint("merge")

    def check(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["sa"].to_pylist(), b["sb"].to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return met.mapInArrow(check, "a long, b long").distinct()


def _nearer(links: DataFrame) -> DataFrame:
    """node, component: the smallest neighbour's smallest neighbour, which is enough to
    see most pairs as connected between turns."""
    parent = written(links.groupBy("a").agg(F.min("b").alias("p")), "parents")
    above = parent.select(F.col("a").alias("p"), F.col("p").alias("pp")).hint("merge")
    return written(parent.join(above, "p", "left").select(F.col("a").alias("node"), F.coalesce("pp", "p").alias("component")), "nearer")


def _with_components(marks: DataFrame, now: DataFrame | None) -> DataFrame:
    """Signature rows (doc, n, sig, rest, small) with the component so far, c."""
    own = ["doc", "n", "sig", "rest", "small"]
    if now is None:
        return marks.select(*own, F.col("doc").alias("c"))
    named = now.withColumnRenamed("node", "doc").hint("merge")
    return marks.select(own).join(named, "doc", "left").select(*own, F.coalesce("component", "doc").alias("c"))


def unit_rows(doc: list, key: list, sig: list) -> pa.RecordBatch:
    """One row a shingle: its document, the set's own number and size, the shingle."""
    size = [len(x) for x in sig]
    return pa.record_batch([np.repeat(np.array(doc, np.int64), size), np.repeat(np.array(key, np.int64), size),
                            np.repeat(np.array(size, np.int32), size), np.concatenate(sig)], ["doc", "key", "n", "sig"])


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))

    def measure(batches):
        known = word_hashes()
        for b in batches:
            sets = [shingle_set(t, known) for t in b["text"].to_pylist()]
            keys = np.array([xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets], object)
            half = lambda shift: pa.array([(int(k) >> shift & (1 << 64) - 1) - (1 << 63) for k in keys], pa.int64())
            yield pa.record_batch([b["doc"], pa.array([len(s) for s in sets], pa.int64()), half(0), half(64)], ["doc", "n", "k0", "k1"])
        known.clear()  # workers live on; later stages need the memory

    sizes = written(rows.mapInArrow(measure, "doc long, n long, k0 long, k1 long"), "sizes")
    sets = sizes.filter("n > 0 and doc is not null").groupBy("k0", "k1").agg(F.min("doc").alias("rep"), F.max("n").alias("n"))
    sets = written(sets, "sets")

    def by_parts(b):
        known = word_hashes()
        for t in b["text"].to_pylist():
            if len(s := shingle_set(t, known)):
                k = xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1
                yield k - (1 << 63), signatures(s), spare(-(-3 * len(s) // 4))

    some = written(shared_enough(rows.filter("doc is not null"), by_parts, "parts"), "some")
    some = written(sets.join(some.withColumnRenamed("id", "k0"), "k0").select(F.col("rep").alias("doc")).distinct(), "some")

    def collect(batches):
        known = word_hashes()
        for b in batches:
            found = [(d, s.tobytes()) for d, t in zip(b["doc"].to_pylist(), b["text"].to_pylist()) if len(s := shingle_set(t, known))]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["doc", "shingles"])

    held = written(rows.join(some.hint("merge"), "doc", "left_semi").mapInArrow(collect, "doc long, shingles binary"), "held")

    def by_shingle(b):
        for d, s in zip(b["doc"].to_pylist(), b["shingles"].to_pylist()):
            s = np.frombuffer(s, "<u8")
            yield d, s, -(-3 * len(s) // 4)

    left = written(shared_enough(held, by_shingle, "shingles").select(F.col("id").alias("doc")), "left")
    held = written(held.join(left.hint("merge"), "doc", "left_semi"), "held")

    def units(batches):
        for b in batches:
            doc, key, sig = [], [], []
            for d, s in zip(b["doc"].to_pylist(), b["shingles"].to_pylist()):
                doc.append(d)
                key.append(xxhash.xxh3_64_intdigest(s) - (1 << 63))
                sig.append(np.frombuffer(s, "<i8"))
                if len(sig) == 1 << 10:
                    yield unit_rows(doc, key, sig)
                    doc, key, sig = [], [], []
            if sig:
                yield unit_rows(doc, key, sig)

    single = held.mapInArrow(units, "doc long, key long, n int, sig long")
    usual = written(single.groupBy("sig").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    place = F.dense_rank().over(Window.partitionBy("doc", "key").orderBy(F.desc("df"), F.desc("sig")))
    marks = single.join(usual.hint("merge"), "sig").select("doc", "n", "sig", place.alias("rest"))
    # a similar partner of n shingles or fewer shares 3 n / 4 at least
    marks = marks.filter("4 * rest >= 3 * n").distinct().select("*", F.expr("7 * rest >= 6 * n").alias("small"))
    marks = written(marks, "marks")
    groups = marks.groupBy("sig").agg(F.count("*").alias("size"), F.max("small").alias("any")).filter("size > 1 and any").select("sig")
    marks = written(marks.join(written(groups, "groups").hint("merge"), "sig"), "marks")
    links = tried = now = None
    for turn in range(ROUNDS):
        # each set against the member that leads most of the groups it shares with
        # another component; the lead changes by turn
        spread = written(_with_components(marks, now), "spread")
        order = F.xxhash64("doc", F.lit(turn)) if turn else F.col("doc")
        leads = spread.groupBy("sig").agg(F.min_by(F.struct("doc", "c", "n", "rest"), order).alias("lead"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        leads = written(leads.filter("lo <> hi").select(
            "sig", F.col("lead.doc").alias("lead"), F.col("lead.c").alias("lead_c"), F.col("lead.n").alias("lead_n"), F.col("lead.rest").alias("lead_rest")), "leads")
        marks = spread.join(leads.hint("merge"), "sig")  # the groups that span components; the others stay closed
        led = marks.filter("c <> lead_c and 7 * least(rest, lead_rest) >= 3 * (n + lead_n)").groupBy("doc", "lead").count()
        pairs = led.groupBy("doc").agg(F.max_by("lead", F.struct("count", -F.col("lead"))).alias("lead")).select(
            F.greatest("doc", "lead").alias("a"), F.least("doc", "lead").alias("b")).distinct()
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        found = written(verified(pairs, held), "found")
        if links is not None and found.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        now = _nearer(links)
    spread = written(_with_components(marks, components(links)), "spread")
    open_ = spread.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("small").alias("any"))
    open_ = written(open_.filter("lo <> hi and any").select("sig"), "open")
    spread = spread.join(open_.hint("merge"), "sig", "left_semi")
    side = lambda x: [F.col("sig"), *(F.col(c).alias(c + x) for c in ("doc", "n", "rest", "c"))]
    other = spread.select(side("a")).hint("merge").join(spread.filter("small").select(side("b")), "sig").filter(
        "na >= nb and ca <> cb and 7 * least(resta, restb) >= 3 * (na + nb)")
    other = other.select(F.greatest("doca", "docb").alias("a"), F.least("doca", "docb").alias("b")).distinct()
    second = verified(written(other.join(tried, ["a", "b"], "left_anti"), "other"), held)
    links = written(links.unionByName(second), "links")
    roots = components(links)
    # a set's documents share its representative's component; a document of several texts joins theirs
    named = sets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("k0", "k1", "rep", F.coalesce("component", "rep").alias("component"))
    out = sizes.join(named.hint("merge"), ["k0", "k1"], "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                      F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id, before rows
    without one; of rows alike in that, the first as stored. Texts without words link
    with nothing, so such rows stay.

    Where doc_ids repeat or are missing, rows are numbered (in a written copy) and
    linked by number, so each of them is a document of its own here."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        lost = join(docs).filter("component_id <> doc_id").select("doc_id").distinct()
        return docs.join(written(lost, "lost").hint("merge"), "doc_id", "left_anti").select(docs.columns)
    rows = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = written(join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id"), "groups")
    named = rows.select("_row", "doc_id").join(groups.hint("merge"), "_row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("_row"))).alias("first"))
    return rows.join(written(first.select("first._row"), "firsts").hint("merge"), "_row", "left_semi").select(docs.columns)
