"""Operator 6, byte-pair encoding and decoding over a compiled lexicon.

Frequent words of the corpus are compiled into a minimal acyclic transducer: an
automaton that shares suffixes as well as prefixes, whose transitions carry additive
outputs that sum to the word's number, which leads to its token ids. It travels as
one block of bytes, is memory-mapped by each worker, and is walked once per word and
worker; words it does not hold are merged exactly. Either way the ids are the same.

The lexicon is bounded by proof: a word enters only with at least 1 / 2**16 of all
words, so at most 2**16 enter. A task counts in runs of 2**19 distinct words and reports
of each run the words that reach this share of the run; one that reaches it over all must
do so in some run. Counts of other runs are then missing from its sum, so a word near the
share may be left out; ids do not depend on it.

Rules: a null text is encoded as empty. Special strings in a text give their own id.
Texts with code points unknown to this Python's Unicode tables are cut into words by
the tokenizer library. Repeated rows are encoded one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import mmap
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.llm.bpe import has_unassigned, library, merger
from careflow.llm.common import written
from careflow.llm.words import ranges, words

SHARE = 1 << 16
WORD_BYTES = 64  # longer words are merged anew
LOCAL = 1 << 19  # distinct words counted at once in a task
MEMO = 1 << 19


def cut(text: str, path: str) -> list[str]:
    if has_unassigned(text):
        return [text[a:b] for _, (a, b) in library(path).pre_tokenizer.pre_tokenize_str(text)]
    return words(text)


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """Minimal acyclic transducer of sorted (word, ids), built incrementally: after each
    word the states that can no longer change are replaced by equal ones already kept."""
    kept: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...)) by number

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if (at := kept.get(key)) is None:
            at = kept[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]  # unfrozen nodes along the last word
    last = b""
    for word, _ in entries:
        p = 0
        while p < min(len(word), len(last)) and word[p] == last[p]:
            p += 1
        for d in range(len(last), p, -1):
            path[d - 1][1].append((last[d - 1], freeze(path.pop())))
        for _ in word[p:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for d in range(len(last), 0, -1):
        path[d - 1][1].append((last[d - 1], freeze(path.pop())))
    root = freeze(path[0])
    below = []  # words in each state; targets come before sources
    for final, moves in states:
        below.append(int(final) + sum(below[t] for _, t in moves))
    begin, label, target, output = [0], [], [], []
    for final, moves in states:
        seen = int(final)
        for c, t in moves:
            label.append(c)
            target.append(t)
            output.append(seen)
            seen += below[t]
        begin.append(len(label))
    ends = np.cumsum([0, *(len(ids) for _, ids in entries)])
    arrays = [np.array([len(states), len(label), len(entries), int(ends[-1]), root, 0], "<i4"),
              np.array(begin, "<i4"), np.array(target, "<i4"), np.array(output, "<i4"), ends.astype("<i4"),
              np.array([i for _, ids in entries for i in ids], "<u4"),
              np.array([f for f, _ in states], "u1"), np.array(label, "u1")]
    return b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, read through a memory map of an unnamed file."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        states, moves, words, ids, self.root, _ = view[:24].cast("i")
        at = 24

        def take(n, kind):
            nonlocal at
            a = view[at:at + n * (1 if kind == "B" else 4)].cast(kind)
            at += a.nbytes
            return a

        self.begin, self.target, self.output = take(states + 1, "i"), take(moves, "i"), take(moves, "i")
        self.ends, self.ids = take(words + 1, "i"), take(ids, "I")
        self.final, self.label = take(states, "B"), bytes(take(moves, "B"))

    def get(self, word: bytes) -> bytes | None:
        """The ids of a word as little-endian bytes, or None."""
        state, number = self.root, 0
        for c in word:
            at = self.label.find(c, self.begin[state], self.begin[state + 1])
            if at < 0:
                return None
            number += self.output[at]
            state = self.target[at]
        return self.ids[self.ends[number]:self.ends[number + 1]].tobytes() if self.final[state] else None


class Codec(dict):
    """Words to ids: a bounded memo over the lexicon over exact merges."""

    def __init__(self, path: str, block: bytes):
        super().__init__()
        self.path, self.merger, self.lexicon = path, merger(path), Lexicon(block) if block else None
        self.length = np.array([len(x) for x in self.merger.bytes_of], np.int64)
        self.start, self.bytes = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(self.merger.bytes_of), np.uint8)
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in self.merger.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.lexicon.get(raw) if self.lexicon and len(raw) <= WORD_BYTES else None
        if ids is None:
            ids = np.array(self.merger.merge(raw), "<u4").tobytes()
        if len(raw) <= WORD_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, cut(text, self.path)))
        return b"".join(self.special.get(p) or b"".join(map(self.__getitem__, cut(p, self.path))) for p in self.split(text))

    def decode(self, ids: bytes) -> str:
        ids = np.frombuffer(ids, "<u4")
        return self.bytes[ranges(self.start[ids], self.length[ids])].tobytes().decode("utf-8", "replace")


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def frequent_words(docs: DataFrame, tokenizer: str) -> list[str]:
    """Words with at least 1 / 2**16 of all words of the corpus, as far as the tasks' runs
    report them: at most 2**16, in order."""

    def run(seen, total):
        keep = [(w, n) for w, n in seen.items() if n * SHARE >= total and len(w.encode()) <= WORD_BYTES]
        return pa.record_batch([pa.array([*(w for w, _ in keep), None], pa.string()), pa.array([*(n for _, n in keep), total], pa.int64())], ["word", "n"])

    def report(batches):
        seen, total = Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                found = cut(text, tokenizer)
                total += len(found)
                seen.update(found)
                if len(seen) > LOCAL:
                    yield run(seen, total)
                    seen, total = Counter(), 0
        yield run(seen, total)

    counts = written(_rows(docs).mapInArrow(report, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = sum(r.n for r in counts.filter("word is null").collect())  # one row
    keep = counts.filter(F.col("word").isNotNull() & (F.col("n") * SHARE >= total))
    return sorted((r.word for r in keep.select("word").collect()), key=str.encode)


def build_lexicon(docs: DataFrame, tokenizer: str) -> bytes:
    """The compiled lexicon of a corpus (at most 2**16 words of 64 bytes)."""
    m = merger(tokenizer)
    return compile_lexicon([(w.encode(), m.merge(w.encode())) for w in frequent_words(docs, tokenizer)])


@functools.lru_cache(maxsize=4)
def _codec(path: str, block: bytes) -> Codec:
    return Codec(path, block)


def encode(docs: DataFrame, tokenizer: str, decode: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ids (little-endian unsigned 32-bit integers) and n_tokens, and
    decoded text if asked for. Columns of those names in ``docs`` are replaced."""
    new = {"ids", "n_tokens", "decoded"}
    columns = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    block = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, tokenizer))
    # the text to encode travels in front; the other columns pass through unread
    rows = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("_code_text"), *columns)
    fields = [*(docs.schema[c] for c in columns), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    if decode:
        fields.append(T.StructField("decoded", T.StringType()))

    def run(batches):
        codec = _codec(tokenizer, block.value)
        for b in batches:
            ids = [codec.encode(t) for t in b.column(0).to_pylist()]
            arrays = [*b.columns[1:], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decode:
                arrays.append(pa.array([codec.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with a column decoded, made from its ids (null ids: empty)."""
    rows = encoded.select(F.coalesce(F.col("ids"), F.lit(b"")).alias("_code_ids"), *(c for c in encoded.columns if c != "decoded"))
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = _codec(tokenizer, b"")
        for b in batches:
            text = pa.array([codec.decode(x) for x in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], text], schema.names)

    return rows.mapInArrow(run, schema)
