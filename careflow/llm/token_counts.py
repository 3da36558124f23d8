"""Operator 9, token counts by compiled finite-state transducers.

The pre-tokenizer is compiled to a deterministic transducer of five states over six
symbols, whose transitions emit a token start or nothing. The maps that texts induce
on its states form a small finite monoid, so a text is cut into chunks of equal
length, each chunk's state map is composed column by column, chunk maps are composed
by a parallel (doubling) prefix scan, and every position's state follows without
reading the text in sequence. A start is weighted with the number of tokens its word
emits; that lexicon is filled from exact merges, one word once per worker.

Rules: a null text counts as empty (0 bytes, 0 tokens). Special strings in a text are
one token each. Rows that share a doc_id are counted one by one. Further columns,
whatever their names, are ignored. Texts with code points that this Python's Unicode
tables do not know are counted by the tokenizer library itself, since tables of
different ages may class them differently.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.bpe import has_unassigned, library, merger

SPACE, DIGIT, LETTER, OTHER, SHORT, LONG = range(6)  # SHORT, LONG: an apostrophe that a 1 or 2 letter ending follows
STATES = 5  # between tokens, in letters, in other marks, one letter of an ending left, two left
CHUNK = 64
SLICE = 1 << 21  # characters worked on at once, unless one text is longer
MEMO = 1 << 20
BASE, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")


def _step(state: int, symbol: int) -> tuple[int, int]:
    """Next state and whether a token starts with this character."""
    if state >= 3:
        return (0 if state == 3 else 3), 0
    if state == 2 and symbol in (OTHER, SHORT, LONG):
        return 2, 0
    if symbol == LETTER:
        return 1, int(state != 1)
    return {SPACE: 0, DIGIT: 0, OTHER: 2, SHORT: 3, LONG: 4}[symbol], int(symbol != SPACE)


@functools.lru_cache(maxsize=1)
def compiled() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the transducer: the map of each symbol, the product of two maps, the action of
    a map on a state, and the emissions by state and symbol. Map 0 is the identity."""
    gens = [tuple(_step(q, s)[0] for q in range(STATES)) for s in range(6)]
    maps, seen = [tuple(range(STATES))], {tuple(range(STATES)): 0}
    for m in maps:
        for g in gens:
            if (x := tuple(g[q] for q in m)) not in seen:
                seen[x] = len(maps)
                maps.append(x)
    product = np.array([[seen[tuple(b[q] for q in a)] for b in maps] for a in maps], np.uint16)
    emits = np.array([[_step(q, s)[1] for s in range(6)] for q in range(STATES)], bool)
    return np.array([seen[g] for g in gens], np.uint16), product, np.array(maps, np.uint8), emits


@functools.lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((SPACE, r"\s"), (DIGIT, r"\p{N}"), (LETTER, r"\p{L}")):
        out[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return out


def symbols(codes: np.ndarray) -> np.ndarray:
    out = char_classes()[codes]
    at = np.flatnonzero(codes == 0x27)
    if at.size:
        padded = np.append(codes, [10, 10])
        one, two = padded[at + 1], padded[at + 2]
        out[at[np.isin(one, [ord(c) for c in ENDINGS_1])]] = SHORT
        for a, b in ENDINGS_2:
            out[at[(one == ord(a)) & (two == ord(b))]] = LONG
    return out


def token_starts(sym: np.ndarray) -> np.ndarray:
    """Positions where the transducer emits a token start."""
    gens, product, act, emits = compiled()
    n, size = len(sym), len(act)
    chunks = -(-n // CHUNK)
    maps = np.zeros(chunks * CHUNK, np.uint16)
    maps[:n] = gens[sym]
    maps = np.ascontiguousarray(maps.reshape(chunks, CHUNK).T)
    flat, before = product.ravel(), np.zeros((CHUNK, chunks), np.uint16)
    acc = np.zeros(chunks, np.uint16)
    for j in range(CHUNK):  # all chunks advance by one character
        before[j] = acc
        acc = flat[acc.astype(np.int32) * size + maps[j]]
    shift = 1
    while shift < chunks:  # inclusive scan of the chunk maps
        acc[shift:] = product[acc[:-shift], acc[shift:]]
        shift *= 2
    entry = np.zeros(chunks, np.uint8)
    entry[1:] = act[acc[:-1], 0]
    state = act.ravel()[before.astype(np.int32) * STATES + entry].T.ravel()[:n]
    return np.flatnonzero(emits.ravel()[state.astype(np.int16) * 6 + sym])


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Counter:
    """Token counts of texts under one tokenizer file. ``memo``: tokens by word hash."""

    def __init__(self, path: str):
        self.path, self.merger, self.memo = path, merger(path), {}
        self.special = regex.compile("|".join(map(regex.escape, self.merger.special)))

    def segments(self, text: str) -> tuple[list[str], int]:
        """The normalized text between special strings, and how many of those there are."""
        parts = self.special.split(text) if "<|" in text else [text]
        out = []
        for p in parts:
            if not p.isascii():
                import unicodedata

                p = unicodedata.normalize("NFC", p).replace("Σ", "σ")
            out.append(p.lower())
        return out, len(parts) - 1

    def words(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Start of each word, and the number of tokens of each."""
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym = symbols(codes)
        starts = token_starts(sym)
        if not starts.size:
            return starts, starts
        up, down = powers(1 << max(SLICE, len(codes)).bit_length())
        solid = sym != SPACE
        v = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX_A)
        v ^= v >> np.uint64(29)
        v *= np.uint64(MIX_B)
        v *= up[: len(v)]
        v[~solid] = 0
        key = np.add.reduceat(v, starts) * down[starts]
        size = np.add.reduceat(solid.astype(np.int32), starts)
        key ^= size.astype(np.uint64) << np.uint64(48)
        keys, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, counts = self.memo, np.empty(len(keys), np.int64)
        for i, (k, at) in enumerate(zip(keys.tolist(), where.tolist())):
            n = memo.get(k)
            if n is None:
                s = int(starts[at])
                n = memo[k] = len(self.merger.merge(joined[s:s + int(size[at])].encode()))
            counts[i] = n
        return starts, counts[inverse]

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        chars = 0

        def flush():
            nonlocal held, owner, chars
            starts, counts = self.words("\n".join(held))
            offset = np.cumsum([0, *(len(s) + 1 for s in held)])[:-1]
            doc = np.asarray(owner)[np.searchsorted(offset, starts, "right") - 1] if len(starts) else starts
            np.add.at(out, doc, counts)
            held, owner, chars = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if has_unassigned(text):
                out[i] = len(library(self.path).encode(text, add_special_tokens=False).ids)
                continue
            parts, special = self.segments(text)
            out[i] += special
            for p in parts:
                held.append(p)
                owner.append(i)
                chars += len(p)
            if chars >= SLICE:
                flush()
        if held:
            flush()
        return out


@functools.lru_cache(maxsize=None)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. No shuffle."""

    def run(batches):
        c = counter(tokenizer)
        for b in batches:
            n = c.count(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
