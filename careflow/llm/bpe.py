"""Byte-pair merges over a tokenizer file (one word at a time), for the operators
that treat words no table holds."""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np

SHORT, NONE, ID = 64, 1 << 60, (1 << 20) - 1


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@functools.lru_cache(maxsize=None)
def unassigned() -> np.ndarray:
    """True for code points without a character in this Python's Unicode data: there
    tables of different libraries may disagree, so such texts are cut by the library."""
    import unicodedata

    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def has_unassigned(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")  # whose code points are all assigned
        return False
    except UnicodeEncodeError:
        pass
    return bool(unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())


class Merger:
    """Exact merges of one tokenizer file: words as UTF-8 bytes to token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + self.suffix] for c in alphabet]
        self.rank = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = rank << 20 | vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for piece, i in vocab.items():
            if piece not in self.special:
                piece = piece.removesuffix(self.suffix) if self.suffix else piece
                self.bytes_of[i] = bytes(back[c] for c in piece)
        for piece, i in self.special.items():
            self.bytes_of[i] = piece.encode()

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: lowest rank first, leftmost among equals."""
        if not word:
            return []
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get = self.rank.get
        ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < NONE:
            i = ranks.index(best)
            ids[i:i + 2] = [new := best & ID]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), NONE)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), NONE)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """O(n log n): a heap over a linked list."""
        n, get = len(ids), self.rank.get
        heap = [(r, i) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i], ids[j])) != r:
                continue  # one of the two has been merged meanwhile
            ids[i] = new = r & ID
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((new, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((ids[h], new))) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]


@functools.lru_cache(maxsize=None)
def merger(path: str) -> Merger:
    """One per Python worker and file."""
    return Merger(path)


@functools.lru_cache(maxsize=None)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
