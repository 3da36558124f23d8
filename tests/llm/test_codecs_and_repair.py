"""Merge replay, token alignment and structure repair against libraries and plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from careflow.llm import alignment, merge_replay, structure_repair
from careflow.llm.bpe import byte_alphabet
from careflow.llm.catalog import BYTE_BPE, MULTI_RANKS, PIECES, tokenizer
from careflow.llm.words import PATTERN, words

DOCS = "doc_id long, text string, ids int, _row string, n_a int, row long, shard int"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioéß中,'.!0 \n") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    texts = [None, "", " ", "\n\n  \t", "a͸b <|endoftext|> </s> <0x41>", "\x00\x1c\x85 nul", "ﬁ ½ Å  tab\t\r\n", "  lead", "'ll don't 'S", "x" * 5000,
             "ab" * 3000, "日本語" * 400, "one two", "one two"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    rows = [(i if i % 13 else None, t, 1, "x", None, i, 2) for i, t in enumerate(texts)] + [(1, "", 1, "x", None, 1, 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_words_are_the_patterns_matches():
    import public_tokenizers
    import regex

    assert PATTERN == public_tokenizers.PATTERN
    plain, rng = regex.compile(PATTERN), random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1 \n\t\r\x0b\x1c\x1f'stmdrevl.,!_") for _ in range(rng.randint(0, 12)))
        assert words(text) == plain.findall(text)


def test_replay_equals_the_library():
    path = tokenizer(MULTI_RANKS)
    ranks, library, rng = merge_replay.rank_file(path), merge_replay.library(path), random.Random(4)
    found = list({"".join(rng.choice("abcdeéß中 \n'0123.,!?") for _ in range(rng.randint(1, 40))).encode() for _ in range(5000)})
    found += [b"a" * 300, b"ab" * 4000, b" " * 77, bytes(range(1, 256))]
    ids, count = merge_replay.encode_words(found, ranks)
    for word, own in zip(found, np.split(ids, np.cumsum(count)[:-1])):
        assert own.tolist() == library._core_bpe.encode_single_piece(word)
    assert merge_replay.encode_words([], ranks)[0].size == 0


def test_replay_with_ranks_out_of_order(tmp_path):
    """A merged pair may open one of a lower rank; plain: lowest rank first, then leftmost."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"ab", b"cabc", b"aa", b"abcab", b"ca"]
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    rank, rng = {t: i for i, t in enumerate(tokens)}, random.Random(7)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
            if best is None:
                return [rank[p] for p in parts]
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    found = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 15))) for _ in range(2000)})
    ids, count = merge_replay.encode_words(found, merge_replay.Ranks(str(path)))
    for word, own in zip(found, np.split(ids, np.cumsum(count)[:-1])):
        assert own.tolist() == plain(word)


def test_merge_replay(spark, docs):
    path = tokenizer(MULTI_RANKS)
    library = merge_replay.library(path)
    out = merge_replay.decode(merge_replay.encode(docs, path, decode=True), path).collect()
    assert Counter((r.doc_id, r.text, r.row) for r in out) == Counter((r.doc_id, r.text, r.row) for r in docs.collect())
    for r in out:
        expected = library.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == expected and r.n_tokens == len(expected)
        assert bytes(r.decoded).decode() == (r.text or "")
    assert merge_replay.encode(docs.limit(0), path).count() == 0


def _plain_alignment(rows, a, b):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(a)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=b)
    back, pieces = {c: i for i, c in enumerate(byte_alphabet())}, {i: t for t, i in ta.get_vocab().items()}
    out, counts = [], Counter()
    for text in rows:
        x, y = (ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)) if text else ([], [])
        bx = [bytes(back[c] for c in pieces[i]) for i in x]
        by = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := tb.id_to_piece(i)) else p.replace("▁", " ").encode() for i in y]
        if not text or b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            out.append(None)
            continue
        of = lambda tokens: [k for k, t in enumerate(tokens) for _ in t]  # noqa: E731 - token of each byte
        pairs = sorted(set(zip(of(bx), of(by))))
        groups, left = [], []
        ends = set(np.cumsum([len(t) for t in bx]).tolist()) & set(np.cumsum([len(t) for t in by]).tolist())
        at = list(zip(of(bx), of(by)))
        for byte, pair in enumerate(at, 1):
            left.append(pair)
            if byte in ends:
                groups.append(",".join(str(x[i]) for i in sorted({p[0] for p in left})) + "|" + ",".join(str(y[j]) for j in sorted({p[1] for p in left})))
                left = []
        own = [(x[i], y[j]) for i, j in pairs]
        counts.update(own)
        out.append((len(x), len(y), groups, own))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    for r in out:
        if r is None:
            yield 0, 0, 0, 0, 0, 0, "", ""
        else:
            text = ";".join(r[2])
            yield (r[0], r[1], len(r[2]), len(r[3]), sum(counts[p] == top[p[1]] for p in r[3]), sum(counts[p] for p in r[3]),
                   text, hashlib.sha256(text.encode()).hexdigest())


def test_alignment(spark, docs):
    a, b = tokenizer(BYTE_BPE), tokenizer(PIECES)
    rows = docs.collect()
    expected = Counter((r.doc_id, r.row, *e) for r, e in zip(rows, _plain_alignment([r.text or "" for r in rows], a, b)))
    names = ("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256")
    got = Counter(tuple(r[c] for c in names) for r in alignment.linked(docs, a, b).collect())
    assert got == expected
    cut = {(r.doc_id, r.row): (len(r.a_ids), len(r.b_ids), len(r.a_cuts)) for r in alignment.align(docs, a, b).collect()}
    assert cut == {e[:2]: e[2:5] for e in expected}
    assert alignment.linked(docs.limit(0), a, b).count() == 0


NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"u": "user", "a": "assistant"}


def _plain_repair(rows, damaged):
    """Whole strings and every state, row by row."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else None
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        convs[conv] += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    for conv, held in convs.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in held:
            bare = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in held]
        turns = {r[0] for r in held} - {None}

        def better(to, state, value):
            if state not in to or value[:2] < to[state][:2]:
                to[state] = value

        def inserted(now):
            now = dict(now)
            for _ in range(3):
                for state, (cost, audit, kept) in list(now.items()):
                    for i in NEXT[state].keys() - {"s"}:
                        better(now, NEXT[state][i], (cost + 5, audit + "I", (*kept, FULL[i] + ":")))
            return now

        now = {0: (0, "", ())}
        for (_, role, text), fault in zip(held, faults):
            after = {}
            for state, (cost, audit, kept) in inserted(now).items():
                better(after, state, (cost + 2, audit + "D", kept))
                if fault in ("", "truncated"):
                    cost += 5 * (fault == "truncated")
                    for i in NEXT[state]:
                        if i == role[:1]:
                            better(after, NEXT[state][i], (cost, audit + "K", (*kept, f"{role}:{text}")))
                        if i in FULL:
                            better(after, NEXT[state][i], (cost + 1, audit + "R", (*kept, f"{FULL[i]}:{text}")))
            now = after
        cost, audit, kept = min((v for k, v in inserted(now).items() if k in (0, 3)), key=lambda v: v[:2])
        yield (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
               sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


SUMMARY = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _chat(seed: int, n: int, convs, turns):
    rng = random.Random(seed)
    texts = ["hi.", "no end", None, "", " \t", "ok! ", "what?\n", "é.", "long " * 30, *(f"t{i}." for i in range(n // 3))]
    return [(rng.choice(convs), rng.choice(turns), rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool", "Sys"]), rng.choice(texts), "kept?") for _ in range(n)]


@pytest.mark.parametrize("damaged", [True, False])
@pytest.mark.parametrize("rows", [_chat(1, 300, [None, *range(40)], [None, *range(12)]), _chat(2, 1500, [1] * 20 + [2, 3, None], list(range(400)))])
def test_structure_repair(spark, rows, damaged):
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(3)
    given = structure_repair.damage(chat) if damaged else chat
    summaries, pieces = structure_repair.repair(given, piece_rows=7)
    expected = set(_plain_repair([r[:4] for r in rows], damaged))
    assert {tuple(r[c] for c in SUMMARY) for r in summaries.collect()} == expected and summaries.count() == len(expected)
    whole = defaultdict(list)
    for r in sorted(pieces.collect(), key=lambda r: r.seg):
        whole[r.conv_id] += [f"{a}:{b}" for a, b in zip(r.roles, r.texts)]
    assert {(c, hashlib.sha256("\n".join(t).encode()).hexdigest()) for c, t in whole.items()} == {(e[0], e[-1]) for e in expected}


def test_structure_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure_repair.repair(structure_repair.damage(empty))[0].count() == 0


def test_grammar_gives_the_plain_product():
    rng, grammar = random.Random(9), structure_repair.Grammar()
    sequences = [bytes(rng.choice([0, 2, 4, 2, 4, 3, 5, 8]) for _ in range(rng.randint(0, 60))) for _ in range(100)]
    flat = lambda m: [[e and (e[0], str(e[1])) for e in row] for row in m]
    for s, m in grammar.solve(sequences).items():
        plain = structure_repair.NONE
        for x in s:
            plain = structure_repair.product(plain, grammar.matrices[x])
        assert flat(m) == flat(plain)
    assert grammar.rules
