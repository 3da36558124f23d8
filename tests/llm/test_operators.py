"""The operators against plain versions on small tables with every odd row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from careflow.llm import (decontaminate, hnsw_dedup, lattice_lm, lexicon_codec, line_dedup, secrets,
                          shingle_join, suffix_dedup, token_counts, toxicity)
from careflow.llm.bpe import merger
from careflow.llm.catalog import BYTE_BPE, PIECES, WORD_BPE, tokenizer
from careflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, word string, row long"


def frame(spark, texts: dict):
    """Documents with further columns whose names operators use inside."""
    rows = [(d, t, "en" if (d or 0) % 3 else None, None, None, 7, "x", None) for d, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeiourstlnbé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line, passage = "This Line is common to Many documents, and is long enough " + say(5), say(60)
    out = {0: None, 1: "", 2: " \n\t ", 3: "one two", 4: "one two", 5: "é" * 39 + "\n" + "é" * 40}
    for i in range(6, 60):
        parts = [say(rng.randint(0, 80)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), ("  " if i % 2 else "") + (line.upper() if i % 4 else line) + "\t")
        if i % 5 == 0:
            parts.insert(0, say(3) + " " + passage + " " + say(3))
        out[i] = "\n".join(parts)
    base = say(400).split()
    for i in range(60, 80):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out[i] = " ".join(w)
    out |= {80: out[70], 81: out[70], 82: say(6000), 83: "x" * 30000, 84: "don't we'll <|endoftext|> <|startoftext|>I've 'S 12 3½ … Σίσυφος ΑΣ é a b　c \U0001f600\U0001f600 ͸ ꟒x"}
    out[85] = 'password = "abcd1234efgh" user: svc_mail https://mail.example.org/x AKIA' + "B" * 16 + " key " + "0af" * 12 + " token: short Ab1" + "xY2" * 9
    return out


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_empty_tables(spark, texts):
    docs = frame(spark, texts).filter("doc_id < 0")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (token_counts.token_counts(docs, tokenizer(WORD_BPE)), lexicon_codec.encode(docs, tokenizer(BYTE_BPE), decode=True), secrets.digest(docs),
                line_dedup.dedup_lines(docs), toxicity.score(docs, labels), decontaminate.contained_items(docs, items), lattice_lm.score(docs, tokenizer(PIECES)),
                suffix_dedup.repeated_passages(docs), shingle_join.join(docs),
                hnsw_dedup.linked(spark.createDataFrame([], "vec_id long, embedding array<float>"))):
        assert out.collect() == []


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(WORD_BPE))
    got = rows_of(token_counts.token_counts(frame(spark, texts), tokenizer(WORD_BPE)))
    for d, text in texts.items():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len((text or "").encode()), n, n > 2048), d


def test_transducer_equals_pattern():
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    rng = random.Random(1)
    for n in (1, 63, 64, 65, 400, 9000):
        text = "".join(rng.choice("a's t'rev 'lm1½ .!\n　é’") for _ in range(n))
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        assert token_counts.token_starts(token_counts.symbols(codes)).tolist() == [m.start() for m in pattern.finditer(text)]


def test_codec(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(BYTE_BPE))
    out = lexicon_codec.encode(frame(spark, texts), tokenizer(BYTE_BPE), decode=True)
    assert {"n", "word", "row"} <= set(out.columns)
    got = rows_of(out)
    again = rows_of(lexicon_codec.decode(out.drop("decoded"), tokenizer(BYTE_BPE)))
    for d, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[d]["ids"], "<u4").tolist() == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["decoded"] == again[d]["decoded"] == t.decode(ids, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact():
    m = merger(tokenizer(BYTE_BPE))
    words = sorted({f"{a}{b}".encode() for a in ("talk", "walk", "jump", "") for b in ("", "s", "ed", "ing")})
    block = lexicon_codec.compile_lexicon([(w, m.merge(w)) for w in words])
    lexicon = lexicon_codec.Lexicon(block)
    for w in words:
        assert lexicon.get(w) == np.array(m.merge(w), "<u4").tobytes()
    assert lexicon.get(b"walke") is None and lexicon.get(b"zebra") is None
    assert len(lexicon.final) < 25  # the endings are shared


def test_merges_of_short_and_long_words_agree():
    m, rng = merger(tokenizer(BYTE_BPE)), random.Random(2)
    for _ in range(300):
        w = bytes(rng.choice(b"aabeethinors\xc3\xa9 ") for _ in range(rng.randint(1, 60)))
        ids = [m.first[b] for b in w[:-1]] + [m.last[w[-1]]]
        assert m._short(list(ids)) == m._long(list(ids))


def test_secrets(spark, texts):
    got = rows_of(secrets.digest(frame(spark, texts)))
    name = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for d, text in texts.items():
        text = text or ""
        own = [(m.start(), 0, m.end()) for m in name.finditer(text) if len(m[1]) >= 8]
        own += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        own += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(own))
        assert got[d]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[d]["spans"].split(","))
    spans = got[85]["spans"]
    assert "endpoint:" in spans and "ident:" in spans and "opaque:" in spans
    alone = frame(spark, {1: "see https://example.org/a and user: somebody", 2: "user: somebody" + " " * 300 + "password=abcdefgh1"})
    assert [("endpoint" in r["spans"], "ident" in r["spans"]) for r in rows_of(secrets.digest(alone)).values()] == [(False, False)] * 2


def plain_links(text):
    """All spans that count, by the rule over all pairs."""
    ascii_ = {k: re.compile(p, re.A) for k, (p, _) in (secrets.BASE | secrets.WEAK).items()}
    spans = [(m.start(), secrets.KINDS.index(k), m.end(), k) for k, p in ascii_.items() for m in p.finditer(text)
             if len(m[1]) >= (secrets.BASE | secrets.WEAK)[k][1] and (k != "opaque" or all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]")))]
    out = []
    for s, rank, e, k in sorted(spans):
        clash = any(b in secrets.BASE and bs < e and be > s for bs, _, be, b in spans)
        links = any(secrets.ROLE[o] in secrets.WITH[secrets.ROLE[k]] and (0 <= s - oe <= secrets.REACH or 0 <= os - e <= secrets.REACH) for os, _, oe, o in spans)
        if k in secrets.BASE or (links and not clash):
            out.append(f"{k}:{s}:{e}")
    return ",".join(out)


def test_secrets_beside_overlapping_parts(spark):
    key, rng = "Ab1Cd2Ef3Gh4Ij5Kl6Mn7", random.Random(11)
    texts = {1: f"client_id={key} client_secret=hunter2hunter2", 2: f"see https://example.org/{key}/x password=abcdefgh1",
             3: f"password=abcdefgh1 account={key}", 4: f"client_id={key}"}
    parts = ["user: somebody", f"client_id={key}", f"https://example.org/{key}/x", "https://example.org/a", "password=abcdefgh1", key, f"token={key}",
             "AKIA" + "B" * 16, "0af" * 12, "é" * 90, "x " * 60, "https://h/?user=somebody", f"https://h/?password={key}", "user=a_b secret=12345678"]
    texts |= {i: rng.choice([" ", ",", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for i in range(10, 300)}
    got = {d: r["spans"] for d, r in rows_of(secrets.digest(frame(spark, texts))).items()}
    assert "ident:" in got[1] and "endpoint:" in got[2] and "ident:" in got[3] and got[4] == ""
    assert got == {d: plain_links(t) for d, t in texts.items()}


def plain_lines(texts, chars=40, least=5):
    white = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(white).translate(low)
    held = defaultdict(set)
    for d, t in texts.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    lose = lambda d, x: len(key(x)) >= chars and len(held[key(x)]) >= least and d != max(held[key(x)])
    return {d: [x for x in (t or "").split("\n") if not lose(d, x)] for d, t in texts.items()}


@pytest.mark.parametrize("hot", [1, line_dedup.HOT])  # 1: every line is looked up in a routed shard
def test_line_dedup(spark, texts, hot):
    kept = plain_lines(texts, least=3)
    got = rows_of(line_dedup.dedup_lines(frame(spark, texts), least=3, hot=hot))
    assert sum(len((t or "").split("\n")) - len(kept[d]) for d, t in texts.items()) > 10
    for d, t in texts.items():
        n = len((t or "").split("\n"))
        assert (got[d]["text"], got[d]["n_lines"], got[d]["n_dropped"]) == ("\n".join(kept[d]), n, n - len(kept[d]))


def test_perfect_hash():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 62, (5000, 2)).astype(np.uint64)
    words[1, 0] = words[0, 0]  # halves that collide
    index = line_dedup.Index(line_dedup.build(words, np.arange(5000), np.arange(5000) * 3))
    at = index.find(words)
    assert sorted(at) == list(range(5000)) and (index.last[at] == np.arange(5000) * 3).all() and (index.counts[at] == np.arange(5000)).all()
    assert (index.find(rng.integers(0, 1 << 62, (5000, 2)).astype(np.uint64)) == -1).all()


def test_suffix_dedup(spark, texts):
    first = {}
    raw = {d: (t or "").encode() for d, t in texts.items()}
    for d, t in sorted(raw.items()):
        for i in range(len(t) - 49):
            first.setdefault(t[i:i + 50], d)
    got = rows_of(suffix_dedup.repeated_passages(frame(spark, texts)))
    for d, t in raw.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if first[t[i:i + 50]] < d:
                gone[i:i + 50] = True
        mine = np.zeros(len(t), bool)
        for s in got[d]["spans"]:
            mine[s["start"]:s["end"]] = True
        assert (mine == gone).all() and got[d]["kept"] == bytes(np.frombuffer(t, np.uint8)[~gone]), d
    assert got[80]["n_bytes"] and not got[80]["kept"]


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abc\n", bytes(range(256))])
def test_suffix_order(alphabet):
    rng = random.Random(len(alphabet))
    strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(50, 160))) for _ in range(20)]
    strings += [s[rng.randint(0, 20):][:rng.randint(50, 90)].ljust(50, b"a") for s in strings]
    size = np.array([len(s) - 49 for s in strings])
    text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in strings]).astype(np.uint16)
    order, common = suffix_dedup.equal_windows(text, size)
    raw = [text[i:i + 50].tobytes() for i in order]
    keys = [tuple(text[i:i + 50].tolist()) for i in order]
    assert len(order) == size.sum() and keys == sorted(keys)
    assert [c >= 50 for c in common[1:]] == [a == b for a, b in zip(raw, raw[1:])]


def test_alignment_by_arrays():
    from careflow.llm import alignment

    rng = random.Random(13)
    for n in (1, 2, 7, 300):
        cut = lambda: np.array(sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, n)))}))
        ends_a, ends_b = cut(), cut()
        cuts_a, cuts_b, i, j = alignment.slices_and_links(ends_a, ends_b)
        common = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        assert ends_a[cuts_a - 1].tolist() == common and ends_b[cuts_b - 1].tolist() == common
        pairs = sorted({(int((ends_a <= byte).sum()), int((ends_b <= byte).sum())) for byte in range(n)})
        assert list(zip(i.tolist(), j.tolist())) == pairs
        a = np.array([rng.choice([0, 5, 49_999, 131_071]) for _ in ends_a])
        b = np.array([rng.choice([0, 10, 31_999]) for _ in ends_b])
        groups = [",".join(map(str, a[p:q])) + "|" + ",".join(map(str, b[r:t]))
                  for p, q, r, t in zip([0, *cuts_a], cuts_a, [0, *cuts_b], cuts_b)]
        assert alignment.group_text(a, b, cuts_a, cuts_b) == ";".join(groups).encode()
    assert [x.tolist() for x in alignment.slices_and_links(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[]] * 4


def test_shingles_are_sorted_once(monkeypatch):
    known = shingle_join.WordHashes()
    texts = [b"", b"A b", b"a b c d e", b"a b c d e f g " * 9, b"x " * 40, "\u00e9 \u00df c d e f".encode(), None]
    expected = shingle_sets(dict(enumerate(t and t.decode() for t in texts)))
    monkeypatch.setattr(np, "unique", None)
    monkeypatch.setattr(np, "fromiter", None)  # a list's items are taken over at once
    found = [shingle_join.shingle_set(t, known) for t in texts]
    assert [len(s) for s in found] == [len(expected[i]) for i in range(len(texts))]
    assert all((s[1:] > s[:-1]).all() and s.dtype == np.uint64 for s in found)
    assert shingle_join.shingle_set(b"a B c D e", known).tolist() == found[2].tolist()


def test_copies_are_not_sorted_again(monkeypatch):
    rng = random.Random(5)
    part = bytes(rng.randrange(3) for _ in range(90))
    strings = [part, part, part[20:] + part[:50], bytes([1]) * 120, part] + [bytes(rng.randrange(2) for _ in range(70)) for _ in range(30)]
    text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, 0) for s in strings]).astype(np.uint16)
    words, at = suffix_dedup._words(text), np.flatnonzero(text)
    tail = np.append(text, np.zeros(64, text.dtype)).tolist()
    sorts = []
    plain = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorts.append(len(x)) or plain(x, *a, **k))
    monkeypatch.setattr(np, "lexsort", None)  # not needed for what is in order
    order = suffix_dedup.direct(words, at.copy())
    keys = [tail[i:i + 56] for i in order]
    assert sorted(order.tolist()) == at.tolist() and keys == sorted(keys)
    of_copies = np.tile(np.arange(90) * 0 + 1, 3).astype(np.uint16)
    sorts.clear()
    suffix_dedup.direct(suffix_dedup._words(of_copies), np.arange(30))
    assert sorts == [30]


def shingle_sets(texts):
    out = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        out[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_components(sets):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_shingle_join(spark, texts):
    rng = random.Random(9)
    more, at = dict(texts), 100
    for size in (5, 6, 7, 9, 12, 17, 20, 31, 32, 40, 64, 90):  # short sets around the limit
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 2, 3):
            w = base + [f"v{at}{k}" for k in range(edits)] if at % 2 else base[edits:]
            more[at] = " ".join(w)
            at += 1
    sets = shingle_sets(more)
    expected = plain_components(sets)
    got = rows_of(shingle_join.join(frame(spark, more)))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {d: (len(sets[d]), expected[d]) for d in sets}
    assert len(set(expected.values())) < len(expected) - 20


def test_signatures_meet():
    """Similar sets share t signatures, whatever their sizes."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 40), 50, 63, 64, 65, 95, 96, 97, 120, 127, 128, 200, 300]:
        for _ in range(20):
            s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            cut, add = rng.integers(0, n // 4 + 1), 0
            while 100 * (n - cut) >= 75 * (n + add + 1) and rng.random() < 0.9:
                add += 1
            other = np.unique(np.concatenate([s[rng.permutation(n)[cut:]], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            assert 100 * len(np.intersect1d(s, other)) >= 75 * len(np.union1d(s, other))
            least = min(shingle_join.spare(len(s)), shingle_join.spare(len(other)))
            assert len(np.intersect1d(shingle_join.signatures(s), shingle_join.signatures(other))) >= least


def test_contained_items(spark, texts):
    items = {1: " ".join(texts[82].split()[100:130]), 2: " ".join(texts[82].split()[200:230] + ["zz"] * 12), 3: "", 4: None, 5: "one two", 6: texts[60][:300]}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs, tests = shingle_sets(texts), shingle_sets(items)
    expected = {(d, i): len(docs[d] & tests[i]) for d in docs for i in tests if tests[i] and 100 * len(docs[d] & tests[i]) >= 75 * len(tests[i])}
    found = decontaminate.contained_items(frame(spark, texts), bench)
    assert {(r.doc_id, r.item_id): r.n_shared for r in found.collect()} == expected and len(expected) > 4
    left = {r.doc_id for r in decontaminate.decontaminate(frame(spark, texts), bench).collect()}
    assert left == set(texts) - {d for d, _ in expected}


def test_toxicity(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeiourstln") for _ in range(4)) for _ in range(400)]
    texts, toxic = {}, {}
    for d in range(900):
        bad = d % 9 == 0
        texts[d] = " ".join([rng.choice(words) for _ in range(60)] + (rng.sample(["grolk", "vlimp", "zzorn", "quexa"], 2) if bad else []))
        if d % 2 == 0 or bad:
            toxic[d] = int(bad)
    texts |= {900: None, 901: ""}
    labels = spark.createDataFrame([(d, None, t) for d, t in toxic.items()] + [(5, 1, None), (None, 1, 1), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    got = rows_of(toxicity.score(frame(spark, texts), labels))
    assert len(got) == 902 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [d for d in range(900) if got[d]["held_out"]]
    assert sum(got[d]["predicted"] != (d % 9 == 0) for d in held) <= len(held) * 0.03
    assert got[900]["score"] == got[901]["score"] < 0.5
    none = rows_of(toxicity.score(frame(spark, texts), labels.filter("toxic = 0")))
    assert {r["score"] for r in none.values()} == {0.0}


def test_lattice_lm(spark, texts):
    got = rows_of(lattice_lm.score(frame(spark, texts), tokenizer(PIECES), head=64))
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    words = {d: (t or "").encode().lower().split() + [None] for d, t in texts.items()}
    count = Counter(w for d in train for w in words[d])
    n, v = sum(count.values()), len(count)
    for d, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (d not in train, len(words[d]), n)
        assert r["n_known"] == sum(count[w] > 0 for w in words[d])
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[d]), abs=1e-6)
        assert r["score"] <= 0
    same = rows_of(lattice_lm.score(frame(spark, texts), tokenizer(PIECES), head=1 << 19))
    assert all(same[d]["score"] == pytest.approx(r["score"], rel=1e-9) for d, r in got.items())


def test_forward_sums_all_segmentations():
    pieces, p = lattice_lm.vocabulary(tokenizer(PIECES))
    chance = dict(zip(pieces, p))
    stop = 0.3

    def paths(word):
        if not word:
            yield 1.0
        for k in range(1, len(word) + 1):
            if word[:k] in chance:
                for rest in paths(word[k:]):
                    yield chance[word[:k]] * (1 - stop) * rest

    lattice = lattice_lm.Lattice(tokenizer(PIECES), p, stop)
    own = [b"the", b"ing", "né".encode(), b"a", b"zqx1", b"there"]
    for w, got in zip(own, lattice.log10(own)):
        assert got == pytest.approx(math.log10(sum(paths(b" " + w)) * stop / (1 - stop)), rel=1e-9)
    # expected uses: every byte of a word is covered once
    use = lattice.expect(own)
    assert sum(u * len(x) for u, x in zip(use, pieces)) == pytest.approx(sum(len(w) + 1 for w in own))


def test_lattice_holds_every_piece():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(PIECES))
    given = {model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    given = {x for x in given if b" " not in x[1:]}  # words are split at blanks
    pieces, p = lattice_lm.vocabulary(tokenizer(PIECES))
    assert given <= set(pieces) and max(map(len, pieces)) > 16
    lattice, chance = lattice_lm.Lattice(tokenizer(PIECES), p, 0.3), dict(zip(pieces, np.log(p).tolist()))
    own = [x.strip() + b"s" for x in sorted(given, key=len)[-20:]]
    for w, got in zip(own, lattice.log10(own)):
        assert got == pytest.approx(plain_word(w, chance, 0.3), rel=1e-9)
    use = lattice.expect(own)
    assert sum(u * len(x) for u, x in zip(use, pieces)) == pytest.approx(sum(len(w) + 1 for w in own))


def plain_word(word, chance, stop):
    """log10 of the sum over all segmentations of a word, by a plain recursion."""
    word, longest = b" " + word, max(map(len, chance))
    alpha = [0.0]
    for j in range(1, len(word) + 1):
        ways = [alpha[j - k] + chance[word[j - k:j]] + math.log(1 - stop) for k in range(1, min(j, longest) + 1) if word[j - k:j] in chance]
        alpha.append(max(ways) + math.log(sum(math.exp(w - max(ways)) for w in ways)))
    return (alpha[-1] + math.log(stop) - math.log(1 - stop)) / math.log(10)


def test_lattice_lm_long_words(spark):
    rng = random.Random(3)
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 == 2][:4]
    train = [d for d in range(200) if zlib.crc32(str(d).encode()) % 7 != 2][:40]
    long = ["".join(rng.choice("aeiourstlnbé/7") for _ in range(n)) for n in (5000, 200, 400)] + ["中文语言模型评分" * 30]
    texts = {d: " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(1, 8))) for _ in range(20)) for d in train}
    got = rows_of(lattice_lm.score(frame(spark, texts | dict(zip(held, long))), tokenizer(PIECES), class_column=None))
    count = Counter(w for t in texts.values() for w in t.encode().split())
    p, stop = lattice_lm.fit_pieces(spark.createDataFrame([(bytearray(w),) for w in count], "word binary"), tokenizer(PIECES))
    chance = dict(zip(lattice_lm.vocabulary(tokenizer(PIECES))[0], np.log(p).tolist()))
    n, v, d = sum(count.values()) + len(train), len(count) + 1, lattice_lm.DISCOUNT
    end = (len(train) - d) / n + d * v / n * lattice_lm.END_FLOOR
    # one class holds all training text, the other none; the word is new to both
    prior = [(len(train) + 1) / (len(train) + 2), 1 / (len(train) + 2)]
    rest = prior[0] * d * v / n * ((len(train) - d) / n + d * v / n * end) + prior[1] * end
    for doc, word in zip(held, long):
        expected = plain_word(word.encode(), chance, stop) + math.log10((1 - lattice_lm.END_FLOOR) * d * v / n * rest)
        assert expected < -300 and got[doc]["score"] == pytest.approx(expected, rel=1e-9)


def test_hnsw(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:160] = x[100] + rng.normal(size=(60, 16)).astype(np.float32) * 0.12
    x[200:240] = x[200]
    x[240:250] = x[200] * 3
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [1.0] * 15 + [None]), (1004, [1.0] * 15 + [float("nan")]), (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, [1.0] * 16)]
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = rows_of(hnsw_dedup.linked(df, shards=3, blocks=2), "vec_id")
    assert len(got) == 709
    found = sum(got[i]["n_links"] for i in range(700))
    assert found == near.sum() and all(got[i]["n_links"] == near[i].sum() for i in range(700))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(1000, 1006))
    assert got[1007]["component_id"] == 1006 and got[None]["component_id"] is None
    assert len({got[i]["component_id"] for i in range(200, 250)}) == 1


def test_hnsw_shards_follow_the_count(spark, monkeypatch):
    for name, value in (("SHARD", 60), ("QUERIES", 90), ("FLOATS", 1 << 10)):
        monkeypatch.setattr(hnsw_dedup, name, value, raising=False)
    grouped, dealt = hnsw_dedup.spread, []
    monkeypatch.setattr(hnsw_dedup, "spread", lambda *a: dealt.append(grouped(*a)) or dealt[-1])
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:340] = x[300] + rng.normal(size=(40, 8)).astype(np.float32) * 0.1
    u = hnsw_dedup._unit(x)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    wide = rng.normal(size=(30, 256)).astype(np.float32)  # 4 of them fill a shard
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*x, *wide])], "vec_id long, embedding array<float>")
    got = rows_of(hnsw_dedup.linked(df), "vec_id")
    assert all(got[i]["n_links"] == near[i].sum() for i in range(900)) and all(got[i]["n_links"] == 0 for i in range(900, 930))
    shards = {(r["dim"], r["shard"]): r["count"] for r in dealt[0].groupBy("dim", "shard").count().collect()}
    blocks = {(r["dim"], r["block"]): r["count"] for r in dealt[0].groupBy("dim", "block").count().collect()}
    assert sum(shards.values()) == sum(blocks.values()) == 930
    assert max(n for (d, _), n in shards.items() if d == 8) <= 2 * 60 and max(n for (d, _), n in blocks.items() if d == 8) <= 2 * 90
    few = dealt[0].select("dim", "shards", "blocks").distinct().collect()
    assert {r["dim"]: (r["shards"], r["blocks"]) for r in few} == {8: (15, 10), 256: (8, 8)}


def test_graph_of_many_levels():
    """A shard with several full upper levels and tight clusters: no link is missed."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, 24))
    x = centres[rng.integers(0, 300, 3000)] + rng.normal(size=(3000, 24)) * 0.18
    u = hnsw_dedup._unit(x)
    level = np.sort(np.floor(-np.log(rng.random(3000)) / np.log(16)).astype(np.int64))[::-1]
    g = hnsw_dedup.Graph.build(u.astype(np.float32), level)
    assert len(g.layers) >= 3 and len(g.layers[1]) > 100
    rows, nodes = g.within(u.astype(np.float32), 0.95)
    near = u.astype(np.float32) @ u.astype(np.float32).T >= 0.95
    found = np.zeros_like(near)
    found[rows, nodes] = True
    assert found.sum() >= 0.999 * near.sum() and not (found & ~(u @ u.T >= 0.9499)).any()


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_repeated_rows(spark, texts):
    """A row that occurs twice keeps both rows, and does not become a partner of itself."""
    some = {d: t for d, t in texts.items() if d in (0, 1, 3, 6, 9, 12, 60, 82)} | {None: "a row without a key " * 9}
    once, twice = frame(spark, some), frame(spark, some).unionAll(frame(spark, some))
    for make in (lambda d: token_counts.token_counts(d, tokenizer(WORD_BPE)), secrets.digest, lambda d: lexicon_codec.encode(d, tokenizer(BYTE_BPE)),
                 lambda d: suffix_dedup.repeated_passages(d), shingle_join.join):
        a, b = [tuple(r) for r in make(once).collect()], [tuple(r) for r in make(twice).collect()]
        assert sorted(map(repr, a * 2)) == sorted(map(repr, b))
    # for the line count each row is a document: the common line now recurs often enough
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(twice, least=4).collect())[-1] == 1
    assert lattice_lm.score(twice, tokenizer(PIECES)).count() == 2 * len(some)
    labels = spark.createDataFrame([(3, 0, 1), (3, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(twice, labels).count() == 2 * len(some)


def test_native_operators_run_no_python(spark, texts):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (secrets.digest(frame(spark, texts)), decontaminate.contained_items(frame(spark, texts), bench)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
