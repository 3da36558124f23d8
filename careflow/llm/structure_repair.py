"""Operator 11, repair of conversation structure by grammar-compressed dynamic programming.

A conversation's rows, by turn, become symbols: the role's initial (s, u, a or another)
with the row's fault. Re-Pair replaces the commonest pair of neighbouring symbols by a
rule, over all sequences of a batch at once, until no pair is left twice. Each symbol and
each rule has one min-plus transfer matrix over the states of the wanted form (start,
after s, after u, after a): the least cost of leading one state to another, with the
audit, a rope of edit letters, that is least in ASCII among the cheapest. A rule's matrix
is the product of its two sides' matrices, made once, bottom up, and shared by all
conversations that hold the rule. Audits of equal cost for the same rows are never
prefixes of one another (a longer one holds more inserts and costs more), so the least
audit of a product is made of least audits.

Rows are dealt by ranges of (conversation, turn) and read in order, in pieces of bounded
size. A conversation that lies within one task is solved there. One that may go on in
another task (the first and last of a range, and any longer than a piece) travels as
pieces: repeats are found across pieces by (conversation, row hash), piece matrices are
folded in order, a row a piece, and the texts stay with their pieces but for the last
hash over them.

Rules: nulls of role and text are one space. A conversation without an id is one of its
own; turns that are null come first and leave gaps unchanged. Rows of one turn are taken
by role, then text. Rows whose ``kept`` is false only name their conversation; without
such a column all rows are kept. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.llm.common import shuffle_partitions, written

BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FORM = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5  # costs; keeping costs nothing
NAMES = {"u": "user", "a": "assistant"}
PIECE_ROWS, PIECE_CHARS = 4096, 1 << 22
GONE = 8  # the symbol of a row that must be deleted; the others are 2 * role + (1 if cut short)


class Rope:
    """A string made of two parts, written out when it is asked for."""

    __slots__ = ("parts", "flat")

    def __init__(self, left: Rope | None, right: Rope | None = None, flat: str | None = None):
        self.parts, self.flat = (left, right), flat

    def __str__(self) -> str:
        if self.flat is None:
            out, open_ = [], [self]
            while open_:
                r = open_.pop()
                if r.flat is None:
                    open_ += reversed(r.parts)
                else:
                    out.append(r.flat)
            self.flat, self.parts = "".join(out), (None, None)
        return self.flat


def leaf(text: str) -> Rope:
    return Rope(None, None, text)


Matrix = list  # of rows of (cost, rope) or None


def product(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product; of equal costs the least audit."""
    out = []
    for p in STATES:
        row = []
        for q in STATES:
            best = None
            for k in STATES:
                a, b = x[p][k], y[k][q]
                if a is None or b is None:
                    continue
                cost = a[0] + b[0]
                if best is None or cost < best[0]:
                    best = cost, Rope(a[1], b[1])
                elif cost == best[0] and str(rope := Rope(a[1], b[1])) < str(best[1]):
                    best = cost, rope
            row.append(best)
        out.append(row)
    return out


def _inserts() -> Matrix:
    """Any number of inserts."""
    out = [[(0, leaf("")) if p == q else None for q in STATES] for p in STATES]
    for p in STATES:
        state, n = p, 0
        while (state := FORM.get((state, "u")) or FORM[state, "a"]) and out[p][state] is None:
            n += 1
            out[p][state] = n * INSERT, leaf("I" * n)
    return out


def _edits(symbol: int) -> Matrix:
    out = [[(DELETE, leaf("D")) if p == q else None for q in STATES] for p in STATES]
    if symbol != GONE:
        own, late = "sua-"[symbol // 2], CUT_SHORT * (symbol % 2)
        for (p, initial), q in FORM.items():
            if initial == own:
                out[p][q] = late, leaf("K")
            elif initial in NAMES:
                out[p][q] = REROLE + late, leaf("R")
    return out


INSERTS = _inserts()
NONE = [[(0, leaf("")) if p == q else None for q in STATES] for p in STATES]


class Grammar:
    """Re-Pair rules over symbol sequences and the matrix of each, for one task."""

    def __init__(self):
        self.rules: dict[tuple[int, int], int] = {}
        self.matrices: list[Matrix] = [product(INSERTS, _edits(s)) for s in range(GONE + 1)]

    def rule(self, pair: tuple[int, int]) -> int:
        if (x := self.rules.get(pair)) is None:
            x = self.rules[pair] = len(self.matrices)
            self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))
        return x

    def solve(self, sequences: list[bytes]) -> dict[bytes, Matrix]:
        """The matrix of each sequence (without inserts after its last row)."""
        every = list(dict.fromkeys(sequences))
        out = {}
        for s, left in zip(every, self.compress(every)):
            m = NONE
            for x in left:
                m = product(m, self.matrices[x])
            out[s] = m
        return out

    def compress(self, sequences: list[bytes]) -> list[list[int]]:
        """The sequences after all replacements."""
        flat: list[int] = []
        for s in sequences:
            flat += [*s, -1]
        after, before = list(range(1, len(flat) + 1)), list(range(-1, len(flat) - 1))
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i in range(len(flat) - 1):
            if flat[i] >= 0 <= flat[i + 1]:
                where[flat[i], flat[i + 1]].add(i)
        heap = [(-len(at), pair) for pair, at in where.items() if len(at) > 1]
        heapq.heapify(heap)

        def drop(i: int, j: int) -> None:
            if i >= 0 and flat[i] >= 0 <= flat[j]:
                where[flat[i], flat[j]].discard(i)

        while heap:
            n, pair = heapq.heappop(heap)
            at = where.get(pair, ())
            if len(at) < 2:
                continue
            if len(at) < -n:  # counted before others were replaced
                heapq.heappush(heap, (-len(at), pair))
                continue
            new, touched = self.rule(pair), set()
            for i in sorted(at):
                j = after[i]
                if j >= len(flat) or (flat[i], flat[j]) != pair:
                    continue
                h, k = before[i], after[j]
                drop(h, i)
                if k < len(flat):
                    drop(j, k)
                    before[k] = i
                flat[i], flat[j], after[i] = new, -2, k
                for p, q in ((h, i), (i, k)):
                    if p >= 0 and q < len(flat) and flat[p] >= 0 <= flat[q]:
                        where[flat[p], flat[q]].add(p)
                        touched.add((flat[p], flat[q]))
            where.pop(pair, None)
            for t in touched:
                if len(where.get(t, ())) > 1:
                    heapq.heappush(heap, (-len(where[t]), t))
        out: list[list[int]] = [[]]
        for x in flat:
            if x == -1:
                out.append([])
            elif x >= 0:
                out[-1].append(x)
        return out[:-1]


class Steps:
    """One step of a folded conversation: the state it begins in, and its audit."""

    __slots__ = ("before", "state", "audit")

    def __init__(self, before: Steps | None, state: int, audit: Rope):
        self.before, self.state, self.audit = before, state, audit


def _least(options: list[tuple[int, Steps]]) -> tuple[int, Steps] | None:
    """The cheapest; of equal ones the least audit, read back to where they meet."""
    best = None
    for cost, steps in options:
        if best is None or cost < best[0]:
            best = cost, steps
        elif cost == best[0]:
            x, y, mine, other = steps, best[1], [], []
            while x is not y:
                mine.append(str(x.audit))
                other.append(str(y.audit))
                x, y = x.before, y.before
            if "".join(reversed(mine)) < "".join(reversed(other)):
                best = cost, steps
    return best


class Fold:
    """A conversation's matrices, applied in order from the start."""

    def __init__(self):
        self.now: list[tuple[int, Steps | None] | None] = [(0, None), None, None, None]

    def add(self, m: Matrix) -> None:
        self.now = [_least([(v[0] + m[p][q][0], Steps(v[1], p, m[p][q][1])) for p in STATES
                            if (v := self.now[p]) is not None and m[p][q] is not None]) for q in STATES]

    def close(self) -> tuple[int, list[tuple[int, str]]]:
        """The cost, and the first state and audit of each step; inserts at the end are the last's."""
        self.add(INSERTS)
        cost, steps = _least([v for v in (self.now[START], self.now[ASSISTANT]) if v is not None])
        out = []
        while steps is not None:
            out.append((steps.state, str(steps.audit)))
            steps = steps.before
        out.reverse()
        (_, tail), out = out[-1], out[:-1]
        if out:
            out[-1] = out[-1][0], out[-1][1] + tail
        return cost, out


def applied(state: int, audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The repaired roles and texts."""
    out, rows = ([], []), iter(zip(roles, texts))
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        initial = role[0] if edit == "K" else "a" if state == USER else "u"
        out[0].append(role if edit == "K" else NAMES[initial])
        out[1].append(text)
        state = FORM[state, initial]
    return out


class Piece:
    """Rows of one conversation in order."""

    def __init__(self, conv):
        self.conv, self.roles, self.texts, self.symbols, self.seen = conv, [], [], bytearray(), set()
        self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None

    def add(self, turn, role: str, text: str) -> None:
        initial = role[:1]
        if self.roles and self.roles[-1][:1] + initial not in LEGAL:
            self.illegal += 1
        bare = text.rstrip(BLANKS)
        symbol = GONE
        if not bare:
            self.blank += 1
        elif (role, text) in self.seen:
            self.duplicate += 1
        else:
            short = bare[-1] not in ".!?"
            self.truncated += short
            symbol = 2 * ("sua".find(initial) % 4 if initial else 3) + short
        self.seen.add((role, text))
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        self.roles.append(role)
        self.texts.append(text)
        self.symbols.append(symbol)
        self.chars += len(text)


SUMS = "blank long, duplicate long, truncated long, illegal long"
PIECES = ("seg long, closed boolean, symbols binary, first long, last long, turns long, first_initial string, last_initial string, "
          + SUMS + ", cost long, audit string, roles array<string>, texts array<string>, keys array<binary>")
FIELDS = [c.split()[0] for c in PIECES.split(", ")]


def _key(role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(len(r).to_bytes(4, "little") + r + text.encode(), digest_size=16).digest()


def _pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Rows (conv_id, turn, role, text, kept) in pieces. Closed ones are whole conversations,
    solved, with their repaired roles and texts; the others wait."""
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(PIECES).fields])
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order[:3], F.substring("text", 1, 32)).sortWithinPartitions(*order)

    def run(batches):
        part, serial, grammar = TaskContext.get().partitionId() << 32, 0, Grammar()
        now, first, whole = None, True, True  # the open piece; whether its conversation is the range's first; has no earlier piece
        done, ready = [], []

        def row(p: Piece, closed: bool) -> dict:
            nonlocal serial
            serial += 1
            return {"conv_id": p.conv, "seg": part + serial, "closed": closed, "symbols": bytes(p.symbols), "first": p.first, "last": p.last, "turns": p.turns,
                    "first_initial": p.roles[0][:1] if p.roles else None, "last_initial": p.roles[-1][:1] if p.roles else None,
                    "blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal}

        def waiting(p: Piece) -> dict:
            keys = [None if s == GONE else _key(r, t) for s, r, t in zip(p.symbols, p.roles, p.texts)]
            return row(p, False) | {"roles": p.roles, "texts": p.texts, "keys": keys}

        def solved(pieces: list[Piece]):
            matrices = grammar.solve([bytes(p.symbols) for p in pieces])
            known = {}
            for s, m in matrices.items():
                fold = Fold()
                fold.add(m)
                known[s] = fold.close()
            for p in pieces:
                cost, ((state, audit),) = known[bytes(p.symbols)]
                roles, texts = applied(state, audit, p.roles, p.texts)
                yield row(p, True) | {"cost": cost, "audit": audit, "roles": roles, "texts": texts}

        for b in batches:
            for conv, turn, role, text, kept in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "kept"))):
                if now is None or conv != now.conv:
                    if now is not None:
                        if first or not whole:
                            done.append(waiting(now))
                        else:
                            ready.append(now)
                        first = False
                    now, whole = Piece(conv), True
                elif len(now.roles) >= piece_rows or now.chars >= PIECE_CHARS:
                    done.append(waiting(now))
                    now, whole = Piece(conv), False
                    yield from _batches(done, schema)
                    done = []
                if kept:
                    now.add(turn, role, text)
            yield from _batches([*done, *solved(ready)], schema)
            done, ready = [], []
        if now is not None:
            yield from _batches([waiting(now)], schema)

    return dealt.mapInArrow(run, schema)


def _batches(rows: list[dict], schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    if rows:
        yield from pa.Table.from_pylist(rows, to_arrow_schema(schema)).combine_chunks().to_batches()


def _folded(open_: DataFrame) -> DataFrame:
    """Of waiting pieces: a row for each conversation (seg null) with its figures, and one for
    each piece with the state it begins in and its audit."""
    key = Window.partitionBy("conv_id", "key").orderBy("seg")
    again = (open_.select("conv_id", "seg", F.posexplode("keys").alias("at", "key")).filter(F.col("key").isNotNull())
             .withColumn("rank", F.row_number().over(key)).filter("rank > 1").groupBy("seg").agg(F.collect_list("at").alias("again")))
    narrow = open_.drop("roles", "texts", "keys", "closed", "cost", "audit").join(again, "seg", "left")
    dealt = narrow.repartition(shuffle_partitions(open_.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "seg")
    schema = T.StructType([open_.schema["conv_id"], *T.StructType.fromDDL(f"seg long, state int, audit string, cost long, gaps long, {SUMS}").fields])

    def run(batches):
        grammar, fold, now, conv = Grammar(), None, None, None

        def close():
            cost, steps = fold.close()
            gaps = now["last"] - now["first"] + 1 - now["turns"] if now["first"] is not None else 0
            out = [{"conv_id": conv, "cost": cost, "gaps": gaps} | {c: now[c] for c in ("blank", "duplicate", "truncated", "illegal")}]
            return out + [{"conv_id": conv, "seg": s, "state": state, "audit": audit} for s, (state, audit) in zip(now["segs"], steps)]

        for b in batches:
            rows, out = b.to_pylist(), []
            for r in rows:
                symbols, again_ = bytearray(r["symbols"]), r["again"] or []
                r["duplicate"] += len(again_)
                r["truncated"] -= sum(symbols[i] % 2 for i in again_)
                for i in again_:
                    symbols[i] = GONE
                r["symbols"] = bytes(symbols)
            matrices = grammar.solve([r["symbols"] for r in rows])
            for r in rows:
                if fold is None or r["conv_id"] != conv:
                    if fold is not None:
                        out += close()
                    fold, conv = Fold(), r["conv_id"]
                    now = {"segs": [], "first": None, "last": None, "turns": 0, "initial": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                fold.add(matrices[r["symbols"]])
                now["segs"].append(r["seg"])
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += r[c]
                if r["symbols"]:
                    if now["initial"] is not None and now["initial"] + r["first_initial"] not in LEGAL:
                        now["illegal"] += 1
                    now["initial"] = r["last_initial"]
                if r["first"] is not None:
                    now["turns"] += r["turns"] - (r["first"] == now["last"])
                    now["first"] = r["first"] if now["first"] is None else now["first"]
                    now["last"] = r["last"]
            yield from _batches(out, schema)
        if fold is not None:
            yield from _batches(close(), schema)

    return dealt.mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 is gone
    (kept false), 1 loses its text, 2 its end marks, 3 comes twice, 4 is the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("kept"), F.explode(times).alias("_")).drop("_")


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text, and kept or not): a row for each conversation with
    gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; and the
    repaired pieces (conv_id, seg, audit, roles, texts), a conversation's in order of seg.
    A piece holds ``piece_rows`` rows or 2**22 characters at most, or one longer row."""
    kept = F.coalesce(F.col("kept"), F.lit(False)) if "kept" in rows.columns else F.lit(True)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), kept.alias("kept"))
    every = written(_pieces(rows, piece_rows), "pieces")
    closed, open_ = every.filter("closed"), every.filter("not closed")
    folded = written(_folded(open_), "folded")
    waiting = open_.select("conv_id", "seg", "roles", "texts").join(folded.filter("seg is not null").select("seg", "state", "audit"), "seg")
    columns = ["conv_id", "seg", "audit", "roles", "texts"]

    def apply(batches):
        for b in batches:
            out = [applied(*x) for x in zip(*(b[c].to_pylist() for c in ("state", "audit", "roles", "texts")))]
            lists = [pa.array([o[k] for o in out], pa.list_(pa.string())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["seg"], b["audit"], *lists], columns)

    schema = T.StructType([every.schema[c] for c in columns])
    mended = written(waiting.mapInArrow(apply, schema), "mended")
    lines = F.concat_ws("\n", F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)))
    gaps = F.when(F.col("first").isNull(), 0).otherwise(F.col("last") - F.col("first") + 1 - F.col("turns")).cast("long")
    figures = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = closed.select("conv_id", gaps.alias("gaps"), *figures, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    parts = mended.select("conv_id", "seg", "audit", F.when(F.size("roles") > 0, lines).alias("lines"))
    heads = folded.filter("seg is null").select("conv_id", "gaps", *figures)

    def finish(batches):
        """Heads come first in their conversations."""
        head = None

        def close():
            return [*head, "".join(audits), digest.hexdigest()]

        for b in batches:
            out = []
            for conv, seg, audit, text_, *numbers in zip(*(b[c].to_pylist() for c in ("conv_id", "seg", "audit", "lines", "gaps", *figures))):
                if seg is None:
                    if head is not None:
                        out.append(close())
                    head, audits, digest, begun = [conv, *numbers], [], hashlib.sha256(), False
                    continue
                audits.append(audit)
                if text_ is not None:
                    digest.update((b"\n" if begun else b"") + text_.encode())
                    begun = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(close()), kinds)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    names, kinds = whole.columns, [to_arrow_type(f.dataType) for f in whole.schema.fields]
    dealt = (heads.unionByName(parts, allowMissingColumns=True).repartition(shuffle_partitions(rows.sparkSession), "conv_id")
             .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("seg").asc_nulls_first()))
    return whole.unionByName(dealt.mapInArrow(finish, whole.schema)), closed.select(*columns).unionByName(mended)
