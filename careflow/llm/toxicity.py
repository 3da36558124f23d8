"""Operator 4, toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy is trained on confirmed toxic texts and on text whose
labels are not looked at. With the class prior p, the risk is
``p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-))`` under the logistic loss: what the
positives contribute to the unlabelled texts' negative risk is taken off again, and
where that turns the estimate negative (overfitting), the step goes back up instead.
The prior is the share of toxic rows among the labelled training rows.

Features: the distinct words of a text and the beginnings of words (3 to 6 bytes),
hashed; those enter whose share among toxic texts differs from that among all texts by
``SIGNIFICANT`` standard errors, ``FEATURES`` at most. Training takes a bounded sample
(``POSITIVE`` toxic and ``UNLABELLED`` other rows, those with the smallest key hashes;
of equal texts one), so one task can hold it. Every row is scored, by its whole text, where it is read.

Rules: rows whose key's crc32 modulo ``folds`` is 0 are held out and never learnt from.
Null and empty texts have no features and get the score of the bias. Several labels of a
key: toxic if any says so; null labels and labels without a document are ignored. With
no toxic example at all every score is 0. Other columns pass through unread; columns
named held_out, score or predicted are replaced.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.llm.common import crc_bucket, written

POSITIVE, UNLABELLED = 4096, 12288
FEATURES, BITS, SIGNIFICANT, LEAST = 1 << 14, 22, 4.5, 5
PREFIXES, EDGES = (3, 4, 5, 6), b".,;:!?\"'()[]{}|-*#$%&<>"
STEPS, RATE, DECAY, BACK = 150, 0.05, 1e-4, 0.5


class Features(dict):
    """Words to hashed features, bounded."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        w = word.strip(EDGES)
        mask = (1 << BITS) - 1
        out = (xxhash.xxh32_intdigest(w, 1) & mask, *(xxhash.xxh32_intdigest(w[:k], k) & mask for k in PREFIXES if len(w) >= k)) if w else ()
        if len(self) >= 1 << 16:
            self.clear()
        self[word] = out
        return out


@functools.lru_cache(maxsize=1)
def features() -> Features:
    return Features()


def of_text(text: bytes | None, known: Features) -> set[int]:
    return {f for w in set((text or b"").lower().split()) for f in known[w]}


class Sparse:
    """Rows of feature numbers; products with a weight vector and their gradients."""

    def __init__(self, rows: list[np.ndarray], n: int):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.shape = len(rows), n

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, their weights, and the bias."""
    size = 1 << BITS
    count = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), minlength=size)
    a, b = count(pos), count(unl)
    share = (a + b) / (len(pos) + len(unl))
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / len(pos) + 1 / len(unl)))
    pull = np.abs(a / len(pos) - b / len(unl)) / error
    pull[(a + b < LEAST) | (pull < SIGNIFICANT)] = 0
    names = np.sort(np.argpartition(-pull, FEATURES)[:FEATURES])
    names = names[pull[names] > 0]
    at = np.full(size, -1, np.int64)
    at[names] = np.arange(len(names))
    mats = [Sparse([(x := at[r])[x >= 0] for r in rows], len(names)) for rows in (pos, unl)]
    w, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p, u = mats
    for step in range(1, STEPS + 1):
        zp, zu = p.dot(w) + bias, u.dot(w) + bias
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus, gp_minus, gu = -sigmoid(-zp) * prior / len(pos), sigmoid(zp) * prior / len(pos), sigmoid(zu) / len(unl)
        if negative >= 0:
            gp, gu = gp_plus - gp_minus, gu
        else:
            gp, gu = BACK * gp_minus, -BACK * gu
        g = np.append(p.back(gp) + u.back(gu) + DECAY * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return names, w, float(bias)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5) -> tuple[bytes, bytes, float] | None:
    """The model: feature numbers (int32), weights (float64) and bias; None without examples."""
    learnt = crc_bucket(F.col("doc_id"), folds) != 0
    marks = labels.filter(learnt & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    n, toxic = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    if not toxic:
        return None
    prior = min(max(toxic / n, 1e-3), 0.5)
    chosen = marks.filter("toxic = 1").select("doc_id").orderBy(order).limit(POSITIVE).withColumn("positive", F.lit(True))
    other = docs.filter(learnt & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order).limit(UNLABELLED)
    ids = written(chosen.unionByName(other.withColumn("positive", F.lit(False))), "sample")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ids, "doc_id").select("positive", "text")

    def extract(batches):
        known = features()
        for b in batches:
            sets = [np.fromiter(s, np.int32, len(s)).tobytes() for s in (of_text(t, known) for t in b["text"].to_pylist())]
            yield pa.record_batch([b["positive"], pa.array(sets, pa.binary())], ["positive", "features"])
        known.clear()  # workers live on; later stages need the memory

    def learn(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.int32) for x in table["features"].to_pylist()]
        positive = table["positive"].to_pylist()
        pos, unl = ([*{r.tobytes(): r for r, p in zip(rows, positive) if p == side}.values()] for side in (True, False))
        names, w, bias = fit(pos, unl, prior) if pos and unl else (np.zeros(0), np.zeros(0), -30.0)
        return pa.table({"names": pa.array([names.astype(np.int32).tobytes()], pa.binary()),
                         "weights": pa.array([w.astype(np.float64).tobytes()], pa.binary()), "bias": [bias]})

    sets = rows.mapInArrow(extract, "positive boolean, features binary")
    got = sets.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "names binary, weights binary, bias double").collect()
    return (bytes(got[0].names), bytes(got[0].weights), got[0].bias) if got else None


def score(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= 0.5)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, folds))  # FEATURES weights at most
    columns = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(F.col("text").cast("binary").alias("_score_text"), *columns)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType())])

    def run(batches):
        known, weight, bias = features(), None, -30.0
        if model.value:
            names, w, bias = model.value
            weight = np.zeros(1 << BITS)
            weight[np.frombuffer(names, np.int32)] = np.frombuffer(w, np.float64)
        for b in batches:
            z = np.full(b.num_rows, bias)
            if weight is not None:
                for i, text in enumerate(b.column(0).to_pylist()):
                    own = of_text(text, known)
                    z[i] += weight[np.fromiter(own, np.int64, len(own))].sum()
                z = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                z[:] = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(z)], schema.names)
        known.clear()

    out = rows.mapInArrow(run, schema)
    return out.withColumns({"held_out": crc_bucket(F.col("doc_id"), folds) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).filter("predicted = 0").select(docs.columns)
