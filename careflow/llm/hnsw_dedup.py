"""Operator 5, embedding near-duplicates over hierarchical navigable small-world graphs.

Equal vectors are one class. Classes are dealt by hash to shards of about ``SHARD``
classes at most, and to blocks of queries of about ``QUERIES`` (either of ``FLOATS``
floats at most, so about 128 MB in single precision), whose numbers follow the count of
classes of one length; what a task holds of vectors and graphs does not grow with the
table. Every block is searched in every shard, so the number of such searches, and the
bytes moved for them, grow with the square of the count. Each shard builds its graph: levels by hash, upper levels as entry points, links chosen so that a link
leads away from links already taken. Every class queries every shard by beam search.
Beams widen for two reasons: a beam that ends full of links is doubled for its query,
and each block of queries is audited against exact search of the shard on ``AUDIT`` of
them, doubling all its beams until the audit finds no link missing (a beam as wide as
the shard is exact search). Cosines of found links are verified in double precision.

A task sees the links between its block of queries and its shard. It returns how many
vectors each query links with, and a spanning forest of the links, so its rows do not
grow with the square of a group. Components are united by stars over those forests.

Rules: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths do not link. Doubles are kept and compared as
such, other numbers as floats. Rows that share a vec_id are vectors of their own under
one id: equal ones are one class, others link like any two, and each counts the other.
A row without vec_id links with nothing and has a
null component. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import written
from careflow.llm.components import components

LINKS, BUILD_BEAM, BEAM, AUDIT, BATCH, WIDTH = 16, 48, 32, 96, 512, 4
SHARD, QUERIES, FLOATS = 100_000, 50_000, 1 << 25  # classes a shard, classes a block, floats of either
SLACK = 1e-4  # between single precision search and double precision verification


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar of each row, best first."""
    if ids.shape[1] > k:
        at = np.argpartition(-sims, k - 1, 1)[:, :k]
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    at = np.argsort(-sims, 1, kind="stable")
    return np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)


class Graph:
    """``x``: unit vectors in order of falling level; ``layers``: links by level, the
    upper ones over a prefix of the nodes, -1 where there is none."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, level: np.ndarray) -> "Graph":
        """``level`` falls along the rows of x."""
        g = cls(x, [])
        for own in range(int(level.max(initial=0)), -1, -1):
            g.layers.insert(0, np.full((0, 2 * LINKS), -1, np.int32))
            g._grow(int((level >= own).sum()))
        return g

    def _grow(self, n: int) -> None:
        done = 0
        while done < n:
            size = min(n - done, max(64, min(BATCH, done)))
            new = np.arange(done, done + size)
            inside = self.x[new] @ self.x[new].T
            np.fill_diagonal(inside, -2)
            ids = np.broadcast_to(new, inside.shape)
            ids, sims = _top(ids, inside, min(BUILD_BEAM, size))
            ids = np.where(sims < -1.5, -1, ids)
            if done:
                old, close = self.search(self.x[new], BUILD_BEAM)
                ids, sims = _top(np.concatenate([ids, old], 1), np.concatenate([sims, close], 1), BUILD_BEAM)
            links = np.full((size, 2 * LINKS), -1, np.int32)
            links[:, :LINKS] = self._choose(ids, sims, LINKS)
            self.layers[0] = np.concatenate([self.layers[0], links])
            self._back(new, links[:, :LINKS])
            done += size

    def _choose(self, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
        """Up to k links for each row of candidates (best first): one that is nearer to a
        link already taken than to the node comes after those that are not."""
        n, c = ids.shape
        v = self.x[np.maximum(ids, 0)]
        near = np.einsum("ncd,nkd->nck", v, v, optimize=True)
        taken = np.zeros((n, c), bool)
        for j in range(c):
            clash = (taken & (near[:, j] > sims[:, j, None])).any(1)
            taken[:, j] = (ids[:, j] >= 0) & ~clash & (taken.sum(1) < k)
        rank = np.where(ids < 0, 2 * c, np.where(taken, 0, c)) + np.arange(c)
        at = np.argsort(rank, 1)[:, :k]
        out = np.take_along_axis(ids, at, 1)
        if out.shape[1] < k:
            out = np.pad(out, ((0, 0), (0, k - out.shape[1])), constant_values=-1)
        return out

    def _back(self, new: np.ndarray, links: np.ndarray) -> None:
        """Links back to the new nodes; full lists are chosen anew."""
        layer = self.layers[0]
        source, target = np.repeat(new, links.shape[1]), links.ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        widest = int(count.max(initial=0))
        more = np.full((len(nodes), widest), -1, np.int64)
        place = np.arange(len(target)) - np.repeat(start, count)
        more[np.repeat(np.arange(len(nodes)), count), place] = source
        for lo in range(0, len(nodes), BATCH):
            at = nodes[lo:lo + BATCH]
            both = np.concatenate([layer[at].astype(np.int64), more[lo:lo + BATCH]], 1)
            both.sort(1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.einsum("nd,ncd->nc", self.x[at], self.x[np.maximum(both, 0)], optimize=True)
            sims[both < 0] = -2
            ids, sims = _top(both, sims, min(both.shape[1], 4 * LINKS))
            layer[at] = self._choose(np.where(sims < -1.5, -1, ids), sims, 2 * LINKS)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of each query's final beam and their similarities, best first."""
        ids = np.zeros((len(q), 1), np.int64)
        for layer in self.layers[:0:-1]:
            if len(layer):
                ids, sims = self._beam(q, layer, ids[:, :1], 4)
        ids = np.where(ids < len(self.layers[0]), ids, 0)  # while the lowest layer grows, it may lack an entry
        return self._beam(q, self.layers[0], ids, beam)

    def _beam(self, q: np.ndarray, layer: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        step = max(16, min(BATCH, (1 << 26) // max(1, len(layer))))
        if len(q) > step:
            parts = [self._beam(q[i:i + step], layer, entry[i:i + step], beam) for i in range(0, len(q), step)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        n, beam = len(q), min(beam, len(layer))
        ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -2.0, np.float32)
        entry = entry[:, :beam]
        ids[:, : entry.shape[1]] = entry
        sims[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("nd,ncd->nc", q, self.x[np.maximum(entry, 0)]), -2)
        open_ = ids >= 0
        seen = np.zeros((n, len(layer) + 1), bool)
        seen[np.arange(n)[:, None], ids] = True
        seen[:, -1] = True  # the place of -1
        live = np.arange(n)
        while live.size:
            score = np.where(open_[live], sims[live], -3)
            pick = np.argsort(-score, 1)[:, :WIDTH]
            ok = np.take_along_axis(score, pick, 1) > -3
            live, pick, ok = live[ok[:, 0]], pick[ok[:, 0]], ok[ok[:, 0]]
            if not live.size:
                break
            nodes = np.where(ok, ids[live[:, None], pick], -1)
            open_[live[:, None], pick] = False
            near = layer[nodes].astype(np.int64)
            near[nodes < 0] = -1
            near = np.sort(near.reshape(len(live), -1), 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[live[:, None], near]] = -1
            wide = max(1, int((near >= 0).sum(1).max()))
            near = -np.sort(-near, 1)[:, :wide]
            seen[live[:, None], near] = True
            close = np.einsum("nd,ncd->nc", q[live], self.x[np.maximum(near, 0)], optimize=True).astype(np.float32)
            close[near < 0] = -2
            all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], close], 1)
            all_open = np.concatenate([open_[live], near >= 0], 1)
            at = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, at, 1) for a in (all_ids, all_sims, all_open))
        at = np.argsort(-sims, 1)
        return np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)

    def within(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with similarity of at least ``least``, beams widened until
        none is full of links and the audit misses nothing."""
        if not len(q) or not len(self.x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        beam, whole = BEAM, len(self.x)
        while True:
            rows, nodes = self._widen(q, least, beam)
            if beam >= whole:
                return rows, nodes
            # audit those with links and as many others, spread over the block
            hits = np.bincount(rows, minlength=len(q))
            some, none = np.flatnonzero(hits), np.flatnonzero(hits == 0)
            audit = np.concatenate([a[:: max(1, len(a) * 2 // AUDIT)] for a in (some, none)])
            truth = (q[audit] @ self.x.T >= least).sum()
            if hits[audit].sum() >= truth:
                return rows, nodes
            beam *= 2

    def _widen(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        left, rows, nodes = np.arange(len(q)), [], []
        while left.size:
            if beam >= len(self.x):
                step = max(1, (1 << 22) // len(self.x))
                for i in range(0, len(left), step):
                    r, c = np.nonzero(q[left[i:i + step]] @ self.x.T >= least)
                    rows.append(left[i:i + step][r])
                    nodes.append(c)
                break
            ids, sims = self.search(q[left], beam)
            full = sims[:, -1] >= least
            r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
            rows.append(left[r])
            nodes.append(ids[r, c])
            left, beam = left[full], beam * 2
        return np.concatenate(rows), np.concatenate(nodes)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs that form a spanning forest."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent, keep = list(range(len(names))), []

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    half = len(a)
    for k, (i, j) in enumerate(zip(at[:half].tolist(), at[half:].tolist())):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            keep.append(k)
    return np.array(keep, np.int64)


def spread(classes: DataFrame, shards: int, blocks: int) -> DataFrame:
    """The classes (h, g, rep, n, v) with their dim, shard and block, and how many shards
    and blocks their dim has: as many as its count of classes needs, the given ones at least."""
    classes = classes.withColumn("dim", F.size("v"))

    def needed(rows: int, at_least: int) -> Column:
        each = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(FLOATS) / F.col("dim"))))
        return F.greatest(F.lit(at_least), F.ceil(F.col("count") / each)).cast("int")

    # L different lengths need L * L / 2 floats, so this table is small at any size
    sizes = classes.groupBy("dim").count().select("dim", needed(SHARD, shards).alias("shards"), needed(QUERIES, blocks).alias("blocks"))
    return classes.join(F.broadcast(sizes), "dim").select(
        "rep", "n", "v", "dim", F.pmod("h", "shards").cast("int").alias("shard"), F.pmod("g", "blocks").cast("int").alias("block"), "g", "shards", "blocks")


def linked(vectors: DataFrame, least: float = 0.95, shards: int = 8, blocks: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors`` (vec_id, embedding)."""
    wide = vectors.schema["embedding"].dataType.simpleString() == "array<double>"
    kind, sql = (np.float64, "array<double>") if wide else (np.float32, "array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(sql).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumns({"h": F.when(good, F.xxhash64("v")), "g": F.when(good, F.xxhash64(F.lit(7), F.col("v")))})
    classes = rows.filter(good).groupBy("h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    # a class goes by a number of its own (stored, so it stays): vec_ids may repeat
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    dealt = spread(classes, shards, blocks)

    def build(key, table):
        draw = (table["g"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.minimum(np.floor(-np.log(draw + 2.0**-54) / np.log(LINKS)), 8).astype(np.int64)
        order = np.lexsort((table["rep"].to_numpy(), -level))
        v = _vectors(table["v"])[order]
        g = Graph.build(_unit(v).astype(np.float32), level[order])
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
                         "blocks": pa.array([key[2].as_py()], pa.int32()),
                         "reps": pa.array([table["rep"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
                         "weights": pa.array([table["n"].to_numpy()[order].astype("<i8").tobytes()], pa.binary()),
                         "vectors": pa.array([v.tobytes()], pa.binary()),
                         "layers": pa.array([[x.tobytes() for x in g.layers]], pa.list_(pa.binary()))})

    graphs = dealt.groupBy("dim", "shard", "blocks").applyInArrow(build, "dim int, shard int, blocks int, reps binary, weights binary, vectors binary, layers array<binary>")
    graphs = written(graphs, "graphs", maxRecordsPerFile=4)  # cells of many MB, which a reader takes a file at a time

    def ask(key, graph, asked):
        a, b, n = [np.zeros(0, np.int64)] * 3
        if graph.num_rows and asked.num_rows:
            dim = key[0].as_py()
            reps, weights = (np.frombuffer(graph[c][0].as_py(), "<i8") for c in ("reps", "weights"))
            exact = _unit(np.frombuffer(graph["vectors"][0].as_py(), kind).reshape(-1, dim))
            g = Graph(exact.astype(np.float32), [np.frombuffer(x, np.int32).reshape(-1, 2 * LINKS) for x in graph["layers"][0].as_py()])
            own = asked["rep"].to_numpy()
            q = _unit(_vectors(asked["v"]))
            r, c = g.within(q.astype(np.float32), least - SLACK)
            other = own[r] != reps[c]
            r, c = r[other], c[other]
            sure = np.concatenate([np.einsum("nd,nd->n", q[r[i:i + 65536]], exact[c[i:i + 65536]]) >= least for i in range(0, len(r), 65536)] or [np.zeros(0, bool)])
            r, c = r[sure], c[sure]
            links = np.bincount(r, weights[c], len(own)).astype(np.int64)
            tree = _forest(own[r], reps[c])
            at = np.flatnonzero(links)
            a = np.concatenate([own[at], own[r][tree]])
            b = np.concatenate([own[at], reps[c][tree]])
            n = np.concatenate([links[at], np.zeros(len(tree), np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    left = graphs.withColumn("block", every("blocks")).groupBy("dim", "shard", "block")
    right = dealt.select("dim", "block", "rep", "v", every("shards").alias("shard")).groupBy("dim", "shard", "block")
    found = written(left.cogroup(right).applyInArrow(ask, "a long, b long, n long"), "links")
    links = found.groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "rep")
    trees = components(found.filter("a <> b").select("a", "b"))
    classes = classes.select("h", "g", "least", "rep", "n").join(links, "rep", "left").join(trees.withColumnRenamed("node", "rep"), "rep", "left")
    classes = written(classes.withColumn("root", F.coalesce("component", "rep")), "rooted")
    roots = classes.groupBy("root").agg(F.min("least").alias("smallest")).hint("merge")
    classes = classes.join(roots, "root").select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.col("smallest").alias("component"))
    out = rows.select("vec_id", "h", "g").join(written(classes, "linked"), ["h", "g"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
