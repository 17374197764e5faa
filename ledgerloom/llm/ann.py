"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

Vectors that are equal are one point, so a vector that a third of all rows share costs one node. The points are dealt to shards; each
shard's graph is built once, by greedy searches that propose a node's neighbours and robust pruning that keeps those no kept one
is closer to by the factor ALPHA, and written with its edges. Inner products become distances by one more dimension that lifts
all points to one length. A beam search from the shard's medoid answers each query in each shard, in blocks of queries, each of
which gets the written graph; the best points of the shards are merged, widened to all rows that hold them, and scored in double
precision on the original vectors. A shard of at most BEAM points fits in the beam and is scanned whole.

Measured recall against brute force is in the README; tests/llm/test_operators.py holds it to 0.9.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors are
compared with those of their own length, each length being searched by itself; null ids take no part; repeated rows (id and vector) are candidates each;
ties go to the smaller id; very long vectors and columns of other names change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import Cut

TOP = 20
#: Points of one shard up to which more shards aren't made, and least number of shards (for parallel building).
SHARD_POINTS, LEAST_SHARDS = 200_000, 6
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 64, 96, 1.2
#: Distances between proposals that are held at once.
GRAM = 1 << 22
#: Queries of one block, each of which gets a copy of every shard, and those searched in one step.
BLOCK, STEP = 262_144, 256


class Graph:
    """A robust-pruned graph over the rows of x; distances are squared Euclidean."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, links: np.ndarray | None = None, start: int = 0):
        """x: the points, and for a graph that is built already its edges and first node."""
        self.x, self.degree, self.start = np.ascontiguousarray(x, np.float32), degree, start
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        self.links = np.full((len(x), degree), -1, np.int32) if links is None else links
        self._seen = np.zeros((STEP, len(x) + 1), bool)  # cleared where it was set after each search

    def build(self, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 1) -> Graph:
        n = len(self.x)
        self.start = int(np.argmin(self.norm - 2 * self.x @ self.x.mean(axis=0)))
        order = np.random.default_rng(seed).permutation(n)
        done = [self.start]
        order = order[order != self.start]
        at = 0
        while at < len(order):
            # As many at once as the graph already holds, so early nodes see one another.
            batch = order[at : at + min(STEP, max(1, len(done)))]
            self._insert(batch, beam, alpha)
            done.extend(batch)
            at += len(batch)
        for at in range(0, n, STEP):  # a second pass, over the full graph
            self._insert(np.arange(at, min(n, at + STEP)), beam, alpha)
        return self

    def distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each row of q from its row of ids; a negative id is infinitely far."""
        d = self.norm[ids] - 2 * np.einsum("bd,bkd->bk", q, self.x[ids], optimize=True)
        return np.where(ids < 0, np.inf, d)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's nodes and distances (less the query's own square) for each query, nearest first; -1 where fewer are reached."""
        b, n, rows = len(q), len(self.x), np.arange(len(q))
        ids = np.full((b, beam), -1, np.int32)
        dist = np.full((b, beam), np.inf, np.float32)
        open_ = np.zeros((b, beam), bool)
        ids[:, 0], open_[:, 0] = self.start, True
        dist[:, 0] = self.distances(q, ids[:, :1])[:, 0]
        seen, touched = self._seen, [(rows, np.full((b, 1), self.start))]
        seen[:b, self.start] = True
        while len(live := np.flatnonzero(open_.any(axis=1))):
            first = open_[live].argmax(axis=1)
            node = ids[live, first]
            open_[live, first] = False
            near = self.links[node]
            known = seen[live[:, None], near]  # -1 reads the last column, which stays unset
            near = np.where(known, -1, near)
            seen[live[:, None], near] = True
            seen[:b, n] = False
            touched.append((live, near))
            d = self.distances(q[live], near)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_d = np.concatenate([dist[live], d], axis=1)
            all_open = np.concatenate([open_[live], near >= 0], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_d, keep, 1), axis=1, kind="stable"), 1)
            r = rows[: len(live), None]
            ids[live], dist[live], open_[live] = all_ids[r, keep], all_d[r, keep], all_open[r, keep]
        for who, what in touched:
            seen[who[:, None], what] = False
        return ids, dist

    def prune(self, nodes: np.ndarray, ids: np.ndarray, alpha: float) -> np.ndarray:
        """Of each node's proposals, the nearest first, those that no kept one is nearer to by the factor alpha."""
        most = max(1, GRAM // ids.shape[1] ** 2)
        if len(nodes) > most:
            return np.concatenate([self.prune(nodes[at : at + most], ids[at : at + most], alpha) for at in range(0, len(nodes), most)])
        own = self.norm[nodes][:, None]
        d = np.maximum(self.distances(self.x[nodes], ids) + own, 0)
        d[ids == nodes[:, None]] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        twice = np.zeros(ids.shape, bool)
        twice[:, 1:] = (ids[:, 1:] == ids[:, :-1])  # a proposal made twice has one distance, so its two stand together
        d[twice] = np.inf
        points = self.x[ids]
        norms = self.norm[ids]
        apart_all = norms[:, :, None] + norms[:, None, :] - 2 * (points @ points.transpose(0, 2, 1))
        kept = np.full((len(nodes), self.degree), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(self.degree):
            best = d.argmin(axis=1)
            have = np.isfinite(d[rows, best])
            if not have.any():
                break
            kept[have, k] = ids[rows, best][have]
            d[apart_all[rows, best] * alpha**2 <= d] = np.inf
            d[rows, best] = np.inf
        return kept

    def _insert(self, nodes: np.ndarray, beam: int, alpha: float) -> None:
        found, _ = self.search(self.x[nodes], beam)
        self.links[nodes] = self.prune(nodes, np.concatenate([found, self.links[nodes]], axis=1), alpha)
        # Edges back: a target with room takes them; one without is pruned anew.
        source = np.repeat(nodes, self.degree)
        target = self.links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, count = np.unique(target, return_counts=True)
        place = np.arange(len(target)) - np.repeat(np.cumsum(count) - count, count)
        more = np.full((len(heads), int(count.max()) if len(count) else 0), -1, np.int32)
        more[np.repeat(np.arange(len(heads)), count), place] = source
        old = self.links[heads]
        all_ids = np.concatenate([old, more], axis=1)
        distinct = np.sort(all_ids, axis=1)
        distinct[:, 1:][distinct[:, 1:] == distinct[:, :-1]] = -1
        distinct = -np.sort(-distinct, axis=1)  # those that are there first
        easy = (distinct >= 0).sum(axis=1) <= self.degree
        self.links[heads[easy]] = distinct[easy, : self.degree]
        if (~easy).any():
            self.links[heads[~easy]] = self.prune(heads[~easy], all_ids[~easy], alpha)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """x divided by the length `longest`, with one more dimension that brings every row to length 1."""
    x = x / longest
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def _stacked(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    c = column.combine_chunks()
    return np.asarray(c.flatten(), kind).reshape(len(c), -1)


def _built(longest: dict[int, float]):
    """A shard's points, in order of their least id, with the edges of its graph; the first node has the mark `start`."""

    def run(points: pa.Table) -> pa.Table:
        points = points.sort_by([("least", "ascending"), ("point", "ascending")])
        n = points.num_rows
        if n > BEAM:
            x = _stacked(points.column("v"))
            graph = Graph(_lifted(x, longest[x.shape[1]])).build()
            edges, start = pa.array(list(graph.links), pa.list_(pa.int32())), np.arange(n) == graph.start
        else:
            edges, start = pa.nulls(n, pa.list_(pa.int32())), np.zeros(n, bool)
        return points.append_column("i", pa.array(np.arange(n))).append_column("edges", edges).append_column("start", pa.array(start))

    return run


def _answer(longest: dict[int, float], top: int):
    """longest: the greatest norm of the vectors of each length. Equally near points go by their least id."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query", "point", "least", "nearness"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not points.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        points = points.sort_by("i")
        x, q, ids, least = _stacked(points.column("v")), _stacked(queries.column("v")), np.asarray(points.column("point")), np.asarray(points.column("least"))
        take = min(top + 1, len(x))
        beam = min(max(BEAM, take), len(x))
        graph = None
        if len(x) > BEAM:
            graph = Graph(_lifted(x, longest[x.shape[1]]), links=_stacked(points.column("edges"), np.int32), start=int(np.flatnonzero(np.asarray(points.column("start")))[0]))
        out = []
        names_q = np.asarray(queries.column("query"))
        for at in range(0, len(q), STEP):
            part = q[at : at + STEP]
            if graph is None:
                found = np.broadcast_to(np.arange(len(x)), (len(part), len(x)))
            else:
                unit = part / np.sqrt(np.einsum("ij,ij->i", part, part))[:, None]
                found, _ = graph.search(np.concatenate([unit, np.zeros((len(part), 1))], axis=1).astype(np.float32), beam)
            near = np.where(found >= 0, np.einsum("bd,bkd->bk", part, x[found]), -np.inf)
            best = np.lexsort((found, -near), axis=1)[:, :take]
            r = np.arange(len(part))[:, None]
            value, got = near[r, best], found[r, best]
            ok = value > -np.inf
            out.append((np.broadcast_to(names_q[at : at + STEP, None], got.shape)[ok], ids[got[ok]], least[got[ok]], value[ok]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _usable(v):
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0)


def search(queries: DataFrame, candidates: DataFrame, top: int = TOP, same: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: each query's `top` candidates of largest inner product, nearest first. Both tables have vec_id and embedding.

    same: a candidate of the query's own id is no answer.
    """
    spark = candidates.sparkSession
    kinds = {dict(df.dtypes)["embedding"] for df in (queries, candidates)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    points = clean(candidates)
    # Of equal vectors' rows, the smallest ids are the only ones that can be answers.
    order = Window.partitionBy("v").orderBy("vec_id")
    first = points.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top + 1)
    held = Cut(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.monotonically_increasing_id()), "points")
    if not held.rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    longest = {r.length: float(r.longest) for r in held.df.groupBy(F.size("v").alias("length")).agg(F.max(norm).alias("longest")).collect()}
    asked = Cut(clean(queries), "asked")
    kinds = Cut(asked.df.groupBy("v").agg(F.count("*").alias("n")).withColumn("query", F.monotonically_increasing_id()), "queries")
    shards = max(LEAST_SHARDS, -(-held.rows // SHARD_POINTS))
    blocks = max(1, -(-kinds.rows // BLOCK))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    dealt = held.df.select("point", F.element_at("ids", 1).alias("least"), "v", F.size("v").alias("length"), at("point", shards).alias("shard"))
    graphs = Cut(dealt.groupBy("length", "shard").applyInArrow(_built(longest), f"point long, least long, v {kind}, length int, shard long, i long, edges array<int>, start boolean"), "graphs")
    left = graphs.df.withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    right = kinds.df.select("query", "v", F.size("v").alias("length"), at("query", blocks).alias("block"), F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"))
    found = left.groupBy("length", "shard", "block").cogroup(right.groupBy("length", "shard", "block")).applyInArrow(_answer(longest, top), "query long, point long, least long, nearness double")
    best = Window.partitionBy("query").orderBy(F.desc("nearness"), "least", "point")
    near = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= top + 1).select("query", "point", "nearness")
    wide = near.join(held.df.select("point", "ids"), "point").select("query", "nearness", F.explode("ids").alias("vec_id"))
    ranked = wide.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("nearness")).alias("far"), "vec_id"))), 1, top + 1).alias("answers"))
    answers = Cut(ranked.join(kinds.df.select("query", "v"), "query").select("v", "answers"), "answers").df
    for x in (held, kinds, graphs):
        x.drop()
    own = asked.df.select(F.col("vec_id").alias("query_id"), "v").join(answers, "v")
    others = F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")) if same else F.col("answers")
    rows = own.select("query_id", F.posexplode(F.slice(others, 1, top)).alias("i", "a"))
    return rows.select("query_id", (F.col("i") + 1).alias("rank"), F.col("a.vec_id").alias("vec_id"), (-F.col("a.far")).alias("score"))


def op6_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows.filter(F.col("vec_id") % 20 == 0), rows)
