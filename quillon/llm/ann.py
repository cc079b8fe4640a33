"""Nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample: a node splits its members at the median of their projections on
the line through two of them (moved to the means of what lies nearer to each). Every vector then goes
to one leaf of each tree. A query searches all trees through one priority queue, ordered by the sum of
squared margins on the way, until the leaves it has reached hold a share of the table; that share is
measured on the sample, so that the recall aimed at is reached there. Candidates in those
leaves are ranked by their exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import first_by_hash, lean, tune, written

TREES = 8
LEAF = 80
SAMPLE = 20_000
#: Lengths of vectors in one table.
WIDTHS = 16
AIM = 0.96
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.5)
#: Rows of a leaf that one task ranks; leaves with more are dealt out, and their queries to each part.
PART = 8192
BLOCK = 1024
#: Pairs whose exact cosines are computed at once.
PAIRS = 100_000


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision: equal rows give equal results."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


@dataclass
class Tree:
    """Inner nodes as arrays; a child below zero is leaf number -1 - child."""

    lines: np.ndarray
    cuts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n_leaves: int

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), 0 if len(self.cuts) else -1)
        while len(live := np.flatnonzero(at >= 0)):
            k = at[live]
            right = np.einsum("ij,ij->i", x[live], self.lines[k]) > self.cuts[k]
            at[live] = np.where(right, self.high[k], self.low[k])
        return -1 - at


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int) -> Tree:
    lines, cuts, low, high, n = [], [], [], [], 0

    def node(idx: np.ndarray) -> int:
        nonlocal n
        line = cut = None
        if len(idx) > leaf:
            a, b = x[rng.choice(idx, 2, replace=False)]
            for _ in range(4):
                near = x[idx] @ (a - b) > (a @ a - b @ b) / 2
                if near.all() or not near.any():
                    break
                a, b = x[idx[near]].mean(axis=0), x[idx[~near]].mean(axis=0)
            size = np.linalg.norm(a - b)
            if size > 0:
                line = (a - b) / size
                cut = float(np.median(x[idx] @ line))
        if line is None or not (right := x[idx] @ line > cut).any() or right.all():
            n += 1
            return -n
        me = len(cuts)
        lines.append(line)
        cuts.append(cut)
        low.append(0)
        high.append(0)
        low[me], high[me] = node(idx[~right]), node(idx[right])
        return me

    node(np.arange(len(x)))
    return Tree(np.array(lines).reshape(len(cuts), x.shape[1]), np.array(cuts), np.array(low, np.int64), np.array(high, np.int64), n)


def search(trees: list[Tree], counts: list[np.ndarray], q: np.ndarray, budget: float) -> Iterator[tuple[int, int]]:
    """Leaves (tree, leaf) by the sum of squared margins, until they hold budget rows."""
    margins = [t.lines @ q - t.cuts for t in trees]
    queue = [(0.0, i, 0 if len(t.cuts) else -1) for i, t in enumerate(trees)]
    seen = 0
    while queue and seen < budget:
        far, i, at = heapq.heappop(queue)
        t, m = trees[i], margins[i]
        while at >= 0:
            a, b = (t.high[at], t.low[at]) if m[at] > 0 else (t.low[at], t.high[at])
            heapq.heappush(queue, (far + m[at] * m[at], i, int(b)))
            at = int(a)
        leaf = -1 - at
        if counts[i][leaf]:
            seen += int(counts[i][leaf])
            yield i, leaf


def aimed_share(trees: list[Tree], x: np.ndarray, rng: np.random.Generator, k: int, aim: float, n_queries: int = 100) -> float:
    """The smallest share of SHARES that finds the k nearest of sample vectors in the sample as often as
    aimed at; infinity if none does."""
    labels = [t.leaves(x) for t in trees]
    members = [[np.flatnonzero(lab == i) for i in range(t.n_leaves)] for t, lab in zip(trees, labels)]
    counts = [np.bincount(lab, minlength=t.n_leaves) for t, lab in zip(trees, labels)]
    picks = rng.choice(len(x), min(n_queries, len(x)), replace=False)
    hits, total = np.zeros(len(SHARES)), 0
    for p in picks:
        s = x @ x[p]
        s[p] = -9
        true = np.argsort(-s, kind="stable")[:k]
        total += len(true)
        when = np.full(len(x), np.inf)  # rows seen when a row is first reached
        seen = 0
        for i, leaf in search(trees, counts, x[p], SHARES[-1] * len(x)):
            own = members[i][leaf]
            when[own] = np.minimum(when[own], seen)
            seen += len(own)
        hits += [(when[true] < share * len(x)).sum() for share in SHARES]
    good = np.flatnonzero(hits >= aim * total)
    return SHARES[good[0]] if len(good) else np.inf


def packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors as bytes of doubles. Rows with a null id, and vectors that are null, empty, zero or
    hold null or non-finite components, are left out."""
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
                if i is None or not v or None in v:
                    continue
                a = np.array(v, np.float64) + 0.0  # no negative zeros
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, v binary")


def _matrix(col: pa.Array) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, aim: float = AIM, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors by cosine, but
    for rows with its own id; nearest first, equal scores by the smaller id.

    The forest is fitted on at most `sample` different vectors (those whose hashes come first), every
    vector is indexed. Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do rows without id. Vectors of different lengths have no cosine: each length is searched on its own, and more than
    WIDTHS of them are an error. Of equal vectors the k + 1 smallest ids are kept (more can't be among the k nearest), and
    equal queries are searched once, so that groups of copies cost one. An empty table gives no rows."""
    spark = vectors.sparkSession
    every = packed(vectors, id_col, vec_col)
    copies = W.partitionBy("v").orderBy("id")
    kept = written(every.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    sizes = [r["n"] for r in kept.select(F.length("v").alias("n")).distinct().limit(WIDTHS + 1).collect()]
    if len(sizes) > WIDTHS:
        raise ValueError(f"vectors of more than {WIDTHS} lengths")
    wanted = packed(queries, id_col, vec_col)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in sorted(sizes):
        own = F.length("v") == width
        out = out.unionByName(_nearest(kept.where(own), wanted.where(own), k, trees, leaf, sample, aim, seed))
    return out


def _nearest(kept: DataFrame, wanted: DataFrame, k: int, trees: int, leaf: int, sample: int, aim: float, seed: int) -> DataFrame:
    """nearest() for packed vectors of one length."""
    spark = kept.sparkSession
    some = first_by_hash(kept, "v", sample).collect()  # bounded by sample
    x = unit(np.frombuffer(b"".join(r["v"] for r in some), np.float64).reshape(len(some), -1))
    rng = np.random.default_rng(seed)
    forest = [grow(x, rng, leaf) for _ in range(trees)]
    share = aimed_share(forest, x, rng, k, aim)
    shared = spark.sparkContext.broadcast(forest)  # bounded by sample

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(_matrix(b.column("v")))
            for i, t in enumerate(shared.value):
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(t.leaves(u).astype(np.int32)), b.column("id"), b.column("v")], ["tree", "leaf", "id", "v"])

    indexed = kept.mapInArrow(index, "tree int, leaf int, id long, v binary")
    counts = [np.zeros(t.n_leaves, np.int64) for t in forest]
    for r in indexed.groupBy("tree", "leaf").count().collect():  # leaves of the forest
        counts[r["tree"]][r["leaf"]] = r["count"]
    budget = max(share * counts[0].sum(), 2 * trees * leaf)  # two leaves of each tree at least
    parts = [np.maximum(1, -(-c // PART)) for c in counts]

    @lean
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            u = unit(_matrix(b.column("v")))
            for q, i, v in zip(u, b.column("id").to_pylist(), b.column("v").to_pylist()):
                at = [(t, lf, p) for t, lf in search(shared.value, counts, q, budget) for p in range(parts[t][lf])]
                cols = np.array(at, np.int32).reshape(-1, 3).T
                n = len(at)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array([i] * n, pa.int64()), pa.array([v] * n, pa.binary())], ["tree", "leaf", "part", "id", "v"])

    salts = {(t, lf): int(p) for t in range(trees) for lf, p in enumerate(parts[t]) if p > 1}

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [((i * 2654435761) >> 7) % salts.get((t, lf), 1) for t, lf, i in zip(*(b.column(c).to_pylist() for c in ("tree", "leaf", "id")))]
            yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("leaf"), pa.array(own, pa.int32()), b.column("id"), b.column("v")], ["tree", "leaf", "part", "id", "v"])

    schema = "tree int, leaf int, part int, id long, v binary"
    rows = indexed.mapInArrow(deal, schema) if salts else indexed.select("tree", "leaf", F.lit(0).alias("part"), "id", "v")
    once = wanted.groupBy("v").agg(F.min("id").alias("id"))
    asked = once.select("id", "v").mapInArrow(route, schema)
    met = asked.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)))
    keys = ["tree", "leaf", "part"]
    ranked = met.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_ranker(k + 1), "qid long, id long, score double")
    best = ranked.groupBy("qid", "id").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    asks = wanted.join(once.withColumnRenamed("id", "qid"), "v").select(F.col("id").alias("query_id"), "qid").distinct()
    out = asks.join(best, "qid").where(F.col("id") != F.col("query_id"))
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _ranker(m: int):
    """Streams rows sorted by leaf, queries first: the m best rows of each leaf for each of its queries, equal scores by the
    smaller id. Products of unit vectors choose, with room for rounding; what they choose is ranked by its exact cosine."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, qids, qs = None, [], []
        ids: list[int] = []
        vs: list[bytes] = []
        best: dict[int, list[tuple[float, int]]] = {}

        def block() -> None:
            if ids and qids:
                data = np.frombuffer(b"".join(vs), np.float64).reshape(len(vs), -1)
                near, own = unit(data), np.array(ids)
                for first in range(0, len(qids), BLOCK):
                    q = np.frombuffer(b"".join(qs[first : first + BLOCK]), np.float64).reshape(-1, data.shape[1])
                    s = unit(q) @ near.T
                    n = min(m, len(own))
                    cut = np.partition(s, len(own) - n, axis=1)[:, len(own) - n]
                    at, row = np.nonzero(s >= cut[:, None] - 1e-9)
                    exact = np.concatenate([cosines(q[at[i : i + PAIRS]], data[row[i : i + PAIRS]]) for i in range(0, len(at), PAIRS)])
                    order = np.lexsort((own[row], -exact, at))
                    at, row, exact = at[order], row[order], exact[order]
                    first_of = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                    good = np.arange(len(at)) - np.repeat(first_of, np.diff(np.r_[first_of, len(at)])) < m
                    found: dict[int, list] = {}
                    for j, e, i in zip(at[good].tolist(), (-exact[good]).tolist(), own[row[good]].tolist()):
                        found.setdefault(j, []).append((e, i))
                    for j, rows in found.items():
                        best[first + j] = sorted(best.get(first + j, []) + rows)[:m]
            ids.clear()
            vs.clear()

        def close() -> pa.RecordBatch:
            block()
            flat = [(qids[j], i, -s) for j, kept in best.items() for s, i in kept]
            best.clear()
            qids.clear()
            qs.clear()
            cols = list(zip(*flat)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["qid", "id", "score"])

        for b in batches:
            for *here, kind, i, v in zip(*(b.column(c).to_pylist() for c in ("tree", "leaf", "part", "kind", "id", "v"))):
                if here != key:
                    if key is not None:
                        yield close()
                    key = here
                if kind == 0:
                    qids.append(i)
                    qs.append(v)
                elif qids:
                    ids.append(i)
                    vs.append(v)
                    if len(ids) == BLOCK:
                        block()
        if key is not None:
            yield close()

    return run
