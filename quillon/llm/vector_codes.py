"""Codes of vectors by product quantisation, with codebooks made by filtering Lloyd rounds.

Vectors become integers, and each is cut into PARTS equal parts with a codebook each. Every partition deals its vectors into chunks and builds, once, a
kd-tree over each part of a chunk: a node holds its points' bounding box, sum and count. A round walks the trees from
the root with all entries of a codebook as candidates. Of a node's candidates the one nearest to the middle of its box eliminates each other
that is nowhere nearer within the box; where one is left, the whole subtree is assigned at once, by its cached sum and count. Points of leaves
are compared with the candidates left there. All of it is exact, in integers, so trees and partitions don't change results.

Trees are a table; rounds read it and send back sums per entry, aggregated before they reach the driver: a codebook has at most ENTRIES entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import lean, nameless, tune, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a chunk, and points of a leaf at most.
CHUNK, LEAF = 4096, 16
#: Integers beyond this could overflow a squared distance (of up to 2^13 components).
LARGEST = 1 << 23


def kept_vectors(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, vector: array of doubles, label: string) without vectors that are null or hold null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"), F.col(label_col).cast("string").alias("label")).where(F.col("vector").isNotNull() & ~bad)


def integers(rows: pa.Array, width: int) -> np.ndarray:
    """floor(1024 x) of each component."""
    flat = np.floor(SCALE * np.asarray(rows.flatten(), np.float64))
    if len(flat) != width * len(rows):
        raise ValueError(f"vectors of other lengths than {width}")
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / SCALE} have no exact squared distances in 64 bits")
    return flat.astype(np.int64).reshape(len(rows), width)


@dataclass
class Tree:
    """A balanced kd-tree, level by level: node i has children 2 i + 1 and 2 i + 2, and the points order[start[i]:end[i]]."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    total: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        n, d = x.shape
        depth = 0
        while n >> depth > LEAF:
            depth += 1
        nodes = (2 << depth) - 1
        start, end = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        low, high, total = (np.zeros((nodes, d), np.int64) for _ in range(3))
        order = np.arange(n)
        end[0] = n
        for i in range(nodes):
            a, b = int(start[i]), int(end[i])
            own = x[order[a:b]]
            low[i], high[i], total[i] = own.min(axis=0), own.max(axis=0), own.sum(axis=0)
            if 2 * i + 2 < nodes:
                mid = (a + b) // 2
                wide = int((high[i] - low[i]).argmax()) if d else 0
                if d and high[i][wide] > low[i][wide]:
                    order[a:b] = order[a:b][np.argpartition(own[:, wide], mid - a)]
                start[2 * i + 1], end[2 * i + 1], start[2 * i + 2], end[2 * i + 2] = a, mid, mid, b
        return cls(order, start, end, low, high, total)


def eliminate(low: np.ndarray, high: np.ndarray, entries: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Of boxes (nodes x d) and their candidates (nodes x entries, boolean): those that may be nearest to a point within the box, equal
    distances going to the lower entry."""
    middle = (low + high) / 2.0
    norms = (entries * entries).sum(axis=1)
    far = norms - 2.0 * (middle @ entries.T)
    far[~alive] = np.inf
    best = far.argmin(axis=1)
    out = alive.copy()
    for i in range(len(low)):
        at = np.flatnonzero(alive[i])
        step = entries[at] - entries[best[i]]
        # by how much an entry is farther than the best one, at that corner of the box where it is so the least
        least = norms[at] - norms[best[i]] - 2 * np.where(step > 0, high[i] * step, low[i] * step).sum(axis=1)
        out[i, at] = (least < 0) | (least == 0) & (at < best[i]) | (at == best[i])
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point its nearest entry (the lowest of equals) and the squared distance."""
    far = (entries * entries).sum(axis=1) - 2 * (x @ entries.T)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at] + (x * x).sum(axis=1)


def assign(tree: Tree, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(sums, counts, codes, compared): of each entry the sum and number of its points, of each point its entry, and how many pairs of point
    and entry were compared one by one."""
    sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
    codes, compared = np.empty(len(x), np.int64), 0
    level, alive = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    while len(level):
        alive = eliminate(tree.low[level], tree.high[level], entries, alive)
        one = alive.sum(axis=1) == 1
        whole, to = level[one], alive[one].argmax(axis=1)
        np.add.at(sums, to, tree.total[whole])
        np.add.at(counts, to, tree.end[whole] - tree.start[whole])
        for i, e in zip(whole.tolist(), to.tolist()):
            codes[tree.order[tree.start[i] : tree.end[i]]] = e
        level, alive = level[~one], alive[~one]
        inner = 2 * level + 2 < len(tree.start)
        for i, own in zip(level[~inner].tolist(), alive[~inner]):
            at, points = np.flatnonzero(own), tree.order[tree.start[i] : tree.end[i]]
            code = at[nearest(x[points], entries[at])[0]]
            compared += len(at) * len(points)
            codes[points] = code
            np.add.at(sums, code, x[points])
            np.add.at(counts, code, 1)
        level, alive = level[inner], alive[inner]
        level, alive = np.concatenate((2 * level + 1, 2 * level + 2)), np.concatenate((alive, alive))
    return sums, counts, codes, compared


TREES = "chunk long, ids array<long>, labels array<string>, points binary, " + ", ".join(f"{c} binary" for c in ("orders", "starts", "ends", "lows", "highs", "totals"))
_STORED = [f.split()[0] for f in TREES.split(", ")]


def grow(vectors: DataFrame, width: int) -> DataFrame:
    """Chunks of vectors (vec_id, vector, label) with their trees (see TREES)."""
    tune(vectors.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, rows = [], 0

        def close(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, held, rows
            while rows >= CHUNK or all_of_it and rows:
                table = pa.Table.from_batches(held)
                own = table.slice(0, CHUNK).combine_chunks()
                ids, vectors_, labels = (own.column(c).chunk(0) for c in ("vec_id", "vector", "label"))
                held = table.slice(CHUNK).to_batches()
                rows -= own.num_rows
                x = integers(vectors_, width)
                trees = [Tree.build(part) for part in np.split(x, PARTS, axis=1)]
                kinds = [("order", "<i4"), ("start", "<i4"), ("end", "<i4"), ("low", "<i4"), ("high", "<i4"), ("total", "<i8")]
                packed = [b"".join(np.ascontiguousarray(getattr(t, c), kind).tobytes() for t in trees) for c, kind in kinds]
                cols = [pa.array([number], pa.int64()), pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([labels.to_pylist()], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([p], pa.binary()) for p in (x.astype("<i4").tobytes(), *packed))], _STORED)
                number += 1

        for b in batches:
            held.append(b)
            rows += b.num_rows
            yield from close(False)
        yield from close(True)

    return vectors.mapInArrow(run, TREES)


def _read(row: dict, width: int) -> tuple[list, np.ndarray, list[Tree]]:
    n, d = len(row["ids"]), width // PARTS
    get = lambda c, kind: np.frombuffer(row[c], kind).astype(np.int64)
    orders, starts, ends = (get(c, "<i4").reshape(PARTS, -1) for c in ("orders", "starts", "ends"))
    lows, highs, totals = (get(c, k).reshape(PARTS, -1, d) if d else np.zeros((PARTS, starts.shape[1], 0), np.int64) for c, k in (("lows", "<i4"), ("highs", "<i4"), ("totals", "<i8")))
    trees = [Tree(*(x[p] for x in (orders, starts, ends, lows, highs, totals))) for p in range(PARTS)]
    return row["ids"], get("points", "<i4").reshape(n, width), trees


def lloyd_round(trees: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks (PARTS x entries x d) after one round: each entry is the floor of its points' mean; unused ones stay."""
    width = PARTS * codebooks.shape[2]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(codebooks), np.zeros(codebooks.shape[:2], np.int64)
        for b in batches:
            for row in b.to_pylist():
                _, x, own = _read(row, width)
                for p, part in enumerate(np.split(x, PARTS, axis=1)):
                    s, c, *_ = assign(own[p], part, codebooks[p])
                    sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    each = trees.mapInArrow(run, "part long, entry long, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(codebooks.shape[2])]
    out = codebooks.copy()
    for r in each.groupBy("part", "entry").agg(F.sum("n"), *added).collect():  # PARTS * ENTRIES rows at most
        out[r[0], r[1]] = np.array(r[3:], np.int64) // r[2]
    return out


def encode(trees: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, codes: array of PARTS entry numbers, error: the squared distances to those entries, summed)."""
    width = PARTS * codebooks.shape[2]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, x, own = _read(row, width)
                codes = np.stack([assign(own[p], part, codebooks[p])[2] for p, part in enumerate(np.split(x, PARTS, axis=1))], 1)
                near = np.concatenate([codebooks[p][codes[:, p]] for p in range(PARTS)], axis=1)
                error = ((x - near) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(row["labels"], pa.string()), pa.array(list(codes), pa.list_(pa.int64())), pa.array(error)], ["vec_id", "label", "codes", "error"])

    return trees.mapInArrow(run, "vec_id long, label string, codes array<long>, error long")


def fit(vectors: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Codebooks (PARTS x entries x d) after ROUNDS rounds, and the trees' table. vectors: see kept_vectors, at least one."""
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    width = len(first[0]["vector"])
    if width % PARTS:
        raise ValueError(f"vectors of {width} components have no {PARTS} equal parts")
    start = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width)
    codebooks = np.stack(np.split(start, PARTS, axis=1))
    trees = written(grow(vectors, width), "trees")
    for _ in range(ROUNDS):
        codebooks = lloyd_round(trees, codebooks)
    return codebooks, trees


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), a row for each vector kept; other columns are not read.

    Codebooks start with the ENTRIES smallest vec_ids (fewer vectors: all of them); null ids come last, equal ids by their vectors.
    Repeated rows stay and count as often as they stand there. label_error adds the errors of rows whose label is the same, nulls together.
    No vector kept: no row. Vectors must be of one length that has four equal parts, and components within 8192; else an error is raised,
    as no rows are dropped for it."""
    plain, names = nameless(df)
    vectors = kept_vectors(plain, *(names[df.columns.index(c)] for c in (id_col, vec_col, label_col)))
    if vectors.isEmpty():
        return vectors.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    codebooks, trees = fit(vectors)
    coded = written(encode(trees, codebooks), "codes")
    added = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    code = F.lower(F.concat(*(F.lpad(F.hex(F.col("codes")[p]), 2, "0") for p in range(PARTS))))
    return coded.join(added, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """DuckDB SQL for the rows of op12: rounds one after the other over (part, vector, entry)."""
    far = "CAST(list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    parts = [
        "k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"x AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM x WHERE r < {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT p, r, min((far, e)) AS m FROM (SELECT x.p, x.r, c.e, {far} AS far FROM x JOIN c{n} c ON x.p = c.p) GROUP BY p, r)")
        if n < ROUNDS:
            means = f"SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT a.p, a.m[2] AS e, i, sum(x.x[i]) AS s, count(*) AS n FROM a{n} a JOIN x USING (p, r), generate_series(1, len(x.x)) g(i) GROUP BY ALL) GROUP BY p, e"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN ({means}) m USING (p, e))")
    parts.append(f"f AS (SELECT r, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    digest_ = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM c{ROUNDS})"
    return f"WITH {', '.join(parts)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest_} AS codebooks_sha256 FROM k JOIN f USING (r)"


SQL = _sql()
