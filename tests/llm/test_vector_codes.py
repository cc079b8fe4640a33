"""Vector codes against a brute-force version."""

import hashlib
import math

import numpy as np
import pytest

from quillon.llm import queries, vector_codes as V


def brute(rows):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    x = np.array([r[1] for r in kept], np.int64)
    parts = np.split(x, 4, axis=1)
    books = [p[:256].copy() for p in parts]

    def assigned():
        return [((p[:, None] - b[None]) ** 2).sum(axis=2) for p, b in zip(parts, books)]

    for _ in range(4):
        for p, b, far in zip(parts, books, assigned()):
            at = far.argmin(axis=1)
            for e in np.unique(at):
                own = p[at == e]
                b[e] = [int(s) // len(own) for s in own.sum(axis=0)]
    fars = assigned()
    codes, errors = np.stack([f.argmin(axis=1) for f in fars], 1), sum(f.min(axis=1) for f in fars)
    by = {}
    for r, e in zip(kept, errors.tolist()):
        by[r[2]] = by.get(r[2], 0) + e
    told = hashlib.sha256(",".join(str(c) for b in books for entry in b.tolist() for c in entry).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), e, by[r[2]], told) for r, code, e in zip(kept, codes.tolist(), errors.tolist())), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "x", 2) for r in rows], "vec_id long, embedding array<float>, label int, error double, code string, row int")


def found(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(n, d, seed=0, spread=1.0, step=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, spread, (n, d))
    return (np.round(x / step) * step if step else x).astype(np.float32).tolist()


def test_trees_assign_as_all_pairs_do():
    rng = np.random.default_rng(3)
    for d, n, entries, high in ((1, 300, 40, 20), (3, 1000, 256, 8), (16, 500, 256, 900), (2, 5, 3, 3)):
        x, e = rng.integers(-high, high, (n, d)), rng.integers(-high, high, (entries, d))
        tree = V.Tree.build(x)
        sums, counts, codes, compared = V.assign(tree, x, e)
        want = V.nearest(x, e)[0]
        assert codes.tolist() == want.tolist() and counts.tolist() == np.bincount(want, minlength=entries).tolist()
        assert all((sums[k] == x[want == k].sum(axis=0)).all() for k in range(entries))
        assert compared <= n * entries


def test_boxes_spare_most_comparisons_where_points_cluster():
    rng = np.random.default_rng(5)
    centres = rng.integers(-8000, 8000, (256, 8))
    x = centres[rng.integers(0, 256, 4096)] + rng.integers(-3, 3, (4096, 8))
    assert V.assign(V.Tree.build(x), x, centres)[3] < 0.1 * len(x) * 256


def test_small_tables_as_brute_force(spark):
    nan, inf = float("nan"), float("inf")
    awkward = [(900, None, 1), (901, [nan] * 8, 1), (902, [inf] + [0.0] * 7, 2), (903, [None] + [0.0] * 7, 2), (None, [0.25] * 8, 3), (5, [-0.0004] * 8, None), (5, [-0.0004] * 8, None)]
    for n, step, parts in ((0, None, 1), (40, None, 3), (700, 0.5, 5), (700, None, 1)):
        rows = [(7 * i % 1009, v, i % 3 or None) for i, v in enumerate(vectors(n, 8, n, step=step))] + awkward
        assert found(V.vector_codes(table(spark, rows).repartition(parts))) == brute(rows)


def test_more_than_a_chunk_and_hot_copies(spark):
    rows = [(i, v, 1) for i, v in enumerate(vectors(V.CHUNK + 900, 4, 1))] + [(10_000 + i, [1.5, 2.5, -3.0, 0.0], 2) for i in range(2500)]
    assert found(V.vector_codes(table(spark, rows).coalesce(1))) == brute(rows)


def test_empty_and_wrong_tables(spark):
    assert found(V.vector_codes(table(spark, []))) == []
    assert found(V.vector_codes(table(spark, [(1, None, 1)]))) == []
    assert [r[:4] for r in found(V.vector_codes(table(spark, [(1, [], 1), (2, [], 1)])))] == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    with pytest.raises(ValueError, match="equal parts"):
        V.vector_codes(table(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(Exception, match="other lengths"):
        V.vector_codes(table(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)])).collect()
    with pytest.raises(Exception, match="exact squared distances"):
        V.vector_codes(table(spark, [(1, [1e30] * 4, 1)])).collect()


def test_query_as_brute_force(spark):
    from conftest import SF

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(queries.op12_vector_codes(spark, SF)) == brute(rows)


def test_query_as_its_sql(spark, duck):
    from conftest import SF

    assert found(queries.op12_vector_codes(spark, SF)) == sorted(duck.execute(V.SQL).fetchall(), key=repr)
