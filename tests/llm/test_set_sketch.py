"""SetSketch near-duplicates against a brute-force version."""

import random

import numpy as np

from helpers import AWKWARD, LONG, docs
from quillon.llm import queries, set_sketch as S


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    by = {}
    for k, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    head = list(range(len(rows)))

    def find(k):
        while head[k] != k:
            head[k] = head[head[k]]
            k = head[k]
        return k

    for k, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= 80 * len(s | sets[j]):
                head[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(words, edits, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def corpus(seed, groups=40, n=120):
    """Groups of texts that are edited one from the other or all from one, at similarities around 0.8."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        last = base
        for _ in range(rng.randrange(1, 6)):
            last = (edited(last if g % 2 else base, rng.randrange(1, 5), rng)).split()
            texts.append(" ".join(last))
        texts.append(" ".join(base))
    rng.shuffle(texts)
    return [(1000 + i, t) for i, t in enumerate(texts)]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64)) for _ in range(2))
    union = np.union1d(a, b)
    assert (S.merge(S.sketch(a), S.sketch(b)) == S.sketch(union)).all()
    assert abs(S.cardinality(S.sketch(union)) / len(union) - 1) < 0.2
    assert not S.sketch(a[:0]).any() and (S.merge(S.sketch(a[:0]), S.sketch(a)) == S.sketch(a)).all()


def pairs_at(similar, count, rng, size=400, ratio=1.0):
    out = []
    for _ in range(count):
        pool = rng.integers(0, 1 << 64, 2 * size, dtype=np.uint64)
        both = round(similar * (size + ratio * size) / (1 + similar))
        out.append((np.sort(pool[:size]), np.sort(np.r_[pool[:both], pool[size : size + round(ratio * size) - both]])))
    return out


def test_likelihood_finds_the_similarity():
    rng = np.random.default_rng(2)
    for similar, ratio in ((0.5, 1.0), (0.8, 1.0), (0.8, 0.9), (0.95, 1.0), (0.1, 0.3)):
        pairs = pairs_at(similar, 200, rng, ratio=ratio)
        x, y = (np.stack([S.sketch(p[k], S.LONG) for p in pairs]) for k in (0, 1))
        n, m = (np.array([float(len(p[k])) for p in pairs]) for k in (0, 1))
        best, less = S.estimate(n, m, (x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1))
        assert abs(best.mean() - similar) < 0.02 and best.std() < 0.05
        if similar >= 0.8:
            assert S.plausible(n, m, x, y).all() and (less <= S.DEVIATION).all()
        else:
            assert not S.plausible(n, m, x, y).any()


def test_links_at_the_threshold_meet_over_five_seeds(monkeypatch):
    rng = np.random.default_rng(3)
    pairs = pairs_at(0.8, 500, rng)
    for seed in range(5):
        own = np.random.default_rng(seed)
        flips, times = (own.integers(0, 1 << 32, S.LONG, dtype=np.uint32) for _ in range(2))
        monkeypatch.setattr(S, "_FLIPS", flips)
        monkeypatch.setattr(S, "_TIMES", times | np.uint32(1))
        x, y = (S.band_keys(np.stack([S.sketch(p[k]) for p in pairs])) for k in (0, 1))
        assert (x == y).any(axis=1).mean() >= 0.998


def test_unlike_sets_seldom_meet():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(0, 1 << 64, 400, dtype=np.uint64)) for _ in range(2000)]
    keys = S.band_keys(np.stack([S.sketch(s) for s in sets]))
    assert sum(len(keys) - len(np.unique(k)) for k in keys.T) < 20  # of 64 million pairs and bands


def test_awkward_rows_as_brute_force(spark):
    rows = [*AWKWARD, (11, LONG + " more"), (12, "A"), (13, "the QUICK brown"), (14, "the quick brown"), (None, "the quick\tbrown"), (None, None)]
    rows = [(i, None if t is None else t.replace("\x00", "")) for i, t in rows]
    want = brute(rows)
    want = sorted(((i, n, c, i == c) for i, n, c, _ in want), key=repr)
    assert found(S.near_duplicates(docs(spark, rows))) == want


def test_empty_table(spark):
    assert found(S.near_duplicates(docs(spark, []))) == []
    assert found(S.near_duplicates(docs(spark, [(1, None), (2, " ")]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_groups_as_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(S.near_duplicates(docs(spark, rows))) == brute(rows)


def test_a_large_group_and_strays(spark, monkeypatch):
    """Every text shares keys with hundreds of others, many at less than 0.8; slices and hot keys are split."""
    monkeypatch.setattr(S, "SLICE", 64)
    monkeypatch.setattr(S, "HOT", 32)
    monkeypatch.setattr(S, "AT_ONCE", 100)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(base, rng.randrange(2, 9), rng)) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(300)]
    assert found(S.near_duplicates(docs(spark, rows))) == brute(rows)


def test_query_as_its_sql(spark, duck):
    from conftest import SF

    assert found(queries.op11_set_sketch(spark, SF)) == sorted(duck.execute(S.SQL).fetchall(), key=repr)
