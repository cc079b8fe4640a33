"""The pipeline's near copies against brute-force Jaccard over five words."""

import random

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from helpers import AWKWARD, docs

from quillon.llm import near_copies


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(data):
    """Ids that are the smallest of their group."""
    sets = [plain_shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root(i) != root(j):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(data):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(least.values())


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.randrange(10**9)}"
    return words


def test_copies_at_0_8_go(spark):
    rng = random.Random(5)
    data = []
    for k in range(40):
        base = [f"b{k}_{i}" for i in range(200)]
        for n in (0, 1, 2, 3, 4, 5, 6, 9, 20):
            data.append((rng.randrange(10**12), " ".join(edited(rng, base, n))))
        data.append((rng.randrange(10**12), " ".join(base).upper()))
    got = corpus_pipeline.near_dedup(spark, docs(spark, data), SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == brute_kept(data)


def test_unlike_texts_of_one_id_stay(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(100)) for x in "ab")
    got = corpus_pipeline.near_dedup(spark, docs(spark, [(1, a), (2, a), (2, b), (2, b), (None, a)]), SF)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, a), (2, b), (None, a)], key=repr)


def test_large_meetings_make_few_pairs(monkeypatch):
    monkeypatch.setattr(near_copies, "AT_ONCE", 16)
    sets = [near_copies.shingles(" ".join(edited(random.Random(i), [f"w{k}" for k in range(300)], 2)).encode()) for i in range(100)]
    checks = np.stack([near_copies.long_fingerprint(s)[1] for s in sets])
    i, j, cut = near_copies.tree(checks, near_copies.FEW)
    assert set(i.tolist()) == set(range(1, 100)) and (j < i).all() and len(i) <= 99 * near_copies.FEW and cut


def test_parts_meet_within_one_bit():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << near_copies.BITS, near_copies.PARTS).astype(np.uint32)
    for bits in range(4):
        flips = [sum(1 << int(k) for k in rng.choice(near_copies.BITS, bits, replace=False)) for _ in a]
        keys = [set(near_copies.variants(x[None])[0].tolist()) for x in (a, a ^ np.array(flips, np.uint32))]
        met = {k >> near_copies.BITS for k in keys[0] & keys[1]}
        assert len(met) == near_copies.PARTS if bits < 2 else bits == 2 or not met


def test_pairs_of_later_rounds_come_from_their_first_meeting():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 1 << near_copies.BITS, (300, near_copies.PARTS)).astype(np.uint32)
    b = a.copy()
    for _ in range(40):
        row, part = rng.integers(0, 300, 300), rng.integers(0, near_copies.PARTS, 300)
        b[row, part] ^= np.uint32(1) << rng.integers(0, near_copies.BITS, 300).astype(np.uint32)
    first = near_copies.first_meeting(a, b)
    assert (first == near_copies.first_meeting(b, a)).all()
    for x, y, key in zip(a, b, first.tolist()):
        both = np.intersect1d(near_copies.variants(x[None])[0], near_copies.variants(y[None])[0])
        assert key == (both.min() if len(both) else 1 << 40)


def test_pairs_at_0_8_meet():
    """Sets of 900 shingles that share 800: the share that meets and passes the check bits."""
    rng = np.random.default_rng(4)
    found = 0
    for _ in range(200):
        a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (900, 100))
        (p, x), (q, y) = (near_copies.long_fingerprint(s) for s in (a, np.concatenate((a[:800], b))))
        found += bool(np.intersect1d(near_copies.variants(p[None])[0], near_copies.variants(q[None])[0]).size) and near_copies.apart(x, y) <= near_copies.MAYBE
    assert found >= 0.93 * 200


def test_long_checks_tell_alike_from_unlike():
    """Sets of 900 shingles that share 800 (0.8) and 741 (0.7): which pairs later rounds verify."""
    rng = np.random.default_rng(6)
    passed = dict.fromkeys((800, 741), 0)
    for shared in passed:
        for _ in range(150):
            a, b = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (900, 900 - shared))
            x, y = (near_copies.check_words(s, near_copies._LONG_FLIPS, near_copies._LONG_TIMES) for s in (a, np.concatenate((a[:shared], b))))
            passed[shared] += int(near_copies.apart(x, y) <= near_copies.LONG_MAYBE)
    assert passed[800] >= 148 and passed[741] <= 15


def test_members_of_open_meetings_come_back_by_meeting(spark):
    """Two components and a loose node at one meeting, all alike by their bits: pairs across components only, each once."""
    rng = np.random.default_rng(2)
    parts, long = rng.integers(0, 1 << near_copies.BITS, near_copies.PARTS).astype(np.uint32), rng.integers(0, 1 << 62, near_copies.LONG // 64).astype("<u8")
    nodes = [5, -3, 7, 11, -20]
    known = spark.createDataFrame([(n, g, bytearray(long.tobytes()), bytearray(parts.tobytes())) for n, g in zip(nodes, (5, 5, 5, 11, -20))], "node long, group long, long binary, parts binary")
    keys = near_copies.variants(parts[None])[0]
    blobs = [b["rows"].to_pylist()[0] for b in near_copies._open(np.repeat(keys, 5), np.array(nodes * len(keys)))]
    rest = spark.createDataFrame([(bytearray(b),) for b in blobs], "rows binary")
    got = near_copies.left_out(rest, known, 10).where("u is not null").collect()
    assert sorted((r["u"], r["v"]) for r in got) == sorted((min(a, b), max(a, b)) for a, b in [(11, 5), (11, -3), (11, 7), (11, -20), (-20, 5), (-20, -3), (-20, 7)])


@pytest.mark.parametrize(("few", "edits"), [(1, 9), (2, 12), (8, 5)])
def test_large_groups_lose_no_link(spark, monkeypatch, few, edits):
    """Groups that are just similar enough, with few partners at first: later rounds find what is left."""
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "SMALL", 4)
    rng = random.Random(few)
    data = []
    for k in range(3):
        base = [f"b{k}_{i}" for i in range(400)]
        data += [(len(data), " ".join(edited(rng, base, edits))) for _ in range(60)]
    got = corpus_pipeline.near_dedup(spark, docs(spark, data), SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == brute_kept(data)


def test_edges(spark):
    got = corpus_pipeline.near_dedup(spark, docs(spark, AWKWARD), SF)
    assert sorted((r["doc_id"] for r in got.collect()), key=repr) == sorted([None, 1, 2, 6, 7, 8, 10], key=repr)
    assert corpus_pipeline.near_dedup(spark, docs(spark, []), SF).count() == 0
