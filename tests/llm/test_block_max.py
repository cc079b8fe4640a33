"""Ranked search against a brute-force version."""

import math
import re
from collections import Counter

from quillon.llm import block_max, queries

from helpers import AWKWARD, LONG, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, asked, k=10):
    held = [(i, Counter(split(t))) for i, t in rows]
    held = [(i, c, c.total()) for i, c in held if c]
    n_docs, words = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
    out = []
    for item, text in asked:
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * n_docs) // words
            scores.append((-sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in split(text) if c[t]), i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted((x for x in scores if x[0] < 0), key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=repr)


def asked(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "The QUICK brown fox, fox"), (2, None), (3, ""), (4, "漢字 x y Ünïcödé"), (5, "nothing-here"), (6, "w1 w2 w3 a"), (7, "the the")]


def test_awkward_rows_as_brute_force(spark):
    assert found(block_max.rank_documents(docs(spark, AWKWARD), asked(spark, [*ITEMS, ITEMS[0]]))) == brute(AWKWARD, ITEMS)


def test_an_item_id_with_two_texts_is_one_query(spark):
    both = block_max.rank_documents(docs(spark, AWKWARD), asked(spark, [(1, "quick"), (1, "fox"), (None, "lost"), (None, "words")]))
    assert found(both) == brute(AWKWARD, [(1, "quick fox"), (None, "lost words")])


def test_empty_tables(spark):
    assert found(block_max.rank_documents(docs(spark, []), asked(spark, ITEMS))) == []
    assert found(block_max.rank_documents(docs(spark, AWKWARD), asked(spark, []))) == []
    assert found(block_max.rank_documents(docs(spark, [(1, None), (2, " ,.")]), asked(spark, ITEMS))) == []


def test_ties_over_blocks_go_to_the_smaller_id(spark):
    rows = [(i, "same words here") for i in range(400, 0, -1)] + [(1000 + i, f"filler number {i}") for i in range(400)]
    got = found(block_max.rank_documents(docs(spark, rows).coalesce(2), asked(spark, [(1, "words")])))
    assert [r[2] for r in got] == sorted(range(1, 11), key=lambda i: repr((1, i)))
    assert got == brute(rows, [(1, "words")])


def test_blocks_under_the_threshold_are_not_scored(spark, monkeypatch):
    rows = [(i, f"common topic{i // 100} detail{i}") for i in range(4000)]
    rows += [(10_000 + i, "rare gem " * 3) for i in range(12)]
    seen, score = [], block_max._score
    monkeypatch.setattr(block_max, "_score", lambda index, pairs, *a: (seen.append(pairs.count()), score(index, pairs, *a))[1])
    items = [(1, "rare gem common"), (2, "topic7 detail701")]
    got = found(block_max.rank_documents(docs(spark, rows).coalesce(1), asked(spark, items)))
    assert got == brute(rows, items)
    blocks = -(-len(rows) // block_max.DOCS)
    assert sum(seen) < blocks  # of two queries with a term in every block


def test_long_texts_make_blocks_of_their_own(spark):
    rows = [(1, LONG * 6), (2, "w1 w2"), (3, LONG)]
    index = block_max.build_index(docs(spark, rows).coalesce(1))
    assert index.blocks.count() == 2 and index.docs == 3
    assert found(block_max.search(index, asked(spark, [(1, "w1 w2 w4999")]))) == brute(rows, [(1, "w1 w2 w4999")])


def test_large_query_sets_travel_with_their_pairs(spark, monkeypatch):
    for name in ("FEW", "PAIRS", "TOLD"):
        monkeypatch.setattr(block_max, name, 0)
    monkeypatch.setattr(block_max, "ASKED", 2)
    assert found(block_max.rank_documents(docs(spark, AWKWARD), asked(spark, ITEMS))) == brute(AWKWARD, ITEMS)


def test_products_beyond_64_bits():
    import numpy as np

    n, docs_, words = 10**9, 10**11, 5 * 10**13
    assert block_max.length_norms(np.array([n, 500]), docs_, words).tolist() == [25 + 75 * x * docs_ // words for x in (n, 500)]


def test_query_as_its_sql(spark, duck):
    from conftest import SF

    assert found(queries.op13_block_max(spark, SF)) == sorted(duck.execute(f"SELECT item_id, rank, doc_id, score FROM ({block_max.SQL})").fetchall(), key=repr)
