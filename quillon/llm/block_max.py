"""Ranked lexical search with block-max pruning.

The index is a table of blocks: runs of documents in the order in which they are stored. A block is a forward index of at most DOCS documents, with each one's
length and its terms' frequencies, over a dictionary of the block that holds for every term the largest part of a score that a document of
the block gets from it, and how many documents hold it. Terms stand there as 64-bit XXH64 values.

A search sums these maxima to a bound for each query and block, and sorts a query's blocks by it. The FIRST best blocks of each query are
scored at once; the k-th best score so far is a threshold, and only blocks with a bound not under it are read after that. There each task takes
the blocks of a query by falling bound and stops at the first that lies under the task's own k-th best score. So blocks are left out only
where none of their documents can be among the k best, and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import lean, nameless, texts_of, tune, written

#: Documents and words up to which a block is filled, and words that a task knows by number.
DOCS, WORDS, KNOWN = 64, 1 << 18, 500_000
#: Blocks of a query that are scored first.
FIRST = 8
#: Queries that a row of a block carries at most.
ASKED = 256
#: Bytes of blocks that a task holds at once.
HELD = 24 << 20
#: Block numbers whose filter, pairs of query and block, and terms of all queries that may be broadcast (8, 24 and 16 bytes each).
FEW, PAIRS, TOLD = 4_000_000, 1_000_000, 2_000_000

#: Bytes of terms: digits, lower-case letters and all beyond ASCII; A-Z are lowered, all others part terms.
_TERM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split()


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


class _Vocabulary(dict):
    """Numbers of words, given out as they come, with the words' hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(term_hash(word))
        return n


BLOCK = "block long, doc_ids array<long>, terms array<long>, most array<int>, docs array<int>, lengths binary, starts binary, at binary, tf binary"


def _block(number: int, ids: list, numbers: list[np.ndarray], hashes: list[int], docs: int, words: int) -> list:
    lengths = np.array([len(x) for x in numbers], np.int64)
    key = np.repeat(np.arange(len(ids), dtype=np.int64) << 32, lengths) | np.concatenate(numbers)
    key, tf = np.unique(key, return_counts=True)
    known, at = np.unique(key & 0xFFFFFFFF, return_inverse=True)
    own = np.array([hashes[i] for i in known.tolist()], np.int64)
    order = np.argsort(own)
    place = np.empty(len(own), np.uint32)
    place[order] = np.arange(len(own), dtype=np.uint32)
    at = place[at]
    starts = np.searchsorted(key >> 32, np.arange(len(ids) + 1)).astype(np.int64)
    by_term = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[by_term], np.arange(len(own)))
    most = np.maximum.reduceat(score_parts(lengths, starts, tf, docs, words)[by_term], cuts)
    return [number, ids, own[order], most.astype(np.int32), np.diff(np.r_[cuts, len(at)]).astype(np.int32), lengths.tobytes(), starts.tobytes(), at.tobytes(), tf.astype(np.uint32).tobytes()]


def score_parts(lengths: np.ndarray, starts: np.ndarray, tf: np.ndarray, docs: int, words: int) -> np.ndarray:
    """What each posting gives for a term of weight 1."""
    m = np.repeat(length_norms(lengths, docs, words), np.diff(starts))
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def counts(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """The number of documents with at least one term, and of all their terms."""
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = words = 0
        for b in batches:
            for text in texts_of(b, "text"):
                n = len(terms(text))
                docs, words = docs + (n > 0), words + n
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64())], ["docs", "words"])

    each = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "docs long, words long")
    return tuple(each.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())


def blocks_of(df: DataFrame, docs: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks (see BLOCK) of all documents with at least one term. docs and words: see counts."""
    tune(df.sparkSession)
    columns = [f.split()[0] for f in BLOCK.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        vocabulary, ids, numbers, filled = _Vocabulary(), [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, vocabulary, filled
            if ids:
                row = _block(number, list(ids), numbers, vocabulary.hashes, docs, words)
                kinds = (pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], columns)
                number, filled = number + 1, 0
                ids.clear()
                numbers.clear()
            if len(vocabulary) > KNOWN:
                vocabulary = _Vocabulary()

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), texts_of(b, "text")):
                if own := terms(text):
                    if ids and filled + len(own) > WORDS:
                        yield from close()
                    ids.append(i)
                    numbers.append(np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)))
                    filled += len(own)
                    if len(ids) == DOCS:
                        yield from close()
        yield from close()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, BLOCK)


@dataclass
class Block:
    """A block as read by a task: parts[i] is what posting i gives for a term of weight 1."""

    doc_ids: list
    terms: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    parts: np.ndarray

    @classmethod
    def read(cls, row: dict, docs: int, words: int) -> Block:
        lengths, starts = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["starts"], np.int64)
        tf = np.frombuffer(row["tf"], np.uint32).astype(np.int64)
        return cls(row["doc_ids"], row["terms"], starts, np.frombuffer(row["at"], np.uint32), score_parts(lengths, starts, tf, docs, words))

    def scores(self, asked: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The score of each document for terms with weights (repeats are in these)."""
        weight = np.zeros(len(self.terms) + 1, np.int64)
        place = np.searchsorted(self.terms, asked)
        there = place < len(self.terms)
        there[there] = self.terms[place[there]] == asked[there]
        weight[place[there]] = weights[there]
        return np.add.reduceat(self.parts * weight[self.at], self.starts[:-1])


def length_norms(lengths: np.ndarray, docs: int, words: int) -> np.ndarray:
    """100 - 75 + (75 n N) div L, in 64-bit integers where these suffice for the product."""
    if len(lengths) and int(lengths.max()) * 75 * docs >= 1 << 63:
        return np.array([25 + 75 * n * docs // words for n in lengths.tolist()], np.int64)
    return 25 + 75 * lengths * docs // words


@dataclass
class Index:
    """blocks (see BLOCK), the number of documents with terms, and of all their terms."""

    blocks: DataFrame
    docs: int
    words: int


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents. Rows are documents: repeated ones count as often as they stand there. Null texts and texts without
    terms are in no block and count nowhere; other columns are not read; an empty table gives an empty index."""
    docs, words = counts(df, text_col)
    return Index(written(blocks_of(df, docs, words, id_col, text_col), "blocks"), docs, words)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, item, term, times): item numbers the queries. Rows that agree in id and text are one query; unlike texts under one id, as
    under the null id, are one query with the terms of all of them."""

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in zip(b.column("item_id"), texts_of(b, "text")):
                own = np.array([term_hash(t) for t in terms(text)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(own), pa.int64()), pa.array(own)], ["item_id", "term"])

    named = queries.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    told = written(named.mapInArrow(split, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times")), "asked")
    items = written(told.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    return told.join(items, told["item_id"].eqNullSafe(items["item_id"])).select(items["item_id"], "item", "term", "times")


def term_weight(df: Column, docs: int) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles."""
    return F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * docs + 2.0) / (F.lit(2.0) * df.cast("double") + F.lit(1.0))))


def _score(index: Index, pairs: DataFrame, defined: DataFrame, k: int, parts: int) -> DataFrame:
    """(item, doc_id, score): the k best of each task for pairs (item, block, bound, least). defined: (item, terms, weights)."""
    docs, words, spark = index.docs, index.words, pairs.sparkSession
    few = pairs.select("block").distinct()
    blocks = index.blocks.select("block", "doc_ids", "terms", "lengths", "starts", "at", "tf")
    blocks = blocks.join(F.broadcast(few) if few.count() <= FEW else few, "block", "left_semi")
    told = None
    if defined.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] <= TOLD:
        told = spark.sparkContext.broadcast({r["item"]: (r["terms"], r["weights"]) for r in defined.collect()})
        full = pairs.withColumns({c: F.lit(None).cast("array<long>") for c in ("terms", "weights")})
    else:  # they travel with the pairs
        full = pairs.join(defined, "item")
    asked = F.collect_list(F.struct("item", "bound", "least", "terms", "weights")).alias("asked")
    grouped = full.groupBy("block", F.pmod(F.xxhash64("item"), F.lit(parts)).alias("part")).agg(asked).drop("part")
    if told is not None and pairs.count() <= PAIRS:
        grouped = F.broadcast(grouped)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        held, size = [], 0

        def close() -> None:
            """Score the blocks held, for each query by falling bound."""
            wanted: dict[int, list] = {}
            for block, asked in held:
                for q in asked:
                    wanted.setdefault(q["item"], []).append((q["bound"], block, q))
            for item, own in wanted.items():
                own.sort(key=lambda x: -x[0])
                kept = best.setdefault(item, [])
                terms_, weights = map(np.array, told.value[item] if told is not None else (own[0][2]["terms"], own[0][2]["weights"]))
                for bound, block, q in own:
                    least = max(q["least"], -kept[-1][0] if len(kept) == k else 0)
                    if bound < least:
                        break
                    s = block.scores(terms_, weights)
                    at = np.flatnonzero((s >= least) & (s > 0)).tolist()
                    kept += [(-int(s[i]), block.doc_ids[i] is None, block.doc_ids[i] or 0) for i in at]
                    kept.sort()
                    del kept[k:]
            held.clear()

        for b in batches:
            lists = b.column("terms")
            flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
            for n, row in enumerate(b.drop_columns(["terms"]).to_pylist()):
                block = Block.read(row | {"terms": flat[cuts[n] : cuts[n + 1]].copy()}, docs, words)
                held.append((block, row["asked"]))
                size += 12 * len(block.at) + 8 * len(block.terms)
                if size > HELD:
                    close()
                    size = 0
        close()
        rows = [(item, None if null else i, -s) for item, own in best.items() for s, null, i in own]
        cols = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    return blocks.join(grouped, "block").mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest score above 0 for each query, equal scores by ascending doc_id (null
    ids last). Queries without terms, or whose terms no document holds, have no rows; see query_terms for null and repeated ids. An
    empty index or no queries give no rows."""
    told = written(query_terms(queries, id_col, text_col), "terms")
    single = told.select("term").distinct()
    entries = index.blocks.select("block", F.explode(F.arrays_zip("terms", "most", "docs")).alias("x")).select("block", F.col("x.terms").alias("term"), "x.most", "x.docs")
    hits = written(entries.join(single, "term"), "hits")
    weights = hits.groupBy("term").agg(F.sum("docs").alias("docs")).select("term", term_weight(F.col("docs"), index.docs).alias("weight"))
    weighted = written(told.join(weights, "term").select("item_id", "item", "term", (F.col("times") * F.col("weight")).alias("weight")), "weighted")
    bounds = hits.join(weighted, "term").groupBy("item", "block").agg(F.sum(F.col("most") * F.col("weight")).alias("bound")).where("bound > 0")
    bounds = written(bounds, "bounds")
    defined = weighted.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    parts = -(-weighted.select("item").distinct().count() // ASKED) or 1

    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound"), "block"))
    first = written(bounds.withColumn("place", place).where(F.col("place") <= FIRST).select("item", "block", "bound", F.lit(0).cast("long").alias("least")), "first")
    best = written(_ranked(_score(index, first, defined, k, parts), k).select("item", "doc_id", "score"), "best")
    least = best.groupBy("item").agg(F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("least"))
    later = bounds.join(first.select("item", "block"), ["item", "block"], "left_anti").join(least, "item", "left")
    later = written(later.select("item", "block", "bound", F.coalesce("least", F.lit(0)).alias("least")).where("bound >= least"), "later")
    found = _ranked(best.unionByName(_score(index, later, defined, k, parts)), k)
    items = weighted.select("item", "item_id").distinct()
    return found.join(items, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(df: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """search() over an index of df (doc_id, text) for queries (item_id, text); other columns are not read."""
    plain, names = nameless(df)
    return search(build_index(plain, names[df.columns.index("doc_id")], names[df.columns.index("text")]), queries, k)


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
SQL = f"""
WITH d AS (SELECT *, row_number() OVER () AS r FROM documents), w AS (SELECT r, doc_id, {_TERMS} AS t FROM d),
q AS (SELECT item_id, {_TERMS} AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)), p AS (SELECT r, doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
n AS (SELECT r, count(*) AS n FROM w GROUP BY r), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
f AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY t),
g AS (SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)) AS part FROM p JOIN n USING (r), s WHERE t IN (SELECT t FROM q)),
x AS (SELECT item_id, r, doc_id, CAST(sum(weight * part) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN g USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
