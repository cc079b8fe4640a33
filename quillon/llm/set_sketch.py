"""Near-duplicates by SetSketch registers: documents whose sets of four-word shingles agree to 0.8 or more (Jaccard).

A register holds the least of exponentially distributed hashes of a set's members, on a truncated scale whose steps grow by a factor of BASE: K =
floor(1 - log_BASE(least)), from 0 to LIMIT. Registers of a union are the larger ones of both, so sketches can be merged, and two
sets' registers are equal the likelier the more the sets agree.

1. Sketches: texts with one set are one node from here on.
2. Bands: ROWS registers make a key, BANDS keys a node. Nodes that share a key meet. Of two sets at 0.8 every register is equal with a
   chance of 0.8 at least, so a link is missed by all bands once in 30,000 times, where no chain of links spans it either.
3. Pairs: at first each node with the least node of each of its keys. Merged links give components, and only keys whose nodes lie in several of
   them are looked at again: nodes outside of a key's largest component are compared with all others there, in slices of bounded size, by their
   sketches. Each takes its few likeliest partners in other components; keys where that leaves some out come up again, with longer sketches of
   their nodes and more partners, at last with all.
4. Joint estimation: of the registers of a pair that are larger here, larger there, or equal, and of the sizes of both sets, follows the
   likelihood of each similarity. Pairs go on if 0.8 isn't far less likely than the likeliest one (a deviation of 4.5 at most).
5. Verification: both texts of a pair are read and their whole sets compared, in integers. Shingles are 64-bit hashes there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rewrite import PACKED, pack_texts, raw_text, unpacked
from .substring_dedup import prefix_sums, run_hashes, word_hashes
from .util import lean, nameless, tune, written

SHINGLE = 4
#: A link: PARTS * intersection >= SIMILAR * union.
SIMILAR, PARTS = 80, 100
#: Rows of a band, bands, the registers of these, and those of longer sketches, which begin with them.
ROWS, BANDS = 6, 32
REGISTERS, LONG = ROWS * BANDS, 1024
#: The registers' scale, its largest value, and the rate of the exponential distribution.
BASE, LIMIT, RATE = 1.1, 255, 20.0
#: How much less likely (as a logarithm) a similarity of 0.8 may be than the likeliest one.
DEVIATION = 4.5**2 / 2
#: Partners that a node takes in a slice, in rounds over the keys left: at first by its bands' registers, then by longer sketches; at last all.
FEW = (2, 32, None)
#: Nodes of a slice, and pairs whose likelihood is computed at once.
SLICE, AT_ONCE = 4096, 100_000
#: Rows of one key that a join sends to one task, and keys whose list may be broadcast (16 bytes each).
HOT, LISTED = 256, 1_000_000
#: Nodes whose texts are picked by a broadcast list (24 bytes each).
PICKED = 1_000_000

_rng = np.random.default_rng(11)
_FLIPS, _TIMES = (_rng.integers(0, 1 << 32, LONG, dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)


def shingle_set(raw: bytes) -> np.ndarray:
    """Hashes of the different runs of four words (ASCII lower case and white space), sorted; fewer words are one run."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(prefix_sums(word_hashes(words)), min(SHINGLE, len(words))))


def sketch(own: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The registers of a set of hashes; all 0 for an empty one."""
    if not len(own):
        return np.zeros(registers, np.uint8)
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(registers, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(short), 256):
        h = (short[first : first + 256, None] ^ _FLIPS[:registers]) * _TIMES[:registers]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        np.minimum(least, h.min(axis=0), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def cardinality(registers: np.ndarray) -> float:
    """The estimated size of a sketch's set."""
    return len(registers) * (1 - 1 / BASE) / (RATE * np.log(BASE) * (BASE ** -registers.astype(float)).sum())


def _unlike(x: np.ndarray) -> np.ndarray:
    """The chance that a register is larger in the set of which a share x of both sizes' sum isn't in the other."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _likelihood(similar: np.ndarray, u: np.ndarray, here: np.ndarray, there: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Logarithm of the likelihood of a similarity: u is the first set's share of both sizes' sum; here, there and same are how many registers
    are larger in the first and in the second set, and equal."""
    p, q = (np.maximum(_unlike(np.maximum(x, 0.0)), 1e-300) for x in (u - (1 - u) * similar, 1 - u - u * similar))
    return np.where(here > 0, here * np.log(p), 0) + np.where(there > 0, there * np.log(q), 0) + np.where(same > 0, same * np.log(np.maximum(1 - p - q, 1e-300)), 0)


def estimate(n: np.ndarray, m: np.ndarray, here: np.ndarray, there: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets with sizes n and m: the likeliest similarity, and by how much that is likelier than a link's least one (as a
    logarithm; 0 where it is a link's itself, infinite where the sizes allow no link)."""
    u = n / (n + m)
    top = np.minimum(n / m, m / n)
    low, high = np.zeros(len(u)), top.copy()
    for _ in range(32):  # the likelihood has one peak
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = _likelihood(a, u, here, there, same) > _likelihood(b, u, here, there, same)
        low, high = np.where(left, low, a), np.where(left, b, high)
    best, link = (low + high) / 2, SIMILAR / PARTS
    less = _likelihood(best, u, here, there, same) - _likelihood(np.full(len(u), link), u, here, there, same)
    return best, np.where(top < link - 1e-12, np.inf, np.where(best >= link, 0.0, less))


def plausible(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches (rows of a and b) with sizes n and m may be links."""
    here, there = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - here - there
    ok = same >= least_equal(a.shape[1])
    ok[ok] = estimate(n[ok], m[ok], here[ok], there[ok], same[ok])[1] <= DEVIATION
    return ok


def least_equal(registers: int) -> float:
    """Equal registers below which a pair surely is no link: 5.5 standard deviations under what 0.8 gives."""
    return 0.8 * registers - 5.5 * (0.16 * registers) ** 0.5


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """The keys (nodes x BANDS) of sketches."""
    h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sketches), 1))
    for k in range(ROWS):
        h = (h ^ sketches[:, k : k + ROWS * BANDS : ROWS].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def sketches_of(col: pa.Array, registers: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, registers)


def sketched(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, node, n, sketch): key is of the text, node of its set, n its size. Empty sets have neither node nor sketch."""
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, sketches = [], [], []
            for text in b.column("text").to_pylist():
                own = shingle_set(raw_text(text))
                sizes.append(len(own))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 11) - (1 << 63) if len(own) else None)
                sketches.append(sketch(own).tobytes() if len(own) else None)
            cols = [b.column("doc_id"), b.column("key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "node", "n", "sketch"])

    return _named(df, id_col, text_col).mapInArrow(run, "doc_id long, key long, node long, n long, sketch binary")


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def attach(rows: DataFrame, table: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """rows with the columns of table, which has one row for each value of `on`. Values with over HOT rows are dealt to several tasks by a hash
    of `by`, and their row of the table goes to each of those; the list of such values has at most one entry for HOT rows."""
    hot = written(rows.groupBy(on).agg(F.ceil(F.count("*") / HOT).alias("deals")).where("deals > 1"), "hot")
    n = hot.count()
    if not n:
        return rows.join(table, on, how)
    listed = F.broadcast(hot) if n <= LISTED else hot
    deals = F.coalesce("deals", F.lit(1))
    left = rows.join(listed, on, "left").withColumn("deal", F.pmod(F.xxhash64(by), deals)).drop("deals")
    right = table.join(listed, on, "left").withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("deals")
    return left.join(right, [on, "deal"], how).drop("deal")


def meetings(nodes: DataFrame) -> DataFrame:
    """(key, node, hub): every key that several nodes share, its nodes, and the least of these."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = band_keys(sketches_of(b.column("sketch")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("node").to_numpy(), BANDS))], ["key", "node"])

    rows = nodes.select("node", "sketch").mapInArrow(run, "key long, node long")
    shared = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    return rows.join(shared, "key")


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches may be links."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = plausible(*(b.column(c).to_numpy().astype(float) for c in ("n", "m")), sketches_of(b.column("x")), sketches_of(b.column("y")))
                at = pa.array(np.flatnonzero(good))
                yield pa.RecordBatch.from_arrays([b.column("u").take(at), b.column("v").take(at)], ["u", "v"])

    first = nodes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    second = nodes.select(F.col("node").alias("u"), "n", F.col("sketch").alias("x"))
    both = attach(attach(pairs, first, "v", "u"), second, "u", "v")
    return both.select("u", "v", "n", "m", "x", "y").mapInArrow(run, "u long, v long")


def still_open(met: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, group): the keys of met whose nodes lie in several components."""
    known = met.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("group"))
    mixed = known.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
    return known.join(mixed, "key")


def first_shared(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Whether the key is the first one that rows of keys share."""
    same = a == b
    return a[np.arange(len(a)), same.argmax(axis=1)] == key


def across(loose: DataFrame, nodes: DataFrame, registers: int, few: int | None) -> DataFrame:
    """(u, v, key), u < v: pairs that share a key of loose (see still_open), lie in unlike components there and may be links, of which each node outside of
    its key's largest component takes its `few` likeliest in a slice (None: all, each pair at the first key that both share). Keys
    where more than these were left out come as (null, null, key). nodes: (node, n, sketch of so many registers)."""
    sizes = loose.groupBy("key", "group").count().groupBy("key").agg(F.max(F.struct("count", "group")).alias("large"), F.sum("count").alias("k"))
    slices = lambda n: F.ceil(n / SLICE)
    sizes = sizes.select("key", F.col("large.group").alias("large"), slices(F.col("k")).alias("a_s"), slices(F.col("k") - F.col("large.count")).alias("b_s"))
    full = loose.join(sizes, "key").join(nodes.select("node", "n", "sketch"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    names = ["key", "a", "b", "small", "node", "group", "large", "n", "sketch"]
    a_side = full.withColumns({"a": own(F.col("a_s")), "small": F.lit(0)}).withColumn("b", every(F.col("b_s"))).select(names)
    b_side = full.where("group <> large").withColumns({"b": own(F.col("b_s")), "small": F.lit(1)}).withColumn("a", every(F.col("a_s"))).select(names)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {0: [], 1: []}

        def pairs(x: tuple, y: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Places in x and y of pairs that may be links, some nodes of y at a time, and how many registers are equal."""
            at, waiting = [], 0
            for j in range(len(y[0])):
                other = np.flatnonzero((x[1] != y[1][j]) & ((x[1] == x[2]) | (x[0] < y[0][j])))
                equal = (x[4][other] == y[4][j]).sum(axis=1)
                some = equal >= least_equal(registers)
                at.append((other[some], np.full(int(some.sum()), j), equal[some]))
                waiting += len(at[-1][0])
                if waiting and (waiting > AT_ONCE or j == len(y[0]) - 1):
                    i, k, equal = (np.concatenate(c) for c in zip(*at))
                    good = plausible(x[3][i], y[3][k], x[4][i], y[4][k])
                    if few is None:
                        good[good] = first_shared(band_keys(x[4][i[good]]), band_keys(y[4][k[good]]), cell[0])
                    yield i[good], k[good], equal[good]
                    at, waiting = [], 0

        def close() -> Iterator[pa.RecordBatch]:
            cut = False
            if held[0] and held[1]:
                x, y = (tuple(np.concatenate(c) for c in zip(*held[k])) for k in (0, 1))
                for i, j, equal in pairs(x, y):
                    if few is not None:
                        order = np.lexsort((-equal, j))
                        i, j = i[order], j[order]
                        place = np.arange(len(j)) - np.searchsorted(j, j)
                        cut |= bool((place >= few).any())
                        i, j = i[place < few], j[place < few]
                    if len(i):
                        u, v = x[0][i], y[0][j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.nulls(len(u), pa.int64())], ["u", "v", "key"])
            if cut:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([cell[0]], pa.int64())], ["u", "v", "key"])
            held[0].clear()
            held[1].clear()

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("key", "a", "b", "small")], 1) if b.num_rows else np.empty((0, 4))
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if tuple(keys[i][:3].tolist()) != cell:
                    yield from close()
                    cell = tuple(keys[i][:3].tolist())
                part = b.slice(i, j - i)
                held[int(keys[i][3])].append((*(part.column(c).to_numpy() for c in ("node", "group", "large")), part.column("n").to_numpy().astype(float), sketches_of(part.column("sketch"), registers)))
        yield from close()

    dealt = a_side.unionAll(b_side).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "small")
    return dealt.mapInArrow(run, "u long, v long, key long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links. texts: (node, __packed)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.empty(0, np.uint64)
        for b in batches:
            good = []
            for i, (u, x, y) in enumerate(zip(b.column("u").to_pylist(), unpacked(b.column("x")), unpacked(b.column("y")))):
                if u != last:
                    last, own = u, shingle_set(x)
                other = shingle_set(y)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if PARTS * both >= SIMILAR * (len(own) + len(other) - both):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("u").take(at), b.column("v").take(at)], ["u", "v"])

    first, second = (texts.select(F.col("node").alias(c), F.col(PACKED).alias(t)) for c, t in (("v", "y"), ("u", "x")))
    return attach(attach(pairs, first, "v", "u"), second, "u", "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def linked(nodes: DataFrame, least: DataFrame, named: DataFrame) -> DataFrame:
    """(node, component) of nodes that have links. nodes: (node, n, sketch), each once; least (node, least) names a document of each, of those in
    named (doc_id, key, text)."""
    met = written(meetings(nodes), "met")
    read = written(met.select("node").distinct().join(least, "node").select("node", F.col("least.doc_id").alias("id"), F.col("least.key").alias("of")), "read")
    picked = F.broadcast(read) if read.count() <= PICKED else read
    rows = named.join(picked, named["doc_id"].eqNullSafe(picked["id"]) & (named["key"] == picked["of"])).select("node", "text")
    texts = written(pack_texts(rows).select("node", PACKED).dropDuplicates(["node"]), "texts")
    pairs = met.where("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    tested = written(likely(written(pairs, "pairs"), nodes), "likely")
    comp = connected_components(written(verified(tested, texts), "links"))
    loose, sketches, registers = written(still_open(met, comp), "loose"), nodes, REGISTERS
    for few in FEW:
        if loose.isEmpty():
            break
        if few != FEW[0] and registers == REGISTERS:
            sketches, registers = written(longer(texts.join(loose.select("node").distinct(), "node", "left_semi")), "longer"), LONG
        found = written(across(loose, sketches, registers, few), "across")
        pairs = written(found.where("u is not null").select("u", "v").distinct().join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
        links = written(verified(pairs, texts), "links")
        if not links.isEmpty():  # components so far stand for their links
            comp = connected_components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
        cut = found.where("u is null").select("key").distinct()
        loose = written(still_open(loose.join(cut, "key", "left_semi"), comp), "loose")
    return comp


def longer(texts: DataFrame) -> DataFrame:
    """(node, n, sketch of LONG registers) of texts (node, __packed)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(raw) for raw in unpacked(b.column(PACKED))]
            cols = [b.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x, LONG).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "n", "sketch"])

    return texts.mapInArrow(run, "node long, n long, sketch binary")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of df; other columns are not read.

    n_shingles: the size of the document's set. component_id: the smallest doc_id reachable by links; kept: whether that is its own.
    Null texts and texts without words have empty sets and are linked with nothing: their component_id is their own id. Repeated rows stay,
    in one component. Null ids take part and are never the smallest, unless a component has no other; then it is null, and kept is true. An
    empty table stays empty."""
    plain, names = nameless(df)
    i, t = (names[df.columns.index(c)] for c in (id_col, text_col))
    prints = written(sketched(plain, i, t), "prints")
    nodes = written(prints.where("node is not null").select("node", "n", "sketch").dropDuplicates(["node"]), "nodes")
    least = prints.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    comp = linked(nodes, least, _named(plain, i, t))
    own = written(least.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.col("least.doc_id").alias("first")), "own")
    ids = own.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = attach(own.select("node", "component"), ids, "component", "node").select("node", "component_id")
    rows = prints.select("doc_id", "node", F.col("n").alias("n_shingles"))
    full = attach(rows.where("node is not null"), groups, "node", "doc_id").select("doc_id", "n_shingles", "component_id")
    full = full.unionByName(rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return full.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, list_aggregate(w[i : i + 3], 'string_agg', ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
e AS MATERIALIZED (SELECT a, b FROM (SELECT p.r AS a, q.r AS b, count(*) AS shared FROM s p JOIN s q ON p.x = q.x AND p.r <> q.r GROUP BY ALL) JOIN n m ON m.r = a JOIN n o ON o.r = b WHERE 100 * shared >= 80 * (m.n + o.n - shared)),
c(a, b) AS (SELECT r, r FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
f AS (SELECT c.a AS r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.b GROUP BY c.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN f USING (r) LEFT JOIN n USING (r)
"""
