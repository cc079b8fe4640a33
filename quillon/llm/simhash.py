"""SimHash near-duplicates by meeting in the middle of a Hamming ball.

Links span 3 bits, an odd number, so half the radius is rounded down for one end of a link and up for the other. Which
end is which follows from parity: two fingerprints that differ in 1 or 3 bits have unlike parity. Those with an even
number of set bits emit themselves and their 64 variants at one bit. Those with an odd number emit their 64 variants
at one bit and variants at two bits; since of any three bits two lie in one half, two bits of the same half suffice (992).

- 1 bit apart: the odd end's variant is the even end itself. 2 bits apart: both emit the two fingerprints between them.
- 3 bits apart: of the three bits two lie in one half; the odd end flips those, the even end the third.

Variants are shuffled, those that collide are verified on all 64 bits, and the links are merged to components. At most 1,057
different fingerprints can meet at a variant, so there are no hot keys, however alike the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .util import lean, nameless, texts_of, tune, written

SEED = 42
RADIUS = 3


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of rows of 64-bit words, the lowest of the first word first. Bits are counted in lanes of a
    byte, 255 rows at a time."""
    n, words = hashes.shape
    counts = np.zeros(64 * words, np.int64)
    for first in range(0, n, 255):
        own = np.ascontiguousarray(hashes[first : first + 255], "<u8")
        bits = np.unpackbits(own.view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return 2 * counts > n


def fingerprint(text: str, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half the XXH64 values of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        line = memoryview(b" ".join(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - shingle].tolist()]
        h = xxhash.xxh64_intdigest
        hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))
    return int(np.packbits(majority(hashes[:, None]), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, with_key: bool = False) -> DataFrame:
    """(doc_id, fp): 64 bits as a signed long, and where with_key a hash of the text. Null texts and texts without words give 0."""
    tune(df.sparkSession)
    names = ["doc_id", "fp", *["key"] * with_key]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts_of(b, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), *([b.column("key")] if with_key else [])], names)

    text = F.col(text_col).cast("string")
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *[F.xxhash64(text).alias("key")] * with_key)
    return named.mapInArrow(run, "doc_id long, fp long" + ", key long" * with_key)


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """What fingerprints with an even and with an odd number of set bits flip to make their variants."""
    bits = [1 << i for i in range(64)]
    pairs = [a | b for half in (bits[:32], bits[32:]) for a, b in combinations(half, 2)]
    return np.array([0, *bits], np.uint64), np.array(bits + pairs, np.uint64)


EVEN, ODD = _flips()
#: Rows of a variant in its block: the variant, and which flip made it.
VARIANT = np.dtype([("key", "<u8"), ("flip", "<u2")])
#: Variants in a block, and of a fingerprint on average.
BLOCK = 2_000_000
#: Fingerprints that one task spreads; their number is stated, so that a small table isn't spread by one task.
PRINTS_A_TASK = 10_000
PER_PRINT = (len(EVEN) + len(ODD)) / 2


def is_odd(fps: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(fps) & 1).astype(bool)


def variants(fps: np.ndarray) -> np.ndarray:
    """All variants of fingerprints, as rows of VARIANT; odd fingerprints number their flips behind the even ones'."""
    parts = []
    odd = is_odd(fps)
    for own, flips, first in ((fps[~odd], EVEN, 0), (fps[odd], ODD, len(EVEN))):
        part = np.empty((len(own), len(flips)), VARIANT)
        part["key"] = own[:, None] ^ flips
        part["flip"] = np.arange(first, first + len(flips))
        parts.append(part.ravel())
    return np.concatenate(parts)


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(blocks)


def collisions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different fingerprints within the radius: of those that met at a variant, each with the one nearest to it.

    All members within one bit of the variant are linked so, and those at two bits are within three of them. Where all are at two
    bits, pairs within the radius differ in two and meet between them as well."""
    keys = np.ascontiguousarray(rows["key"])
    order = np.argsort(keys)
    rows, keys = rows[order], keys[order]
    same = keys[1:] == keys[:-1]
    met = np.zeros(len(rows), bool)
    met[1:] |= same
    met[:-1] |= same
    rows, keys = rows[met], keys[met]
    if not len(rows):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    fps = keys ^ np.concatenate((EVEN, ODD))[rows["flip"]]
    new = np.r_[True, keys[1:] != keys[:-1]]
    place = np.flatnonzero(new)[np.cumsum(new) - 1]
    order = np.lexsort((fps, np.bitwise_count(fps ^ keys), place))
    hub = fps[order][place]
    fps = fps[order]
    good = (np.bitwise_count(hub ^ fps) <= RADIUS) & (hub != fps)
    return hub[good], fps[good]


def near_links(fps: DataFrame) -> DataFrame:
    """(u, v): links that connect all different fingerprints (column fp) within the radius.

    Variants travel in blocks, chosen by a hash of the variant: a row holds the variants that a batch of fingerprints has in
    a block. The number of blocks follows the number of fingerprints, so that a block fits a task. A block's variants are sorted,
    equal ones deduplicated, and those that collide verified."""
    tune(fps.sparkSession)
    single = written(fps.select("fp").distinct(), "fingerprints")
    n = single.count()
    blocks, tasks = max(1, int(n * PER_PRINT / BLOCK)), max(1, -(-n // PRINTS_A_TASK))

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # of BATCH_ROWS fingerprints at most
            rows = variants(b.column("fp").to_numpy().view(np.uint64))
            at = block_of(rows["key"], blocks)
            order = np.argsort(at.astype(np.uint16 if blocks <= 1 << 16 else np.uint64), kind="stable")
            at, rows = at[order], rows[order]
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else np.zeros(1, np.int64)
            for i in range(0, len(cuts) - 1, 512):
                own = cuts[i : i + 513].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(at[own[:-1]].astype(np.int64)), pa.array([rows[x:y].tobytes() for x, y in zip(own, own[1:])], pa.binary())], ["block", "variants"])

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                u, v = collisions(np.frombuffer(b"".join(held), VARIANT))
                held.clear()
                pairs = np.unique(np.stack((u, v), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in pairs.T], ["u", "v"])

        for b in batches:
            for here, rows in zip(b.column("block").to_pylist(), b.column("variants").to_pylist()):
                if here != block:
                    yield from close()
                    block = here
                held.append(rows)
        yield from close()

    dealt = single.repartition(tasks, "fp").mapInArrow(spread, "block long, variants binary").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(meet, "u long, v long").distinct()


def near_groups(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) with component_id, the smallest doc_id reachable by links; prints should be a written
    table. Null doc_ids take part and are never the smallest, unless a group has no other."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    own = nodes.join(_components(nodes), "fp")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(own.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _components(nodes: DataFrame) -> DataFrame:
    """(fp, component) of all fingerprints."""
    comp = connected_components(near_links(nodes))
    return nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of df.

    fingerprint: 16 lowercase hex digits. Null texts and texts without words have fingerprint zero and are
    linked like any other; repeated rows stay; other columns are not read; an empty table stays
    empty. See near_groups for null ids."""
    groups = near_groups(written(fingerprints(df, id_col, text_col), "prints"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of df whose document is the first (by id, then by a hash of the text) of its group; all columns stay as they are.

    Rows that agree in id and text are one document, of which one row stays; unlike texts under one id are documents of
    their own. Rows with a null id stay, as no smaller id can stand for them surely, and are nobody's copy. Null texts are copies
    of texts without words. An empty table stays empty."""
    plain, names = nameless(df)
    i, t = (names[df.columns.index(c)] for c in (id_col, text_col))
    key = F.xxhash64(F.col(t).cast("string"))
    prints = fingerprints(plain.where(F.col(i).isNotNull()).select(F.col(i), F.col(t)), i, t, shingle, with_key=True)
    prints = written(prints, "prints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    least = nodes.join(_components(nodes), "fp").groupBy("component").agg(F.min("least").alias("least"))
    kept = least.select(F.col("least.doc_id").alias("kept"), F.col("least.key").alias("of"))
    out = plain.withColumn("key", key).join(kept, (F.col(i) == F.col("kept")) & (F.col("key") == F.col("of")), "left_semi")
    out = out.dropDuplicates([i, "key"]).drop("key")
    return out.unionByName(plain.where(F.col(i).isNull())).toDF(*df.columns)
