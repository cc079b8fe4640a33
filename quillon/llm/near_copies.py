"""SimHash near copies at a similarity: documents whose sets of five-word shingles agree to 0.8 or more (Jaccard).

Copies at 0.8 lie about 0.15 of all bits apart, too far for one ball around a 64-bit fingerprint. So a fingerprint is longer here: parts
of BITS bits, each with a Hamming ball of its own.

1. Fingerprints: texts with the same shingles are one node from here on. A bit is 1 if it is set in over half of a node's shingle hashes.
   For checks a node has 256 more bits, one from the least of its shingles under each of 256 hashes: sets at 0.8 differ in 0.1 of these, sets
   at 0.67 (two edits of one text that are each at 0.8 from it) in 0.165, which SimHash bits tell apart less well.
2. Balls: two nodes meet at a part if it differs in one bit at most. Half of that radius is rounded down for parts with an even
   number of set bits, which emit themselves, and up for the others, which emit all variants at one bit. Variants are shuffled
   in blocks. As many parts are made as let a pair at 0.8 meet with a chance of 0.95 (0.99 at 0.85, 0.999 at 0.9).
3. Pairs: nodes that meet are compared by their check bits. Where a node has few partners at a variant, all pairs are taken; where it
   has many (a large group of copies), the nearest one, at half of the parts, so a group's pairs grow with its members, not with their square.
4. Verification: both texts of a pair are read and their shingles compared; only pairs of 0.8 or more are links, which are merged
   to components. Where partners were left out, those in other components are taken up in further rounds, each with 64 times
   as many, until none is left: what is left out is only what a component holds already. By then most pairs that 256 bits can't tell
   apart are unlike, so nodes of open meetings get 1,024 bits of their own, which decide in these rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rewrite import PACKED, pack_texts, raw_text, unpacked
from .simhash import block_of, is_odd, majority
from .substring_dedup import prefix_sums, run_hashes, word_hashes
from .util import lean, nameless, tune, written

SHINGLE = 5
SIMILAR = 0.8
#: Bits of a part. About n * (BITS + 1) / 2^(BITS + 1) of n unlike nodes meet at a variant: a few up to some ten million.
BITS, MEET = 20, 0.95


def differing(similar: float) -> float:
    """The share of bits in which fingerprints of sets with this similarity differ: the angle between them."""
    return acos(2 * similar / (1 + similar)) / pi


def parts_for(bits: int, similar: float = SIMILAR, meet: float = MEET) -> int:
    """How many parts let a pair meet with the chance aimed at: one bit of a part may differ."""
    p = differing(similar)
    one = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return ceil(log(1 - meet) / log(1 - one))


PARTS = parts_for(BITS)
WORDS = -(-PARTS * BITS // 64)
#: Bits for checks, differing ones up to which a pair is verified (three standard deviations over what 0.8 gives), and up to which
#: a member surely has a copy before it (three under it), and needs not stand for itself in later blocks of a meeting.
CHECK, MAYBE, SURE = 256, 41, 10
#: The same for later rounds: bits, and differing ones up to which a pair is verified (as many deviations over what 0.8 gives).
LONG, LONG_MAYBE = 1024, 133
#: Members of a meeting up to which pairs are found by shifts of whole blocks of variants.
SMALL = 16
#: Partners of a node at a large meeting in the first round.
FEW = 1
#: How many times as many each later round takes.
MORE = 64
#: Nodes of a meeting that are compared with those before them at once, with how many of these at most, and members compared with loose ones at once.
AT_ONCE, AHEAD, WIDE = 512, 1024, 8192
#: Variants in a block, and of a node on average.
BLOCK = 1_000_000
PER_NODE = PARTS * (BITS + 1) / 2
NODES_A_TASK = 10_000
#: Nodes whose components are looked up at once in later rounds, and their memberships of meetings in a block.
LOOKED_UP, OPEN = 1024, 8192
ROW = np.dtype([("key", "<u4"), ("node", "<i8"), ("check", "<u8", (CHECK // 64,))])
MEMBER = np.dtype([("key", "<u4"), ("node", "<i8")])
LOOSE = np.dtype([("key", "<u4"), ("node", "<i8"), ("group", "<i8"), ("long", "<u8", (LONG // 64,)), ("parts", "<u4", (PARTS,))])

_rng = np.random.default_rng(42)
_MASKS, _FACTORS, _AGAIN = _rng.integers(0, 1 << 64, (3, WORDS + 1), dtype=np.uint64)[:, :WORDS]  # fingerprints as before, without the spare word
_FACTORS |= np.uint64(1)
_AGAIN |= np.uint64(1)
_FLIPS, _TIMES = (_rng.integers(0, 1 << 32, CHECK, dtype=np.uint32) for _ in range(2))
_TIMES |= np.uint32(1)
_LONG_FLIPS, _LONG_TIMES = (_rng.integers(0, 1 << 32, LONG, dtype=np.uint32) for _ in range(2))
_LONG_TIMES |= np.uint32(1)


def shingles(raw: bytes) -> np.ndarray:
    """Hashes of the different runs of five words (ASCII lower case and white space); shorter texts are one run."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(prefix_sums(word_hashes(words)), min(SHINGLE, len(words))))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of sets from shingles()."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def long_fingerprint(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts (uint32) and the check words of a set of shingles."""
    h = (own[:, None] ^ _MASKS) * _FACTORS
    h ^= h >> np.uint64(32)
    h *= _AGAIN
    h ^= h >> np.uint64(29)
    bits = majority(h)
    parts = (bits[: PARTS * BITS].reshape(PARTS, BITS) << np.arange(BITS)).sum(axis=1).astype(np.uint32)
    return parts, check_words(own)


def check_words(own: np.ndarray, flips: np.ndarray = _FLIPS, times: np.ndarray = _TIMES) -> np.ndarray:
    """The parity of the least hash of a set under each of some hashes (CHECK), as 64-bit words."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    for first in range(0, len(short), 256):
        h = (short[first : first + 256, None] ^ flips) * times
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(least, h.min(axis=0), out=least)
    return np.packbits(np.bitwise_count(least) & 1, bitorder="little").view("<u8")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of check words (which broadcast)."""
    return sum(np.bitwise_count(a[..., k] ^ b[..., k]).astype(np.int16) for k in range(a.shape[-1]))


def check_array(words: np.ndarray) -> pa.Array:
    """Rows of check words as a binary column."""
    raw = np.ascontiguousarray(words, "<u8")
    return pa.Array.from_buffers(pa.binary(CHECK // 8), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def checks_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(-1, CHECK // 64)


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, node, check, parts): key is of the text, node of the set of shingles (0 for none, whose check and parts are
    null). Rows without id are left out."""
    tune(df.sparkSession)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, checks, parts = [], [], []
            for text in b.column("text").to_pylist():
                own = shingles(raw_text(text))
                if not len(own):
                    nodes.append(0)
                    checks.append(None)
                    parts.append(None)
                    continue
                part, check = long_fingerprint(own)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 5) - (1 << 63))
                checks.append(check.tobytes())
                parts.append(part.tobytes())
            cols = [b.column("doc_id"), b.column("key"), pa.array(nodes, pa.int64()), pa.array(checks, pa.binary()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "node", "check", "parts"])

    return _named(df, id_col, text_col).mapInArrow(run, "doc_id long, key long, node long, check binary, parts binary")


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def variants(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of parts: the keys (part number and variant) of all balls, and the row of each."""
    odd = is_odd(parts)
    tag = (np.arange(PARTS, dtype=np.uint32) << np.uint32(BITS))[None, :]
    even_at, odd_at = np.nonzero(~odd), np.nonzero(odd)
    flips = np.uint32(1) << np.arange(BITS, dtype=np.uint32)
    around = ((parts | tag)[odd_at][:, None] ^ flips).ravel()
    return np.concatenate(((parts | tag)[even_at], around)), np.concatenate((even_at[0], np.repeat(odd_at[0], BITS)))


def tree(checks: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (i, j), j before i, of members of one meeting whose check bits pass, and whether partners were left out. Of each i the `few`
    nearest are taken, or one if that is surely a copy. A member is compared with those of its own block and with AHEAD earlier ones at most that nothing
    before them stands for, so the work grows as the meeting does; what that leaves out is taken up between components."""
    out_i, out_j, cut = [], [], False
    ahead = np.empty(0, np.int64)
    for first in range(0, len(checks), AT_ONCE):
        here = np.arange(first, min(first + AT_ONCE, len(checks)))
        pool = np.concatenate((ahead, here))
        far = apart(checks[here][:, None], checks[pool])
        far[pool >= here[:, None]] = CHECK
        sure = far.min(axis=1) <= SURE
        n = np.where(sure, 1, np.minimum((far <= MAYBE).sum(axis=1), few))
        cut |= bool(((far <= MAYBE).sum(axis=1) > n).any()) or bool(sure.any())
        some = np.argsort(far, axis=1, kind="stable")[:, : max(1, int(n.max()))]
        i, k = np.nonzero(np.arange(some.shape[1]) < n[:, None])
        out_i.append(here[i])
        out_j.append(pool[some[i, k]])
        ahead = np.concatenate((ahead, here[~sure]))
        cut |= len(ahead) > AHEAD and first + AT_ONCE < len(checks)
        ahead = ahead[:AHEAD]
    return np.concatenate(out_i), np.concatenate(out_j), cut


def between(checks: np.ndarray, few: int, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs (i, j) of members of unlike groups whose LONG check bits pass, and whether partners were left out: members outside of the largest group are compared
    with all others, so the work grows with what is still loose. Of each of them the `few` nearest are taken, of those in loose groups only earlier ones."""
    own, counts = np.unique(groups, return_counts=True)
    large = own[counts.argmax()]
    loose = np.flatnonzero(groups != large)
    out_i, out_j, cut = [], [], False
    for first in range(0, len(loose), AT_ONCE):
        here = loose[first : first + AT_ONCE]
        at, with_, far_ = [], [], []
        for start in range(0, len(checks), WIDE):
            pool = np.arange(start, min(start + WIDE, len(checks)))
            far = apart(checks[here][:, None], checks[pool])
            ok = (far <= LONG_MAYBE) & (groups[here][:, None] != groups[pool]) & ((groups[pool] == large) | (pool < here[:, None]))
            i, j = np.nonzero(ok)
            at.append(i)
            with_.append(pool[j])
            far_.append(far[i, j])
        i, j, far = (np.concatenate(x) for x in (at, with_, far_))
        order = np.lexsort((far, i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        cut |= bool((place >= few).any())
        out_i.append(here[i[place < few]])
        out_j.append(j[place < few])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j]), cut


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two tables of parts: the least key that the balls of both rows hold, for rows that meet."""
    x = a ^ b
    n, odd = np.bitwise_count(x), is_odd(a)
    top = np.uint32(1) << np.log2(np.maximum(a, 1)).astype(np.uint32)
    low = x & (~x + np.uint32(1))
    same = np.where(odd, a ^ top, a)
    key = np.select([n == 0, n == 1], [same, np.where(odd, b, a)], np.minimum(a ^ low, a ^ x ^ low)).astype(np.int64)
    key |= np.arange(PARTS) << BITS
    return np.where((n < 2) | (n == 2) & odd, key, 1 << 40).min(axis=1)


def meetings(rows: np.ndarray, few: int, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (u, v) of nodes of a block of variants, and the rows of meetings where partners were left out."""
    mixed = (rows["node"].view(np.uint64) ^ rows["key"]) * np.uint64(0x9E3779B97F4A7C15)  # another order at each variant
    rows = rows[np.lexsort((mixed, rows["key"]))]
    keys, nodes, checks = (np.ascontiguousarray(rows[c]) for c in ("key", "node", "check"))
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edges)
    big = np.repeat(sizes > small, sizes)
    u, v, rest = [], [], []
    for d in range(1, small):
        if not (same := (keys[d:] == keys[:-d]) & ~big[d:]).any():
            break
        at = np.flatnonzero(same)
        at = at[apart(checks[at], checks[at + d]) <= MAYBE]
        u.append(nodes[at])
        v.append(nodes[at + d])
    for i in np.flatnonzero(sizes > small).tolist():
        own = slice(edges[i], edges[i + 1])
        if (int(keys[edges[i]]) >> BITS) % 2:  # large groups meet at many parts: half of them wait until components are known
            rest.append(rows[own])
            continue
        a, b, cut = tree(checks[own], few)
        u.append(nodes[own][a])
        v.append(nodes[own][b])
        if cut:
            rest.append(rows[own])
    none = np.empty(0, np.int64)
    u, v = np.concatenate([none, *u]), np.concatenate([none, *v])
    pairs = np.unique(np.stack((np.minimum(u, v), np.maximum(u, v)), 1), axis=0)
    return pairs[:, 0], pairs[:, 1], np.concatenate(rest) if rest else rows[:0]


def candidates(nodes: DataFrame, few: int, small: int) -> DataFrame:
    """(u, v, rows): pairs of nodes to be verified, and the members of meetings where partners were left out. nodes: (node,
    check, parts), each node once. few: partners of a node in meetings of over `small` nodes. Variants travel in blocks, chosen by a hash of the
    variant, whose number follows the nodes'."""
    n = nodes.count()
    blocks, tasks = max(1, int(n * PER_NODE / BLOCK)), max(1, -(-n // NODES_A_TASK))

    @lean
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = np.frombuffer(b"".join(b.column("parts").to_pylist()), np.uint32).reshape(-1, PARTS)
            keys, at = variants(parts)
            rows = np.empty(len(keys), ROW)
            rows["key"] = keys
            rows["node"] = b.column("node").to_numpy()[at]
            rows["check"] = checks_of(b.column("check"))[at]
            block = block_of(keys.astype(np.uint64), blocks)
            order = np.argsort(block.astype(np.uint16 if blocks <= 1 << 16 else np.uint64), kind="stable")
            block, rows = block[order], rows[order]
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for i in range(0, len(cuts) - 1, 512):
                own = cuts[i : i + 513].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(block[own[:-1]].astype(np.int64)), pa.array([rows[x:y].tobytes() for x, y in zip(own, own[1:])], pa.binary())], ["block", "variants"])

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                u, v, rest = meetings(np.frombuffer(b"".join(held), ROW), few, small)
                held.clear()
                yield from _pairs(u, v)
                yield from _open(rest["key"], rest["node"])

        for b in batches:
            for here, rows in zip(b.column("block").to_pylist(), b.column("variants").to_pylist()):
                if here != block:
                    yield from close()
                    block = here
                held.append(rows)
        yield from close()

    dealt = nodes.repartition(tasks, "node").mapInArrow(spread, "block long, variants binary").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(meet, "u long, v long, rows binary")


def _pairs(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(u), 100_000):
        k = len(u[i : i + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + k]), pa.array(v[i : i + k]), pa.nulls(k, pa.binary())], ["u", "v", "rows"])


def _open(keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Members of meetings where partners were left out, packed; a meeting's come one after the other."""
    for i in range(0, len(keys), 100_000):
        own = np.empty(len(keys[i : i + 100_000]), MEMBER)
        own["key"], own["node"] = keys[i : i + 100_000], nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([own.tobytes()], pa.binary())], ["u", "v", "rows"])


def blobs(number: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Rows by their number, packed."""
    order = np.argsort(number, kind="stable")
    number, rows = number[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]).tolist() if len(rows) else [0]
    return number[cuts[:-1]].astype(np.int64).tolist(), [rows[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]


def open_nodes(rest: DataFrame) -> DataFrame:
    """(node) of open meetings."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = np.unique(np.frombuffer(b"".join(b.column("rows").to_pylist()), MEMBER)["node"])
            yield pa.RecordBatch.from_arrays([pa.array(nodes)], ["node"])

    return rest.mapInArrow(run, "node long").distinct()


def long_checks(texts: DataFrame) -> DataFrame:
    """(node, long) of texts (node, __packed)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [check_words(shingles(x), _LONG_FLIPS, _LONG_TIMES).tobytes() for x in unpacked(b.column(PACKED))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(words, pa.binary())], ["node", "long"])

    return texts.mapInArrow(run, "node long, long binary")


def left_out(rest: DataFrame, known: DataFrame, few: int) -> DataFrame:
    """(u, v, rows) again, of open meetings (rows) whose members lie in several components: pairs across these, each from the
    first meeting that both nodes have. known: (node, group, long, parts) of all their members.

    Memberships travel packed: by node, to be looked up, then by meeting. A node has a bounded number of them."""
    n = known.count()
    members = rest.agg(F.sum(F.length("rows"))).first()[0] // MEMBER.itemsize
    buckets, blocks = max(1, -(-n // LOOKED_UP)), max(1, -(-members // OPEN))

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer(b"".join(b.column("rows").to_pylist()), MEMBER)
            number, packed = blobs(rows["node"] % buckets, rows)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(packed, pa.binary())], ["bucket", "members"])

    def look_up(members: pa.Table, own: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(members.column("members").to_pylist()), MEMBER)
        nodes = own.column("node").to_numpy()
        order = np.argsort(nodes)
        at = order[np.searchsorted(nodes[order], rows["node"])]
        out = np.empty(len(rows), LOOSE)
        out["key"], out["node"], out["group"] = rows["key"], rows["node"], own.column("group").to_numpy()[at]
        out["long"] = np.frombuffer(b"".join(own.column("long").to_pylist()), "<u8").reshape(-1, LONG // 64)[at]
        out["parts"] = np.frombuffer(b"".join(own.column("parts").to_pylist()), "<u4").reshape(-1, PARTS)[at]
        number, packed = blobs(block_of(rows["key"].astype(np.uint64), blocks), out)
        return pa.table({"block": pa.array(number, pa.int64()), "members": pa.array(packed, pa.binary())})

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = np.frombuffer(b"".join(held), LOOSE)
            held.clear()
            order = np.lexsort((rows["node"], rows["key"]))
            keys = rows["key"][order]
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]).tolist()
            for x, y in zip(edges, edges[1:]):
                own = rows[order[x:y]]
                if (own["group"] == own["group"][0]).all():
                    continue
                nodes, parts = own["node"], own["parts"]
                a, b, cut = between(np.ascontiguousarray(own["long"]), few, own["group"])
                for k in range(0, len(a), 100_000):
                    i, j = a[k : k + 100_000], b[k : k + 100_000]
                    first = first_meeting(parts[i], parts[j]) == int(keys[x])
                    yield from _pairs(np.minimum(nodes[i], nodes[j])[first], np.maximum(nodes[i], nodes[j])[first])
                if cut:
                    yield from _open(own["key"], nodes)

        for b in batches:
            for here, rows in zip(b.column("block").to_pylist(), b.column("members").to_pylist()):
                if here != block:
                    yield from close()
                    block = here
                held.append(rows)
        yield from close()

    dealt = rest.mapInArrow(deal, "bucket long, members binary").groupBy("bucket")
    named = dealt.cogroup(known.withColumn("bucket", F.expr(f"pmod(node, {buckets}L)")).groupBy("bucket")).applyInArrow(look_up, "block long, members binary")
    return named.repartition("block").sortWithinPartitions("block").mapInArrow(meet, "u long, v long, rows binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar enough. texts: (node, __packed)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.empty(0, np.uint64)
        for b in batches:
            good = []
            for i, (u, x, y) in enumerate(zip(b.column("u").to_pylist(), unpacked(b.column("x")), unpacked(b.column("y")))):
                if u != last:
                    last, own = u, shingles(x)
                if similarity(own, shingles(y)) >= SIMILAR:
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("u").take(at), b.column("v").take(at)], ["u", "v"])

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col(PACKED).alias("x")), "u").join(texts.select(F.col("node").alias("v"), F.col(PACKED).alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is the smallest of its group of near copies; all columns stay as they are.

    Rows that agree in id and text are one document, of which one row stays; unlike texts under one id are documents of
    their own (ties by a hash of the text). Null texts and texts without words are copies of each other. Rows with a null id stay and are
    nobody's copy. An empty table stays empty."""
    plain, names = nameless(df)
    i, t = (names[df.columns.index(c)] for c in (id_col, text_col))
    prints = written(signatures(plain, i, t), "prints")
    least = prints.groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("least"))
    nodes = written(prints.where("check is not null").select("node", "check", "parts").dropDuplicates(["node"]), "nodes")
    comp = linked(nodes, least, _named(plain, i, t))
    own = least.join(comp, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("least").alias("least"))
    kept = own.select(F.col("least.doc_id").alias("kept"), F.col("least.key").alias("of"))
    named = plain.withColumn("key", F.xxhash64(F.col(t).cast("string")))
    out = named.join(kept, (F.col(i) == F.col("kept")) & (F.col("key") == F.col("of")), "left_semi")
    rows, docs = prints.agg(F.count("*"), F.countDistinct("doc_id", "key")).first()
    if rows != docs:
        out = out.dropDuplicates([i, "key"])
    return out.drop("key").unionByName(plain.where(F.col(i).isNull())).toDF(*df.columns)


def linked(nodes: DataFrame, least: DataFrame, named: DataFrame) -> DataFrame:
    """(node, component) of nodes that have links. named: (doc_id, key, text) of all documents, of which least (node, least) names one for
    each node."""
    packed = pack_texts(named)

    def texts_of(ids: DataFrame) -> DataFrame:
        read = ids.join(least, "node").select("node", F.col("least.doc_id").alias("__id"), F.col("least.key").alias("__of"))
        return packed.join(read, (packed["doc_id"] == read["__id"]) & (packed["key"] == read["__of"])).select("node", PACKED).dropDuplicates(["node"])

    few, comp, tested, longs = FEW, None, None, None
    found = written(candidates(nodes, FEW, SMALL), "met")
    while True:
        pairs = found.where("u is not null").select("u", "v").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        ends = pairs.select(F.col("u").alias("node")).distinct().union(pairs.select("v").distinct()).distinct()
        new = written(verified(pairs, written(texts_of(ends), "texts")), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        if comp is None:
            comp = connected_components(new)
        elif not new.isEmpty():  # components so far stand for their links
            comp = connected_components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new))
        rest = found.where("rows is not null").select("rows")
        if rest.isEmpty():
            return comp
        if longs is None:  # meetings of later rounds are among these
            longs = written(long_checks(texts_of(open_nodes(rest))).join(nodes.select("node", "parts"), "node"), "longs")
        few *= MORE
        known = longs.join(comp.select("node", F.col("component").alias("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))
        found = written(left_out(rest, known, few), "met")
        if found.isEmpty():
            return comp
