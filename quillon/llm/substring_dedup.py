"""Removal of passages that documents with smaller ids hold, by sharded automata of recurring phrases.

A passage counts from 50 words. Of each window of 50 words one phrase of 8 is chosen by its content (the
smallest hash in the window), so equal windows choose equal phrases, wherever they stand.

Exact copies of a text need no search: all words of all but the copies with the smallest id repeat. So each different text
goes once, with its smallest id, through what follows.

1. Phrases: the chosen phrases of all texts are grouped by their words; those that two or more different texts chose
   are confirmed as recurring.
2. Automata: confirmed phrases are dealt into shards of a few thousand, each compiled to one Aho-Corasick automaton. Phrases
   whose first text is the same share a shard, so that a text's phrases lie in few of them. Every text is streamed through each
   shard that holds a phrase which it chose (no other shard can hold one), and the automaton says where all phrases stand in it.
3. Windows: those whose least phrase was located belong to that phrase's shard. All texts that hold the window stream
   through the same shard, so it is decided there: by hash, then by comparing the words of whole stretches.

A shard with many words of text (a large group of near copies) is dealt into parts, and a shard with many phrases (of one very
long text) into several, each with an automaton of its own. A part decides its own texts; what its first holder of a window has to ask
of other parts travels as a 128-bit hash, aggregated to the smallest id before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rewrite import KEY, PACKED, SPEC, key_of, pack_texts, raw_text, rewritten, unpacked, with_spec
from .util import lean, tune, written

WINDOW = 50
PHRASE = 8
#: Phrases of a shard, and words of text that are streamed through it in one part.
SHARD_PHRASES = 4096
PART_WORDS = 500_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words, from the sums of prefix_sums()."""
    n = len(prefix) - size
    h = (prefix[size:] - prefix[:-size]) * _power(n)[1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def prefix_sums(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(len(words))[0], dtype=np.uint64, out=out[1:])
    return out


def sliding(a: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each run of size values."""
    done = 1
    while 2 * done <= size:
        a = pick(a[:-done], a[done:])
        done *= 2
    return pick(a[: len(a) - (size - done)], a[size - done :]) if size > done else a


def chosen(phrases: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The least phrase hash of each window, and whether each phrase is the least of some window."""
    n = window - PHRASE + 1
    least = sliding(phrases, n, np.minimum)
    edge = np.zeros(n - 1, np.uint64)
    return least, sliding(np.concatenate((edge, least, edge)), n, np.maximum) == phrases


def _phrases_of(raw: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray] | None:
    words = raw.split()  # ASCII white space
    if len(words) < WINDOW:
        return None
    sums = prefix_sums(word_hashes(words))
    return words, sums, run_hashes(sums, PHRASE)


#: Rows of the table of phrases: documents (doc_id, key, n) and phrases of different texts (key, n, h, phrase). n: words of the text.
PRINTS = "doc_id long, key long, n long, h long, phrase binary"


def _prints(df: DataFrame) -> DataFrame:
    """Documents that have an id and a window, and the chosen phrases of their texts (once for each task that reads a text)."""
    names = ["doc_id", "key", "n", "h", "phrase"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            docs, keys, sizes, hs, phrases, owners, counts = [], [], [], [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                raw = raw_text(text)
                if (key := key_of(raw)) in seen or (found := _phrases_of(raw)) is None:
                    if key in seen:
                        docs.append(doc), keys.append(key), sizes.append(seen[key])
                    continue
                words, _, h = found
                seen[key] = len(words)
                docs.append(doc), keys.append(key), sizes.append(len(words))
                at = np.flatnonzero(chosen(h)[1])
                phrases += [b" ".join(words[i : i + PHRASE]) for i in at.tolist()]
                hs.append(h[at])
                owners.append(np.full(len(at), key, np.int64))
                counts.append(np.full(len(at), len(words), np.int64))
            if docs:
                k = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names)
            if phrases:
                k = len(phrases)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(np.concatenate(owners)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(hs).view(np.int64)), pa.array(phrases, pa.binary())], names)

    return df.where("doc_id is not null and text is not null").mapInArrow(run, PRINTS)


class Text:
    """A text on its way through a shard: its words and hashes, and the windows whose least phrase was located."""

    def __init__(self, doc: int, key: int, raw: bytes):
        self.doc, self.key = doc, key
        self.words, self.sums, h = _phrases_of(raw)
        self.least, _ = chosen(h)
        self.h = h

    def locate(self, automaton: ahocorasick.Automaton) -> np.ndarray:
        """The starts of windows whose least phrase the automaton finds."""
        said = " " + b" ".join(self.words).decode("utf-8", "surrogatepass") + " "
        ends = np.fromiter((e for e, _ in automaton.iter(said)), np.int64)
        if not len(ends):
            return ends
        if said.isascii():
            spaces = np.flatnonzero(np.frombuffer(said.encode(), np.uint8) == 32)
        else:
            spaces = np.flatnonzero(np.frombuffer(said.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        found = np.zeros(len(self.h), bool)
        found[np.searchsorted(spaces, ends) - PHRASE] = True
        known = sliding(np.where(found, self.h, np.uint64(0xFFFFFFFFFFFFFFFF)), WINDOW - PHRASE + 1, np.minimum)
        return np.flatnonzero((known == self.least) & sliding(found, WINDOW - PHRASE + 1, np.maximum))

    def said(self, start: int, count: int = 1) -> list[bytes]:
        """The words of count windows that follow one another."""
        return self.words[start : start + count + WINDOW - 1]


def automaton_of(phrases: list[bytes]) -> ahocorasick.Automaton:
    """Finds phrases between spaces."""
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        out.add_word(" " + p.decode("utf-8", "surrogatepass") + " ")
    out.make_automaton()
    return out


def _stretches(*cols: np.ndarray) -> np.ndarray:
    """First places of stretches in which the first two columns stay and the others go up by one."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for k, c in enumerate(cols):
        new[1:] |= c[1:] - c[:-1] != (k > 1)
    return np.flatnonzero(new)


def decide(texts: list[Text], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of located windows: (texts, starts) of those that a text with a smaller id holds too, and of those whose text is the first
    here. Windows are equal if their words are: hashes choose, then the words of whole stretches are compared."""
    text = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    if not len(start):
        return text, start, text, start
    h = np.concatenate([run_hashes(t.sums, WINDOW)[s] for t, s in zip(texts, starts)])
    ids = np.array([t.doc for t in texts], np.int64)
    order = np.lexsort((start, text, ids[text], h))
    h, text, start = h[order], text[order], start[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    first = np.repeat(first, np.diff(np.r_[first, len(h)]))
    later = ids[text] != ids[text[first]]
    by = np.flatnonzero(later)
    by = by[np.lexsort((start[by], text[first[by]], text[by]))]
    a, i, b, j = text[by], start[by], text[first[by]], start[first[by]]
    cuts = _stretches(a, b, i, j)
    good = np.ones(len(by), bool)
    for x, n in zip(cuts.tolist(), np.diff(np.r_[cuts, len(by)]).tolist()):
        if texts[a[x]].said(i[x], n) != texts[b[x]].said(j[x], n):
            good[x : x + n] = False
    if not good.all():  # equal hashes of unlike windows: those hashes are settled by their words
        odd = np.isin(h, h[by[~good]])
        firsts: dict[tuple, int] = {}
        for k in np.flatnonzero(odd).tolist():
            words = tuple(texts[text[k]].said(start[k]))
            later[k] = firsts.setdefault(words, ids[text[k]]) != ids[text[k]]
    return text[later], start[later], text[~later], start[~later]


def runs_of(starts: np.ndarray) -> bytes:
    """Sorted places as (first, last) of stretches, int32."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack((starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]), 1).astype("<i4").tobytes()


def _specs(texts: list[Text], text: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    cuts = np.flatnonzero(np.diff(text)) + 1
    for t, s in zip(text[np.r_[0, cuts]].tolist() if len(text) else [], np.split(start, cuts)):
        yield texts[t].doc, texts[t].key, runs_of(s)


_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def second_hashes(texts: list[Text], text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Another 64 bits of windows, from other word hashes."""
    out = np.empty(len(text), np.uint64)
    for t in np.unique(text):
        own = text == t
        w = np.fromiter((xxhash.xxh64_intdigest(x, 11) for x in texts[t].words), np.uint64, len(texts[t].words))
        out[own] = run_hashes(prefix_sums(w * _OTHER), WINDOW)[start[own]]
    return out


#: What shards give: decided windows of a document (doc_id, key, spec), or windows to be asked about in other parts.
FOUND = "doc_id long, key long, spec binary, h long, g long, start int"


def _streamed(dealt: DataFrame) -> DataFrame:
    """Rows come by cell, phrases first: (cell columns, alone, phrase, doc_id, key, packed)."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, alone = None, True
        phrases: list[bytes] = []
        texts: list[Text] = []
        starts: list[np.ndarray] = []
        automaton = None
        loose = zstandard.ZstdDecompressor()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal automaton
            text, start, own_text, own_start = decide(texts, starts)
            if rows := list(_specs(texts, text, start)):
                d, k, s = zip(*rows)
                n = len(d)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)
            if not alone and len(own_text):
                h = np.concatenate([np.empty(0, np.uint64)] + [run_hashes(texts[t].sums, WINDOW)[own_start[own_text == t]] for t in np.unique(own_text)])
                order = np.argsort(own_text, kind="stable")
                own_text, own_start = own_text[order], own_start[order]
                g = second_hashes(texts, own_text, own_start)
                docs, keys = np.array([t.doc for t in texts], np.int64)[own_text], np.array([t.key for t in texts], np.int64)[own_text]
                for i in range(0, len(h), 200_000):
                    z = slice(i, i + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(docs[z]), pa.array(keys[z]), pa.nulls(len(docs[z]), pa.binary()), pa.array(h[z].view(np.int64)), pa.array(g[z].view(np.int64)), pa.array(own_start[z].astype(np.int32))], names)
            phrases.clear(), texts.clear(), starts.clear()
            automaton = None

        for b in batches:
            for *here, one, phrase, doc, key, packed in zip(*(b.column(c).to_pylist() for c in ("shard", "sub", "part", "alone", "phrase", "doc_id", "key", PACKED))):
                if here != cell:
                    yield from close()
                    cell, alone = here, one
                if phrase is not None:
                    phrases.append(phrase)
                elif phrases and not (texts and (texts[-1].doc, texts[-1].key) == (doc, key)):  # else a row that repeats
                    automaton = automaton or automaton_of(phrases)
                    text = Text(doc, key, loose.decompress(packed))
                    if len(own := text.locate(automaton)):
                        texts.append(text)
                        starts.append(own)
        yield from close()

    return dealt.mapInArrow(run, FOUND)


def _dealt(df: DataFrame, prints: DataFrame, least: DataFrame, shard_phrases: int, part_words: int) -> DataFrame:
    """Confirmed phrases and the texts that chose them, by cells (shard, sub, part)."""
    chose = prints.where("phrase is not null")
    confirmed = chose.groupBy("phrase", "h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    confirmed = written(confirmed.select("phrase", "h", "lo"), "phrases")
    shards = max(1, -(-confirmed.count() // shard_phrases))
    confirmed = confirmed.withColumn("shard", F.pmod(F.xxhash64("lo"), F.lit(shards)))
    by_hash = written(confirmed.select("h", "shard"), "shards")  # a shuffle of its own on either side, so that a hot phrase can be split
    routes = written(chose.select("h", "key", "n").join(by_hash, "h").groupBy("shard", "key").agg(F.max("n").alias("n")), "routes")
    held = confirmed.groupBy("shard").agg(F.ceil(F.count("*") / shard_phrases).alias("subs"))
    size = routes.groupBy("shard").agg(F.ceil(F.sum("n") / part_words).alias("parts"))
    sizes = written(held.join(size, "shard"), "cells")
    none = F.lit(None)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    cells = confirmed.join(sizes, "shard").select("shard", F.pmod("h", F.col("subs")).cast("int").alias("sub"), upto("parts").alias("part"), (F.col("parts") == 1).alias("alone"), "phrase")
    phrases = cells.select("*", none.cast("long").alias("doc_id"), none.cast("long").alias("key"), none.cast("binary").alias(PACKED))
    wanted = routes.join(sizes, "shard").join(least.select("key", F.col("doc_id").alias("first")), "key")
    wanted = wanted.select("shard", upto("subs").alias("sub"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), (F.col("parts") == 1).alias("alone"), "first", F.col("key").alias("of"))
    packed = pack_texts(df.where("doc_id is not null and text is not null"))
    texts = packed.join(wanted, (packed["doc_id"] == wanted["first"]) & (packed[KEY] == wanted["of"]))
    texts = texts.select("shard", "sub", "part", "alone", none.cast("binary").alias("phrase"), "doc_id", F.col(KEY).alias("key"), PACKED)
    cell = ["shard", "sub", "part"]
    return phrases.unionByName(texts).repartition(*cell).sortWithinPartitions(*cell, F.col("phrase").isNull(), "doc_id", "key")


def repeated_windows(df: DataFrame, shard_phrases: int = SHARD_PHRASES, part_words: int = PART_WORDS) -> DataFrame:
    """(__id, __key, __spec): of each document that holds windows whose words also start in a document with a
    smaller id, the places of their first words (int32 pairs: first and last of stretches; empty: all windows). df has
    doc_id and text."""
    tune(df.sparkSession)
    prints = written(_prints(df), "prints")
    keys = prints.where("phrase is null").select("doc_id", "key")
    least = keys.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("most"))
    found = written(_streamed(_dealt(df, prints, least, shard_phrases, part_words)), "windows")
    decided = found.where("spec is not null").select("doc_id", "key", "spec")
    asked = found.where("spec is null").select("doc_id", "key", "h", "g", "start")
    firsts = written(asked.groupBy("h", "g").agg(F.min("doc_id").alias("first")), "firsts")

    @lean
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts = [runs_of(np.sort(np.array(x, np.int64))) for x in b.column("starts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(starts, pa.binary())], ["doc_id", "key", "spec"])

    more = asked.join(firsts, ["h", "g"]).where("doc_id > first").groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
    every = decided.unionByName(more.mapInArrow(runs, "doc_id long, key long, spec binary"))
    each = every.groupBy("doc_id", "key").agg(F.expr("concat_ws('', collect_list(hex(spec)))").alias("x")).select("doc_id", "key", F.unhex("x").alias("spec"))
    copied = least.where("doc_id < most").select("key", F.col("doc_id").alias("least"))
    copies = keys.join(copied, "key").where("doc_id > least").select("doc_id", "key").distinct().withColumn("spec", F.lit(b""))
    return each.unionByName(copies).select(F.col("doc_id").alias("__id"), F.col("key").alias(KEY), F.col("spec").alias(SPEC))


def covered(n: int, spec: bytes) -> np.ndarray:
    """Which of n words stand in the windows of a spec."""
    if not spec:
        return np.ones(n, bool)
    first, last = np.frombuffer(spec, "<i4").reshape(-1, 2).T
    step = np.bincount(first, minlength=n + 1) - np.bincount(last + WINDOW, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def _kept(raw: bytes, spec: bytes | None) -> tuple[list[bytes], int]:
    words = raw.split()
    if spec is None:
        return words, 0
    gone = covered(len(words), spec)
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def repeated_words(df: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of kept words joined by one space) for each row of df.

    Null texts have no words. Rows with a null id lose nothing and are nobody's source; rows that repeat id
    and text fare alike, and rows of equal id are not each other's source. Windows are judged on the
    input. Windows are equal if their words are; where a shard is dealt into parts, if 128-bit hashes agree (odds of one error: n^2 /
    2^129 for n such windows). Texts are equal if 64-bit hashes of them agree. Other columns are not read; an
    empty table stays empty."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    specs = repeated_windows(docs)
    joined = with_spec(pack_texts(docs), specs, "doc_id")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, said = [], [], []
            for raw, spec in zip(unpacked(b.column(PACKED)), b.column(SPEC).to_pylist()):
                kept, removed = _kept(raw, spec)
                n.append(len(kept) + removed)
                gone.append(removed)
                said.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(said, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _without(raw: bytes, spec: bytes) -> bytes:
    return b" ".join(_kept(raw, spec)[0])


def drop_repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the words of repeated windows taken out of its texts; texts that lose none stay as they are,
    others become their kept words joined by one space. All rows and columns stay."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rewritten(df, repeated_windows(docs), _without, id_col, text_col)
