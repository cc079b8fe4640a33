"""Language identification: script ranges narrow candidates, then Viterbi labels words.

A word (a run of letters) gets a score for each language from its letter bigrams and trigrams. Languages
whose training text hardly has the word's script are no candidates for it. The best path
through a text pays a penalty at each change of language, so that spans of mixed-language
texts get labels of their own; the text's language is the one with most letters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import crc_mod, hash_below, lean, texts_of, tune

BUCKETS = 1 << 16
#: First code points of ranges of letters with their scripts, in order.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"),
    (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x30000, "other"),
]
FIRST = np.array([a for a, _ in SCRIPTS], np.uint32)
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT = np.array([NAMES.index(n) for _, n in SCRIPTS])
#: Characters scored at once; longer texts are cut between words for this.
AT_ONCE = 1 << 20
BLOCK = 64
#: The score of a language that is no candidate for a word.
NEVER = -1e4

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  #: 2 (bigrams, trigrams) x BUCKETS x languages, logarithms
    scripts: np.ndarray  #: scripts x languages: is a candidate


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    at: np.ndarray  #: positions that have n-grams: letters and the place behind each word
    first: np.ndarray  #: of each word among them
    grams: tuple[np.ndarray, np.ndarray]


def words_of(text: str) -> Words:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate(([0, 0], codes, [0])).astype(np.uint32)
    alpha = letters()[codes]
    codes = np.where(alpha, codes, np.uint32(0))
    edge = np.diff(alpha.view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    has = alpha.copy()
    has[end] = True
    at = np.flatnonzero(has)
    a, b, c = codes[at - 2], codes[at - 1], codes[at]
    two = b * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA77)
    three = (two ^ a * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    two *= np.uint32(0x165667B1)
    # a trigram of a word's first letter looks back over the gap: it must not see the word before
    early = alpha[at] & ~alpha[at - 1]
    three[early] = two[early]
    first = np.searchsorted(at, start)
    script = SCRIPT[np.searchsorted(FIRST, codes[start], side="right") - 1]
    return Words(start - 2, end - 2, script, at, first, (two >> np.uint32(16), three >> np.uint32(16)))


def slices(text: str) -> Iterator[tuple[int, str]]:
    """Parts of a text with their places, cut between words."""
    at = 0
    while len(text) - at > AT_ONCE:
        cut = at + AT_ONCE
        while cut < len(text) and text[cut].isalpha():
            cut += 1
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def train(
    df: DataFrame,
    keep=None,
    docs_per_language: int = 1500,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_languages: int = 500,
) -> Model:
    """A model of all languages in lang_col.

    Learns from rows with text and language (where keep, a condition, holds); of each language at most
    docs_per_language ids, those whose hashes come first. That bound makes what the driver gathers independent
    of the corpus: counts in 2 x BUCKETS cells per language. More than max_languages are an error: none is left out."""
    spark = df.sparkSession
    tune(spark)
    named = df.where(keep if keep is not None else F.lit(True)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    named = named.where("lang is not null")  # texts are read for the sample alone; null ones add nothing
    counts = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages (0.5 MB of model each)")
    if not counts:
        return Model([], np.zeros((2, BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * docs_per_language / n))))[F.col("lang")]
    first = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    near = named.select("id", "lang").where(hash_below("id", share) | (share >= 1)).distinct()  # about 2 x docs_per_language of each
    chosen = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_language).select("id", "lang")
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # bounded by max_languages x docs_per_language
    sample = named.join(F.broadcast(chosen), ["id", "lang"]).where("text is not null").select("text", "lang")

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(texts_of(b, "text"), b.column("lang").to_pylist()):
                g = grams.setdefault(lang, np.zeros((2, BUCKETS), np.int64))
                s = scripts.setdefault(lang, np.zeros(len(NAMES), np.int64))
                for _, part in slices(text.lower()):
                    w = words_of(part)
                    for k in (0, 1):
                        g[k] += np.bincount(w.grams[k], minlength=BUCKETS)
                    s += np.bincount(w.script, weights=w.end - w.start, minlength=len(NAMES)).astype(np.int64)
        for lang, g in grams.items():
            cells = np.concatenate((g.ravel(), scripts[lang]))
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(cells[at])], ["lang", "cell", "n"])

    cells = sample.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(cells["lang"].unique())
    table = np.zeros((2 * BUCKETS + len(NAMES), len(languages)))
    table[cells["cell"], [languages.index(x) for x in cells["lang"]]] = cells["n"]
    scores = np.empty((2, BUCKETS, len(languages)), np.float32)
    for k in (0, 1):
        part = table[k * BUCKETS : (k + 1) * BUCKETS] + 0.5
        scores[k] = np.log(part / part.sum(axis=0))
    shares = table[2 * BUCKETS :]
    return Model(languages, scores, shares >= 0.01 * np.maximum(shares.sum(axis=0), 1))


def word_scores(model: Model, w: Words) -> np.ndarray:
    """Words x languages. A word in a script of no language says nothing."""
    if not len(w.start):
        return np.zeros((0, len(model.languages)), np.float32)
    each = model.scores[0][w.grams[0]] + model.scores[1][w.grams[1]]
    out = np.add.reduceat(each, w.first, axis=0)
    out -= out.max(axis=1, keepdims=True)
    candidate = model.scripts[w.script]
    known = candidate.any(axis=1, keepdims=True)
    return np.where(known, np.where(candidate, np.maximum(out, NEVER), NEVER), 0).astype(np.float32)


def _forward(s: np.ndarray, entry: np.ndarray, penalty: float, stays: np.ndarray, bests: np.ndarray) -> np.ndarray:
    """Blocks of scores (blocks x BLOCK x languages) from the states they are entered with. A state is each language's score less
    the best one's; what lies deeper than the penalty is marked, as it can't be stayed with. stays and bests are filled:
    whether a language's best path came from itself, and the best language before each word."""
    low = np.float32(-penalty)
    d = entry
    for t in range(BLOCK):
        bests[:, t] = d.argmax(axis=1)
        stays[:, t] = d >= low
        d = np.maximum(d, low) + s[:, t]
        d -= d.max(axis=1, keepdims=True)
        d = np.where(d >= low, d, low - np.float32(1))
    return d


def best_paths(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The Viterbi labels of rows of scores; offsets: of texts, each with a path of its own.

    All blocks of words run at once, first as if each began a text. A block whose entry proves to differ from what the block before it
    gives runs again with that, until none differs (twice for most, as a state forgets what lies a few clear words back);
    the result is that of a pass word by word. Memory grows with words times languages."""
    n, langs = scores.shape
    sizes = np.diff(offsets)
    counts = -(-sizes // BLOCK)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    total = int(firsts[-1])
    if not total:
        return np.empty(0, np.int64)
    inside = np.arange(n) - np.repeat(offsets[:-1], sizes)
    slot = (np.repeat(firsts[:-1], sizes) + inside // BLOCK) * BLOCK + inside % BLOCK
    s = np.zeros((total * BLOCK, langs), np.float32)
    s[slot] = scores
    s = s.reshape(total, BLOCK, langs)
    entry, leave = np.zeros((total, langs), np.float32), np.empty((total, langs), np.float32)
    stays, bests = np.empty((total, BLOCK, langs), bool), np.empty((total, BLOCK), np.int32)
    begins = np.zeros(total, bool)
    begins[firsts[:-1][counts > 0]] = True
    todo = np.arange(total)
    while len(todo):
        own_stays, own_bests = np.empty((len(todo), BLOCK, langs), bool), np.empty((len(todo), BLOCK), np.int32)
        leave[todo] = _forward(s[todo], entry[todo], penalty, own_stays, own_bests)
        stays[todo], bests[todo] = own_stays, own_bests
        after = todo + 1
        after = after[after < total]
        after = after[~begins[after]]
        todo = after[(entry[after] != leave[after - 1]).any(axis=1)]
        entry[todo] = leave[todo - 1]
    # backwards: which language each block is entered with, for every language that it may be left with
    rows = np.arange(total)
    back = np.tile(np.arange(langs), (total, 1))
    for t in range(BLOCK - 1, -1, -1):
        back = np.where(np.take_along_axis(stays[:, t], back, 1), back, bests[:, t, None])
    order = np.argsort(-counts, kind="stable")
    active = np.searchsorted(-counts[order], -np.arange(counts.max()) - 0.5, side="left")
    state, left = np.zeros(len(counts), np.int64), np.empty(total, np.int64)
    ends = firsts[1:] - 1
    state[counts > 0] = leave[ends[counts > 0]].argmax(axis=1)
    for k in range(len(active) - 1, -1, -1):
        docs = order[: active[k]]
        at = firsts[docs] + k
        left[at] = state[docs]
        state[docs] = back[at, state[docs]]
    labels = np.empty((total, BLOCK), np.int64)
    for t in range(BLOCK - 1, -1, -1):
        labels[:, t] = left
        left = np.where(stays[rows, t, left], left, bests[:, t])
    return labels.reshape(-1)[slot]


def identify(df: DataFrame, model: Model, penalty: float = 8.0, with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of letters in words of that language), and where with_spans the
    spans (start, end, lang) of words of one language.

    Null texts and texts without letters give `und`, score 0 and no spans; with a model of no language
    all do. Equal shares go to the language that sorts first. Null and repeated ids stay rows;
    other columns are not read."""
    tune(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 x BUCKETS numbers a language

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = texts_of(b, "text")
            preds, shares, spans = [], [], []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                    size += len(texts[end])
                    end += 1
                for p, share, sp in _label(m, texts[at:end], penalty, with_spans):
                    preds.append(p)
                    shares.append(share)
                    spans.append(sp)
                at = end
            cols = [b.column("doc_id"), pa.array(preds, pa.string()), pa.array(shares, pa.float64())]
            if with_spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                cols.append(pa.array(spans, kind))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = ", spans array<struct<start:bigint,end:bigint,lang:string>>" * with_spans
    return named.mapInArrow(run, "doc_id long, lang_pred string, score double" + spans)


def _lower(text: str) -> str:
    """Lower case without changing the number of characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _label(m: Model, texts: list[str], penalty: float, with_spans: bool) -> Iterator[tuple[str, float, list | None]]:
    """All texts are scored as one, joined by a character that is no letter, unless one is long."""
    if not m.languages:
        yield from (("und", 0.0, []) for _ in texts)
        return
    lows = [_lower(t) for t in texts]
    joined = "\n".join(lows)
    starts = np.cumsum([0, *(len(t) + 1 for t in lows)])
    begin, end, scores = [], [], []
    for place, part in slices(joined):
        w = words_of(part)
        begin.append(w.start + place)
        end.append(w.end + place)
        scores.append(word_scores(m, w))
    begin, end, scores = np.concatenate(begin), np.concatenate(end), np.concatenate(scores)
    offsets = np.searchsorted(begin, starts)
    labels = best_paths(scores, offsets, penalty)
    langs = len(m.languages)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    weight = np.bincount(doc * langs + labels, weights=end - begin, minlength=len(texts) * langs).reshape(len(texts), langs)
    whole, best = weight.sum(axis=1), weight.argmax(axis=1)
    for i in range(len(texts)):
        a, z = offsets[i], offsets[i + 1]
        spans = None
        if with_spans:
            cuts = np.flatnonzero(np.diff(labels[a:z])) + 1
            edges = np.r_[0, cuts, z - a] if z > a else np.empty(0, np.int64)
            spans = [{"start": int(begin[a + x] - starts[i]), "end": int(end[a + y - 1] - starts[i]), "lang": m.languages[labels[a + x]]} for x, y in zip(edges[:-1], edges[1:])]
        yield ("und", 0.0, spans) if not whole[i] else (m.languages[best[i]], float(weight[i, best[i]] / whole[i]), spans)


def identify_held_out(docs: DataFrame, docs_per_language: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows whose crc32(doc_id as text) mod 3 is not 1,
    applied to all. A null doc_id is never learned from and not held out."""
    rest = crc_mod("doc_id", 3)
    model = train(docs, rest != 1, docs_per_language)
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
