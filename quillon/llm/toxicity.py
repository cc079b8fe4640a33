"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has a probability from its words and their stems; the text's is their
noisy-or, one minus the product of the complements. Only texts have labels: the sentence model is
fitted through the noisy-or, and so learns which sentences offend.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import crc_mod, first_by_hash, lean, texts_of, tune, written

WORD = re.compile(r"[^\W\d_]+")
#: Ends of sentences: Latin, line ends, Devanagari, Arabic, and full-width ones.
SENTENCE = re.compile(r"[^.!?\n\u0964\u061f\u06d4\u3002\uff01\uff1f]+")
THRESHOLD = 0.3


#: Different features that a task counts before it hands counts on.
COUNTED = 200_000
#: Lengths of word beginnings that count as stems of inflected forms.
STEMS = range(3, 8)


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word, *(word[:k] for k in STEMS if k <= len(word))]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]  #: of words ("=" in front) and stems
    starts: set[str] = field(init=False)  #: first letters of all of them

    def __post_init__(self) -> None:
        self.starts = {f.removeprefix("=")[:3] for f in self.weights}


def fit_bags(bags: list[list[list[int]]], sizes: list[int], labels: np.ndarray, n_words: int, steps: int = 400, rate: float = 0.1, l2: float = 2e-4) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the likelihood of labels under the noisy-or, by Adam.

    bags: of each text, its sentences with known words, as word numbers; sizes: all its sentences."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    lens = np.array([len(s) for bag in bags for s in bag], np.int64)
    words = np.array([w for bag in bags for s in bag for w in s], np.int64)
    owner = np.repeat(np.arange(len(lens)), lens)
    plain = np.asarray(sizes) - np.bincount(doc, minlength=len(bags))  # sentences without known words
    theta = np.zeros(n_words + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(owner, theta[words], len(lens))
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        none = np.exp(np.clip(plain * np.log1p(-p0) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags)), -700, -1e-12))
        pull = np.where(labels == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        g = pull[doc] * p
        grad = np.zeros_like(theta)
        grad[:-1] = np.bincount(words, g[owner], n_words)
        grad[-1] = g.sum() + (pull * plain * p0).sum()
        grad = grad / len(bags) - l2 * np.r_[theta[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(theta[-1]), theta[:-1]


def train(
    docs: DataFrame,
    labels: DataFrame,
    keep=None,
    max_docs: int = 12_000,
    max_words: int = 2_000,
    min_docs: int = 8,
    min_lift: float = 6.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """A model from labelled texts: at most max_docs of them, those whose hashed ids come first, and at most
    max_words words and stems, those that tell toxic texts most. Null labels and texts are left out. Without any toxic
    or any harmless text the model knows no word and rates sentences at the base rate. An id with several labels counts as
    toxic if any of them says so."""
    spark = docs.sparkSession
    tune(spark)
    chosen = labels.where(keep if keep is not None else F.lit(True)).where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    ids = spark.createDataFrame(first_by_hash(chosen, "id", max_docs).collect(), "id long")  # bounded by max_docs
    chosen = chosen.join(F.broadcast(ids), "id").groupBy("id").agg(F.max("label").alias("label"))
    chosen = spark.createDataFrame(chosen.collect(), "id long, label int")  # bounded by max_docs
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id").select("text", "label")
    sample = written(sample, "sample")  # read twice

    @lean
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, bad = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([bad[f] for f in n], pa.int64()), pa.array(list(n.values()), pa.int64())], ["word", "bad", "n"])
            n.clear(), bad.clear()
            return out

        for b in batches:
            for text, label in zip(texts_of(b, "text"), b.column("label").to_pylist()):
                own = {"", *(f for w in set(WORD.findall(text.lower())) for f in features(w))}
                n.update(own)
                if label:
                    bad.update(own)
                if len(n) >= COUNTED:
                    yield flush()
        yield flush()

    counted = sample.mapInArrow(seen, "word string, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    whole = counted.where("word = ''").first()
    if whole is None or not 0 < whole["bad"] < whole["n"]:
        rate = 0.0 if whole is None else min(max(whole["bad"] / whole["n"], 1e-4), 1 - 1e-4)
        return Model(float(np.log(rate / (1 - rate))) if rate else -5.0, {})
    base = whole["bad"] / whole["n"]
    lift = (F.col("bad") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    telling = counted.where((F.col("word") != "") & (F.col("n") >= min_docs)).withColumn("lift", lift).where(F.col("lift") > min_lift).orderBy(F.desc("lift"), "word").limit(max_words)
    vocabulary = [r["word"] for r in telling.select("word").collect()]
    known = {w: i for i, w in enumerate(vocabulary)}

    @lean
    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes = [], []
            for text in texts_of(b, "text"):
                sentences = SENTENCE.findall(text.lower())
                own = [sorted({known[f] for w in WORD.findall(s) for f in features(w) if f in known}) for s in sentences]
                found.append([s for s in own if s])
                sizes.append(max(1, len(sentences)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.list_(pa.int32()))), pa.array(sizes, pa.int32()), b.column("label")], ["bag", "size", "label"])

    rows = sample.mapInArrow(bag, "bag array<array<int>>, size int, label int").collect()  # numbers of known words; bounded by max_docs
    rows.sort(key=lambda r: (r["label"], r["size"], r["bag"]))
    bias, weights = fit_bags([r["bag"] for r in rows], [r["size"] for r in rows], np.array([r["label"] for r in rows]), len(vocabulary))
    return Model(bias, dict(zip(vocabulary, weights.tolist())))


def score_text(model: Model, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """The text's probability, and the sentences (start, end, probability) that hold known words (others have the base rate)."""
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    p0 = 1 / (1 + np.exp(-model.bias))
    weights, starts = model.weights, model.starts
    if not any(f in weights for w in set(WORD.findall(low)) if w[:3] in starts for f in features(w)):
        return float(1 - (1 - p0) ** max(1, len(SENTENCE.findall(low)))), []
    none, spans, n = 1.0, [], 0
    for s in SENTENCE.finditer(low):
        n += 1
        known = {f for w in WORD.findall(s[0]) if w[:3] in starts for f in features(w) if f in weights}
        p = p0
        if known:
            p = 1 / (1 + np.exp(-(model.bias + sum(weights[f] for f in sorted(known)))))
            spans.append((s.start(), s.end(), float(p)))
        none *= 1 - p
    return float(1 - none), spans


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score at or over the threshold), offending: the spans (start, end,
    score) of sentences that reach the threshold. With keep_columns, df's columns and __toxicity instead.

    Null and empty texts count as one sentence without known words. Null and repeated ids stay rows."""
    tune(df.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rated = [score_text(model, t) for t in texts_of(b, text_col if keep_columns else "text")]
            scores = pa.array([r[0] for r in rated], pa.float64())
            if keep_columns:
                yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, "__toxicity"])
                continue
            spans = pa.array([[{"start": a, "end": e, "score": p} for a, e, p in r[1] if p >= threshold] for r in rated], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores, pa.array([int(r[0] >= threshold) for r in rated], pa.int32()), spans], ["doc_id", "score", "predicted", "offending"])

    if keep_columns:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, schema + ", __toxicity double")
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start:bigint,end:bigint,score:double>>")


def score_held_out(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted, offending: learned from labels whose crc32(doc_id as text) mod 4
    is not 2, applied to all documents. A null doc_id is not held out."""
    rest = crc_mod("doc_id", 4)
    model = train(docs, labels, rest != 2, max_docs)
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", "predicted", "offending")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_docs: int = 12_000, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is under the threshold, with their columns as they are.

    Null and empty texts score like one sentence without known words and so stay at usual base rates; rows that repeat fare alike;
    null ids are scored like any other; with an empty table of labels nothing is known and everything stays."""
    model = train(docs, labels, crc_mod("doc_id", 4) != 2, max_docs)
    return score(docs, model, keep_columns=True).where(F.col("__toxicity") < threshold).drop("__toxicity")
