"""Toxicity from a bag of subwords: character n-grams of each word share vectors, so unseen misspellings lie near the known word.

A document is the mean of the vectors of all its subwords (the whole word between marks and its character n-grams, hashed into
`buckets` rows) and `NEUTRAL` zero vectors; a linear softmax over that mean gives the score. Vectors and softmax are trained jointly in numpy by
stochastic gradient steps in one task, on at most `per_class` labelled rows of each class (the least hashes of the ids), each class weighted to its
share among all labelled rows. The model has a fixed size, so sending it to every task is bounded; all texts are scored whole.

Nulls: a null text counts as empty; a text without words gets the score of the class shares. Labels that are null, or
rows whose doc_id is null, teach nothing; a doc_id with several labels counts as toxic if one of them is 1. With no labels, or
labels of one class, every score is the share of label 1 (0 without labels). Repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.decontam import words
from waymark.llm.shared import table

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 5)
PER_CLASS = 2500
EPOCHS = 6
RATE = 0.1
THRESHOLD = 0.3
CACHE_WORDS = 400_000
#: Zero vectors that stand beside a text's subwords in its mean, so a few odd words don't decide over a short text.
NEUTRAL = 500


def subwords(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Bucket numbers of a word's n-grams and of the word itself."""
    marked = f"<{word.decode(errors='replace')}>"
    n = len(marked)
    grams = {marked} | {marked[i : i + k] for k in range(GRAMS[0], GRAMS[1] + 1) for i in range(n - k + 1)}
    return [zlib.crc32(g.encode()) % buckets for g in sorted(grams)]


class Model:
    """weight: for each bucket, its vector's product with the difference of the two softmax columns; bias: likewise."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias


def _bags(texts: list[bytes], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of the mean bag of each text; the shares of the neutral vectors are left out."""
    known: dict[bytes, bytes] = {}
    bags = []
    for raw in texts:
        parts = []
        for w in words(raw):
            if w not in known:
                known[w] = np.array(subwords(w, buckets), np.int32).tobytes()
            parts.append(known[w])
        ids = np.frombuffer(b"".join(parts), np.int32)
        col, n = np.unique(ids, return_counts=True)
        bags.append((col, (n / (len(ids) + NEUTRAL)).astype(np.float32)))
    return bags


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, prior: float, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Joint training of subword vectors and softmax on the weighted log loss, a text a step, steps scaled by the
    gradients so far; prior: the share of label 1, where the bias begins."""
    logit = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if len(texts) == 0 or len(set(labels.tolist())) < 2:
        return Model(np.zeros(buckets, np.float32), logit)
    bags = _bags(texts, buckets)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (buckets, dimensions)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (dimensions, 2)).astype(np.float32)
    bias = np.array([0, logit], np.float32)
    seen_v, seen_s, seen_b = (np.full(x, 1e-8, np.float32) for x in (buckets, softmax.shape, 2))
    each = (weights / weights.mean()).astype(np.float32)
    # Means of thousands of subwords are tiny: this keeps the steps of the vectors and of the softmax alike.
    scale = np.float32(math.sqrt(np.mean([len(c) for c, _ in bags])))
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            col, share = bags[k]
            if not len(col):
                continue
            share = share * scale
            old = vectors[col]
            hidden = share @ old
            z = hidden @ softmax + bias
            z = np.exp(z - z.max())
            error = z / z.sum()
            error[labels[k]] -= 1
            error *= each[k]
            back = softmax @ error
            seen_v[col] += share * share * float(back @ back)
            vectors[col] = old - np.outer(share * (rate / np.sqrt(seen_v[col])), back)
            step = np.outer(hidden, error)
            seen_s += step * step
            seen_b += error * error
            softmax -= rate * step / np.sqrt(seen_s)
            bias -= 0.1 * rate * error / np.sqrt(seen_b)
    return Model(vectors @ (softmax[:, 1] - softmax[:, 0]) * scale, float(bias[1] - bias[0]))


class WordScores(dict):
    """word -> complex(sum of its subwords' weights, number of its subwords), filled as words come."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight = weight

    def __missing__(self, word: bytes) -> complex:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = subwords(word, len(self.weight))
        got = self[word] = complex(float(self.weight[ids].sum()), len(ids))
        return got


_scores: dict[int, WordScores] = {}


def _known(weight: np.ndarray, bias: float) -> tuple[WordScores, float]:
    """The worker's cache of word scores for a model."""
    mark = zlib.crc32(weight.tobytes())
    if mark not in _scores:
        _scores.clear()
        _scores[mark] = WordScores(weight)
    return _scores[mark], bias


def score(raw: bytes, known: WordScores, bias: float) -> float:
    total = sum(map(known.__getitem__, words(raw)), 0j)
    z = bias + total.real / (total.imag + NEUTRAL)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model from the labelled rows of docs(doc_id, text) and labels(doc_id, toxic). The sample is bounded, so one task trains on it and the driver
    gets the model alone."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = seen.get(0, 0) + seen.get(1, 0)
    if not total:
        return Model(np.zeros(BUCKETS, np.float32), -math.inf)
    prior = seen.get(1, 0) / total
    sample = None
    for toxic in (0, 1):
        ids = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id")
        rows = docs.join(F.broadcast(ids), "doc_id").select(F.lit(toxic).alias("toxic"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("t")).orderBy("doc_id", "t").limit(per_class)
        sample = rows if sample is None else sample.unionByName(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, texts = [], []
        for b in batches:
            labels += b.column(0).to_pylist()
            texts += b.column(2).to_pylist()
        ys = np.array(labels, np.int64)
        each = np.array([seen[y] / labels.count(y) for y in (0, 1) if y in labels])[np.unique(ys, return_inverse=True)[1]] if labels else np.empty(0)
        model = train(texts, ys, each, prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weight", "bias"])

    made = sample.repartition(1).sortWithinPartitions("toxic", "doc_id", "t").mapInArrow(run, "weight binary, bias double").first()
    return Model(np.frombuffer(made.weight, np.float32), made.bias) if made else train([], np.empty(0, np.int64), np.empty(0), prior)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bias = _known(*sent.value)
        for b in batches:
            found = [score(x.as_py() or b"", known, bias) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bias = _known(*sent.value)
        for b in batches:
            yield b.filter(pa.array([score((x.as_py() or "").encode(), known, bias) < threshold for x in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id) -> object:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
