"""Quality classifier: supervised subword embeddings, trained here by numpy stochastic gradient descent.

Model. A text's features are its words, their character n-grams and its word bigrams, hashed into `BUCKETS`
learned vectors; a bigram of twice the same word is one feature of its own. The vectors' mean goes through a
linear layer and softmax. As the layer is linear, a trained model folds into one number for each bucket (its vector
times the difference of the two output rows), so a score is a mean of looked-up numbers; the folded table has a
fixed size and is broadcast.

Training set. Labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most `SAMPLE` of them, taken by hash of
doc_id; their texts are used whole. Labels, lang, source and doc_id are inputs of no score. Without labelled rows
every score is 0.5.

Cases. A long text counts whole; it has at most `BUCKETS` distinct features. Null text counts as empty; a text without words scores by the bias alone. Null labels and null doc_ids
in `labels` are left out; repeated labels count once, the larger one. Repeated documents are scored one by one. An
empty table gives an empty result. Extra columns, whatever their names, are ignored by `classify` and kept by
`keep_good`.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import boxed, each_text, unboxed, worker_cache

FOLDS = 5
THRESHOLD = 0.3
BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 4)
SAMPLE = 2000
EPOCHS = 15
RATE = 2.0
KEPT_WORDS = 400_000
#: Bucket of a word followed by itself.
SAME = zlib.crc32(b"<same>") % BUCKETS


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def word_buckets(word: bytes) -> list[int]:
    """The word itself, then its character n-grams."""
    marked = f"<{word.decode(errors='replace')}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(x.encode()) % BUCKETS for x in grams)]


def bigram_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, given the words' CRC-32 values."""
    a, b = hashes[:-1].astype(np.uint64), hashes[1:].astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA6B)) >> np.uint64(7)
    return np.where(a == b, SAME, (mixed % np.uint64(BUCKETS)).astype(np.int64))


class Words:
    """What a worker keeps of the words it has met, `KEPT_WORDS` at most."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = table
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hashes, self.sums, self.sizes = array("I"), array("d"), array("I")
        self.buckets: list[list[int]] = []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.number)
        if len(self.number) + len(new) > KEPT_WORDS:
            self.clear()
            new = set(words)
        for word in new:
            found = word_buckets(word)
            self.number[word] = len(self.hashes)
            self.hashes.append(zlib.crc32(word))
            self.sizes.append(len(found))
            if self.table is None:
                self.buckets.append(found)
            else:
                self.sums.append(float(self.table[found].sum(dtype=np.float64)))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def features(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct buckets of a text and how often each occurs."""
        own = self.numbers(text.split())
        found = np.array([b for i in own.tolist() for b in self.buckets[i]], np.int64)
        both = np.concatenate([found, bigram_buckets(np.array(self.hashes)[own])])
        return np.unique(both, return_counts=True)

    def scores(self, texts: Iterable[bytes], bias: float) -> list[float]:
        out = []
        for text in texts:
            own = self.numbers(text.split())
            total, size = 0.0, 0
            if len(own):
                pairs = bigram_buckets(np.frombuffer(self.hashes, np.uint32)[own])
                total = float(np.frombuffer(self.sums)[own].sum() + self.table[pairs].sum(dtype=np.float64))
                size = int(np.frombuffer(self.sizes, np.uint32)[own].sum()) + len(pairs)
            out.append(1 / (1 + np.exp(-np.clip(bias + total / max(1, size), -60, 60))))
        return out


@dataclass
class Model:
    """Folded model: log odds of label 1 are bias + mean of table[bucket]."""

    table: np.ndarray
    bias: float


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Stochastic gradient descent over (buckets, counts, label), one text at a time, with falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    total, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            buckets, counts, label = rows[k]
            share = counts / max(1, counts.sum())
            hidden = share @ vectors[buckets]
            logits = out @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            step = rate * (1 - done / total)
            back = error @ out
            out -= step * np.outer(error, hidden)
            bias -= 0.1 * step * error
            vectors[buckets] -= step * share[:, None] * back
            done += 1
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Words().features(x) for x in each_text(batch.column("text"), 1)]
        lists = [pa.array([f[i].astype(np.int32) for f in found], pa.list_(pa.int32())) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "buckets", "counts"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on the labelled documents outside the held-out fold, `sample` at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    known = known.where("_id IS NOT NULL AND label IN (0, 1)").where(fold_of(F.col("_id")) != 0)
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([tuple(r) for r in chosen], "_id LONG, label INT")  # `sample` rows at most
    texts = _texts(docs)
    rows = texts.join(F.broadcast(ids), texts["doc_id"] == ids["_id"]).select("doc_id", "label", "text")
    rows = rows.mapInArrow(_feature_batches, "doc_id BIGINT, label INT, buckets ARRAY<INT>, counts ARRAY<INT>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "buckets", "counts")).alias("f")).select("doc_id", "f.*")
    found = rows.toArrow().sort_by("doc_id")  # `sample` rows of at most `BUCKETS` distinct buckets each, read where they lie
    columns = (found.column(x).combine_chunks() for x in ("buckets", "counts", "label"))
    return train([(b.values.to_numpy(), c.values.to_numpy(), label.as_py()) for b, c, label in zip(*columns)])


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast((model.table, model.bias))
    name = uuid.uuid4().hex

    def scores(texts: pa.Array) -> pa.Array:
        table, bias = shared.value
        by = worker_cache(("words", name), lambda: Words(table))
        return pa.array(by.scores(each_text(texts), bias), pa.float64())

    return scores


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Score of a whole text, from the text alone."""
    return F.arrow_udf(_scorer(spark, model), "double").asNondeterministic()(F.coalesce(text, F.lit("")))  # evaluated once


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: held_out, score, predicted."""
    model = fit(docs, labels)
    rows = _texts(docs).withColumn("score", score_column(docs.sparkSession, model, F.col("text")))
    held_out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score `threshold` or more; all columns stay."""
    score = score_column(docs.sparkSession, fit(docs, labels), F.col("text"))
    return unboxed(boxed(docs, score=score).where(F.col("score") >= threshold), docs)
