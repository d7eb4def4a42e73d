"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed n-grams of the lower-cased text (lengths GRAMS, a space added at both ends) is scaled by the
log ratio of its smoothed rates in toxic and clean training texts; a logistic regression with an L2 penalty is
fitted on the scaled features. Counting runs over the training rows on the executors; the fit itself is on the
driver and bounded by max_train rows and n_features features. Scoring is one pass over whole texts.

Rules: null text scores as empty text does (the intercept alone); a null label or id is not trained on; several
labels of one id count as toxic if any is; rows repeated with one id are trained on as often as they occur. A text of any
length is scored whole; its n-grams count once each, so in the fit it has at most n_features of them. No rows give no rows.
Without labels of both classes the score is the share of toxic ones
among them (0 without any). Other columns are ignored and kept as they are by ``add_score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trimmed
from .optimise import minimised

GRAMS = (3, 4, 5)
HASH_BITS = 20
CHUNK_CHARS = 1 << 19
#: Bounds of the fit: labelled rows (taken by the hash of their id) and selected features.
MAX_TRAIN = 8_000
N_FEATURES = 8_192
MIN_DOCS = 3
#: Added to counts of documents before the ratio; and the strength of the L2 penalty.
SMOOTHING = 1.0
PENALTY = 1.0

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about CHUNK_CHARS characters, each with the index of its first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def hashed_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, bucket) of every n-gram occurrence, one pair of arrays per n-gram length."""
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    mixed = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        mixed = mixed[:m] + codes[n - 1 :] * _K[n - 1]
        if n in GRAMS:
            x = mixed ^ (mixed >> np.uint64(29))
            bucket = ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
            whole = owner[:m] == owner[n - 1 :]
            yield owner[:m][whole], bucket[whole]


def present(texts: list[str], index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, feature) pairs in order; index maps buckets to features (-1: not selected)."""
    found = []
    for owner, bucket in hashed_grams(texts):
        if index is not None:
            feature = index[bucket]
            hit = feature >= 0
            owner, bucket = owner[hit], feature[hit]
        found.append((owner.astype(np.int64) << HASH_BITS) | bucket)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


@dataclass
class Model:
    index: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        if len(self.weights):
            for first, chunk in _chunks(texts):
                owner, feature = present(chunk, self.index)
                out[first : first + len(chunk)] += np.bincount(owner, self.weights[feature], minlength=len(chunk))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-out))


def fit_logistic(owner: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept, by L-BFGS on the mean log loss."""
    n, k = len(y), len(scale)
    value = scale[feature]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(owner, value * w[feature], minlength=n) + w[k]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(feature, value * (p - y)[owner], minlength=k), (p - y).sum()) / n
        grad[:k] += penalty / n * w[:k]
        return float(np.mean(np.logaddexp(0, z) - y * z) + penalty / (2 * n) * (w[:k] ** 2).sum()), grad

    w = np.zeros(k + 1)
    w[k] = np.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))
    w = minimised(loss, w, rounds)
    return w[:k] * scale, float(w[k])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, n_features: int | None = N_FEATURES) -> Model:
    """Fit on labelled rows that are not held out; of more than max_train, those with the smallest hashes of their id.
    n_features None: all n-grams of MIN_DOCS training rows take part."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = known.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(max_train / n * (1 << 40)))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(known), "id").select("y", "text", F.xxhash64("id", "text").alias("k"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << HASH_BITS), dtype=np.int32)
        docs_of = [0, 0]
        for b in batches:
            y, texts = (b.column("y").to_numpy(zero_copy_only=False) > 0).astype(int), b.column("text").to_pylist()
            for c in (0, 1):
                docs_of[c] += int((y == c).sum())
            for first, chunk in _chunks(texts):
                owner, bucket = present(chunk)
                of = y[first : first + len(chunk)][owner]
                for c in (0, 1):
                    seen[c] += np.bincount(bucket[of == c], minlength=1 << HASH_BITS).astype(np.int32)
        hit = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1), pa.int32()), pa.array(np.append(seen[1][hit], docs_of[1]), pa.int64()), pa.array(np.append(seen[0][hit], docs_of[0]), pa.int64())], ["bucket", "pos", "neg"])

    counts = rows.mapInArrow(trimmed(count), "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # the row of bucket -1 holds the numbers of documents and sorts first
    p, q = F.col("pos"), F.col("neg")
    whole = F.max(F.when(F.col("bucket") < 0, F.struct("pos", "neg")))
    totals = counts.where("bucket < 0").agg(whole.alias("x")).first()["x"]
    n_pos, n_neg = (totals["pos"], totals["neg"]) if totals else (0, 0)
    empty = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    if not n_pos or not n_neg:
        share = int(n_pos > 0)
        return Model(empty, np.zeros(0), float("inf") if share else float("-inf"))
    ratio = F.log((p + SMOOTHING) / (n_pos + 2 * SMOOTHING) / ((q + SMOOTHING) / (n_neg + 2 * SMOOTHING)))
    expected = (p + q) * F.lit(n_pos / (n_pos + n_neg))
    chosen = counts.where((F.col("bucket") >= 0) & (p + q >= MIN_DOCS)).withColumn("ratio", ratio).withColumn("chi", (p - expected) * (p - expected) / expected)
    chosen = chosen.orderBy(F.col("chi").desc(), "bucket")
    chosen = (chosen if n_features is None else chosen.limit(n_features)).select("bucket", "ratio").toPandas()
    index = empty
    index[chosen["bucket"].to_numpy()] = np.arange(len(chosen), dtype=np.int32)
    scale = chosen["ratio"].to_numpy(dtype=float)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, y = b.column("text").to_pylist(), b.column("y").to_pylist()
            for first, chunk in _chunks(texts):
                owner, feature = present(chunk, shared.value)
                parts = np.split(feature.astype(np.int32), np.searchsorted(owner, np.arange(1, len(chunk))))
                yield pa.RecordBatch.from_arrays([pa.array([int(v > 0) for v in y[first : first + len(chunk)]], pa.int32()), pa.array(parts, pa.list_(pa.int32())), b.column("k").slice(first, len(chunk))], ["y", "f", "k"])

    table = rows.mapInArrow(trimmed(select), "y int, f array<int>, k long").toArrow()
    table = table.sort_by("k").combine_chunks()  # sums in one order, whatever the order of rows
    y = table.column("y").to_numpy().astype(float)
    lists = table.column("f").chunk(0)
    owner = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    weights, intercept = fit_logistic(owner, lists.flatten().to_numpy(), scale, y)
    return Model(index, weights, intercept)


def add_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of every whole text as column out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(shared.value.score(s.tolist()))

    return docs.withColumn(out, score(text_or_empty(text_col)))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels, **options)
    found = add_score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs without the rows that score threshold or more."""
    model = train(docs, labels, **options)
    return add_score(docs, model, out="__tw_score").where(F.col("__tw_score") < threshold).drop("__tw_score")
