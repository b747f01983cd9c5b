"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-cased words (runs of letters, digits and non-ASCII bytes), their stems (the first
``STEMS`` bytes, so that inflected forms share a feature), pairs of neighbours and pairs with one word between, each
hashed to ``BITS`` bits; a feature counts once per text.
Training takes labelled rows whose crc32(doc_id as text) mod 4 is not 2: at most ``SAMPLE`` of them, those with the
smallest hashed ids, so the sample does not depend on the order of rows. One task runs FTRL over that bounded
sample, as the method goes from row to row, with a learning rate per coordinate. L1 makes nearly all weights
zero, and what is left, 2^BITS numbers at most, goes to the tasks that score all texts.

Defined cases: null or empty text has no features and gets the bias alone; a document with several labels is toxic
if any says so, and of its rows the one with the smallest text hash is learned from; labels without text or ``toxic`` are not used; without any training row, or with one class only, the
score is the (smoothed) share of toxic rows; repeated rows are scored each; a null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import by_text, steps
from fleetgauge.llm.words import LOWER, bytes_of, mix, word_hashes
from fleetgauge.session import stored

BITS = 20
SAMPLE = 16384
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 0.1
THRESHOLD = 0.3
STEMS = (4, 5, 6)
INSIDE = np.zeros(256, np.int8)
INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def hashed_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every word, stem, neighbour pair and skip pair; repeats included."""
    data, offsets = bytes_of(column)
    words, rows, *stems = word_hashes(data, offsets, INSIDE, LOWER, STEMS)
    shift = np.uint64(64 - BITS)
    out_rows = [rows] * (1 + len(stems))
    out = [mix(words) >> shift, *(mix(x * np.uint64(101 + 2 * i)) >> shift for i, x in enumerate(stems))]
    for gap in (1, 2):
        same = rows[gap:] == rows[:-gap]
        first, second = words[:-gap][same], words[gap:][same]
        out_rows.append(rows[gap:][same])
        out.append(mix(first * np.uint64(2 * gap + 1) + mix(second)) >> shift)
    return np.concatenate(out_rows), np.concatenate(out).astype(np.int64)


def _examples(column: pa.Array) -> list[np.ndarray]:
    rows, features = hashed_features(column)
    pairs = np.unique(rows << BITS | features)
    return np.split(pairs & ((1 << BITS) - 1), np.searchsorted(pairs, np.arange(1, len(column)) << BITS))


def _fit(examples: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes of FTRL-proximal with per-coordinate rates."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0
    rng = np.random.default_rng(0)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            at = examples[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30)))
            g = p - labels[i]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_n))
    return weights(np.arange(1 << BITS)), bias


def train(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``feature, weight`` of the non-zero weights; feature -1 is the bias."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    picked = known.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    picked = stored(picked, "toxicity-sample")
    # one row per id, so repeated rows of a sampled id don't all go to the task that fits
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id").groupBy("doc_id", "toxic").agg(
        F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("doc_id", "one.text", "toxic")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            for piece in steps(batch):
                xs += _examples(piece.column("text"))
                ys += piece.column("toxic").to_pylist()
        y = np.array(ys, float)
        if 0 < y.sum() < len(y):
            w, bias = _fit(xs, y)
        else:
            rate = (y.sum() + 1) / (len(y) + 2)
            w, bias = np.zeros(1 << BITS), float(np.log(rate / (1 - rate)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias))], ["feature", "weight"])

    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(2)), "doc_id", "text")
    return stored(ordered.mapInArrow(fit, "feature long, weight double"), "toxicity-model")


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``doc_id, score`` for every row. The model has at most 2^BITS + 1 rows, which bounds what is sent to tasks."""
    got = model.toArrow()
    at, w = got.column("feature").to_numpy(), got.column("weight").to_numpy()
    order = np.argsort(at)
    at, w = at[order], w[order]
    bias = float(w[0]) if len(at) and at[0] == -1 else 0.0
    known = np.zeros(1 << BITS, bool)
    known[at[at >= 0]] = True
    packed = np.packbits(known)

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows, features = hashed_features(piece.column("text"))
        hit = np.unpackbits(packed).view(bool)[features]
        pairs = np.unique(rows[hit] << BITS | features[hit])
        weight = w[np.searchsorted(at, pairs & ((1 << BITS) - 1))] if len(pairs) else np.zeros(0)
        sums = bias + np.bincount(pairs >> BITS, weight, piece.num_rows)
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))))], ["doc_id", "score"])

    return by_text(docs, ["doc_id", "text"], run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
