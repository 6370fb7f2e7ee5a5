"""Toxicity by logistic regression with FTRL-proximal learning.

Features are hashed words, pairs of neighbouring words and pairs with one or two words skipped between them; a feature
counts once in a text. Each coordinate has its own learning rate, and the L1 term leaves few weights other than zero, so
that the model is a short table which every task can hold. Learning takes a bounded sample of labelled rows
(``max_rows`` and ``max_features``, chosen by a hash of the id); scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.shared import Stash, bounded_batches
from tidegate.llm.words import SPACES, Words, mix, returned, scan, slices

#: Words end at white space and at ASCII punctuation other than the apostrophe.
BREAKS = SPACES + bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != 39)
BITS = 20
MAX_ROWS = 16_000
#: Features of all sampled rows together, 4 bytes each.
MAX_FEATURES = 1 << 26
_SEEDS = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7)]


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and pair of a slice, not yet distinct."""
    rows, hashes = [words.row], [words.hash * _SEEDS[0]]
    for gap in (1, 2, 3):
        if len(words.hash) > gap:
            same = words.row[gap:] == words.row[:-gap]
            rows.append(words.row[:-gap][same])
            hashes.append((words.hash[:-gap][same] * _SEEDS[gap]) ^ (words.hash[gap:][same] * _SEEDS[0] + _SEEDS[gap]))
    return np.concatenate(rows), (mix(np.concatenate(hashes)) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row << BITS) | bucket)
    return both >> BITS, both & ((1 << BITS) - 1)


@returned
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            row, bucket = _distinct(*_features(scan(part.column(1), lower=True, breaks=BREAKS)))
            at = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], ["doc_id", "label", "features"])


def ftrl(examples: Sequence[tuple[np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights by bucket, the last being the intercept's, which the L1 term spares. Each epoch takes ``examples`` (the
    buckets of a text, its label) in their order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    free = np.full((1 << BITS) + 1, l1)
    free[-1] = 0.0
    for _ in range(epochs):
        for own, label in examples:
            zi, ni = z[own], n[own]
            root = np.sqrt(ni)
            w = -(zi - np.clip(zi, -free[own], free[own])) / ((beta + root) / alpha + l2)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
            z[own] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[own] = ni + g * g
    return -(z - np.clip(z, -free, free)) / ((beta + np.sqrt(n)) / alpha + l2)


class _Sample(Sequence):
    """Texts' features one after the other in one array, each with the intercept behind them."""

    def __init__(self, sizes: dict[int, int]):
        ids = np.array(sorted(sizes, key=_place), dtype=np.int64)
        self.row = {doc_id: i for i, doc_id in enumerate(ids.tolist())}
        self.at = np.concatenate([[0], np.cumsum(np.array([sizes[i] + 1 for i in ids.tolist()], dtype=np.int64))]).astype(np.int64)
        self.flat = np.full(self.at[-1], 1 << BITS, dtype=np.int32)
        self.label = np.zeros(len(ids), dtype=np.int8)

    def put(self, doc_id: int, label: int, features: np.ndarray) -> None:
        i = self.row[doc_id]
        self.flat[self.at[i] : self.at[i + 1] - 1] = features
        self.label[i] = label

    def __len__(self) -> int:
        return len(self.label)

    def __getitem__(self, i: int) -> tuple[np.ndarray, int]:
        if i >= len(self):
            raise IndexError(i)
        return self.flat[self.at[i] : self.at[i + 1]], int(self.label[i])


def _place(doc_id: int) -> int:
    """Where a row comes in the sample's order."""
    return int(mix(np.array([doc_id], dtype=np.int64).view(np.uint64) * _SEEDS[1])[0])


@returned
def _learn(batches: Iterator[pa.RecordBatch], sizes: dict[int, int], settings: dict) -> Iterator[pa.RecordBatch]:
    sample = _Sample(sizes)
    for batch in batches:
        lists = batch.column(2)
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i, (doc_id, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if doc_id in sample.row:
                sample.put(doc_id, label, flat[at[i] : at[i + 1]])
    weights = ftrl(sample, **settings)
    at = np.flatnonzero(weights)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weights[at])], ["bucket", "weight"])


@returned
def _score(batches: Iterator[pa.RecordBatch], buckets: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = np.zeros((1 << BITS) + 1)
    table[buckets] = weights
    some = table != 0
    for batch in batches:
        for part in slices(batch, "__text"):
            row, bucket = _features(scan(part.column(part.num_columns - 1), lower=True, breaks=BREAKS))
            hit = some[bucket]
            row, bucket = _distinct(row[hit], bucket[hit])
            total = np.bincount(row, weights=table[bucket], minlength=part.num_rows) + table[-1]
            score = 1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score)], [*part.schema.names[:-1], "score"])


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


class ToxicityModel:
    """A learned table of weights. Texts that are null or without words score the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray):
        self.buckets, self.weights = buckets, weights

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, epochs: int = 5, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0) -> ToxicityModel:
        """Learns from at most ``max_rows`` labelled documents outside the held-out fifth, the first ones by a hash of
        their ids, and of these from as many as have ``max_features`` features together (4 bytes each in the learner's
        memory), again the first ones.

        Labels other than 0 and 1 are passed over; of several labels of an id the largest counts, and of several texts
        the one with the smallest features. Without any label the model scores 0.5 everywhere.
        """
        spark = docs.sparkSession
        bounded_batches(spark)
        known = (
            labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
            .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        )
        sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
        settings = {"epochs": epochs, "alpha": alpha, "beta": beta, "l1": l1, "l2": l2}
        stash = Stash(spark)
        features = stash.keep(
            sample.select("doc_id", "text", "label").mapInArrow(_extract, "doc_id long, label int, features array<int>")
            .groupBy("doc_id").agg(F.first("label").alias("label"), F.min("features").alias("features")),
            "features",
        )
        sizes = {r.doc_id: r.n for r in features.select("doc_id", F.size("features").alias("n")).collect()}  # max_rows at most
        taken, total = {}, 0
        for doc_id in sorted(sizes, key=_place):
            total += sizes[doc_id]
            if total > max_features:
                break
            taken[doc_id] = sizes[doc_id]
        found = features.repartition(1).mapInArrow(partial(_learn, sizes=taken, settings=settings), "bucket int, weight double").toArrow()
        stash.drop(features)
        return cls(found.column(0).to_numpy(), found.column(1).to_numpy())

    def scored(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ``score`` between 0 and 1 for every row; a column of that name is replaced."""
        bounded_batches(docs.sparkSession)
        kept = docs.drop("score", "__text") if text_col not in ("score", "__text") else docs
        rest = [c for c in kept.columns if c not in ("score", "__text")]
        schema = kept.select(*rest).schema.add("score", "double")
        return kept.select(*rest, F.col(text_col).cast("string").alias("__text")).mapInArrow(
            partial(_score, buckets=self.buckets, weights=self.weights), schema
        )


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, by a model learned from ``labels``."""
    model = ToxicityModel.fit(docs, labels)
    return model.scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    return ToxicityModel.fit(docs, labels).scored(docs).where(F.col("score") < threshold).select(*docs.columns)
