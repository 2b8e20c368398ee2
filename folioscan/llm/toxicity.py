"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text becomes the set of its hashed word unigrams, bigrams and one-word skip-grams. Training runs
FTRL-proximal (McMahan et al., 2013) with per-coordinate rates and an L1 term on a hash-chosen
sample of about ``sample`` labelled rows, of ``features`` features at most together, so that one task holds it
whatever the corpus; texts are hashed where they are read, and features are sent to that task. Sums of
gradients that are noise grow as the square root of the rows, so the L1 term is ``l1`` times that root,
whatever their number. L1 leaves few non-zero weights, never more than ``2 ** bits``; these are broadcast,
and every text is scored.

Defined results: a null or empty text has no feature and scores the model's bias; a label that is
null, or neither 0 nor 1, does not train; equal texts score equally; an empty training set gives
score 0.5 throughout; columns of the input keep their values, and the added ones replace columns of
the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashed, mix64, slices

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Ftrl:
    """Parameters. ``sample`` and ``features`` bound what trains; ``value`` is that of a present feature.

    ``l1`` is for each square root of a row in ``fit``; ``train`` takes it as it is.
    """

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    epochs: int = 4
    sample: int = 16_000
    features: int = 1 << 26
    value: float = 1.0


def hashes(text: str | None, bits: int, hashed: Hashed) -> np.ndarray:
    """The hashed unigrams, bigrams and skip-grams of a text in order, as indices below ``2 ** bits``."""
    h = hashed.of(WORD.findall(text.lower())) if text else np.zeros(0, np.uint64)
    # Each role has multipliers and an added constant of its own, so the same words in another role differ.
    two = h[:-1] * np.uint64(3) + h[1:] * np.uint64(5) + np.uint64(1)
    skip = h[:-2] * np.uint64(7) + h[2:] * np.uint64(11) + np.uint64(2)
    return (mix64(np.concatenate([h, two, skip])) >> np.uint64(64 - bits)).astype(np.uint32)


def weights(z, n, p: Ftrl):
    """The closed form of FTRL-proximal: zero until a coordinate's sum of gradients passes ``l1``."""
    return np.where(np.abs(z) > p.l1, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2), 0.0)


def train(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the rows in order, ``epochs`` times. Returns weights and the bias."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    bz = bn = 0.0
    for _ in range(p.epochs):
        for index, y in rows:
            zi, ni = z[index], n[index]
            w = weights(zi, ni, p)
            b = -bz / ((p.beta + bn**0.5) / p.alpha)
            g = float(1.0 / (1.0 + np.exp(-np.clip(w.sum() * p.value + b, -35, 35))) - y)
            gi = g * p.value
            z[index] = zi + gi - (np.sqrt(ni + gi * gi) - np.sqrt(ni)) / p.alpha * w
            n[index] = ni + gi * gi
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / p.alpha * b
            bn += g * g
    return weights(z, n, p), -bz / ((p.beta + bn**0.5) / p.alpha)


@dataclass(frozen=True)
class Model:
    """The non-zero weights by feature, and the bias."""

    p: Ftrl
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.p.bits, np.float32)
        out[self.index] = self.weight
        return out


def fit(labelled: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", p: Ftrl = Ftrl()) -> Model:
    """Train on about ``p.sample`` rows of ``labelled``, chosen by a hash of ``key``; all, if there are fewer.

    The rows train in the order of another hash, so that the model does not depend on partitioning; rows that come
    after ``p.features`` features don't train.
    """
    rows = labelled.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("x"), F.col(label).cast("int").alias("y"))
    total = rows.count()
    if total > p.sample:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(17), "k"), F.lit(1 << 32)) < int(p.sample / total * (1 << 32)))

    @F.arrow_udf("array<int>")
    def features(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashed = Hashed()
        for batch in parts:
            for part in slices(batch):
                each = [np.unique(hashes(x, p.bits, hashed)).astype(np.int32) for x in part.to_pylist()]
                flat = np.concatenate([np.zeros(0, np.int32), *each])
                yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), pa.array(flat, pa.int32()))

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, left = [], p.features
        for batch in parts:
            for x, y in zip(batch.column("x"), batch.column("y").to_pylist()):
                index = x.values.to_numpy()
                left -= len(index)
                if left >= 0:
                    got.append((index.copy(), y))
        w, bias = train(got, replace(p, l1=p.l1 * len(got) ** 0.5))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(at, -1), pa.int64()), "w": pa.array(np.append(w[at], bias))})

    # One task, bounded by p.sample and p.features; an empty frame still yields a bias of zero.
    ordered = rows.select(F.xxhash64(F.lit(23), "k").alias("o"), features("x").alias("x"), "y")
    learned = ordered.repartition(1).sortWithinPartitions("o", "y", "x").mapInArrow(learn, "i long, w double").toPandas()
    at = learned.i.to_numpy() >= 0
    bias = learned.w[~at]
    return Model(p, learned.i.to_numpy()[at], learned.w.to_numpy()[at], float(bias.iloc[0]) if len(bias) else 0.0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted`` (1 from 0.5) to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def probability(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        w, hashed = m.dense(), Hashed()
        for batch in parts:
            for part in slices(batch):
                out = np.empty(len(part))
                for k, x in enumerate(part.to_pylist()):
                    got = hashes(x, m.p.bits, hashed)
                    out[k] = w[np.unique(got[w[got] != 0])].sum(dtype=np.float64) * m.p.value + m.bias
                yield pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn("score", probability(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
