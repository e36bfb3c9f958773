"""Toxicity by a factorization machine over hashed terms.

A text's features are its different words and their beginnings of four to six letters, hashed; the beginnings let
inflected insults meet. Besides a weight each feature has a short vector, and the product of two features' vectors is
the weight of their meeting in one text, which linear weights can't express. The machine learns from a bounded sample
of labelled texts: features that go with the label by a chi-squared test, then logistic loss by gradient descent.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of, with_columns

#: Hash space; labelled texts of each class learned from, about; features kept, their least chi-squared and texts.
SPACE, PER_CLASS, FEATURES, CHI2, LEAST = 1 << 22, 8000, 1024, 20.0, 4
#: Length of a feature's vector, steps of gradient descent, weight of the penalty.
FACTORS, STEPS, DECAY = 4, 300, 1e-3
WORD, STARTS = re.compile(r"[^\W_]+"), (4, 5, 6)
REMEMBERED = 80_000


def hashed(word: str) -> list[int]:
    """The features of one word."""
    return [zlib.crc32(f"{len(word)}={word}".encode("utf-8", "replace")) % SPACE, *(zlib.crc32(f"{k}:{word[:k]}".encode("utf-8", "replace")) % SPACE for k in STARTS if len(word) >= k)]


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """features: hashed ids in ascending order; weights and vectors: of the bias first, then of each feature."""

    features: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, found: list[int]) -> float:
        """found: places in features of what a text has."""
        at = [0, *(i + 1 for i in found)]
        v = self.vectors[at]
        z = self.weights[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(rows: list[np.ndarray], labels: np.ndarray, features: np.ndarray, factors: int = FACTORS, steps: int = STEPS) -> Machine:
    """Full-batch Adam on the logistic loss, classes weighing alike; rows hold places in features."""
    n, y = len(features) + 1, labels.astype(float)
    at = np.concatenate([np.concatenate([[0], r + 1]) for r in rows]).astype(np.int64)
    sizes = np.array([len(r) + 1 for r in rows])
    start, row = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(rows)), sizes)
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    params = np.concatenate([np.zeros((n, 1)), np.random.default_rng(7).normal(0, 0.05, (n, factors))], axis=1)
    m, s = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, v = params[:, 0], params[:, 1:]
        sums = np.add.reduceat(v[at], start)
        z = np.add.reduceat(w[at], start) + 0.5 * (sums**2 - np.add.reduceat(v[at] ** 2, start)).sum(1)
        error = share * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = DECAY * params / n
        grad[:, 0] += np.bincount(at, error[row], n)
        pull = error[row][:, None] * (sums[row] - v[at])
        for f in range(factors):
            grad[:, 1 + f] += np.bincount(at, pull[:, f], n)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        params -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Machine(features, params[:, 0], params[:, 1:])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), 200):
            part = batch.iloc[start : start + 200]
            ids = [np.unique([f for w in words(t) for f in hashed(w)]).astype(np.int64) for t in part["text"]]
            grams, at = np.unique(np.concatenate(ids), return_inverse=True)
            toxic = np.repeat(part["toxic"].to_numpy(), [len(i) for i in ids])
            pos, both = np.bincount(at, toxic, len(grams)), np.bincount(at, minlength=len(grams))
            yield pd.DataFrame({"feature": grams, "pos": pos.astype(np.int64), "n": both.astype(np.int64)})


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """The machine for texts (doc_id, text) and labels (doc_id, toxic: 0 or 1). Rows without text or label teach nothing.

    The labels are sampled before they meet the texts, so what is broadcast is bounded by some 2 x per_class ids. What
    comes to the driver is bounded too: FEATURES features, and which of these so many texts have. Without rows of
    both classes the score is the share of toxic rows, 0 if there are none.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    own = F.broadcast(bounded_sample(usable, "toxic", "doc_id", per_class).withColumnRenamed("doc_id", "_doc"))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(own, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "toxic")
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    p, q = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not p or not q:
        return Machine(np.empty(0, np.int64), np.array([35.0 if p else -35.0]), np.zeros((1, 1)))
    counts = rows.select("text", "toxic").mapInPandas(_count, "feature long, pos long, n long")
    counts = counts.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    apart = F.col("pos") / p - (F.col("n") - F.col("pos")) / q
    spread = F.col("n") / (p + q) * (1 - F.col("n") / (p + q)) * (1 / p + 1 / q)
    chi2 = F.coalesce(F.try_divide(apart * apart, spread), F.lit(0.0))
    chosen = counts.withColumn("chi2", chi2).where(F.col("chi2") >= CHI2).orderBy(F.desc("chi2"), "feature").limit(FEATURES)
    features = np.sort(np.array([r["feature"] for r in chosen.select("feature").collect()], np.int64))
    known = {int(f): i for i, f in enumerate(features)}

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted({known[f] for w in words(t) for f in hashed(w) if f in known}) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "found": found, "doc_id": batch["doc_id"]})

    got = rows.mapInPandas(places, f"toxic int, found array<int>, doc_id {rows.schema['doc_id'].dataType.simpleString()}").collect()
    got.sort(key=lambda r: (str(r["doc_id"]), r["toxic"], r["found"]))
    return fit([np.array(r["found"], np.int64) for r in got], np.array([r["toxic"] for r in got]), features)


def score_toxicity(docs: DataFrame, machine: Machine, keep_text: bool = False) -> DataFrame:
    """docs' columns (text only if keep_text), with score (0 to 1) and predicted (1 from 0.5 on) added; only the whole text counts.

    Null and empty texts get the machine's bias. Repeated rows score alike; columns named score or predicted are
    replaced; an empty table gives an empty result.
    """
    def make():
        place = {int(f): i for i, f in enumerate(machine.features)}
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> tuple[float, int]:
            if len(known) > REMEMBERED:
                known.clear()
            found: set[int] = set()
            for word in words(text):
                at = known.get(word)
                if at is None:
                    at = known[word] = tuple(place[f] for f in hashed(word) if f in place)
                found.update(at)
            value = machine.score(sorted(found))
            return value, int(value >= 0.5)

        return lambda texts: [score(t) for t in texts]

    return with_columns(docs, "text", make, "score double, predicted int", keep_text)


def training_labels(labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The labels outside the held-out fold; of a doc_id's repeated labels each counts."""
    return labels.where(fold_of(F.col("doc_id"), folds) != held_out).select("doc_id", "toxic")
