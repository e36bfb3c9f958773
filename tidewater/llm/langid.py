"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three characters of lower-cased words,
with a blank at either end), most frequent first. A text's own most frequent n-grams are compared with each profile:
every n-gram costs the difference of its two ranks, or the full profile length where the language lacks it, and the
language with the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, with_columns

#: N-grams of a profile and of a text; texts of each language that the profiles are learned from, about.
PROFILE, PER_LANG = 300, 3000
BLANK = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a whole text, packed into integers in ascending order, and their counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters()[codes], codes, BLANK).astype(np.int64)
    padded = np.concatenate([[BLANK], codes, [BLANK]])
    one = padded[np.concatenate([[True], (padded[1:] != BLANK) | (padded[:-1] != BLANK)])]
    if len(one) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = one[:-1] << 21 | one[1:]
    three = two[:-1] << 21 | one[2:]
    return np.unique(np.concatenate([one[one != BLANK], two, three[one[1:-1] != BLANK]]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for start in range(0, len(texts), 200):
                found = [ngrams(t) for t in texts.iloc[start : start + 200]]
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": np.bincount(at, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)})


def learn_profiles(labelled: DataFrame, size: int = PROFILE, per_lang: int = PER_LANG) -> dict[str, list[int]]:
    """The n-grams of each language by rank, from doc_id, text and lang. Rows without text or lang teach nothing.

    About per_lang whole texts of each language are read, picked by a hash of their ids; the result is bounded by
    the number of languages times size.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows = bounded_sample(rows, "lang", "doc_id", per_lang)
    counts = rows.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranker:
    """Out-of-place distances of texts to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text or "")
        if not len(grams) or not self.langs:
            return "und", 0.0
        own = ranked(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), self.size)).sum(0)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (len(own) * self.size)


def predict_language(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """docs' columns but text, with lang_pred and score added; only text decides.

    A null text or one without a letter is ``und`` with score 0, as is every text if there are no profiles. Equal
    distances go to the language first in the alphabet. The score is 1 for a text ranked exactly as the profile, 0
    for one that shares no n-gram with it. Repeated rows are judged alike; an empty table gives an empty result.
    """
    def make():
        ranker = Ranker(profiles, size)
        return lambda texts: [ranker.predict(t) for t in texts]

    return with_columns(docs, "text", make, "lang_pred string, score double")
