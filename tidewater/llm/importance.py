r"""Importance resampling towards a target: draws the documents whose words look most like the target's.

Features are runs of one to three consecutive words, known by the CRC-32 of their bytes modulo a number of buckets. A
dictionary of delimiter-bounded words is an Aho-Corasick automaton; each word carries its CRC and its length. Scanning a
block of texts emits these payloads in order, and the CRC of a run is composed from adjacent payloads (the CRC of the
front, advanced by the length of the back, xor the CRC of the back): no run is ever put together or hashed. Spans
that no match covers hold words that the dictionary lacks; their payload is taken from the bytes, so the dictionary decides
how fast a scan is and never what it gives. It holds the most frequent words of a bounded sample of documents.

Bucket counts are summed within tasks and then over them. Scores are ordered by ranges of (score, id) and numbered
within ranges, so that no task holds all of them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, staged, with_columns

#: Buckets, words of the longest run, words of the dictionary, documents it is taken from (about), rows of a range.
BUCKETS, LONGEST, DICTIONARY, SAMPLE, RANGE_ROWS = 10000, 3, 32768, 20000, 1_000_000
#: Bytes of text scanned at once, about.
BLOCK = 1 << 20
#: A-Z become a-z; digits, a-z and all bytes of other characters stay; all else is a delimiter.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Lengths with a table of their own; longer ones are made of powers of two.
SHORT = 64


def _tables() -> np.ndarray:
    """What CRCs become when zero bytes follow: [length][byte of the CRC][its value]; from SHORT on for 2 ** 6, 2 ** 7 ..."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    bits = np.array([1 << k for k in range(32)], np.uint32)

    def spread(images: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for k in range(32):
            out[k // 8] ^= np.where(np.arange(256) >> (k % 8) & 1, images[k], 0).astype(np.uint32)
        return out

    tables, images = [], bits
    for _ in range(SHORT):
        tables.append(spread(images))
        images = (images >> 8) ^ step[images & 255]
    for _ in range(40):  # images: those of 2 ** k bytes, k from 6 on
        tables.append(spread(images))
        images = _advance(images, tables[-1])
    return np.array(tables)


def _advance(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


ADVANCED = _tables()


def composed(front: np.ndarray, back: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of joined byte strings from those of their fronts and backs and the lengths of the backs."""
    low, high = length & (SHORT - 1), length >> 6
    moved = np.zeros(len(front), np.uint32)
    for k in range(4):
        moved ^= ADVANCED[low, k, front >> (8 * k) & 255]
    power = SHORT
    while high.any():
        odd = np.flatnonzero(high & 1)
        moved[odd] = _advance(moved[odd], ADVANCED[power])
        high, power = high >> 1, power + 1
    return moved ^ back


class Scanner:
    """The automaton of a dictionary. Keys stand between blanks, so that a match is a whole word."""

    def __init__(self, words: list[bytes]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, word in enumerate(words):
            self.automaton.add_word(f" {word.decode('latin-1')} ", k)
        if words:
            self.automaton.make_automaton()
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)

    def payloads(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, length and text number of all words of some texts, in order."""
        folded = [t.translate(FOLD) for t in texts]
        whole = b" " + b" ".join(folded) + b" "
        found = np.fromiter(chain.from_iterable(self.automaton.iter(whole.decode("latin-1"))), np.int64) if len(self.crc) else np.empty(0, np.int64)
        end, at = found[::2], found[1::2]
        crc, length = self.crc[at], self.length[at]
        signs = np.zeros(len(whole) + 1, np.int8)
        signs[end - length], signs[end] = 1, -1
        left = np.frombuffer(whole, np.uint8).copy()
        left[np.cumsum(signs[:-1], dtype=np.int8) > 0] = 32  # what no match covers are the words that the dictionary lacks
        rest = left.tobytes().split()
        more = np.flatnonzero((left[:-1] != 32) & (left[1:] == 32)) + 1
        crc = np.append(crc, np.array([zlib.crc32(w) for w in rest], np.uint32))
        length = np.append(length, np.array([len(w) for w in rest], np.int64))
        end = np.append(end, more)
        order = np.argsort(end, kind="stable")
        starts = np.cumsum([1, *(len(t) + 1 for t in folded)])
        return crc[order], length[order], np.searchsorted(starts, end[order] - 1, side="right") - 1

    def features(self, texts: list[bytes], longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """CRC and text number of all runs of 1, of 2, ... words."""
        crc, length, of = self.payloads(texts)
        yield crc, of
        with_blank = composed(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length)
        run = crc
        for words in range(2, longest + 1):
            run = composed(run[:-1], with_blank[words - 1 :], length[words - 1 :] + 1)
            one = of[: len(run)] == of[words - 1 :]
            yield run[one], of[: len(run)][one]


_held: tuple[str, Scanner] | None = None


def scanner(words: list[bytes]) -> Scanner:
    """One automaton in a worker, made again if the dictionary is another."""
    global _held
    mark = hashlib.sha256(b" ".join(words)).hexdigest()
    if _held is None or _held[0] != mark:
        _held = mark, Scanner(words)
    return _held[1]


def _blocks(texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in texts:
        block.append(text or b"")
        size += len(block[-1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def dictionary(docs: DataFrame, words: int = DICTIONARY, sample: int = SAMPLE) -> list[bytes]:
    """The most frequent words of about ``sample`` whole texts, picked by a hash of them: bounded for the driver."""
    share = min(1.0, sample / max(1, docs.count()))
    place = F.pmod(F.xxhash64(F.lit("dictionary"), "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def run(batches):
        for batch in batches:
            found = Counter()
            for text in batch["text"]:
                found.update(text.translate(FOLD).split())
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    picked = docs.where(F.col("text").isNotNull() & (place < share)).select(F.col("text").cast("binary").alias("text"))
    counted = picked.mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]


def bucket_counts(docs: DataFrame, words: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """bucket, n: how many features of all whole texts fall into each bucket that has any. Null texts have none."""

    def run(batches):
        total, scan = np.zeros(buckets, np.int64), scanner(words)
        for batch in batches:
            for block in _blocks(batch["text"]):
                for crc, _ in scan.features(block, longest):
                    total += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    texts = docs.where(F.col("text").isNotNull()).select(F.col("text").cast("binary").alias("text"))
    return texts.mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths: log of its smoothed share in the target over that in the raw texts.

    raw, target: bucket, n. The driver reads two numbers a bucket.
    """
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = [0] * buckets, [0] * buckets
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row["bucket"]], t[row["bucket"]] = row["s"], row["t"]
    whole_s, whole_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(float(y + 1) * whole_s / (float(x + 1) * whole_t))) for x, y in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, words: list[bytes], gains: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """docs' columns but text, with n_words, n_features and weight, the sum of the gains of all features."""

    def make():
        scan, buckets = scanner(words), len(gains)

        def run(texts):
            rows = []
            for block in _blocks(texts):
                each = list(scan.features(block, longest))
                counts = [np.bincount(of, minlength=len(block)) for _, of in each]
                sums = sum(np.bincount(of, gains[crc % buckets], minlength=len(block)) for crc, of in each)
                rows += zip(counts[0].tolist(), sum(counts).tolist(), sums.astype(np.int64).tolist(), strict=True)
            return rows

        return run

    return with_columns(docs.withColumn("text", F.col("text").cast("binary")), "text", make, "n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the id; null without an id."""
    first = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((first + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, drawn: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows (doc_id, n_features, weight, score) with rank: 1, 2, 3 ... for the ``drawn`` highest scores, ties to the smaller id, else null.

    Ranges of (score, id) are written once, so that their counts and their rows are the same; the driver reads one count a range.
    """
    order = [F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")]
    parts = max(1, math.ceil(rows.count() / range_rows))
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, starts = 0, []
    for row in sorted(dealt.groupBy("_range").count().collect()):
        if before < drawn:
            starts.append((row["_range"], before))
        before += row["count"]
    if not starts:
        return dealt.drop("_range").withColumn("rank", F.lit(None).cast("long"))
    last = starts[-1][0]
    offsets = rows.sparkSession.createDataFrame(starts, "_of int, _before long")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    head = dealt.where(F.col("_range") <= last).withColumn("_at", at).join(offsets, F.col("_range") == F.col("_of"))
    place = F.col("_before") + F.col("_at")
    head = head.withColumn("rank", F.when(place <= drawn, place)).select(*rows.columns, "rank")
    return head.unionByName(dealt.where(F.col("_range") > last).select(*rows.columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
    buckets: int = BUCKETS, longest: int = LONGEST, words: int = DICTIONARY, sample: int = SAMPLE, range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text); target: text.

    Of the N rows with an id and least_words words, percent * N // 100 are drawn, the highest scores (weight plus noise by id),
    ties to the smaller id; the others' rank is null. Null and empty texts have no features and weight 0. Without an id
    score and rank are null, but the features count. Repeated rows each count and may each be drawn; other columns are left
    out, whatever their names; an empty table gives an empty result, an empty target counts no feature.
    """
    (own,) = free_names(["n_words", "n_features", "weight", "text"], "doc_id")
    rows, aim = docs.select(F.col("doc_id").alias(own), "text"), target.select("text")
    known = dictionary(rows, words, sample)
    gains = bucket_gains(bucket_counts(rows, known, buckets, longest), bucket_counts(aim, known, buckets, longest), buckets)
    weighed = weigh(rows, known, gains, longest)
    scored = staged(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    columns = ["doc_id", "n_features", "weight", "score"]
    eligible = scored.where(able).select(*columns)
    rest = scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(eligible, percent * eligible.count() // 100, range_rows).unionByName(rest)
