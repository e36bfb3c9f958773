"""Exact dedup by content-defined chunk recipes.

White space is deleted from a text, which is then cut where a rolling hash of its last 32 bytes says so: equal
stretches are cut alike wherever they stand. A chunk's identifier is its 128-bit digest; all chunks are grouped by
digest and content once, which finds every digest that stands for two contents. A document is its recipe, the
ordered list of identifiers, and documents are equal when their recipes are; a recipe that holds an ambiguous
identifier also carries the SHA-256 of its whole text. After the chunks have met once, only recipes move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, staged

#: Chunk sizes in bytes: least, most, and the bits of the rolling hash that must be zero (2 KB apart on average).
LEAST, MOST, BITS = 256, 16384, 11
#: A random number for each byte value, the same in every task.
GEAR = np.frombuffer(hashlib.shake_256(b"content-defined chunks").digest(1024), np.uint32)


def cut_points(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of data."""
    if len(data) <= least:
        return [len(data)] if data else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # doubles the window: 2, 4, ... 32 bytes
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step)
        h = shifted
    found = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    ends, last = [], 0
    for end in [*found.tolist(), len(data)]:
        while end - last > most:
            last += most
            ends.append(last)
        if end - last >= least or end == len(data) and end > last:
            ends.append(end)
            last = end
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def identifier(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def stripped(texts: pa.Array) -> Iterator[bytes]:
    for text in texts.cast(pa.binary()):
        yield (text.as_py() or b"").translate(None, WHITE.encode())


def _recipes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipes, shas = [], []
            for data in stripped(batch["text"]):
                recipes.append([identifier(c, size) for c in chunks_of(data)])
                shas.append(hashlib.sha256(data).hexdigest())
            n = pc.fill_null(pc.utf8_length(batch["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], n, pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.binary()))], names=["doc_id", "n_chars", "text_sha256", "recipe"])

    return run


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {c for data in stripped(batch["text"]) for c in chunks_of(data)}
            held = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([identifier(c, size) for c in held], pa.binary()), pa.array(held, pa.binary())], names=["digest", "chunk"])

    return run


def recipes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, n_chars, text_sha256 and recipe (array of chunk identifiers) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_recipes(digest_bytes), f"doc_id {kind}, n_chars long, text_sha256 string, recipe array<binary>")


def ambiguous(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """The identifiers that stand for more than one content, found by comparing the contents of all chunks."""
    held = docs.select("doc_id", "text").mapInArrow(_chunks(digest_bytes), "digest binary, chunk binary").distinct()
    return held.groupBy("digest").count().where(F.col("count") > 1).select("digest")


def duplicate_classes(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    r"""One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without ``[\x20\x09-\x0D]``; null counts as empty, and empty texts are equal. The
    row with most code points stays, then the smallest doc_id (a null one last). Repeated rows count one each, and of
    rows alike in doc_id and length one is kept. Other columns are ignored; an empty table gives an empty result.
    """
    found = staged(recipes(docs, digest_bytes), "recipes")
    bad = ambiguous(docs, digest_bytes).agg(F.collect_list("digest")).scalar()
    spelled = F.concat(F.col("recipe"), F.array(F.unhex("text_sha256")))
    key = F.when(F.size(F.array_intersect("recipe", bad)) > 0, spelled).otherwise(F.col("recipe"))
    rows = found.withColumn("_key", key).groupBy("doc_id", "n_chars", "text_sha256", "_key").agg(F.count(F.lit(1)).alias("_copies"))
    best = F.struct(F.col("n_chars").alias("n"), F.bitwise_not(F.col("doc_id")).alias("first"))
    classes = rows.groupBy("_key").agg(F.sum("_copies").alias("group_size"), F.max(best).alias("_best"))
    classes = classes.select(F.concat("_key", F.array().cast("array<binary>")).alias("_class"), "group_size", "_best")
    met = rows.join(classes, F.col("_key") == F.col("_class"))
    each = met.select("*", F.posexplode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))).alias("_copy", "_one"))
    keep_id = F.bitwise_not(F.col("_best.first"))
    return each.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n_chars") == F.col("_best.n")) & (F.col("_copy") == 0)).alias("kept"),
        "text_sha256",
        "n_chars",
    )
