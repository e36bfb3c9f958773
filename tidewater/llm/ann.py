"""Approximate nearest neighbours with a permutation index.

A few hundred pivots are taken from the vectors; every vector is represented by its nearest pivots in order. Shards of
rows hold inverted files, one list of (place, row) for each pivot. A query walks the lists of its own nearest pivots,
which gives each row's footrule distance between the two orders; the closest share of every shard is reranked by the
exact inner product. Shards are dealt by a hash of the id, so no list is hot. The stated queries meet all rows in blocks:
each block of queries meets each shard, which copies the index once for so many queries.

Beyond the first copies of a vector, further ones can't be among a query's nearest, as ties go to smaller ids: they
are left out of the shards, and queries with equal vectors are searched once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_long, staged

#: Pivots (the vectors with the smallest id hashes), nearest pivots kept of each vector, share of a shard reranked.
PIVOTS, NEAREST, SHARE = 512, 64, 0.2
#: Rows of a shard and queries of a block, about.
SHARD, BLOCK = 16384, 16384


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part: of the most frequent length, one for each id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vector") == (common["d"] if common else 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def choose_pivots(rows: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """count different vectors at most, by the hash of their smallest id: a bounded sample for the driver."""
    picked = rows.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(count).collect()
    return np.unique(np.array([r["vector"] for r in picked], float), axis=0)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :nearest]


def search_shard(ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, queries: np.ndarray, q_order: np.ndarray, pivots: int, top: int, share: float):
    """For each query the places of its best rows in the shard, and their scores."""
    rows, nearest = order.shape
    flat = order.ravel()
    by_pivot = np.argsort(flat, kind="stable")  # the inverted files: entries of each pivot, one after the other
    starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
    row_of, place_of = by_pivot // nearest, by_pivot % nearest
    kept = min(rows, max(2 * top, math.ceil(share * rows)))
    for query, own in zip(queries, q_order, strict=True):
        saved = np.zeros(rows, np.int64)  # by how much the footrule distance falls below that of strangers
        for place, pivot in enumerate(own):
            a, b = starts[pivot], starts[pivot + 1]
            saved[row_of[a:b]] += 2 * nearest - place - place_of[a:b] - np.abs(place - place_of[a:b])
        least = np.partition(saved, rows - kept)[rows - kept]
        close = np.flatnonzero(saved >= least)
        scores = (vectors[close] * query).sum(axis=1)
        best = np.lexsort((ids[close], -scores))[:top]
        yield close[best], scores[best]


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    pivots: int = PIVOTS, nearest: int = NEAREST, share: float = SHARE, shard_rows: int = SHARD, block_rows: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: of every query (is_query, on vec_id) the top rows with the largest inner product.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part; nor do those of another length
    than most, with which there is no inner product. Rows that repeat an id count once (the smallest vector). A query isn't its own neighbour. Equal scores go to the
    smaller id; fewer than top candidates are all returned; an empty table gives an empty result.
    """
    rows = staged(clean_vectors(vectors, id_col, vector_col), "vectors")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    held = rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= top + 1)
    points = choose_pivots(held.where(F.col("_copy") == 1), pivots)
    asked = rows.where(is_query)
    classes = asked.groupBy("vector").agg(F.min("vec_id").alias("_class"))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))

    def orders(batches):
        for batch in batches:
            found = nearest_pivots(np.array(batch["vector"].tolist(), float).reshape(len(batch), -1), points, nearest) if len(batch) and len(points) else []
            yield batch.assign(order=[list(map(int, o)) for o in found])

    index = held.select("vec_id", "vector").mapInPandas(orders, "vec_id long, vector array<double>, order array<int>")
    index = index.withColumn("_shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wanted = classes.select(F.col("_class").alias("vec_id"), "vector").mapInPandas(orders, "vec_id long, vector array<double>, order array<int>")
    wanted = wanted.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = {"_class": [], "vec_id": [], "score": []}
        if len(own) and len(queries):
            ids, data = own["vec_id"].to_numpy(), np.array(own["vector"].tolist(), float)
            asked_for = np.array(queries["vector"].tolist(), float)
            each = search_shard(ids, data, np.array(own["order"].tolist()), asked_for, np.array(queries["order"].tolist()), len(points), top + 1, share)
            for name, (at, scores) in zip(queries["vec_id"], each, strict=True):
                found["_class"] += [name] * len(at)
                found["vec_id"] += ids[at].tolist()
                found["score"] += scores.tolist()
        return pd.DataFrame(found)

    near = index.groupBy("_shard", "_block").cogroup(wanted.groupBy("_shard", "_block")).applyInPandas(search, "_class long, vec_id long, score double")
    best = Window.partitionBy("_class").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top + 1)
    lists = near.groupBy("_class").agg(F.array_sort(F.collect_list(F.struct("_rank", "vec_id", "score"))).alias("_list"))

    named = asked.join(classes.select(F.concat("vector", F.array().cast("array<double>")).alias("_of"), "_class"), F.col("vector") == F.col("_of")).select(F.col("vec_id").alias("query_id"), "_class")
    met = named.join(lists.select(fresh_long("_class").alias("_of"), "_list"), F.col("_class") == F.col("_of"))
    others = F.slice(F.filter("_list", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    each = met.select("query_id", F.posexplode(others).alias("_at", "_found"))
    return each.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_found.vec_id").alias("vec_id"), F.col("_found.score").alias("score"))
