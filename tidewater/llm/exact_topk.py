"""Exact top-k search by inner product over norm buckets.

Vectors are ordered by length and dealt to shards of neighbouring lengths; within a shard they form buckets, longest
first. A query needs of a bucket only vectors whose cosine with it reaches the local threshold: its k-th best score so far
over its own length and the bucket's largest. Above 1 the bucket is passed over, as are all shorter ones. A high
threshold selects by coordinates: each of the query's largest coordinates bounds that of a vector with such a cosine. A
low one selects by length. What is left is verified by its exact product, and raises the threshold for the next bucket.

Lower bounds from a bounded number of the longest vectors decide which shards a query meets at all. The stated queries
meet the rows in blocks: each block of queries meets each shard that it needs, which copies a shard once for so many queries.

Beyond the first copies of a vector, further ones can't be among a query's best, as ties go to smaller ids: they are left
out of the shards, and queries with equal vectors are searched once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_long, staged

#: Rows of a shard, queries of a block, rows of a bucket, longest vectors that give first bounds.
SHARD, BLOCK, BUCKET, FIRST = 65536, 16384, 512, 2048
#: Cosine from which coordinates select, and how many of a query's coordinates do.
STEEP, FOCUS = 0.6, 6
#: Cuts between lengths at most; what lies between two of them is dealt to as many shards as it fills.
LEVELS = 1024
#: Bounds are lowered by this much before they exclude anything, for the rounding of lengths.
SLACK = 1e-9


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, vector (array<long>, components times scale, rounded down), norm, of the rows that take part, one for each id."""
    wide = F.col(vector_col).cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(wide, lambda x: F.floor(x * scale)).alias("vector"))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products. rows, query: whole numbers as doubles, or objects where sums may pass 2 ** 53."""
    return rows @ query


def as_numbers(vectors: list, largest: float) -> np.ndarray:
    """Doubles if every sum of products with vectors up to ``largest`` long is exact in them, else whole numbers of any size."""
    longest = max((math.sqrt(sum(float(x) * x for x in v)) for v in vectors), default=0.0)
    exact = max(longest, 1.0) * max(largest, 1.0) < 2.0**52
    return np.array([list(v) for v in vectors], float if exact else object).reshape(len(vectors), -1)


class Shard:
    """Vectors of one dimension in buckets, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, bucket: int = BUCKET):
        order = np.lexsort((ids, -norms))
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.starts = range(0, len(ids), bucket)
        self.bucket = bucket
        unit = self.vectors.astype(float) / np.maximum(self.norms, 1e-300)[:, None]
        self.unit = np.ascontiguousarray(unit.T)  # coordinate lists

    def search(self, query: np.ndarray, norm: float, top: int, bound: float = -math.inf, steep: float = STEEP, focus: int = FOCUS):
        """Ids and scores of the top rows, ties to the smaller id; rows below ``bound`` may be missing. Also the number of products."""
        unit = query.astype(float) / max(norm, 1e-300)
        axes = np.argsort(-np.abs(unit), kind="stable")[:focus]
        ids, scores, verified = np.empty(0, np.int64), np.empty(0, query.dtype), 0
        for a in self.starts:
            b = min(a + self.bucket, len(self.ids))
            least = bound * (1 - SLACK) - SLACK if bound > 0 else bound  # what a row must reach
            reach = norm * self.norms[a]
            if bound > 0 and reach < least:
                break
            cosine = least / reach if bound > 0 and reach > 0 else -1.0
            if cosine >= steep:
                near = np.ones(b - a, bool)
                for f in axes:  # with a cosine of t and more, a coordinate lies within t x +- sqrt((1 - t t)(1 - x x))
                    x, t = unit[f], cosine
                    room = math.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - x * x)) + 1e-9
                    side = self.unit[f, a:b]
                    if t < x:  # the bound t x +- room is that of the cone's rim; its axis may stick out
                        near &= side >= t * x - room
                    elif t < -x:
                        near &= side <= t * x + room
                    else:
                        near &= (side >= t * x - room) & (side <= t * x + room)
                at = a + np.flatnonzero(near)
            else:
                stop = b if cosine <= 0 else a + int(np.searchsorted(-self.norms[a:b], -(least / norm), side="right"))
                at = np.arange(a, stop)
            verified += len(at)
            found = products(self.vectors[at], query)
            if bound > -math.inf:
                good = found >= bound
                at, found = at[good], found[good]
            ids, scores = np.append(ids, self.ids[at]), np.append(scores, found)
            if len(ids) > top:
                best = np.lexsort((ids, -scores))[:top]
                ids, scores = ids[best], scores[best]
            if len(ids) == top:
                bound = max(bound, float(scores.min()))
        best = np.lexsort((ids, -scores))
        return ids[best], scores[best], verified


def top_products(
    vectors: DataFrame, is_query: Column, top: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_rows: int = SHARD, block_rows: int = BLOCK, bucket: int = BUCKET, first: int = FIRST, steep: float = STEEP,
) -> DataFrame:
    """query_id, rank, vec_id, score: of every query (is_query, on vec_id) the top rows with the largest inner product of the scaled, rounded
    vectors, exactly.

    Null vectors and those with null or non-finite components take no part, nor do rows without id; zero and empty vectors do. A
    query meets the vectors of its own dimension. Rows that repeat an id count once (the smallest vector). A query isn't its own result. Equal scores
    go to the smaller id; fewer than top candidates are all returned; scores beyond 64 bits are cut off there; an empty table gives an
    empty result; other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    rows = staged(scaled(vectors, id_col, vector_col, scale), "scaled")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    held = staged(rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= top + 1), "held")
    asked = rows.where(is_query)
    classes = asked.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.first("norm").alias("norm"))
    blocks = max(1, math.ceil(asked.count() / block_rows))

    # shards by length: cuts at quantiles, then by hash where one length fills more than a shard
    wanted = min(LEVELS, max(1, math.ceil(held.count() / shard_rows)))
    cuts = sorted(set((held.agg(F.percentile_approx("norm", [k / wanted for k in range(1, wanted)], 10000).alias("c")).first()["c"] or []) if wanted > 1 else []))
    level = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c >= F.col("norm")))
    levelled = held.select("vec_id", "vector", "norm", level.cast("int").alias("_level"))
    sizes = levelled.groupBy("_level").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()  # one short row a shard
    shards, first_of, parts_of = [], {}, {}
    for r in sorted(sizes, key=lambda r: r["_level"]):
        first_of[r["_level"]], parts_of[r["_level"]] = len(shards), max(1, math.ceil(r["n"] / shard_rows / 1.5))
        shards += [r["most"]] * parts_of[r["_level"]]
    numbers = spark.createDataFrame([(k, first_of[k], parts_of[k]) for k in first_of], "_of int, _first int, _parts int")
    index = levelled.join(numbers, F.col("_level") == F.col("_of"))
    index = index.select("vec_id", "vector", "norm", (F.col("_first") + F.pmod(F.xxhash64("vec_id"), F.col("_parts"))).cast("int").alias("_shard"))
    index = index.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    longest = held.orderBy(F.desc("norm"), "vec_id").limit(first).collect()
    reaches = np.array(shards or [0.0])

    def bounds(batches):
        """Each query's (top + 1)-th best score among the longest vectors, and the last shard that can hold a better one."""
        by_size: dict[int, list] = {}
        for r in longest:
            by_size.setdefault(len(r["vector"]), []).append(r)
        made: dict[int, Shard] = {}
        for batch in batches:
            low, last = [], []
            for vector, norm in zip(batch["vector"], batch["norm"], strict=True):
                own = by_size.get(len(vector), [])
                if len(own) <= top:
                    low.append(-math.inf)
                else:
                    if len(vector) not in made:
                        made[len(vector)] = Shard(np.array([r["vec_id"] for r in own]), as_numbers([r["vector"] for r in own], reaches.max()), np.array([r["norm"] for r in own]), bucket)
                    query = np.array([int(x) for x in vector], made[len(vector)].vectors.dtype)
                    low.append(float(made[len(vector)].search(query, norm, top + 1, steep=steep)[1].min()))
                out = reaches * norm < low[-1] * (1 - SLACK) - SLACK if low[-1] > 0 else np.zeros(len(reaches), bool)
                last.append(int(np.flatnonzero(~out).max()) if (~out).any() else 0)
            yield batch.assign(_bound=low, _last=last)

    bounded = classes.select("vec_id", "vector", "norm").mapInPandas(bounds, "vec_id long, vector array<long>, norm double, _bound double, _last int")
    met = bounded.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.col("_last"))))

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = {"_class": [], "vec_id": [], "score": []}
        for size, part in own.groupby(own["vector"].map(len)):
            same = queries[queries["vector"].map(len) == size] if len(queries) else queries
            if len(same):
                vectors = as_numbers(part["vector"].tolist(), max(1.0, same["norm"].max()))
                shard = Shard(part["vec_id"].to_numpy(), vectors, part["norm"].to_numpy(), bucket)
                for name, vector, norm, bound in zip(same["vec_id"], same["vector"], same["norm"], same["_bound"], strict=True):
                    ids, scores, _ = shard.search(np.array([int(x) for x in vector], vectors.dtype), norm, top + 1, bound, steep)
                    found["_class"] += [name] * len(ids)
                    found["vec_id"] += ids.tolist()
                    found["score"] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
        return pd.DataFrame(found)

    near = index.groupBy("_shard", "_block").cogroup(met.groupBy("_shard", "_block")).applyInPandas(search, "_class long, vec_id long, score long")
    best = Window.partitionBy("_class").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= top + 1)
    lists = near.groupBy("_class").agg(F.array_sort(F.collect_list(F.struct("_rank", "vec_id", "score"))).alias("_list"))

    of = classes.select(F.concat("vector", F.array().cast("array<bigint>")).alias("_of"), F.col("vec_id").alias("_class"))
    named = asked.join(of, F.col("vector") == F.col("_of")).select(F.col("vec_id").alias("query_id"), "_class")
    joined = named.join(lists.select(fresh_long("_class").alias("_of"), "_list"), F.col("_class") == F.col("_of"))
    others = F.slice(F.filter("_list", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    each = joined.select("query_id", F.posexplode(others).alias("_at", "_found"))
    return each.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_found.vec_id").alias("vec_id"), F.col("_found.score").alias("score"))
