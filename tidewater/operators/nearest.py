"""The rows nearest to each of many queries, as matrix products of blocks: queries and pool are dealt to blocks and shards by hash, each block meets each shard
once, and what is best in a shard is merged over shards. No pair of a query and a row is ever a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_products(queries: DataFrame, pool: DataFrame, top: int, ties: list[str], apart: Callable[[pd.DataFrame, object], np.ndarray], blocks: int = 4) -> DataFrame:
    """The queries' columns and those of the pool, without vectors, with r and rank: the ``top`` rows with the largest inner product of each query,
    ties (to nine digits) by these columns of the pool.

    queries and pool: columns of different names, and vector, an array of numbers of one length. apart(rows, query) says which rows of a shard may be
    a query's result. The pool has as many shards as a shuffle has partitions and is copied once for each block of queries."""
    spark = pool.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked, held = [c for c in queries.columns if c != "vector"], [c for c in pool.columns if c != "vector"]
    kinds = dict(queries.dtypes) | dict(pool.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*asked, *held]), "r double"])
    own = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    pool = pool.select(*[F.col(c).alias(c) for c in pool.columns])  # queries may come from the pool itself
    left = queries.withColumn("_block", own(asked, blocks)).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = pool.withColumn("_shard", own(held, shards)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(these: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(these) and len(rows):
            rows = rows.sort_values(ties).reset_index(drop=True)
            products = np.array(rows["vector"].tolist(), float) @ np.array(these["vector"].tolist(), float).T
            for j, query in enumerate(these[asked].itertuples(index=False)):
                at = np.flatnonzero(apart(rows, query))
                best = at[np.argsort(-np.round(products[at, j], 9), kind="stable")[:top]]
                out.append(rows.loc[best, held].assign(**dict(zip(asked, query, strict=True)), r=products[best, j]))
        return pd.concat(out)[[*asked, *held, "r"]] if out else pd.DataFrame([], columns=[*asked, *held, "r"])

    near = left.groupBy("_shard", "_block").cogroup(right.groupBy("_shard", "_block")).applyInPandas(meet, schema)
    order = Window.partitionBy(*asked).orderBy(F.desc(F.round("r", 9)), *ties)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
