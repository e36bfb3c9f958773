r"""N-gram Jaccard join in the metric space of shingle sets (distance 1 - Jaccard similarity).

A document is the set of its 5-word shingles; equal sets are one point. Documents are the pivots. Nearly all pairs of
documents share no shingle and lie at distance 1, so pivots drawn from the whole corpus tell nothing; a document is
measured against those pivots that it can be near to, which shared shingles name:

1. A screen. Two linked documents (distance r = 0.2 at most) differ in few shingles, so of the first 0.3 n in hash
   order of each they share 0.08 n at least. Documents that meet too few others there have no partner and are done.
2. Cells. A shingle that no other document holds is no document's shared one; who has more than r n of these has no
   partner. The others enter the cells of their rarest shared shingles, so many that linked ones can't miss each other.
3. Voronoi regions. The most central document of a cell, the one with the smallest unshared share, is its pivot. All
   documents are measured against the pivots of their cells, in parts of bounded size; those within r of a pivot are
   linked to it. Cells whose documents are connected by now are done. What is left of a pivot's region is joined in
   blocks: documents as pivots again, each document in the region of its nearest one, and by the triangle inequality
   in every other that is farther by 2 r at most; regions are joined recursively till few documents are left.

The same code runs for regions of two documents and of thousands; only the number of blocks grows. Every link found
is an exact comparison of whole sets; links inside what is already connected are not looked for, as only components
are returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh_long, staged

#: Words of a shingle; similarity of a link in percent; share of a set, beyond the 0.2 n that may differ, read in step 1.
WORDS, PERCENT, EXTRA = 5, 80, 0.1
#: Documents and shingles of a block; pivots of a region inside a block; documents that are compared without pivots.
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS, LEAF = 256, 1_000_000, 4, 16
#: Random odd numbers, one for each word of a shingle.
FACTORS = np.frombuffer(hashlib.shake_256(b"shingle words").digest(8 * 16), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles, ascending. bytes.lower() and split() treat exactly A-Z and white space."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.int64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)], np.uint64).view(np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    m = len(found) - words + 1
    mixed = np.zeros(m, np.uint64)
    for k in range(words):
        mixed = (mixed ^ (each[k : k + m] * FACTORS[k])) * FACTORS[k + 8]
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


def may_differ(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def print_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [shingle_set(t.as_py()) for t in part.column(1)]
            prints = [print_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([int.from_bytes(p[:8], "little", signed=True) for p in prints], pa.int64())],
                names=["doc_id", "n", "print", "mark"],
            )


def _meetings(percent: int, extra: float):
    """Rows (shingle, mark, met) of step 1. Sets that meet in one batch are credited here (shingle null, met: how
    often), and only one of them is sent on, without a mark: a frequent shingle leaves one row a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                sets = {}
                for text in batch.column(1).slice(start, 2000):
                    own = shingle_set(text.as_py())
                    if len(own):
                        first = may_differ(len(own), percent) + max(1, int(extra * len(own)))
                        sets[int.from_bytes(print_of(own)[:8], "little", signed=True)] = own[:first]
                if not sets:
                    continue
                marks = np.fromiter(sets, np.int64, len(sets))
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
                grams, at, count = np.unique(np.concatenate(list(sets.values())), return_inverse=True, return_counts=True)
                credit = np.bincount(owner[count[at] > 1], minlength=len(sets))
                alone = count[at] == 1
                shared = grams[count > 1]
                got = np.flatnonzero(credit)
                gram = pa.array(np.concatenate([grams[at[alone]], shared, np.zeros(len(got), np.int64)]), mask=np.arange(alone.sum() + len(shared) + len(got)) >= alone.sum() + len(shared))
                mark = pa.array(np.concatenate([marks[owner[alone]], np.zeros(len(shared), np.int64), marks[got]]), mask=np.repeat([False, True, False], [alone.sum(), len(shared), len(got)]))
                met = pa.array(np.concatenate([np.zeros(alone.sum() + len(shared), np.int64), credit[got]]))
                yield pa.RecordBatch.from_arrays([gram, mark, met], names=["shingle", "mark", "met"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shingle, mark) in order of shingle: how often each mark shares its shingle with another row."""
    held: tuple[int, int | None] | None = None  # the last row and whether it was shared are carried over
    before = False
    for batch in batches:
        grams = batch.column(0).to_numpy()
        if not len(grams):
            continue
        marks = batch.column(1)
        same = grams[1:] == grams[:-1]
        first = held is not None and held[0] == grams[0]
        shared = np.concatenate([[first], same]) | np.concatenate([same, [False]])
        out = marks.filter(pa.array(shared)).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        if first and not before and held[1] is not None:
            out = np.append(out, held[1])
        held, before = (grams[-1], marks[-1].as_py()), bool(shared[-1])
        keys, n = np.unique(out, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["mark", "met"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (point, print, text) those whose text has the point's set, as a doc_id may repeat with other texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            sets = [shingle_set(t.as_py()) for t in part.column(2)]
            own = [k for k, (s, p) in enumerate(zip(sets, part.column(1), strict=True)) if print_of(s) == p.as_py()]
            sets = [sets[k] for k in own]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own, pa.int64())), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["point", "n", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node that the edges (a, b) connect it with."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_a")).agg(F.min("label").alias("_near"))
        lower = labels.join(around, F.col("node") == F.col("_a")).select("node", F.least("label", "_near").alias("label"))
        jump = lower.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        lower = staged(lower.join(jump, F.col("label") == F.col("_n")).select("node", F.col("_l").alias("label")), "labels")
        done = labels.join(lower.withColumnRenamed("label", "_new"), "node").where(F.col("label") != F.col("_new")).isEmpty()
        discard(labels, *[both] * done)
        if done:
            return lower
        labels = lower


def overlaps(own: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many shingles own shares with each set of flat."""
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat(own[at] == flat, starts)


def join_block(sets: list[np.ndarray], labels: np.ndarray, unshared: np.ndarray, visitor: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets of different labels that connect all that links connect, as pairs of places.

    unshared: how many of a set's shingles no other set holds. visitor: sets to be joined with the others, but neither
    these nor those among themselves; without it all are joined with all. Pivots are taken in the order given.
    """
    n, r = np.array([len(s) for s in sets]), (100 - percent) / 100
    root = np.unique(labels, return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def measure(i: int, others: np.ndarray) -> np.ndarray:
        """Distances of others to i; what is within r is linked."""
        flat = np.concatenate([sets[j] for j in others])
        both = overlaps(sets[i], flat, np.concatenate([[0], np.cumsum(n[others])[:-1]]))
        union = n[i] + n[others] - both
        for j in others[100 * both >= percent * union]:
            if root[j] != root[i]:
                links.append((i, int(j)))
                root[root == root[j]] = root[i]
        return 1 - both / union

    def compare(own: np.ndarray, others: np.ndarray, within: bool) -> None:
        for k, i in enumerate(own):
            rest = np.concatenate([own[k + 1 :], others]) if within else others
            most = np.minimum(n[i] - unshared[i], n[rest] - unshared[rest])  # shingles that both can hold
            rest = rest[(root[rest] != root[i]) & ((100 + percent) * most >= percent * (n[i] + n[rest]))]
            if len(rest):
                measure(i, rest)

    def join(own: np.ndarray, others: np.ndarray, within: bool) -> None:
        everyone = np.concatenate([own, others])
        if len(own) <= LEAF or (root[everyone] == root[everyone[0]]).all():
            compare(own, others, within)
            return
        apart = np.array([measure(p, everyone) for p in own[:PIVOTS]])
        nearest = apart[:, : len(own)].argmin(0)
        window = apart <= apart.min(0) + 2 * r + 1e-9
        for k in range(len(apart)):
            inside = window[k].copy()
            inside[: len(own)] &= (nearest > k) & within
            mine, theirs = own[nearest == k], everyone[inside]
            # a region that the pivots leave as it was is compared, others are smaller
            (compare if len(mine) == len(own) or len(mine) + len(theirs) == len(everyone) else join)(mine, theirs, within)

    places = np.arange(len(sets))
    if visitor is None:
        join(places, places[:0], True)
    else:
        join(places[~visitor], places[visitor], False)
    return links


def _links(percent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.iloc[np.lexsort((block["point"], block["unshared"] / block["shingles"].map(len)))]
        points = block["point"].to_numpy()
        cross = block["_x"].iloc[0] != block["_y"].iloc[0]
        visitor = (block["_own"] == block["_y"]).to_numpy() if cross else None
        found = join_block([np.asarray(s, np.int64) for s in block["shingles"]], block["label"].to_numpy(), block["unshared"].to_numpy(), visitor, percent)
        return pd.DataFrame({"a": [points[i] for i, _ in found], "b": [points[j] for _, j in found]}, dtype="int64")

    return run


def parts_of(docs: int, shingles: int):
    return F.greatest(F.ceil(F.col("_docs") / docs), F.ceil(F.col("_n") / shingles)).cast("int")


def join_cells(cells: DataFrame, sets: DataFrame, percent: int = PERCENT, docs: int = BLOCK_DOCS, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """node and label: what links connect of the points of cells (cell, point, n, unshared); sets holds (point, shingles).

    Points that share no cell are taken to have no link. Points without a link may be missing from the result.
    """
    central = F.struct((F.col("unshared") / F.col("n")).alias("u"), "n", "point")
    centres = cells.groupBy("cell").agg(F.min(central).alias("_centre"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    placed = staged(cells.join(centres.select(fresh_long("cell").alias("_cell"), F.col("_centre.point").alias("pivot")), F.col("cell") == F.col("_cell")).select("cell", "point", "n", "unshared", "pivot"), "placed")

    # distances to the pivots, those with many documents in parts
    spokes = placed.where("point != pivot").select("point", "pivot", "n").distinct()
    parts = spokes.groupBy("pivot").agg(F.count(F.lit(1)).alias("_docs"), F.sum("n").alias("_n")).select(fresh_long("pivot").alias("_pivot"), parts_of(docs, shingles).alias("_parts"))
    dealt = spokes.join(parts, F.col("pivot") == F.col("_pivot")).withColumn("_part", F.pmod(F.xxhash64("point"), F.col("_parts")).cast("int"))
    of_pivots = parts.join(sets, F.col("_pivot") == F.col("point")).select(F.col("_pivot").alias("_p"), F.col("shingles").alias("_of"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_at"))
    met = dealt.select("point", "pivot", "_part").join(sets.select(F.col("point").alias("_o"), "shingles"), F.col("point") == F.col("_o"))
    met = met.join(of_pivots, (F.col("pivot") == F.col("_p")) & (F.col("_part") == F.col("_at")))
    both = F.size(F.array_intersect("shingles", "_of"))
    measured = met.select("point", "pivot", both.alias("both"), (F.size("shingles") + F.size("_of") - both).alias("either"))
    stars = staged(measured.where(100 * F.col("both") >= percent * F.col("either")).select(F.col("point").alias("a"), F.col("pivot").alias("b")), "stars")
    joined = components(stars)

    # regions of pivots that have cells with documents not yet connected
    named = placed.join(joined.select(F.col("node").alias("_node"), "label"), F.col("point") == F.col("_node"), "left").withColumn("label", F.coalesce("label", "point")).drop("_node")
    named = staged(named, "named")
    mixed = named.groupBy("cell").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least != _most").select(fresh_long("cell").alias("_cell"))
    regions = staged(named.join(mixed, F.col("cell") == F.col("_cell"), "left_semi").select("pivot", "point", "n", "unshared", "label").distinct(), "regions")
    # a document with too many unshared shingles for the smallest of its region has no partner there
    weights = regions.groupBy("pivot").agg(F.count(F.lit(1)).alias("_docs"), F.sum("n").alias("_n"), F.min("n").alias("_short"))
    weights = weights.select(fresh_long("pivot").alias("_pivot"), parts_of(docs, shingles).alias("_parts"), "_short")
    least = F.greatest(F.ceil(F.col("n") * percent / 100), F.col("_short"))
    rows = regions.join(weights, F.col("pivot") == F.col("_pivot")).where((100 + percent) * (F.col("n") - F.col("unshared")) >= percent * (F.col("n") + least))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("point"), F.col("_parts")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.withColumn("_x", F.least("_own", "_other")).withColumn("_y", F.greatest("_own", "_other")).drop("_pivot", "_parts", "_short", "_other", "n")
    blocks = rows.join(sets.withColumnRenamed("point", "_o"), F.col("point") == F.col("_o")).drop("_o")
    links = blocks.groupBy("pivot", "_x", "_y").applyInPandas(_links(percent), "a long, b long")
    out = components(stars.union(links))
    discard(placed, stars, joined, named, regions)
    return out


def near_duplicate_components(docs: DataFrame, percent: int = PERCENT, extra: float = EXTRA, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    r"""doc_id, n_shingles and component_id of every row of docs with a doc_id.

    Words are ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, a set the different 5-word shingles; fewer words are one
    shingle; null or empty texts have none, link with nothing and are their own component. Documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id that links reach. Rows that repeat a
    doc_id are returned each; with other texts they are documents of their own and each keeps its links. Rows without
    a doc_id, which no component can name, have a null component. Other columns are ignored; an empty table gives an
    empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow = staged(texts.mapInArrow(_describe, "doc_id long, n long, print binary, mark long"), "sets")
    points = narrow.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("print", "mark", "n").agg(F.min("doc_id").alias("rep"))
    points = staged(points.withColumn("point", F.monotonically_increasing_id()), "points")

    # step 1: the screen
    met = texts.mapInArrow(_meetings(percent, extra), "shingle long, mark long, met long")
    sent = met.where(F.col("shingle").isNotNull()).select("shingle", "mark").repartition("shingle").sortWithinPartitions("shingle")
    credit = met.where(F.col("shingle").isNull()).select("mark", "met").union(sent.mapInArrow(_shared, "mark long, met long"))
    credit = credit.groupBy(F.col("mark").alias("_mark")).agg(F.sum("met").alias("_met"))
    needed = F.greatest(F.lit(1), F.floor(F.lit(extra * percent / 100) * F.col("n")) - 1)
    left = points.join(credit, F.col("mark") == F.col("_mark")).where(F.col("_met") >= needed).select("point", "rep", "print")

    # step 2: cells of the rarest shared shingles
    # texts meet the documents left by a merge join at any size: how many are left has no bound to broadcast by
    kept = texts.join(left.hint("merge"), F.col("doc_id") == F.col("rep")).select("point", "print", "text")
    whole = staged(kept.mapInArrow(_sets, "point long, n long, shingles array<long>").withColumn("_row", F.monotonically_increasing_id()), "shingles")
    # rows that repeat a doc_id and its text give a point again; sets move for that only if there are such rows
    first = whole.groupBy("point").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_k")).where("_k > 1").select(fresh_long("point").alias("_point"), "_first")
    again = staged(whole.select("point", "_row").join(first, (F.col("point") == F.col("_point")) & (F.col("_row") > F.col("_first"))).select(F.col("_row").alias("_again")), "again")
    whole = whole if again.isEmpty() else staged(whole.join(again, F.col("_row") == F.col("_again"), "left_anti"), "shingles")
    entries = whole.select(F.explode("shingles").alias("shingle"), "point", "n")
    degrees = entries.groupBy(F.col("shingle").alias("_of")).agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(fresh_long("_of").alias("_shingle"), "df")
    shared = entries.join(degrees.hint("merge"), F.col("shingle") == F.col("_shingle")).groupBy("point", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("_shared"))
    unshared = F.col("n") - F.size("_shared")
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100)
    rarest = F.slice("_shared", 1, F.greatest(F.lit(0), lacking + 1 - unshared).cast("int"))
    close = shared.where(unshared <= lacking).select("point", "n", unshared.alias("unshared"), F.transform(rarest, lambda x: x["shingle"]).alias("_rarest"))
    cells = staged(close.select("point", "n", "unshared", F.explode("_rarest").alias("cell")), "cells")

    # step 3: Voronoi regions
    named = join_cells(cells, whole.select("point", "shingles"), percent, block_docs, block_shingles)
    classes = staged(points.join(named, F.col("point") == F.col("node"), "left").select("print", "rep", F.coalesce("label", "point").alias("label")), "classes")
    discard(points, whole, again, cells, named)
    first = classes.groupBy(F.col("label").alias("_l")).agg(F.min("rep").alias("_component"))
    classes = classes.join(first.select(fresh_long("_l").alias("_label"), "_component"), F.col("label") == F.col("_label")).select(F.col("print").alias("_print"), "_component")
    rows = narrow.join(classes, F.col("print") == F.col("_print"), "left")
    own = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("_component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
