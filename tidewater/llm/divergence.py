r"""Source divergence audit: how far the vocabulary of each source of a language lies from each other source's.

Every (language, source) group gives every kept term of the language a price, a smoothed share in billionths that depends on
the term's count in the group alone. So the sum over all terms of what two groups' prices lie apart needs only the joint
table of their counts: how many terms have count a in one and count b in the other. The joint tables of all groups come from
one product: a row for each term, an indicator column for each (group, count level), level 0 included, and the matrix
multiplied by its transpose. Blocks of terms of like frequency, in which few levels occur, are multiplied in tasks: the
counts are whole numbers that single precision holds exactly. Each block's joint tables are priced on the spot in whole
numbers and summed over blocks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Documents of a language that a term must be in, ranks of the terms.
LEAST_DOCS, TOP_TERMS = 10, 10
#: Terms of a block, cells of its count matrix, columns of a product at most.
BLOCK_TERMS, CELLS, COLUMNS = 1024, 1 << 22, 512
#: Entries (group, term) that a task holds before it hands them on.
HELD = 300_000
ONE, DOC = 1_000_000_000, 1 << 40
#: A-Z become a-z; a-z and all bytes of other characters stay; all else parts terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), n, docs: occurrences and rows with the term, counted over all whole texts."""

    def tables(held):
        for (lang, source), own in held.items():
            both = np.fromiter(own.values(), np.int64, len(own))
            columns = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(both % DOC), pa.array(both // DOC)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for lang, source, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    own = held.setdefault((lang, source), {})
                    size -= len(own)
                    for term, n in Counter(text.translate(FOLD).split()).items():
                        own[term] = own.get(term, 0) + n + DOC  # both counts in one number
                    size += len(own)
                    if size > HELD:
                        yield from tables(held)
                        held, size = {}, 0
        yield from tables(held)

    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term with this count, in billionths, rounded down, plus 1; exact for counts of any size."""
    whole, parts = F.lit(ONE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), (total + 2 * terms).cast("decimal(19,0)")
    return F.call_function("div", whole, parts) + 1


def apart(p: Column, q: Column) -> Column:
    """(p - q) ** 2 / (p + q), rounded down, in whole numbers."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p[:, None] - q) ** 2 // (p[:, None] + q)


def priced_products(counts: np.ndarray, totals: list[int], terms: int, columns: int = COLUMNS) -> np.ndarray:
    """For each two groups the summed gaps of some terms. counts: terms x groups; totals: each group's count of kept terms."""
    out = np.zeros((counts.shape[1], counts.shape[1]), np.int64)
    group, level, column = _indicators(counts)
    if len(group) > columns and len(counts) > 1:
        half = len(counts) // 2
        return priced_products(counts[:half], totals, terms, columns) + priced_products(counts[half:], totals, terms, columns)
    shown = np.zeros((len(counts), len(group)), np.float32)
    shown[np.arange(len(counts))[:, None], column] = 1
    prices = np.array([1 + ONE * (int(c) + 2) // (totals[g] + 2 * terms) for g, c in zip(group, level, strict=True)], np.int64)
    for a in range(0, len(group), columns):
        for b in range(0, len(group), columns):
            i, j = slice(a, a + columns), slice(b, b + columns)
            joint = (shown[:, i].T @ shown[:, j]).astype(np.int64)
            worth = joint * gaps(prices[i], prices[j])
            rows, cols = np.flatnonzero(np.diff(group[i], prepend=-1)), np.flatnonzero(np.diff(group[j], prepend=-1))
            summed = np.add.reduceat(np.add.reduceat(worth, rows, axis=0), cols, axis=1)
            out[np.ix_(group[i][rows], group[j][cols])] += summed
    return out


def _indicators(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group and level of each indicator column, in order of groups, and for each (term, group) its column."""
    column, group, level, width = np.empty(counts.shape, np.int64), [], [], 0
    for g in range(counts.shape[1]):
        kinds, at = np.unique(counts[:, g], return_inverse=True)
        column[:, g] = width + at
        group.append(np.full(len(kinds), g))
        level.append(kinds)
        width += len(kinds)
    return np.concatenate(group), np.concatenate(level), column


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total, entries (source, n) of the terms in at least least_docs rows of their language; staged."""
    by_term = count_terms(docs).groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return staged(by_term.where(F.col("_docs") >= least_docs).select("lang", "term", "total", "entries"), "terms")


def group_sums(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total, terms, lang_total of every group of docs: its count and its language's number and count of kept terms; staged."""
    given = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.select("lang", F.explode("entries").alias("_e")).groupBy("lang", F.col("_e.source").alias("source")).agg(F.sum("_e.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_total"))
    both = given.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    return staged(both.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")]), "groups")


def pair_values(kept: DataFrame, groups: DataFrame, block_terms: int = BLOCK_TERMS, columns: int = COLUMNS) -> DataFrame:
    """lang, a, b, value: the gaps of two groups of a language, summed over its kept terms, for each pair with a < b."""
    band = F.floor(F.log2(F.col("total").cast("double"))).cast("int")
    rows = kept.withColumn("band", band)
    blocks = rows.groupBy("lang", "band").agg(F.ceil(F.count(F.lit(1)) / block_terms).cast("int").alias("blocks"))
    sizes = blocks.select(F.col("lang").alias("_lang"), F.col("band").alias("_band"), "blocks")
    rows = rows.join(sizes, (F.col("lang") == F.col("_lang")) & (F.col("band") == F.col("_band")))
    rows = rows.select("lang", "band", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "total", "entries")
    own = blocks.select("lang", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(groups, "lang").select(*[F.col(c).alias(c) for c in ("lang", "band", "block", "source", "total", "terms")])

    def run(terms: pa.Table, sums: pa.Table) -> pa.Table:
        names = sums["source"].combine_chunks()
        by_name = pc.sort_indices(names)
        names, totals = names.take(by_name), sums["total"].combine_chunks().take(by_name).to_pylist()
        out = np.zeros((len(names), len(names)), np.int64)
        if terms.num_rows and len(names):
            terms = terms.sort_by("total")
            kept_in_lang, step = sums["terms"][0].as_py(), max(1, CELLS // len(names))
            for start in range(0, terms.num_rows, step):
                entries = terms["entries"].slice(start, step).combine_chunks()
                flat = entries.flatten()
                counts = np.zeros((len(entries), len(names)), np.int64)
                at = np.repeat(np.arange(len(entries)), pc.list_value_length(entries).to_numpy(zero_copy_only=False))
                counts[at, pc.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
                out += priced_products(counts, totals, kept_in_lang, columns)
        a, b = np.triu_indices(len(names), 1)
        lang = (terms if terms.num_rows else sums)["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(out[a, b], pa.int64())})

    keys = ["lang", "band", "block"]
    priced = rows.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(run, "lang string, a string, b string, value long")
    return priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def term_values(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, item, value, rank: the terms whose price in a group lies furthest above that in its language, top of them."""
    sums = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("total").alias("_total"), "terms", "lang_total")
    each = kept.select("lang", "term", F.col("total").alias("_all"), F.explode("entries").alias("_e"))
    each = each.join(sums, (F.col("lang") == F.col("_lang")) & (F.col("_e.source") == F.col("_source"))).where(F.col("_e.n") > 0)
    p, q = price(F.col("_e.n"), F.col("_total"), F.col("terms")), price(F.col("_all"), F.col("lang_total"), F.col("terms"))
    each = each.select("lang", F.col("_source").alias("source"), F.col("term").cast("string").alias("item"), p.alias("_p"), q.alias("_q")).where("_p > _q")
    each = each.select("lang", "source", "item", apart(F.col("_p"), F.col("_q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs (text, lang, source).

    Part pair: item is each other source of the language, value the summed gaps, 0 without kept terms. Part term: item is each of
    the ``top`` terms that the group prices furthest above its language. Ranks go by value, ties to the smaller item. Null texts, langs and sources
    are empty ones; each row is a document, repeated ones too; other columns are left out, whatever their names; an empty table
    gives an empty result.
    """
    rows = docs.select("lang", "source", "text")
    kept = kept_terms(rows, least_docs)
    groups = group_sums(rows, kept)
    values = pair_values(kept, groups, block_terms, columns)
    both = values.unionByName(values.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    both = both.select(F.col("lang").alias("_lang"), F.col("a").alias("_a"), F.col("b").alias("_b"), "value")
    others = groups.select(F.col("lang").alias("_of"), F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, (F.col("lang") == F.col("_of")) & (F.col("source") != F.col("item")))
    pairs = pairs.join(both, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_a")) & (F.col("item") == F.col("_b")), "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = term_values(kept, groups, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
