r"""Line dedup: explode normalised lines, hash them, count distinct documents per hash, drop lines over a threshold
and reassemble the rest by position.

The key of a line is the line without white space at its ends, A-Z lower-cased. Only hashes and positions are
written once and shuffled, for the counts and for what they decide; texts move once, to meet the positions they lose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, free_names, others, staged

MIN_CHARS, MIN_DOCS = 20, 3


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    r"""docs with kept_text, n_lines and n_dropped added.

    Lines end at \n; null or empty text is one empty line. A key of min_chars code points or more that min_docs
    different doc_ids hold stays only in the largest doc_id that holds it, there with all its lines. A row without
    doc_id counts nowhere and keeps its lines. Repeated rows are one document and lose the same lines. Columns named
    kept_text, n_lines or n_dropped are replaced, others stay whatever their names; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.unhex(F.md5(text))
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", mark.alias("_mark"), F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
    trimmed = lines.select("doc_id", "_mark", "_pos", F.btrim("_line", F.lit(WHITE)).alias("_line")).where(F.length("_line") >= min_chars)
    keyed = staged(trimmed.select("doc_id", "_mark", "_pos", F.unhex(F.md5(ascii_lower(F.col("_line")))).alias("_hash")), "lines")

    counted = keyed.groupBy("_hash").agg(F.count_distinct("doc_id").alias("_n"), F.max("doc_id").alias("_holder")).where(F.col("_n") >= min_docs)
    common = counted.select(F.concat("_hash", F.lit(b"")).alias("_common"), "_holder")
    lost = keyed.join(common, F.col("_hash") == F.col("_common")).where(F.col("doc_id") != F.col("_holder"))
    own, doc, of, gone = free_names(docs.columns, "_mark", "_doc", "_of", "_lost")
    lost = lost.groupBy(F.col("doc_id").alias(doc), F.col("_mark").alias(of)).agg(F.collect_set("_pos").alias(gone))

    kept = others(docs.columns, "kept_text", "n_lines", "n_dropped")
    rows = docs.select(*kept, mark.alias(own)).join(lost, (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(of)), "left")
    split = F.split(text, "\n", -1)
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone)))
    return rows.select(
        *kept,
        F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")).alias("kept_text"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
