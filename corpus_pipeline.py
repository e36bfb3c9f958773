"""A training corpus in five stages over the documents table: toxic texts go, then exact copies, then near copies; the
sources are mixed to target weights, and what is left is encoded. Each stage reads what the one before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from tidewater.llm.common import discard, free_names, shared_folder, staged, table
from tidewater.llm.queries import bpe_digests, tokenizer_path


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with the columns that bear one of these names renamed; their order gives the own names back."""
    given = free_names([*docs.columns, *names], *(f"own_{c}" for c in docs.columns))
    return docs.toDF(*[n if c.lower() in names else c for c, n in zip(docs.columns, given, strict=True)])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject; it learns from the labels of documents at hand.

    Null and empty texts get the machine's bias; repeated rows stay or go together; without labels all stay. Own columns
    named score or predicted are kept as they are; an empty table gives an empty result.
    """
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    own = aside(docs, "score", "predicted")
    return toxicity.score_toxicity(own, machine, keep_text=True).where(F.col("predicted") == 0).select(*own.columns).toDF(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept document of each class of equal texts; null and empty ones are equal, so one of them stays.

    Rows without doc_id stay if their class keeps them; of rows that repeat a doc_id and its text one stays. Other columns
    may bear any name; an empty table gives an empty result.
    """
    doc, n = free_names(docs.columns, "_doc", "_n")
    kept = exact_dedup.duplicate_classes(docs).where("kept").select(F.col("doc_id").alias(doc), F.col("n_chars").alias(n))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.length(F.coalesce("text", F.lit(""))) == F.col(n))
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest doc_id.

    Null and empty texts and rows without doc_id stay; a doc_id that repeats with other texts goes if one of these has a
    smaller partner. Other columns may bear any name; an empty table gives an empty result.
    """
    (doc,) = free_names(docs.columns, "_doc")
    found = jaccard_join.near_duplicate_components(docs)
    lost = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(doc))
    return docs.join(lost, F.col("doc_id") == F.col(doc), "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: those of scarce sources more than once.

    Null and empty texts have the rate that the priors give; without any source all stay once; repeated rows are read
    alike. Own columns named as those of the rates are kept as they are; an empty table gives an empty result.
    """
    own = aside(docs, *mixing.ADDED)
    # written first: a filter on copies would otherwise be pushed down as the whole expression of the rates
    rated = staged(mixing.fit_rates(own).select(*own.columns, "copies"), "rated")
    each = F.explode(F.sequence(F.lit(1), F.col("copies")))
    (copy,) = free_names(rated.columns, "_copy")
    return rated.where(F.col("copies") > 0).select(*own.columns, each.alias(copy)).select(*own.columns).toDF(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of what is left and of the decoded texts, which prove the round trip.

    Null texts count as empty and have no tokens; each row is encoded; other columns are left out; an empty table gives an
    empty result.
    """
    path = tokenizer_path()
    return bpe_digests(bpe.encode_and_decode(docs.select("doc_id", "text"), path))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("source_mixing", mixed),
    ("bpe", encoded),
]

#: SQL can't learn the toxicity model; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage read is deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(before)
        before = path
    return docs
