"""The pipeline's stages, each on its own input, against brute-force versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidewater.llm.queries import tokenizer_path

from .test_operators import WHITE, brute_components


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """What each stage leaves."""
    docs, out, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}, tmp_path_factory.mktemp("stages")
    out["documents"] = docs
    for name, stage in cp.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(at / name))
        out[name] = docs = spark.read.parquet(str(at / name))
    return out


def test_columns(kept):
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "source_mixing", "bpe"]
    assert all(kept[n].columns == kept["documents"].columns for n in names[:-1])


def test_toxic_go_and_clean_stay(spark, sf_dir, kept):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    before = {r["doc_id"]: r["toxic"] for r in kept["documents"].join(labels, "doc_id").select("doc_id", "toxic").collect()}
    after = {r["doc_id"] for r in kept["toxicity"].select("doc_id").collect()}
    clean = [d for d, y in before.items() if y == 0]
    assert sum(d in after for d in clean) >= 0.95 * len(clean)


def test_one_of_each_text(kept):
    texts = lambda name: [(r["doc_id"], r["text"]) for r in kept[name].select("doc_id", "text").collect()]
    groups = {}
    for d, t in texts("toxicity"):
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), d))
    assert sorted(d for d, _ in texts("exact_dedup")) == sorted(min(g)[1] for g in groups.values())


def test_one_of_each_component(kept):
    before = [(r["doc_id"], r["text"]) for r in kept["exact_dedup"].select("doc_id", "text").collect()]
    want = {c for _, c in brute_components(before).values()}
    assert {r["doc_id"] for r in kept["jaccard_join"].select("doc_id").collect()} == want


def test_mixed_keeps_whole_documents(kept):
    before = {r["doc_id"] for r in kept["jaccard_join"].collect()}
    after = [r["doc_id"] for r in kept["source_mixing"].collect()]
    assert after and set(after) <= before


def test_encoded(kept):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    texts = sorted((r["doc_id"], r["text"]) for r in kept["source_mixing"].select("doc_id", "text").collect())
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in kept["bpe"].collect())
    want = []
    for d, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_stages_stand_odd_rows(spark, sf_dir, kept):
    rows = [(None, None, None, None, None), (10**7, "", None, None, 0), (10**7 + 1, "a b", "en", None, 3), (10**7 + 1, "a b", "en", None, 3), (10**7 + 2, "a  b", "en", "s", 4)]
    odd = spark.createDataFrame(rows, kept["documents"].schema)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=lambda d: (d is not None, d))
    every = [None, 10**7, 10**7 + 1, 10**7 + 1, 10**7 + 2]
    want = {"toxicity": every, "exact_dedup": [10**7, 10**7 + 2], "jaccard_join": [None, 10**7, 10**7 + 1, 10**7 + 1], "source_mixing": every, "bpe": every}
    for name, stage in cp.STAGES:
        assert ids(stage(spark, odd, sf_dir)) == want[name]
        empty = stage(spark, kept["documents"].limit(0), sf_dir)
        assert empty.count() == 0 and (name == "bpe" or empty.columns == odd.columns)


def test_stages_hand_on_columns_that_clash(spark, sf_dir, kept):
    names = ["score", "Predicted", "copies", "tokens", "rate", "_copy", "_doc", "_n", "own_score"]
    docs = kept["documents"].limit(20).select("*", *[F.lit(f"kept {n}").alias(n) for n in names])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0
        assert {tuple(r) for r in out.select(*names).collect()} == {tuple(f"kept {n}" for n in names)}


def test_run(spark, sf_dir, kept):
    assert {r["doc_id"] for r in cp.run(spark, sf_dir).select("doc_id").collect()} == {r["doc_id"] for r in kept["bpe"].select("doc_id").collect()}


def test_no_driver_side_column(kept):
    assert kept["source_mixing"].where(F.col("text").isNull()).count() == 0
