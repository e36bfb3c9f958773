"""The registered queries over given tables: what they select, and what they reach on rows they have not learned from."""

import zlib

import numpy as np
import pytest

from tidewater.llm.queries import QUERIES

from .test_operators import brute_nearest


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_neighbours_reach_the_recall(spark, size):
    sf_dir = f"/root/testdata/{size}"
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = brute_nearest(vectors, 20), {}
    for r in QUERIES["op2_nearest_neighbours"](spark, sf_dir).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys() and all(sorted(v) == list(range(1, len(want[q]) + 1)) for q, v in got.items())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    data = {i: np.array(v, float) for i, v in vectors if v}
    assert all(abs(s - float((data[q] * data[i]).sum())) < 1e-9 for q, v in got.items() for i, s in v.values())


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op4_language_id"](spark, sf_dir).collect()
    assert len(got) == len(docs) and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    told = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] and docs[r["doc_id"]]["text"]]
    assert told and np.mean(told) > 0.95


def test_toxicity_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    told = [(toxic[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    assert np.mean([a == b for a, b in told]) > 0.9


def test_sources_meet_their_targets(spark, sf_dir):
    got = QUERIES["op3_source_mixing"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(r["rate"] >= 0 for r in got)
    assert max(abs(r["residual"]) for r in got) <= 1e-3
