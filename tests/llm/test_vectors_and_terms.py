"""Source divergence, exact top-k search and importance resampling: brute force, odd input, production parameters."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import divergence, exact_topk, importance
from tidewater.llm.queries import QUERIES


def got(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# 11 --------------------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute_audit(docs, least_docs=10, top=10):
    groups, seen, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(low(text or ""))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least_docs)
        sources = sorted(s for g, s in groups if g == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def prices(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: prices(counts[lang, s]) for s in sources}, prices(whole)
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted(((o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s), key=lambda r: (-r[1], r[0].encode()))
            terms = sorted(((t, apart(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]), key=lambda r: (-r[1], r[0].encode()))[:top]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(rows, 1)]
    return sorted(out)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


def random_docs(n, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gam1ma", "über", "ÄRGER", "日本", "don't", "x", "hot"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(" ".join(rng.choices(words, weights, k=rng.randrange(0, 60))) if rng.random() > 0.05 else None, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", "é", None])) for _ in range(n)]


@pytest.mark.parametrize("block,columns", [(8192, 512), (7, 5)])
def test_audit_equals_brute_force(spark, block, columns):
    docs = random_docs(400) + [("hot " * 70000 + "alpha", "en", "s1"), ("", "fr", "s1"), (None, "fr", "s2"), ("one two", "it", None)]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(got(divergence.audit(df, block_terms=block, columns=columns), *AUDIT)) == brute_audit(docs)


def test_audit_of_odd_tables(spark):
    schema = "Term string, total long, text string, lang string, source string, entries int"
    docs = spark.createDataFrame([("x", 1, "same words here", "en", s, 2) for s in ("a", "b") for _ in range(10)], schema)
    rows = got(divergence.audit(docs), *AUDIT)
    assert sorted(rows) == brute_audit([("same words here", "en", s) for s in ("a", "b") for _ in range(10)])
    assert {r[4] for r in rows if r[2] == "pair"} == {0}
    assert divergence.audit(docs.limit(0)).count() == 0
    alone = spark.createDataFrame([(None, None, None)] * 3, "text string, lang string, source string")
    assert divergence.audit(alone).count() == 0


def test_products_of_large_counts_are_exact():
    counts = np.array([[0, 5 * 10**12, 3], [2, 0, 10**13], [1, 1, 1]], np.int64)
    totals, terms = counts.sum(0).tolist(), len(counts)
    found = divergence.priced_products(counts, totals, terms, 2)
    price = lambda c, g: 1 + 10**9 * (int(c) + 2) // (totals[g] + 2 * terms)
    for a in range(3):
        for b in range(3):
            assert found[a, b] == sum((price(r[a], a) - price(r[b], b)) ** 2 // (price(r[a], a) + price(r[b], b)) for r in counts)


# 12 --------------------------------------------------------------------------------------------------------------------


def brute_products(vectors, every, top):
    usable = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            scaled = [math.floor(1024 * x) for x in v]
            usable[i] = min(usable.get(i, scaled), scaled)
    out = []
    for i, v in usable.items():
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, w in usable.items() if j != i and len(w) == len(v))
            out += [(i, k, j, -s) for k, (s, j) in enumerate(found[:top], 1)]
    return sorted(out)


PRODUCTS = ("query_id", "rank", "vec_id", "score")


def search(spark, vectors, every=5, top=4, **small):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    return sorted(got(exact_topk.top_products(df, F.col("vec_id") % every == 0, top, **small), *PRODUCTS))


def test_products_equal_brute_force_over_many_lengths(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    vectors = [(i, ((base[i % 12] + 0.1 * rng.normal(size=8)) * math.exp(rng.normal())).tolist()) for i in range(600)]
    small = {"shard_rows": 70, "block_rows": 40, "bucket": 8, "first": 50}
    assert search(spark, vectors, **small) == brute_products(vectors, 5, 4)
    assert search(spark, vectors) == brute_products(vectors, 5, 4)


def test_pruning_verifies_less_and_loses_nothing():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 16))
    rows = np.floor(1024 * (base[np.arange(2000) % 20] + 0.05 * rng.normal(size=(2000, 16))) * np.exp(0.5 * rng.normal(size=(2000, 1))))
    shard = exact_topk.Shard(np.arange(2000), rows, np.linalg.norm(rows, axis=1), 64)
    for q in range(0, 2000, 97):
        ids, scores, verified = shard.search(rows[q], float(np.linalg.norm(rows[q])), 11)
        want = sorted((-s, i) for i, s in enumerate(rows @ rows[q]))[:11]
        assert [(-s, i) for i, s in zip(ids, scores, strict=True)] == want
        assert verified < 1000
    plain = exact_topk.Shard(np.arange(2000), rows, np.linalg.norm(rows, axis=1), 64)
    by_length = sum(plain.search(rows[q], float(np.linalg.norm(rows[q])), 11, steep=2.0)[2] for q in range(0, 2000, 97))
    by_both = sum(plain.search(rows[q], float(np.linalg.norm(rows[q])), 11)[2] for q in range(0, 2000, 97))
    assert by_both < by_length


def test_products_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [0.0, 0.0]), (1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [1.0, None]), (6, [-1.0, 0.5]), (None, [1.0, 1.0]), (10, [1.0, 2.0]), (10, [1.0, 1.0]),
           (20, [3.0]), (21, [0.0001]), (25, []), (26, []), (30, [1e6, -1e6]), (31, [3e9, 3e9]), (35, [-0.0001, 0.0])]
    assert search(spark, odd) == brute_products(odd, 5, 4)
    copies = [(i, [0.5, 0.25]) for i in range(300)] + [(i, [0.5, float(i % 7)]) for i in range(300, 330)]
    assert search(spark, copies, shard_rows=20, block_rows=7, bucket=4, first=9) == brute_products(copies, 5, 4)
    ties = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(40)] + [(i, [-1.0, -1.0]) for i in range(40, 60)]
    assert search(spark, ties) == brute_products(ties, 5, 4)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, Score int, _shard int")
    assert exact_topk.top_products(empty, F.col("vec_id") % 5 == 0).count() == 0
    big = [(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [1e300, 0.0])]
    assert [r[:3] for r in search(spark, big)] == [(0, 1, 2), (0, 2, 1)]


# 13 --------------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall(low(text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def brute_resample(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for count, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            count.update(map(bucket, runs(text)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out, able = {}, []
    for i, text in docs:
        words, features = runs(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [i, len(features), weight, score, None]
        if len(words) >= least:
            able.append((-score, i))
    for k, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][4] = k
    return sorted(map(tuple, out.values()))


DRAW = ("doc_id", "n_features", "weight", "score", "rank")


def test_draw_of_the_given_table_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = sorted(got(QUERIES["op13_importance_resampling"](spark, sf_dir), *DRAW))
    assert rows == brute_resample(docs, target) and sum(r[4] is not None for r in rows) > 0


@pytest.mark.parametrize("words", [0, 3, 32768])
def test_draw_whatever_the_dictionary(spark, words):
    rng = random.Random(9)
    stock = ["One", "two", "THREE4", "fünf", "ÉTÉ", "日本語", "a", "0", "x" * 300, "it's"]
    docs = [(i, " ,\n".join(rng.choices(stock, k=rng.randrange(0, 45)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "!? - "), (1003, "word " * 60000), (1004, "y" * 200000)] + [(i, "copy of the same twenty words " * 5) for i in range(2000, 2100)]
    target = ["one two it", None, "日本語 a 0", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    rows = importance.resample(df, aim, 30, words=words, range_rows=50)
    assert sorted(got(rows, *DRAW)) == brute_resample(docs, target, 30)


def test_draw_from_odd_tables(spark):
    aim = spark.createDataFrame([("some text",)], "text string")
    schema = "doc_id long, text string, Weight int, n_words string, rank int, _range int"
    long = "many words " * 20
    df = spark.createDataFrame([(1, long, 1, "x", 2, 3), (1, long, 1, "x", 2, 3), (None, long, 1, "x", 2, 3), (2, None, 1, "x", 2, 3)], schema)
    rows = got(importance.resample(df, aim, 100), *DRAW)
    assert len(rows) == 4 and sorted(r[4] for r in rows if r[4]) == [1, 2]
    assert [r[3:] for r in rows if r[0] is None] == [(None, None)]
    assert [r[1:3] for r in rows if r[0] == 2] == [(0, 0)]
    assert importance.resample(df.limit(0), aim).count() == 0
    assert len(got(importance.resample(df, aim.limit(0)), *DRAW)) == 4


def test_crcs_are_composed():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 2, 63, 64, 65, 127, 128, 1000, 70000)]
    pairs = [(a, b) for a in parts for b in parts]
    found = importance.composed(np.array([zlib.crc32(a) for a, _ in pairs], np.uint32), np.array([zlib.crc32(b) for _, b in pairs], np.uint32), np.array([len(b) for _, b in pairs]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# names that differ only in case ----------------------------------------------------------------------------------------


def test_columns_that_differ_in_case_are_replaced(spark):
    from tidewater.llm import bpe, html_extract, langid, line_dedup, toxicity, url_filter
    from tidewater.llm.queries import tokenizer_path

    def frame(names, row):
        return spark.createDataFrame([row], names)

    page = html_extract.extract_text(frame("page_id long, html string, Text string, N_CHARS int", (1, "<article><p>some words</p></article>", "x", 2)))
    assert page.columns == ["page_id", "text", "n_chars"] and page.first()["text"] == "some words"
    told = langid.predict_language(frame("doc_id long, text string, Score string, LANG_PRED int", (1, "abc", "x", 2)), {"en": [97]})
    assert told.columns == ["doc_id", "lang_pred", "score"] and told.first()["lang_pred"] == "en"
    docs = frame("doc_id long, text string, Token_ids string, DECODED_TEXT int, other int", (1, "some words", "x", 2, 3))
    both = bpe.encode_and_decode(docs, tokenizer_path()).first()
    assert both["decoded_text"] == "some words" and both["other"] == 3 and len(both) == 4
    once = bpe.decode_ids(bpe.encode_texts(docs, tokenizer_path()), tokenizer_path()).first()
    assert once["decoded_text"] == "some words" and once["token_ids"] == both["token_ids"] and once["other"] == 3
    lines = line_dedup.drop_repeated_lines(frame("doc_id long, text string, N_LINES string, Kept_text int", (1, "a\nb", "x", 2))).first()
    assert lines["n_lines"] == 2 and lines["kept_text"] == "a\nb"
    machine = toxicity.fit([np.array([0]), np.array([1])] * 20, np.array([1, 0] * 20), [11, 12])
    scored = toxicity.score_toxicity(frame("doc_id long, text string, Score string, PREDICTED string", (1, "abc", "x", "y")), machine)
    assert scored.columns == ["doc_id", "score", "predicted"] and 0 <= scored.first()["score"] <= 1
    judged = url_filter.judge(frame("page_id long, url string, Host string, VERDICT string", (1, "http://A.net/de/8", "x", "y")), url_filter.rules_table(spark))
    assert sorted(judged.columns) == ["host", "page_id", "path", "rule", "url", "verdict"] and judged.first()["host"] == "a.net"
