"""Each corpus operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables
and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import ann, bpe, exact_dedup, html_extract, jaccard_join, langid, line_dedup, mixing, toxicity, url_filter
from tidewater.llm.queries import tokenizer_path

DOC = "doc_id long, text string"
WHITE = re.compile(r"[\x20\x09-\x0D]")


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# 1 ---------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<div class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></div><header>Site name</header>
<div id="cookie-notice">We use cookies on this site to make things work for you.</div>
<article><h1>A title &amp; more</h1><p>First <b>bold</b> paragraph of the article&nbsp;here, long enough.</p><p>Short.</p>
<div class="ad">Buy now</div><p>Second   paragraph
with a line end.</p></article><aside>Read also these other fine pieces of text</aside>
<section class="comments"><p>A reader says something at some length about the article.</p></section>
<form><label>Name</label><input></form><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = "A title & more First bold paragraph of the article here, long enough. Short. Second paragraph with a line end."
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>" + "word " * 50000 + "</p>", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_text(pages).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert got[4]["n_chars"] == 249999
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_html_without_article_element():
    long = "This is running text that goes on for a while and says things, so that it is clearly the content of the page. "
    page = f"<body><div class='nav'><a>One</a><a>Two</a></div><div><div><div>stray</div></div></div><div><div><div><p>{long}</p><p>{long}</p></div></div></div><div><div><div><a href=x>Next page</a></div></div></div></body>"
    assert html_extract.main_text(page) == f"{long}{long}".strip()
    assert html_extract.main_text("<p>unclosed <b>tags <p>everywhere") == "unclosed tags everywhere"
    assert html_extract.main_text("<script>never ends") == ""


def test_html_closes_over_many_children():
    long = "This is running text that goes on for a while and says things, so that it is clearly the content of the page."
    for before in (
        "<svg>" + "<path d='M0 0'/>" * 100 + "</svg>",
        "<svg>" + "<g>" * 100 + "</svg>",
        "<nav><dl>" + "<dt>a<dd>b" * 100 + "</dl></nav>",
        "<aside><table>" + "<tr><td>a<td>b" * 100 + "</table></aside>",
        "<aside><table>" + "<tr><th><b>a<td>b" * 100 + "</table></aside>",
    ):
        assert html_extract.main_text(f"<body>{before}<p>{long}</p></body>") == long
    assert html_extract.main_text(f"<body><article><p>{long}</p>{'<div>' * 100}</article><p>{long}</p></body>") == long
    lines = html_extract.strip_markup("<table>" + "<tr><td>a<td>b" * 100 + "</table><p>c")
    assert [x[0] for x in lines if x[0]] == ["a", "b"] * 100 + ["c"]
    assert html_extract.main_text("<b><i>" * 20000 + "</u>" * 20000 + long) == long


def test_html_article_in_what_looks_beside():
    long = "This is running text that goes on for a while and says things, so that it is clearly the content of the page."
    for name in ("class='no-sidebar'", "class='content has-sidebar'", "id='layout-with-nav'"):
        assert html_extract.main_text(f"<body><div {name}><p>{long}</p></div></body>") == long
    for outer in ("<form id='aspnetForm'>", "<div class='page sidebar-right'>", "<div id='menu-layout'>"):
        for inner in ("<article>", "<main>", "<div itemprop='articleBody'>"):
            assert html_extract.main_text(f"<body>{outer}{inner}<p>{long}</p></body>") == long
    inner = f"<div><p>{long}</p><p>{long}</p></div><form><label>Your name and what you want to tell us</label></form><nav>Home and other places</nav>"
    for outer in ("<form id='aspnetForm'>", "<div class='page menu-left'>"):
        assert html_extract.main_text(f"<body>{outer}{inner}") == f"{long} {long}"
    assert html_extract.main_text(f"<body><div><p>{long}</p></div><form><p>{long[:60]}</p></form>") == long
    teaser = "<article><p>Another story on this site that readers may well want to open and read next.</p></article>"
    for outer in ("<aside>", "<div class='related'>", "<div id='sidebar'>", "<section class='comments'>", "<div hidden>"):
        assert html_extract.main_text(f"<body>{outer}{teaser}") == ""
    for outer in ("<section class='comments'>", "<div hidden>", "<div style='display:none'>"):
        assert html_extract.main_text(f"<body>{outer}<main><p>{long}</p></main>") == ""


def test_html_names_with_role_words_in_them_are_no_roles():
    long = "This is running text that goes on for a while and says things, so that it is clearly the content of the page."
    for name in ("share-price", "search-results", "header-bidding", "commentary", "menu-recipes", "notice-of-intent", "social-history", "legal-analysis"):
        for page in (f"<article><p>{long}</p><div class='{name}'><p>{long}</p></div></article>", f"<p>{long}</p><p class='{name}'>{long}</p>"):
            assert html_extract.main_text(page) == f"{long} {long}"
    for name in ("share-bar", "searchBox", "site-header", "comments-area", "menu", "cookie-notice", "ad_slot 1", "social-links", "footer-widgets"):
        assert html_extract.main_text(f"<article><p>{long}</p><div class='{name}'><p>{long}</p></div></article>") == long


def brute_surges(lengths, window, surge, share):
    """Window by window: runs begin after a dive, and a run stays whole if one of its windows surges."""
    text = [sum(lengths[k : k + window]) for k in range(len(lengths))]
    least, out, k = max(1, min(surge, share * max(text, default=0))), [False] * len(lengths), 0
    while k < len(lengths):
        end = k
        while end < len(lengths) - 1 and text[end] > 0:
            end += 1
        for i in range(k, end + 1):
            out[i] = any(lengths) and any(t >= least for t in text[k : end + 1])
        k = end + 1
    return out


def test_html_windows_match_brute_force():
    rng = random.Random(11)
    for _ in range(500):
        lengths = [rng.choice([0, 0, 0, 0, rng.randrange(1, 15), rng.randrange(1, 300)]) for _ in range(rng.randrange(0, 40))]
        window, surge, share = rng.randrange(1, 5), rng.choice([0, 10, 60, 200]), rng.choice([0.0, 0.1, 0.5])
        assert list(html_extract.surged(np.array(lengths, np.int64), window, surge, share)) == brute_surges(lengths, window, surge, share)


def test_html_windows_decide_where_nothing_is_named(monkeypatch):
    # no element names its role: only the lengths of lines tell the article from what stands around it
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(["some", "words", "of", "text"]) for _ in range(n))
    for _ in range(50):
        story = [text(rng.randrange(30, 90)) for _ in range(rng.randrange(2, 6))]
        stray = [text(2) for _ in range(4)]
        gap = "<div></div>" * 6
        page = "".join(f"<div>{x}</div>{gap}" for x in stray[:2]) + "".join(f"<div>{x}</div>" for x in story) + "".join(f"{gap}<div>{x}</div>" for x in stray[2:])
        assert html_extract.main_text(page) == " ".join(story)
        with monkeypatch.context() as without:
            without.setattr(html_extract, "surged", lambda lengths, *_: np.ones(len(lengths), bool))
            assert html_extract.main_text(page) == " ".join(stray[:2] + story + stray[2:])


# 2 ---------------------------------------------------------------------------------------------------------------------


def brute_nearest(vectors, top):
    fine = {i: np.array(v, float) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q, v in fine.items():
        if q % 20 == 0:
            best = sorted(((-float((w * v).sum()), i) for i, w in fine.items() if i != q))[:top]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_ann(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    vectors += [(i, vectors[3][1]) for i in range(600, 700)]  # copies: ties go to smaller ids
    vectors += [(700, None), (701, [0.0] * 8), (702, [float("nan")] + [1.0] * 7), (703, [None] + [1.0] * 7), (720, [float("inf")] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for q, r, i, s in rows(ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0, shard_rows=200, block_rows=20).orderBy("query_id", "rank"), "query_id", "rank", "vec_id", "score"):
        got.setdefault(q, []).append((i, s))
        assert r == len(got[q])
    want = brute_nearest(vectors, 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert [i for i, _ in got[600]] == [i for i, _ in want[600]] and np.allclose([s for _, s in got[600]], [s for _, s in want[600]])
    assert [i for i, _ in got[600]][:3] == [3, 601, 602]
    few = ann.nearest_neighbours(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(spark):
    random.seed(2)
    words = {"a": "alpha beta gamma delta", "b": "one two three four five", "c": "rot gelb blau"}
    docs = [(i, " ".join(random.choices(words[s].split(), k=random.randint(20, 60))), s if i % 9 else None) for i, s in enumerate(random.choices("aaaabbc", k=700))]
    docs += [(9000, None, "a"), (9001, "", None), (1, docs[1][1], docs[1][2])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("rate", F.lit("clash"))
    weights = {"a": 0.4, "b": 0.35, "c": 0.25}
    out = mixing.fit_rates(df, weights).collect()
    assert len(out) == len(docs) and min(r["rate"] for r in out) >= 0
    sums = np.zeros(3)
    for r in out:
        sums += r["rate"] * r["tokens"] * np.array(r["posterior"])
        assert abs(sum(r["posterior"]) - 1) < 1e-9
    assert np.allclose(sums / sums.sum(), list(weights.values()), atol=0.01)
    placed = [r for r in out if r["source"] is None and r["tokens"]]
    truth = {i: next(k for k, v in words.items() if t.split()[0] in v.split()) for i, t, _ in docs if t}
    assert np.mean([truth[r["doc_id"]] == r["domain_pred"] for r in placed]) > 0.95
    assert mixing.fit_rates(df.limit(0)).count() == 0
    assert {r["rate"] for r in mixing.fit_rates(df.withColumn("source", F.lit(None).cast("string"))).collect()} == {1.0}


def test_mixing_sees_long_texts(spark):
    rng = random.Random(5)
    word = lambda s: f"{s}{rng.randrange(20000)}" if rng.random() < 0.5 else f"w{rng.randrange(5000)}"
    docs = [(i, " ".join(word(s) for _ in range(12000)), s if i >= 8 else None, s) for i, s in enumerate("ab" * 20)]
    df = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["domain_pred"], max(r["posterior"])) for r in mixing.fit_rates(df).collect()}
    assert all(got[i][0] == s and got[i][1] > 0.8 for i, _, _, s in docs)


def test_mixing_meets_the_targets_of_a_hot_and_a_small_source(spark):
    # one source has a third of the rows, one five short texts; a declared source is never an input
    rng = random.Random(9)
    text = lambda s, n: " ".join(rng.choice((f"{s}{rng.randrange(8)}", f"w{rng.randrange(50)}")) for _ in range(n))
    docs = [(i, text("s0", 80), "s0") for i in range(500)] + [(1000 + i, text(f"s{1 + i % 8}", 80), f"s{1 + i % 8}") for i in range(1000)] + [(9000 + i, text("tiny", 30), "tiny") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    out = mixing.fit_rates(df).collect()
    own = {s: sum(len(x.split()) for _, x, e in docs if e == s) for s in {d[2] for d in docs}}
    weights = mixing.flattened(own)
    got = sum(r["rate"] * r["tokens"] * np.array(r["posterior"]) for r in out)
    assert np.allclose(got, np.array([weights[s] for s in sorted(own)]) * sum(own.values()), rtol=2e-3)
    assert max(abs(r["residual"]) for r in out) <= 1e-3 and min(r["rate"] for r in out if r["source"] == "tiny") > 1.5
    assert np.mean([r["domain_pred"] == r["source"] for r in out]) > 0.95
    hidden = {r["doc_id"]: r["posterior"] for r in mixing.learn_classifier(df, "source").posterior(df.drop("source"), mixing.words_of(F.col("text")), ["doc_id"]).collect()}
    shown = {r["doc_id"]: r["posterior"] for r in mixing.learn_classifier(df, "source").posterior(df.withColumn("source", F.lit("s3")), mixing.words_of(F.col("text")), ["doc_id"]).collect()}
    assert hidden == shown
    ghost = mixing.fit_rates(df.where("source in ('s1', 's2')"), {"s1": 0.25, "s2": 0.25, "nowhere": 0.5}).collect()
    assert all(abs(r["rate"] - 1) < 0.1 for r in ghost)


def test_mixing_reports_targets_out_of_reach(spark):
    # all texts alike: no rates can tell the domains apart, so all stay as they are and the residual says so
    df = spark.createDataFrame([(i, "same words in all", "a" if i % 4 else "b") for i in range(200)], "doc_id long, text string, source string")
    out = mixing.fit_rates(df, {"a": 0.5, "b": 0.5}).collect()
    assert all(abs(r["rate"] - 1) < 1e-6 for r in out) and max(abs(r["residual"]) for r in out) > 0.3


def test_posterior_is_naive_bayes(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"{rng.choice('xyz'[: 1 + i % 3])}{rng.randrange(30)}" for _ in range(rng.randrange(1, 60))), "abc"[i % 3]) for i in range(90)] + [(99, "", "a"), (98, "new words only", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    learned, buckets = mixing.learn_classifier(df, "source", buckets=1 << 18), 1 << 18
    got = {r["doc_id"]: r["posterior"] for r in learned.posterior(df, mixing.words_of(F.col("text")), ["doc_id"]).collect()}
    seen = {s: [set(t.split()) for _, t, e in docs if e == s and t] for s in "abc"}
    counts = {s: {w: sum(w in t for t in seen[s]) for t in seen[s] for w in t} for s in "abc"}
    for i, t, _ in docs:
        own, scores = set(t.split()), []
        for s in "abc":
            total = sum(counts[s].values()) + mixing.SMOOTHING * buckets
            likelihood = sum(np.log((counts[s].get(w, 0) + mixing.SMOOTHING) / total) for w in own)
            scores.append(np.log(len(seen[s]) / 90) + mixing.EVIDENCE * likelihood / max(1, len(own)) ** 0.5)
        want = np.exp(np.array(scores) - max(scores))
        assert np.allclose(got[i], want / want.sum(), atol=1e-6)


def test_mixing_matches_numpy(spark):
    rng = np.random.default_rng(0)
    p, tokens = rng.dirichlet([0.3] * 3, 200), rng.integers(10, 200, 200)
    df = spark.createDataFrame([(int(t), *[float(x) for x in q]) for t, q in zip(tokens, p)], "tokens long, p0 double, p1 double, p2 double")
    w = np.array([0.5, 0.3, 0.2])
    steps, off = mixing.fit(df, list(w), tolerance=1e-7)
    own = (tokens[:, None] * p).sum(0)
    target, s = w * (own / w).min(), np.zeros(3)
    for _ in range(5000):
        s += ((np.maximum(0, 1 - p @ s)[:, None] * tokens[:, None] * p).sum(0) - target) / own
    assert np.allclose(np.maximum(0, 1 - p @ steps), np.maximum(0, 1 - p @ s), atol=1e-5) and max(map(abs, off)) <= 1e-7
    sizes = [500, 300, 100]
    factors = np.array(mixing.calibrate(df, sizes))
    q = p * factors / (p * factors).sum(1, keepdims=True)
    assert np.allclose((tokens[:, None] * q).sum(0) / tokens.sum(), np.array(sizes) / 900, rtol=0.012)


@pytest.mark.parametrize("name", ["_log", "words", "Vector", "scores", "label", "tokens", "Rate"])
def test_mixing_stands_clashing_names(spark, name):
    df = spark.createDataFrame([(1, "a b", "x", "k"), (2, None, "y", "k"), (3, "c d", "y", "k"), (None, "e", None, "k")], f"doc_id long, text string, source string, `{name}` string")
    out = mixing.fit_rates(df)
    assert out.count() == 4 and (name.lower() in mixing.ADDED or {r[name] for r in out.collect()} == {"k"})


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    profiles = langid.learn_profiles(docs.where("doc_id % 2 = 0"))
    assert set(profiles) == {"de", "en", "es", "fr"} and all(len(v) == langid.PROFILE for v in profiles.values())
    got = langid.predict_language(docs.where("doc_id % 2 = 1").withColumn("score", F.lit("clash")), profiles).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... 4"), (4, "the " * 100000), (4, "the " * 100000), (None, "und der die das nicht")], DOC)
    found = {r["doc_id"]: r for r in langid.predict_language(odd, profiles).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und", "und", "und", "en"] and found[1]["score"] == 0
    assert langid.predict_language(odd.limit(0), profiles).count() == 0
    assert langid.learn_profiles(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.predict_language(odd, {}).collect()} == {"und"}


def test_out_of_place_by_hand():
    ranker = langid.Ranker({"x": [1, 2, 3], "y": [3, 2, 1]}, 3)
    assert ranker.ranks.tolist() == [[0, 2], [1, 1], [2, 0]]


# 5 ---------------------------------------------------------------------------------------------------------------------


def brute_classes(docs):
    groups = {}
    for i, (d, t) in enumerate(docs):
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), d is None, d if d is not None else 0, i))
    out = {}
    for text, members in groups.items():
        first = min(members)
        for m in members:
            out[m[3]] = (docs[m[3]][0], docs[first[3]][0], len(members), m == first, hashlib.sha256(text.encode()).hexdigest())
    return sorted(out.values(), key=str)


def exact_rows():
    random.seed(5)
    long = " ".join(f"w{random.randint(0, 10**6)}" for _ in range(20000))
    return [(1, "a b c"), (2, "a  b\tc"), (3, "abc"), (4, None), (5, ""), (6, " \n"), (7, long), (8, long.replace(" ", "  ")), (9, long + "x"), (10, "é ß"), (11, "éß"), (None, "abc"), (3, "abc")]


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(spark, digest_bytes):
    docs = exact_rows()
    df = spark.createDataFrame(docs, DOC).withColumn("kept", F.lit(1)).repartition(3)
    got = rows(exact_dedup.duplicate_classes(df, digest_bytes), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(got, key=str) == brute_classes(docs)
    assert exact_dedup.duplicate_classes(df.limit(0)).count() == 0


def test_chunks_are_content_defined():
    random.seed(1)
    data = bytes(random.randrange(256) for _ in range(200_000))
    a, b = exact_dedup.chunks_of(data), exact_dedup.chunks_of(data[:1000] + b"inserted" + data[1000:])
    assert b"".join(a) == data and len(set(a) & set(b)) >= len(a) - 3
    assert max(map(len, a)) <= exact_dedup.MOST
    assert b"".join(exact_dedup.chunks_of(b"a" * 100_000)) == b"a" * 100_000 and exact_dedup.chunks_of(b"") == []


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_bpe(spark):
    from tokenizers import Tokenizer

    random.seed(3)
    alphabet = list("abcAB 12'\t\n\r  éñß漢😀\u00a0\u3000.,!?|<>-_sdmtlre") + ["<|endoftext|>", "'s", "'re", "  ", "\n\n", "<|", "endoftext"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>  c", "x" * 50000, "the end " * 20000, "same", "same", None]
    library = Tokenizer.from_file(tokenizer_path())
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("token_ids", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(df, tokenizer_path()).collect()}
    for i, ids in enumerate(want):
        assert got[i]["token_ids"] == ids and got[i]["decoded_text"] == library.decode(ids, skip_special_tokens=False)
    two = bpe.decode_ids(bpe.encode_texts(df.where("doc_id < 200"), tokenizer_path()), tokenizer_path()).collect()
    assert all(r["token_ids"] == want[r["doc_id"]] and r["decoded_text"] == texts[r["doc_id"]] for r in two)
    assert bpe.encode_and_decode(df.limit(0), tokenizer_path()).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    common, other = "This line is a long enough one", "Another long line in two documents"
    docs = [(1, f"{common}\nshort\n{other}"), (2, f"x\n  {common.upper()} \ny"), (3, f"{common}\n{common}\nz"), (4, None), (5, ""), (6, f"{other}\n\n"), (7, "short\nshort"), (1, f"{common}\nshort\n{other}"), (None, common), (8, "line of some length " * 20000)]
    df = spark.createDataFrame(docs, DOC).withColumn("n_lines", F.lit("clash"))
    got = sorted(rows(line_dedup.drop_repeated_lines(df), "doc_id", "n_lines", "n_dropped", "kept_text"), key=lambda r: (r[0] is None, r[0]))
    want = [(1, 3, 1, f"short\n{other}"), (1, 3, 1, f"short\n{other}"), (2, 3, 1, "x\ny"), (3, 3, 0, docs[2][1]), (4, 1, 0, ""), (5, 1, 0, ""), (6, 3, 0, f"{other}\n\n"), (7, 2, 0, "short\nshort"), (8, 1, 0, docs[9][1]), (None, 1, 0, common)]
    assert got == want
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_machine_learns_interactions():
    random.seed(4)
    rows_, labels = [], []
    for _ in range(2000):  # toxic only if both 0 and 1 are there: no linear weights separate this with clean singles as common
        found = [f for f in range(6) if random.random() < 0.5]
        rows_.append(np.array(found, np.int64))
        labels.append(int((0 in found) == (1 in found)))
    machine = toxicity.fit(rows_, np.array(labels), np.arange(6), steps=800)
    assert np.mean([(machine.score(r.tolist()) >= 0.5) == bool(y) for r, y in zip(rows_, labels)]) > 0.95


def test_toxicity(spark):
    random.seed(6)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        text, toxic = random.choices(plain, k=40), int(i % 4 == 0)
        if toxic:
            text[7:9] = random.choices(["insulting", "insulter", "insultingly"], k=2)
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    df, lab = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels + [(10**6, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.learn(df, toxicity.training_labels(lab))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "insulted " * 30000), (1002, "insulted " * 30000)], DOC)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df.union(odd).withColumn("score", F.lit("clash")), machine).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels) and got[1002]["predicted"] == 1 and got[1000]["predicted"] == 0
    assert got[1000]["score"] == got[1001]["score"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score_toxicity(df.limit(0), machine).count() == 0
    none = toxicity.learn(df, lab.limit(0))
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, none).collect()} == {0}


# 9 ---------------------------------------------------------------------------------------------------------------------


def near_rows():
    random.seed(3)
    words = lambda n: [f"w{random.randint(0, 99999)}" for _ in range(n)]
    docs = []
    for _ in range(3):  # families that drift, so that links form chains
        base = words(120)
        for k in range(40):
            own = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3, 4, 5, 8])):
                own[random.randrange(len(own))] = f"x{random.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(own)))
            base = own if k % 10 == 0 else base
    shared = words(60)
    docs += [(len(docs) + k, " ".join(words(40) + shared + words(40))) for k in range(60)]
    docs += [(len(docs) + k, " ".join(words(random.randint(0, 80)))) for k in range(60)]
    n = len(docs)
    return docs + [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A  b"), (n + 4, "w " * 50000), (None, "q r s")]


def brute_components(docs):
    sets = {}
    for d, t in docs:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids, root = sorted(d for d in sets if d is not None), {}
    for d in ids:
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("block_docs", [256, 8])
def test_jaccard_join(spark, block_docs):
    docs = near_rows()
    df = spark.createDataFrame(docs, DOC).withColumn("component_id", F.lit("clash")).repartition(5)
    got = {d: (n, c) for d, n, c in rows(jaccard_join.near_duplicate_components(df, block_docs=block_docs), "doc_id", "n_shingles", "component_id")}
    assert got.pop(None) == (1, None)
    assert got == brute_components(docs)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.near_duplicate_components(spark.createDataFrame([], DOC)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], DOC)
    assert {r["component_id"] for r in jaccard_join.near_duplicate_components(twice).collect()} == {1}


def test_jaccard_join_keeps_links_of_repeated_ids(spark):
    rng = random.Random(8)
    w, v = ([f"{c}{rng.randrange(10**6)}" for _ in range(80)] for c in "wv")
    near = lambda t: " ".join(t[:-1] + ["z"])
    df = spark.createDataFrame([(1, " ".join(w)), (1, " ".join(v)), (2, near(w)), (3, near(v))], DOC)
    assert sorted(rows(jaccard_join.near_duplicate_components(df), "doc_id", "component_id")) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def brute_labels(sets, percent=80):
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= percent * (len(a) + len(sets[j]) - both) and root[i] != root[j]:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    return root


@pytest.mark.parametrize("size", [2, 40, 3000])
def test_one_region_is_joined_by_pivots_at_any_size(spark, size):
    # points that drift from a common base: chains of links, loners, nothing at distance 1
    rng = np.random.default_rng(size)
    base, sets = np.arange(1000, 1060), []
    for k in range(size):
        own = base.copy()
        at = rng.choice(60, rng.integers(0, 12), replace=False)
        own[at] = rng.integers(0, 900, len(at)) if size < 100 else 2000 + 60 * (k % 700) + at
        sets.append(np.unique(own))
        base = own if k % 50 == 0 else base
    want = np.array(brute_labels(sets)) if size < 100 else None
    links = jaccard_join.join_block(sets[:600], np.arange(len(sets[:600])), np.zeros(len(sets[:600]), int))
    if want is not None:
        got = np.arange(size)
        for a, b in links:
            got[got == max(got[a], got[b])] = min(got[a], got[b])
        assert got.tolist() == want.tolist()
    df = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sets)], "point long, shingles array<long>")
    cells = df.select(F.lit(7).cast("long").alias("cell"), "point", F.size("shingles").cast("long").alias("n"), F.lit(0).cast("long").alias("unshared"))
    named = {r["node"]: r["label"] for r in jaccard_join.join_cells(cells, df, docs=16 if size < 100 else 256).collect()}
    if want is None:  # brute force by an inverted matrix
        held = np.zeros((size, max(map(max, sets)) + 1), np.float32)
        for i, s in enumerate(sets):
            held[i, s] = 1
        n, root = held.sum(1), np.arange(size)
        for i in range(size):
            both = held[: i + 1] @ held[i]
            for j in np.flatnonzero(100 * both >= 80 * (n[i] + n[: i + 1] - both)):
                if root[i] != root[j]:
                    low, high = min(root[i], root[j]), max(root[i], root[j])
                    root[root == high] = low
        want = root
    assert [named.get(i, i) for i in range(size)] == list(want)


# 10 --------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    urls = ["https://A.example.COM/en/7?x#y", "http://example.com/en/6", "http://com/en/", "http://xcom/en/", "http://a.b.net/de/8", "http://example.net/de/81", "http://q.example.net/de/7", "ftp://x.org/es/#z", "http://x.org/es", "nothing", "", None, "http://a.com?/en/", "x://y://com/en/", "http://example.com/en/7"]
    want = ["allow", "block", "block", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    rules = ["example.com/en/7", "com/en/", "com/en/", None, "net/de/", "example.net/de/8", "net/de/", "org/es/", None, None, None, None, None, None, "example.com/en/7"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(df, url_filter.rules_table(spark)).collect()}
    assert [got[i]["verdict"] for i in range(len(urls))] == want and [got[i]["rule"] for i in range(len(urls))] == rules
    assert (got[0]["host"], got[0]["path"]) == ("a.example.com", "/en/7") and (got[11]["host"], got[11]["path"]) == ("", "")
    assert got[13]["host"] == "y:" and url_filter.judge(df, url_filter.rules_table(spark)).count() == len(urls) + 1
    assert url_filter.judge(df.limit(0), url_filter.rules_table(spark)).count() == 0
    tie = spark.createDataFrame([("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, tie).collect()}
    assert got[0] == "block" and got[8] == "block"
    assert {r["verdict"] for r in url_filter.judge(df, tie.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("name", ["_url", "_key", "_best", "_host", "_mark", "_doc", "_of", "_lost", "_pos", "_LINE", "_hash"])
def test_own_names_do_not_clash(spark, name):
    df = spark.createDataFrame([(1, "http://example.com/en/6", "a line of more than twenty characters", "k"), (2, None, None, "k")], f"doc_id long, url string, text string, `{name}` string")
    for out in (url_filter.judge(df, url_filter.rules_table(spark)), line_dedup.drop_repeated_lines(df)):
        assert {r[name] for r in out.collect()} == {"k"}
