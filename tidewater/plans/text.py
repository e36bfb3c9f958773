"""Text (N of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.series import own
from tidewater.operators import text as ops
from tidewater.sources import tables as t

from .registry import query, rounded


def docs(spark, sf_dir):
    return t.table(spark, sf_dir, "documents").select("doc_id", "text")


@query("n1_html_to_text", r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script)\b.*?</script\s*>|<(style)\b.*?</style\s*>', ' ', 'g') AS x FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(x, '(?i)</(p|div|h[1-6]|li|tr|article|section)\s*>|<br\s*/?>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM a),
    c AS (SELECT page_id, replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS x FROM b)
    SELECT page_id, sha256(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')) AS text_sha256 FROM c""")
def html_to_text(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", F.sha2(ops.html_to_text(F.col("html")), 256).alias("text_sha256"))


@query("n2_unfold", r"""SELECT doc_id, sha256(array_to_string([trim(regexp_replace(p, '\s*\n\s*', ' ', 'g'), ' ') FOR p IN regexp_split_to_array(text, '\n\s*\n')], chr(10) || chr(10))) AS text_sha256 FROM documents WHERE text IS NOT NULL""")
def unfold(spark, sf_dir):
    return docs(spark, sf_dir).where("text IS NOT NULL").select("doc_id", F.sha2(ops.unfold(F.col("text")), 256).alias("text_sha256"))


@query("n3_prose_filter", r"""WITH k AS (SELECT doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda p: length(p) >= 60 AND len(regexp_extract_all(p, '[.!?]')) * 220 >= length(p) AND len(regexp_extract_all(p, '\S+')) >= 12
      AND len(list_filter(regexp_extract_all(p, '\S+'), lambda w: length(w) <= 3)) >= 0.12 * len(regexp_extract_all(p, '\S+'))), chr(10)) AS kept FROM documents)
    SELECT doc_id, length(text) AS before, CASE WHEN length(kept) > 200 THEN length(kept) ELSE length(text) END AS after, sha256(CASE WHEN length(kept) > 200 THEN kept ELSE text END) AS text_sha256 FROM k""")
def prose_filter(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.length("text").alias("before"), F.length(ops.prose(F.col("text"))).alias("after"), F.sha2(ops.prose(F.col("text")), 256).alias("text_sha256"))


@query("n4_chunks")
def chunk_texts(spark, sf_dir):
    return ops.chunks(docs(spark, sf_dir)).select("doc_id", "ordinal", "char_from", "char_to", "page", "n_chars", "anchor")


@query("n5_usable_texts", r"""SELECT doc_id, length(text) >= 120 AND len(regexp_extract_all(text, '[0-9]')) <= 0.18 * length(text) AND len(regexp_extract_all(text, '\[[0-9]+\]')) * 100 <= length(text)
    AND len(regexp_extract_all(text, '\b(?:19|20)[0-9]{2}\b')) * 80 <= length(text) AS usable FROM documents""")
def usable_texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", ops.usable(F.col("text")).alias("usable"))


@query("n6_to_embed")
def to_embed(spark, sf_dir):
    now = ops.chunks(docs(spark, sf_dir)).withColumn("hash", ops.identity("v1", F.col("doc_id"), F.col("ordinal"), F.col("text")))
    before = now.where("n_chars >= 1000")
    return ops.to_embed(now, before).select("doc_id", "ordinal", "hash")


@query("n7_changed_sources", "SELECT d.doc_id, sha256(d.text) AS hash FROM documents d WHERE sha256(d.text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def changed_sources(spark, sf_dir):
    own = t.table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    known = own.where("lang = 'en'").select("hash").distinct()
    return own.join(known, "hash", "left_anti").select("doc_id", "hash")


@query("n8_new_urls", "SELECT lower(url) AS url, min(page_id) AS page_id FROM pages WHERE lower(url) NOT IN (SELECT lower(url) FROM pages WHERE url LIKE 'https%') GROUP BY 1")
def new_urls(spark, sf_dir):
    own = t.table(spark, sf_dir, "pages").select("page_id", F.lower("url").alias("url"))
    known = own.where("url LIKE 'https%'").select("url").distinct()
    return own.join(known, "url", "left_anti").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("n9_orphans", "SELECT coalesce(d.doc_id, v.vec_id) AS id, CASE WHEN d.doc_id IS NULL THEN 'vector' ELSE 'text' END AS kind FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON d.doc_id = v.vec_id WHERE d.doc_id IS NULL OR v.vec_id IS NULL")
def orphans(spark, sf_dir):
    d, v = docs(spark, sf_dir).select("doc_id").distinct(), t.table(spark, sf_dir, "embeddings").select("vec_id").distinct()
    both = d.join(v, F.col("doc_id") == F.col("vec_id"), "full_outer").where("doc_id IS NULL OR vec_id IS NULL")
    return both.select(F.coalesce("doc_id", "vec_id").alias("id"), F.when(F.col("doc_id").isNull(), "vector").otherwise("text").alias("kind"))


@query("n10_semantic_search", """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), m AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) AS c FROM embeddings JOIN q ON vec_id <> query_id)
    SELECT query_id, vec_id, rank, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank FROM m) WHERE rank <= 5""")
def semantic_search(spark, sf_dir):
    own = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return rounded(ops.top_similar(own.where("vec_id % 50 = 0"), own, 5))


def lexicon(spark):
    return spark.createDataFrame(list(ops.LEXICON.items()), "token string, weight double")


LEX = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in ops.LEXICON.items())
NEG = ", ".join(f"'{w}'" for w in ops.NEGATIONS)
MOOD = rf"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{Nd}}\-'']+'), lambda x: length(x) > 1) AS w FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, w, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM w),
    h AS (SELECT doc_id, CASE WHEN list_has_any(w[greatest(1, p - 3):p - 1], [{NEG}]) THEN -weight ELSE weight END AS v FROM k JOIN (VALUES {LEX}) l(token, weight) USING (token)),
    mo AS (SELECT doc_id, greatest(-1, least(1, avg(v))) AS mood, count(*) AS hits FROM h GROUP BY 1)"""


@query("n11_lexicon_sentiment", f"WITH {MOOD} SELECT doc_id, round(mood, 6) AS mood, hits FROM mo")
def lexicon_sentiment(spark, sf_dir):
    return rounded(ops.sentiment(docs(spark, sf_dir), lexicon(spark)))


@query("n12_decayed_sentiment", f"WITH {MOOD}, s AS (SELECT source AS asset, mood, (SELECT max(doc_id) FROM documents) - doc_id AS age_h FROM mo JOIN documents USING (doc_id)) SELECT asset, round(sum(mood * pow(0.5, age_h / 24)) / sum(pow(0.5, age_h / 24)), 6) AS mood, count(*) AS texts FROM s GROUP BY 1")
def decayed_sentiment(spark, sf_dir):
    own = t.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    newest = own.agg(F.max("doc_id").alias("_m"))
    moods = ops.sentiment(own, lexicon(spark)).join(own.select("doc_id", F.col("source").alias("asset")), "doc_id").join(F.broadcast(newest))
    return rounded(ops.decayed(moods.withColumn("age_h", F.col("_m") - F.col("doc_id"))))


MARK = ", ".join(f"('{w}', '{k}')" for k, ws in ops.MARKERS.items() for w in ws)


CALIB = f"""WITH {t.DAILY_SQL}, {MOOD}, sm AS (SELECT (doc_id // 25) % 1000 + 1 AS rn, doc_id % 25 + 1 AS place, avg(mood) AS s FROM mo GROUP BY 1, 2), ab AS (SELECT asset, row_number() OVER (ORDER BY asset) AS place FROM (SELECT DISTINCT asset FROM bars)),
    bh AS (SELECT asset, row_number() OVER w AS rn, unnest([struct_pack(h := 1, r := ln(lead(close, 1) OVER w / close)), struct_pack(h := 5, r := ln(lead(close, 5) OVER w / close)), struct_pack(h := 20, r := ln(lead(close, 20) OVER w / close))]) AS y FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY asset ORDER BY ts)),
    pr AS (SELECT y.h AS h, s, y.r AS r FROM sm JOIN ab USING (place) JOIN bh ON bh.asset = ab.asset AND bh.rn = sm.rn WHERE y.r IS NOT NULL), c AS (SELECT h, count(*) AS n, coalesce(CASE WHEN stddev_pop(s) > 1e-12 THEN corr(s, r) END, 0) AS r, coalesce(CASE WHEN stddev_pop(s) > 1e-12 THEN regr_slope(r, s) END, 0) AS slope, 2 / sqrt(count(*)) AS threshold FROM pr GROUP BY 1)"""


@query("n14_semantic_calibration", f"""{CALIB} SELECT h, n, round(CASE WHEN n >= 30 THEN r ELSE 0 END, 6) AS r, round(CASE WHEN n >= 30 AND abs(r) > threshold THEN slope ELSE 0 END, 6) AS slope, round(CASE WHEN n >= 30 THEN threshold ELSE 0 END, 6) AS threshold,
    round(CASE WHEN n >= 30 THEN least(1, greatest(0, (abs(r) - threshold) / 0.1)) ELSE 0 END, 6) AS skill FROM c""")
def semantic_calibration(spark, sf_dir):
    return rounded(calibrated(spark, sf_dir))


def calibrated(spark, sf_dir):
    """Texts stand for the news of an asset's day: the asset and the day's number follow from doc_id."""
    moods = ops.sentiment(docs(spark, sf_dir), lexicon(spark))
    moods = moods.groupBy((F.floor(F.col("doc_id") / 25) % 1000 + 1).alias("rn"), (F.col("doc_id") % 25 + 1).alias("place")).agg(F.avg("mood").alias("s"))
    bars = t.bars(spark, sf_dir).where("close > 0")
    places = bars.select("asset").distinct().withColumn("place", F.row_number().over(Window.orderBy("asset")))
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.ln(F.lead("close", h).over(own()) / F.col("close")).alias("r")) for h in (1, 5, 20)])
    rows = bars.select("asset", F.row_number().over(own()).alias("rn"), ahead.alias("_a")).select("asset", "rn", F.explode("_a").alias("_y")).select("asset", "rn", "_y.h", "_y.r")
    return ops.calibration(moods.join(places, "place").join(rows.where("r IS NOT NULL"), ["asset", "rn"]))


@query("n15_language_markers", rf"""WITH k AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS token FROM documents), c AS (SELECT doc_id, lang, count(*) AS n FROM k JOIN (VALUES {MARK}) m(token, lang) USING (token) GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER w AS q, coalesce(lead(n) OVER w, 0) AS s FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY n DESC, lang))
    SELECT d.doc_id, CASE WHEN n >= 3 AND n >= 2 * s THEN b.lang END AS detected FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND q = 1""")
def language_markers(spark, sf_dir):
    markers = spark.createDataFrame([(w, k) for k, ws in ops.MARKERS.items() for w in ws], "token string, lang string")
    return ops.detect_language(docs(spark, sf_dir), markers)


STOP = ", ".join(f"'{w}'" for w in ops.NAME_STOP)


@query("n13_entity_links", rf"""WITH k AS (SELECT DISTINCT doc_id, trim(unnest(regexp_split_to_array(lower(text), '[ 
	,;:()"'']+')), '.-') AS token FROM documents),
    na AS (SELECT item_id AS asset, lower('item-' || item_id || '.X') AS symbol, lower(trim(split_part(ltrim(text), ' ', 1), ',.')) AS first FROM benchmark),
    e AS (SELECT asset, symbol AS token FROM na UNION SELECT asset, split_part(split_part(symbol, '-', 1), '.', 1) FROM na WHERE length(split_part(split_part(symbol, '-', 1), '.', 1)) >= 3 UNION SELECT asset, first FROM na WHERE length(first) >= 4 AND first NOT IN ({STOP})),
    m AS (SELECT DISTINCT asset, doc_id FROM k JOIN e USING (token)) SELECT asset, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY doc_id DESC) AS q FROM m) WHERE q <= 60""")
def entity_links(spark, sf_dir):
    """Items of the benchmark stand for assets: a made-up symbol, the text for the name."""
    names = t.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("asset"), F.concat(F.lit("item-"), "item_id", F.lit(".X")).alias("symbol"), F.col("text").alias("name"))
    return ops.linked(docs(spark, sf_dir), ops.name_keys(names), 60)


@query("n16_newest_unique", "SELECT title, doc_id FROM (SELECT split_part(text, chr(10), 1) AS title, max(doc_id) AS doc_id FROM documents GROUP BY 1) ORDER BY doc_id DESC LIMIT 12")
def newest_unique(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    return own.groupBy("title").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("doc_id")).limit(12)


@query("n17_log_search", "SELECT conv_id, turn, role FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id, turn, role LIMIT 50 OFFSET 50")
def log_search(spark, sf_dir):
    return t.table(spark, sf_dir, "conversations").where(F.lower("text").contains("the")).orderBy("conv_id", "turn", "role").offset(50).limit(50).select("conv_id", "turn", "role")
