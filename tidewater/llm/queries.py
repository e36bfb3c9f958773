"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, divergence, exact_dedup, exact_topk, html_extract, importance, jaccard_join, langid, line_dedup, mixing, toxicity, url_filter
from .common import fold_of, table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.fit_rates(docs).select("doc_id", "source", "domain_pred", "tokens", "rate", "copies", "residual")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    profiles = langid.learn_profiles(docs.where(fold_of(F.col("doc_id"), 4) != 2))
    return langid.predict_language(docs.select("doc_id", "text", held_out.alias("held_out")), profiles)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = bpe.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe_digests(docs)


def bpe_digests(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        bpe.sha256_of_ids(F.col("token_ids")).alias("ids_sha256"),
        F.sha2("decoded_text", 256).alias("decoded_sha256"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score_toxicity(docs.select("doc_id", "text", held_out.alias("held_out")), machine)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_source_mixing": op3_source_mixing,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_topk": op12_exact_topk,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        w AS (
          SELECT doc_id, text_sha256,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op7_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents),
        k AS (
          SELECT doc_id, line, pos,
                 translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM l),
        c AS (
          SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20
          GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (
          SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> c.holder, false) AS lost FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op10_url_filter": r"""
        WITH r(rule_host, rule_path, rule_verdict) AS (VALUES
          ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
          ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        p AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
          FROM pages),
        m AS (
          SELECT p.page_id, p.host, p.path, rule_host || rule_path AS rule, rule_verdict,
                 row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC) AS k
          FROM p LEFT JOIN r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE k = 1""",
    "op11_source_divergence": r"""
        WITH d AS (
          SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
          FROM documents),
        c AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 10),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
        n AS (SELECT lang, source, term, count(*) AS n FROM c SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
        g AS (
          SELECT d.lang, d.source, coalesce(any_value(s.total), 0) AS total, coalesce(any_value(l.v), 0) AS v
          FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS total FROM n GROUP BY 1, 2) s USING (lang, source)
          LEFT JOIN l ON l.lang = d.lang GROUP BY 1, 2),
        p AS (
          SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
                 CAST(1 + 1000000000::HUGEINT * (coalesce(n.n, 0) + 2) // (g.total + 2 * g.v) AS BIGINT) AS p,
                 CAST(1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS BIGINT) AS q
          FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
        pv AS (
          SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
        u AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank
        FROM u QUALIFY part = 'pair' OR rank <= 10""",
    "op12_exact_topk": r"""
        WITH e AS (
          SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
}
