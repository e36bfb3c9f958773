"""Texts: HTML to text, prose, chunks, sentiment, links to assets, similarity search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import clamp, correlation, slope

from .nearest import top_products

# The words of the sentiment lexicon with their weights, the negations, and marker words of languages.
POSITIVE = {
    "rekord": 1.0, "rekordhoch": 1.0, "allzeithoch": 1.0, "durchbruch": 0.9, "rallye": 0.9, "hausse": 0.9, "gewinnsprung": 0.9, "übernahmeangebot": 0.8, "uebernahmeangebot": 0.8,
    "steigt": 0.6, "steigen": 0.6, "stieg": 0.6, "gestiegen": 0.6, "zulegen": 0.6, "zulegt": 0.6, "klettert": 0.7, "erholung": 0.6, "erholt": 0.6, "aufschwung": 0.7, "aufwärtstrend": 0.7,
    "gewinn": 0.5, "gewinne": 0.5, "überschuss": 0.5, "optimistisch": 0.6, "zuversichtlich": 0.6, "hochgestuft": 0.8, "kaufempfehlung": 0.8, "übergewichten": 0.7, "anhebung": 0.6,
    "angehoben": 0.6, "übertrifft": 0.8, "uebertrifft": 0.8, "stark": 0.4, "robust": 0.5, "wachstum": 0.5, "expansion": 0.5, "dividendenerhöhung": 0.7,
    "record": 1.0, "surge": 0.9, "surges": 0.9, "soar": 0.9, "soars": 0.9, "rally": 0.9, "rallies": 0.9, "breakout": 0.8, "bullish": 0.9, "jumps": 0.7, "jumped": 0.7, "climbs": 0.7,
    "gains": 0.6, "rises": 0.6, "rose": 0.6, "higher": 0.4, "advance": 0.5, "upgrade": 0.8, "upgraded": 0.8, "outperform": 0.7, "overweight": 0.6, "beats": 0.8, "strong": 0.4,
    "growth": 0.5, "profit": 0.5, "buyback": 0.6, "approval": 0.5, "partnership": 0.4, "adoption": 0.5, "inflow": 0.5, "inflows": 0.5,
}
NEGATIVE = {
    "insolvenz": 1.0, "pleite": 1.0, "crash": 1.0, "absturz": 1.0, "einbruch": 0.9, "talfahrt": 0.9, "baisse": 0.9, "ausverkauf": 0.8, "fällt": 0.6, "faellt": 0.6, "fallen": 0.6, "fiel": 0.6,
    "sinkt": 0.6, "sinken": 0.6, "verliert": 0.6, "verluste": 0.6, "nachgeben": 0.5, "rutscht": 0.7, "abwärtstrend": 0.7, "gewinnwarnung": 1.0, "gesenkt": 0.6, "herabgestuft": 0.8,
    "verkaufsempfehlung": 0.8, "untergewichten": 0.7, "verfehlt": 0.8, "enttäuscht": 0.7, "ermittlungen": 0.7, "klage": 0.6, "strafe": 0.6, "skandal": 0.8, "rezession": 0.8, "krise": 0.7,
    "schwach": 0.4, "stellenabbau": 0.6, "hack": 0.8, "gehackt": 0.9, "betrug": 0.9,
    "bankruptcy": 1.0, "insolvency": 1.0, "plunge": 0.9, "plunges": 0.9, "slump": 0.8, "slumps": 0.8, "tumble": 0.8, "tumbles": 0.8, "selloff": 0.8, "sell-off": 0.8, "bearish": 0.9,
    "falls": 0.6, "fell": 0.6, "drops": 0.6, "declines": 0.6, "slides": 0.6, "lower": 0.4, "losses": 0.6, "loss": 0.5, "downgrade": 0.8, "downgraded": 0.8, "underperform": 0.7,
    "misses": 0.8, "weak": 0.4, "recession": 0.8, "crisis": 0.7, "lawsuit": 0.6, "probe": 0.6, "investigation": 0.7, "fraud": 0.9, "hacked": 0.9, "exploit": 0.8, "outflow": 0.5,
    "outflows": 0.5, "layoffs": 0.6, "halted": 0.7, "delisting": 0.9,
}
NEGATIONS = ["kein", "keine", "keinen", "keiner", "nicht", "nie", "ohne", "kaum", "no", "not", "never", "without", "fails", "failed", "unlikely", "denies"]
# Words of praise and abuse that no market report holds, for texts of other kinds.
PLAIN = {"good": 1.0, "great": 1.0, "gain": 0.6, "rise": 0.6, "bad": -1.0, "fall": -0.6, "worthless": -1.0, "stupid": -1.0, "trash": -1.0, "pathetic": -1.0}
LEXICON = POSITIVE | {w: -v for w, v in NEGATIVE.items()} | PLAIN
# First words of names that stand for no single asset.
NAME_STOP = [
    "the", "first", "global", "international", "national", "united", "american", "group", "holding", "holdings", "corp", "corporation", "company", "inc", "bank", "banco", "banca", "industries",
    "technologies", "systems", "solutions", "capital", "financial", "energy", "motors", "pharmaceuticals", "partners", "trust", "index", "fund", "etf", "shares", "vanguard", "ishares", "spdr",
]
MARKERS = {"en": ["the", "and", "of", "is", "that", "with"], "de": ["der", "die", "und", "nicht", "von", "ist"], "fr": ["le", "la", "les", "et", "que", "des"], "es": ["el", "los", "que", "una", "por", "con"]}


def html_to_text(page: Column) -> Column:
    """Script and style dropped, block ends as line ends, tags stripped, blanks collapsed, the commonest entities decoded."""
    text = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)</(p|div|h[1-6]|li|tr|article|section)\s*>|<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")


def unfold(text: Column) -> Column:
    """Lines joined to paragraphs; empty lines part them."""
    paragraphs = F.split(text, r"\n\s*\n")
    return F.array_join(F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), "\n\n")


def is_prose(paragraph: Column) -> Column:
    """Long enough, with sentence ends, enough words and enough short ones."""
    n = F.length(paragraph)
    words, short = F.regexp_count(paragraph, F.lit(r"\S+")), F.regexp_count(paragraph, F.lit(r"(?<!\S)\S{1,3}(?!\S)"))
    return (n >= 60) & (F.regexp_count(paragraph, F.lit(r"[.!?]")) * 220 >= n) & (words >= 12) & (short >= 0.12 * words)


def prose(text: Column) -> Column:
    """The paragraphs that are prose; the whole text if 200 characters or fewer are left."""
    kept = F.array_join(F.filter(F.split(text, "\n"), is_prose), "\n")
    return F.when(F.length(kept) > 200, kept).otherwise(text)


def chunks(docs: DataFrame, target: int = 1400, overlap: int = 200, least: int = 100) -> DataFrame:
    """doc_id, ordinal, char_from, char_to, page, text, n_chars, anchor: paragraphs put together up to a target length, the tail of each chunk starting the
    next; paragraphs of over twice the target are cut hard.

    A chunk is a span of the text without its NUL characters, from char_from (counted from 0) up to before char_to. The fold over paragraphs carries only
    offsets; texts are cut once, at the end. page counts the form feeds before a chunk, from 1."""
    clean = F.replace(F.col("text"), F.lit("\x00"), F.lit(""))
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.ceil(F.length(p) / target).cast("int") - 1), lambda k: F.struct((k == 0).alias("starts"), F.least(F.lit(target), F.length(p) - k * target).alias("n")))
    whole = lambda p: F.array(F.struct(F.lit(True).alias("starts"), F.length(p).alias("n")))
    pieces = F.flatten(F.transform(F.split(F.col("_clean"), "\n"), lambda p: F.when(F.length(p) > 2 * target, cut(p)).otherwise(whole(p))))
    span = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    # a piece that starts a paragraph stands behind a line end; the first one stands at -1 + 1
    start = F.struct(F.lit(0).alias("a"), F.lit(-1).alias("end"), F.lit(False).alias("open"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))

    def step(state: Column, piece: Column) -> Column:
        held = F.when(state["open"], state["end"] - state["a"]).otherwise(0)
        at = state["end"] + piece["starts"].cast("int")
        end = at + piece["n"]
        full = (held > 0) & (held + piece["n"] + 1 > target)
        begin = F.when(full, F.when(piece["n"] >= target, at).otherwise(state["end"] - F.least(F.lit(overlap), held))).when(held > 0, state["a"]).otherwise(at)
        return F.struct(begin.alias("a"), end.alias("end"), F.lit(True).alias("open"), F.when(full, F.concat(state["done"], F.array(span(state["a"], state["end"])))).otherwise(state["done"]).alias("done"))

    folded = F.aggregate(pieces, start, step, lambda s: F.concat(s["done"], F.array(span(s["a"], s["end"]))))
    rows = docs.where("text IS NOT NULL").select("doc_id", clean.alias("_clean"))
    rows = rows.select("doc_id", "_clean", F.posexplode(F.filter(folded, lambda c: c["b"] - c["a"] >= least)).alias("ordinal", "_c"))
    rows = rows.select("doc_id", "ordinal", F.col("_c.a").alias("char_from"), F.col("_c.b").alias("char_to"), "_clean", F.expr("substring(_clean, _c.a + 1, _c.b - _c.a)").alias("text"))
    page = F.regexp_count(F.expr("left(_clean, char_from)"), F.lit("\f")) + 1
    return rows.select("doc_id", "ordinal", "char_from", "char_to", page.alias("page"), "text", (F.col("char_to") - F.col("char_from")).alias("n_chars"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ").alias("anchor"))


def usable(text: Column) -> Column:
    """Long enough, not mostly digits, no list of citations or years."""
    n = F.length(text)
    return (n >= 120) & (F.regexp_count(text, F.lit(r"[0-9]")) <= 0.18 * n) & (F.regexp_count(text, F.lit(r"\[[0-9]+\]")) * 100 <= n) & (F.regexp_count(text, F.lit(r"\b(?:19|20)[0-9]{2}\b")) * 80 <= n)


def identity(version: str, source: Column, ordinal: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), source.cast("string"), ordinal.cast("string"), text), 256)


def to_embed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Chunks whose identity isn't known at their place yet."""
    return now.join(before.select("doc_id", "ordinal", "hash"), ["doc_id", "ordinal", "hash"], "left_anti")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, token, and whether one of the three tokens before negates."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}\-']+"), lambda w: F.length(w) > 1)
    rows = docs.where("text IS NOT NULL").select("doc_id", words.alias("_w"))
    negated = F.arrays_overlap(F.slice("_w", F.greatest(F.lit(1), F.col("_pos") - 2), F.least(F.col("_pos"), F.lit(3))), F.array(*map(F.lit, NEGATIONS)))
    each = rows.select("doc_id", "_w", F.posexplode("_w").alias("_pos", "token"))
    return each.select("doc_id", F.col("_pos").alias("pos"), "token", F.when(F.col("_pos") == 0, F.lit(False)).otherwise(negated).alias("negated"))


def sentiment(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean weight of a text's lexicon words, negated ones turned, within -1 and 1, and how many there are."""
    hits = tokens(docs).join(lexicon, "token").withColumn("_v", F.when(F.col("negated"), -F.col("weight")).otherwise(F.col("weight")))
    return hits.groupBy("doc_id").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.avg("_v"))).alias("mood"), F.count(F.lit(1)).alias("hits"))


def decayed(scores: DataFrame, half_life_h: float = 24.0) -> DataFrame:
    """Weighted mean mood of each asset, older texts counting less by half every so many hours. scores: asset, age_h, mood."""
    w = F.pow(F.lit(0.5), F.col("age_h") / half_life_h)
    return scores.groupBy("asset").agg((F.sum(F.col("mood") * w) / F.sum(w)).alias("mood"), F.count(F.lit(1)).alias("texts"))


def calibration(pairs: DataFrame, least: int = 30) -> DataFrame:
    """h, n, r, slope, threshold, skill: whether moods (s) tell the return after (r) at each horizon. The threshold is what
    chance reaches, 2 / sqrt(n); skill grows only beyond it, and below it the slope counts as 0. Fewer than ``least`` pairs give zeros."""
    own_ = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), correlation("s", "r", 1).alias("_r"), slope("r", "s", 1).alias("_b"))
    enough, bar, size = F.col("n") >= least, 2 / F.sqrt("n"), F.abs("_r")
    return own_.select(
        "h", "n", F.when(enough, F.col("_r")).otherwise(0.0).alias("r"), F.when(enough & (size > bar), F.col("_b")).otherwise(0.0).alias("slope"), F.when(enough, bar).otherwise(0.0).alias("threshold"),
        F.when(enough, clamp((size - bar) / 0.1, 0.0, 1.0)).otherwise(0.0).alias("skill"),
    )


def name_keys(assets: DataFrame) -> DataFrame:
    """asset, token: by what words an asset (asset, symbol, name) is known: its symbol, the symbol's part before - or . if three characters or more, and the first word
    of its name if four or more and no common one."""
    symbol, first = F.lower("symbol"), F.lower(F.btrim(F.substring_index(F.ltrim("name"), " ", 1), F.lit(",.")))
    short = F.substring_index(F.substring_index(symbol, "-", 1), ".", 1)
    keys = F.array_compact(F.array(symbol, F.when(F.length(short) >= 3, short), F.when((F.length(first) >= 4) & ~first.isin(NAME_STOP), first)))
    return assets.select("asset", F.explode(F.array_distinct(keys)).alias("token"))


def linked(docs: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """asset, doc_id: the ``most`` newest texts that name an asset, each text once."""
    words = F.array_distinct(F.transform(F.split(F.lower("text"), "[ \\n\\r\\t,;:()\"']+"), lambda w: F.btrim(w, F.lit(".-"))))
    met = docs.select("doc_id", F.explode(words).alias("token")).join(keys, "token").select("asset", "doc_id").distinct()
    return met.withColumn("_q", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("doc_id")))).where(F.col("_q") <= most).select("asset", "doc_id")


def detect_language(docs: DataFrame, markers: DataFrame) -> DataFrame:
    """The language with most marker words, if three at least and twice those of the next; else null. markers: token, lang."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    rows = docs.select("doc_id", F.explode(words).alias("token")).groupBy("doc_id", "token").count()
    counts = rows.join(markers, "token").groupBy("doc_id", "lang").agg(F.sum("count").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "lang")
    best = counts.withColumn("_k", F.row_number().over(order)).withColumn("_second", F.coalesce(F.lead("n").over(order), F.lit(0))).where("_k = 1")
    found = best.select("doc_id", F.when((F.col("n") >= 3) & (F.col("n") >= 2 * F.col("_second")), F.col("lang")).alias("detected"))
    return docs.select("doc_id").join(found, "doc_id", "left")


def top_similar(queries: DataFrame, rows: DataFrame, top: int) -> DataFrame:
    """query_id, rank, vec_id, cosine of the most similar rows; queries and rows: vec_id, embedding. Vectors without a direction take no part."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))

    def unit(df: DataFrame, name: str) -> DataFrame:
        sized = df.select(F.col("vec_id").alias(name), "embedding", norm.alias("_n")).where(F.col("_n") > 0)
        return sized.select(name, F.transform("embedding", lambda v: v.cast("double") / F.col("_n")).alias("vector"))

    apart = lambda rows, q: (rows["vec_id"] != q.query_id).to_numpy()
    found = top_products(unit(queries, "query_id"), unit(rows, "vec_id"), top, ["vec_id"], apart)
    return found.select("query_id", "vec_id", "rank", F.col("r").alias("cosine"))
