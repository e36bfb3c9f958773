"""Mixing sources to target weights with soft membership.

A naive Bayes classifier learns from a bounded sample of rows that name their domain how hashed words are spread over
the domains. It then gives every document a posterior over the domains from its text alone; a declared domain is an
answer to learn from and never an input. The posteriors are calibrated: a factor for each domain brings its expected
tokens to those that rows declare, as otherwise the fit would correct the classifier and not the mixture. Rates are then
fitted to the documents: the expected tokens of a domain are the sum of rate x tokens x posterior, and nonnegative rates
are sought that bring them to the targets, by projected-gradient least squares. An iteration is one aggregate over the documents: only a residual for each domain
comes to the driver, and a document's rate follows from its posterior and the steps so far.

All of it is DataFrame expressions and Spark's own feature hashing and naive Bayes; no Python runs on the executors.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass

from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, discard, free_names, staged

#: Hash buckets of words; weight of a text's words against the prior, over the root of their number; labelled rows learned from, about, of
#: each domain; every how-manyth of these, by a hash of its id, is held out to measure the accuracy.
BUCKETS, EVIDENCE, PER_DOMAIN, HELD_OUT = 1 << 14, 4.0, 500, 5
#: Pseudo-counts of each bucket; largest relative deviation of a domain's expected from its declared tokens after calibration,
#: and its rounds at most.
SMOOTHING, CALIBRATED, ROUNDS = 1.0, 0.01, 30
#: Largest relative residual that ends the fit. It also ends when so many iterations haven't lessened the least by this share.
TOLERANCE, PATIENCE, PROGRESS = 1e-3, 20, 0.02
#: Exponent that flattens the domains' own shares into default targets.
FLATTEN = 0.7
LOG = logging.getLogger(__name__)
WHITE_RUN = r"[\x20\x09-\x0D]+"
ADDED = ("tokens", "domain_pred", "posterior", "rate", "copies", "residual")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RUN), lambda w: w != "")


def literal(values: list[float]) -> Column:
    """Numbers as one constant: a parsed literal stays small in the plan."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def draw_of(salt: str, *columns: str) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def flattened(sizes: dict[str, int], flatten: float = FLATTEN) -> dict[str, float]:
    """Target weights: each domain's share of the tokens to the power flatten, normalised."""
    powers = {k: float(n) ** flatten for k, n in sorted(sizes.items()) if n > 0}
    return {k: v / sum(powers.values()) for k, v in powers.items()}


def with_each(values: Column, one: Column, k: int, f) -> Column:
    """f of each of k values and one number, which is found once and not for each of them."""
    return F.zip_with(values, F.array_repeat(one, k), f)


def normalised(values: Column, k: int) -> Column:
    return with_each(values, F.aggregate(values, F.lit(0.0), lambda a, b: a + b), k, lambda v, total: v / total)


@dataclass
class Classifier:
    """domains in ascending order, their log priors, and Spark's model; none is needed for a single domain."""

    domains: list[str]
    priors: list[float]
    model: NaiveBayesModel | None
    buckets: int
    accuracy: float | None

    def posterior(self, rows: DataFrame, words: Column, keep: list[str]) -> DataFrame:
        """keep, tokens and posterior (array<double>, in the order of domains) of rows; texts without words get the priors."""
        if self.model is None:
            return rows.select(*keep, F.size(words).cast("long").alias("tokens"), F.array(F.lit(1.0)).alias("posterior"))
        w, x, r = free_names(rows.columns, "words", "vector", "scores")
        hashed = HashingTF(numFeatures=self.buckets, binary=True, inputCol=w, outputCol=x).transform(rows.withColumn(w, words))
        raw = self.model.setFeaturesCol(x).setPredictionCol("").setProbabilityCol("").setRawPredictionCol(r).transform(hashed)
        # words are not independent: their summed log likelihood grows with the root of their number only
        evidence = F.zip_with(vector_to_array(r), literal(list(self.model.pi.toArray())), lambda s, p: s - p)
        scale = F.lit(EVIDENCE) / F.sqrt(F.greatest(F.size(F.array_distinct(F.col(w))), F.lit(1)))
        scores = F.zip_with(with_each(evidence, scale, len(self.domains), lambda s, f: s * f), literal(self.priors), lambda s, p: s + p)
        placed = raw.select(*keep, F.size(w).cast("long").alias("tokens"), scores.alias("posterior"))
        placed = placed.withColumn("posterior", with_each(F.col("posterior"), F.array_max("posterior"), len(self.domains), lambda s, top: F.exp(s - top)))
        return placed.withColumn("posterior", normalised(F.col("posterior"), len(self.domains)))


def learn_classifier(docs: DataFrame, domain: str, per_domain: int = PER_DOMAIN, buckets: int = BUCKETS) -> Classifier:
    """The classifier for texts by the domains that rows declare; rows without words teach nothing.

    It learns from about per_domain rows of each domain, picked by a hash of doc_id and text: what comes to the driver is a
    count for each domain and a number for each domain and bucket. accuracy is that on a held-out part of the sample.
    """
    named = docs.where(F.col(domain).isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col(domain).cast("string").alias("domain"), "text", F.xxhash64("doc_id", "text").alias("id"))
    counts = {r[0]: r[1] for r in named.groupBy("domain").count().collect()}
    domains = sorted(counts)
    priors = [math.log(counts[d] / sum(counts.values())) for d in domains]
    if len(domains) < 2:
        return Classifier(domains, priors, None, buckets, None)
    label = (F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1).cast("double").alias("label")
    sample = staged(bounded_sample(named, "domain", "id", per_domain).select("id", label, words_of(F.col("text")).alias("words")), "labelled")
    hashed = HashingTF(numFeatures=buckets, binary=True, inputCol="words", outputCol="features").transform(sample)
    rest = F.pmod(F.xxhash64(F.lit("held out"), "id"), F.lit(HELD_OUT))
    part = NaiveBayes(smoothing=SMOOTHING).fit(hashed.where((rest != 0)))
    tested = part.transform(hashed.where(rest == 0)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    LOG.info("domains told apart from text, held-out accuracy: %s", tested)
    model = NaiveBayes(smoothing=SMOOTHING).fit(hashed)
    discard(sample)
    return Classifier(domains, priors, model, buckets, tested)


def reweighed(posterior: Column, factors: list[float]) -> Column:
    """The posterior times a factor for each domain, normalised again."""
    return normalised(F.zip_with(posterior, literal(factors), lambda p, f: p * f), len(factors))


def spread(placed: DataFrame, k: int) -> DataFrame:
    """tokens, and the posterior as a column for each domain: cheaper to read in every iteration than an array."""
    return placed.select("tokens", *[F.get("posterior", F.lit(d)).alias(f"p{d}") for d in range(k)])


def calibrate(placed: DataFrame, sizes: list[int]) -> list[float]:
    """The factors that bring each domain's expected share of the tokens to its share of sizes; placed has tokens and p0, p1, ..."""
    factors, all_, k = [1.0] * len(sizes), sum(sizes), len(sizes)
    for _ in range(ROUNDS if all_ else 0):
        total = sum((F.col(f"p{d}") * F.lit(f) for d, f in enumerate(factors)), F.lit(0.0))
        weighed = placed.select((F.col("tokens") / total).alias("w"), *[f"p{d}" for d in range(k)])
        got = [f * (g or 0.0) for f, g in zip(factors, weighed.agg(*[F.sum(F.col("w") * F.col(f"p{d}")) for d in range(k)]).first(), strict=True)]
        ratios = [n / all_ / (g / sum(got)) if n > 0 and g > 0 else 1.0 for n, g in zip(sizes, got, strict=True)]
        factors = [f * r for f, r in zip(factors, ratios, strict=True)]
        if max(abs(r - 1) for r in ratios) <= CALIBRATED:
            break
    top = max(factors, default=1.0)
    return [f / top for f in factors]


def rate_at(each: list[Column], steps: list[float]) -> Column:
    """The rate after the steps taken so far, summed by domain, projected onto what isn't negative; each: the posteriors."""
    moved = F.lit(1.0)
    for p, step in zip(each, steps, strict=True):
        moved = moved - p * F.lit(step)
    return F.greatest(F.lit(0.0), moved)


def expected(placed: DataFrame, steps: list[float]) -> list[float]:
    """The domains' expected tokens at these steps; placed has tokens and p0, p1, ..."""
    each = [F.col(f"p{d}") for d in range(len(steps))]
    weighed = placed.select((rate_at(each, steps) * F.col("tokens")).alias("w"), *each)
    return [x or 0.0 for x in weighed.agg(*[F.sum(F.col("w") * p) for p in each]).first()]


def fit(placed: DataFrame, weights: list[float], budget: float | None = None, iterations: int | None = None, tolerance: float = TOLERANCE) -> tuple[list[float], list[float]]:
    """The summed gradient steps that left the least residual, and each domain's relative one; placed has tokens and p0, p1, ...

    budget: the tokens that the targets share out; by default as many as need no document twice if domains were told
    apart without doubt. The residuals are weighed by the domains' own expected tokens. Rates start at 1 and are projected
    from the sum of all steps, so of all rates that meet the targets the fit tends to those nearest 1. The length of a
    step is that of Barzilai and Borwein: the last move by what it did to the gradient. Without a bound on iterations
    the fit goes on as long as the residual lessens; targets out of reach leave one that is given back.
    """
    k = len(weights)
    own = expected(placed, [0.0] * k)
    if budget is None:
        budget = min((own[d] / weights[d] for d in range(k) if weights[d] > 0), default=0.0)
    best, last, mark, done = ([0.0] * k, [0.0] * k), math.inf, math.inf, 0
    if budget <= 0:
        return best
    targets = [w * budget for w in weights]
    steps, got, before = [0.0] * k, own, None
    while True:
        off = [(g - t) / t if t > 0 else 0.0 for g, t in zip(got, targets, strict=True)]
        worst = max(map(abs, off))
        if worst < last:
            best, last = (steps, off), worst
        if worst <= tolerance or done == iterations:
            return best
        done += 1
        if done % PATIENCE == 0:
            if last > mark * (1 - PROGRESS):
                return best
            mark = last
        pull = [(g - t) / o if o > 0 else 0.0 for g, t, o in zip(got, targets, own, strict=True)]
        length = 1.0
        if before:
            moved, turned = [s - q for s, q in zip(steps, before[0], strict=True)], [q - p for p, q in zip(pull, before[1], strict=True)]
            along = sum(m * t for m, t in zip(moved, turned, strict=True))
            length = sum(m * m for m in moved) / along if along > 0 else 1.0
        before = (steps, pull)
        steps = [s + length * p for s, p in zip(steps, pull, strict=True)]
        got = expected(placed, steps)


def fit_rates(docs: DataFrame, targets: dict[str, float] | None = None, domain: str = "source", per_domain: int = PER_DOMAIN, buckets: int = BUCKETS) -> DataFrame:
    """docs with tokens, domain_pred, posterior, rate, copies and residual added.

    rate is how often a document should be read; copies is the whole number drawn for it, the rate rounded up or down
    by a hash of its doc_id, so that the sum comes out as expected. targets: a weight for each domain, normalised
    here; without them the domains' own shares of the tokens, flattened. They share out as many tokens as the table has.
    residual is what the fit leaves of the target of domain_pred, relative to it: the texts may not tell the domains far enough
    apart to meet the targets, which is warned of. Domains that no row with words declares can't be learned; the
    others share out the tokens. Rows of other or null domains are placed by their words, as all are. Null and empty
    texts have no tokens and the priors as posterior. Repeated rows get the same rate; without any domain all rates are 1;
    an empty table gives an empty result. Columns of the added names are replaced; no other name is touched.
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    learned = learn_classifier(docs, domain, per_domain, buckets)
    for d in sorted(d for d, w in (targets or {}).items() if d not in learned.domains and w > 0):
        LOG.warning("%s: no row with words declares it, so nothing can meet its target of %.3g", d, targets[d])
    words = words_of(F.col("text"))
    if not learned.domains:
        none = {"tokens": F.size(words).cast("long"), "domain_pred": F.lit(None).cast("string"), "posterior": F.array().cast("array<double>"), "rate": F.lit(1.0), "copies": F.lit(1), "residual": F.lit(0.0)}
        return docs.select(*kept, *[c.alias(n) for n, c in none.items()])
    placed = staged(learned.posterior(docs.select(*kept), words, kept), "posteriors")
    sizes = {r[0]: r[1] for r in placed.where(F.col(domain).isNotNull()).groupBy(F.col(domain).cast("string")).agg(F.sum("tokens")).collect()}
    narrow = staged(spread(placed, len(learned.domains)), "narrow")
    factors = calibrate(narrow, [sizes.get(d, 0) for d in learned.domains])
    fitted = staged(spread(placed.select("tokens", reweighed(F.col("posterior"), factors).alias("posterior")), len(factors)), "calibrated")
    wanted = flattened({d: sizes.get(d, 0) for d in learned.domains}) if targets is None else targets
    wanted = [max(0.0, wanted.get(d, 0.0)) for d in learned.domains]
    weights = [w / (sum(wanted) or 1.0) for w in wanted]
    steps, residuals = fit(fitted, weights, float(fitted.agg(F.sum("tokens")).first()[0] or 0))
    discard(fitted, narrow)
    for d, off in zip(learned.domains, residuals, strict=True):
        LOG.log(logging.WARNING if abs(off) > TOLERANCE else logging.INFO, "%s: expected tokens %+.3g of the target", d, off)
    placed = placed.withColumn("posterior", reweighed(F.col("posterior"), factors))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int") - 1
    rate = rate_at([F.get("posterior", F.lit(d)) for d in range(len(steps))], steps)
    copies = (F.floor("rate") + (draw_of("mix", "doc_id") < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    rated = placed.select(*kept, "tokens", F.get(F.array(*map(F.lit, learned.domains)), best).alias("domain_pred"), "posterior", rate.alias("rate"), F.get(literal(residuals), best).alias("residual"))
    return rated.withColumn("copies", copies).select(*kept, *ADDED)
