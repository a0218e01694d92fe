"""Mixing sources to target weights by soft membership.

A classifier is trained on a bounded sample of a labelled table and predicts, for
every document, the posterior of each domain. Document rates r >= 0 are then fitted
by least squares so that the expected domain token totals, sum over documents of
rate * tokens * posterior, match the targets.

The fit is projected gradient descent over all documents. A document's rate after
t steps depends only on its own posteriors and on the t gradients so far, each of
which is one number per domain; so the steps aggregate a narrow table and never
rewrite or collect it. Rates are constrained to [least, most] (0 to no bound, by
default); the fit starts from 1, so documents keep about their natural rate where
the targets allow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, table, tidy
from .textkernel import chunks, mix, word_hashes

#: Tokens beside their targets, as a share of all, at which a fit is done.
TOLERANCE = 1e-4
#: Documents per domain that the classifier is trained on at most, and cells that words are hashed to.
SAMPLE, CELLS = 1500, 1 << 14
SAMPLE_CHARS = 30_000

#: Target weights of the languages in the registered query and the pipeline.
TARGETS = {"en": 0.40, "de": 0.20, "fr": 0.20, "es": 0.20}


@dataclass
class Classifier:
    """Naive Bayes over hashed words, tempered so that posteriors stay soft."""

    domains: list[str]
    log_prior: np.ndarray
    log_likelihood: np.ndarray  # domain by cell
    temper: float = 20.0

    def posteriors(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(posteriors, number of words) of each text; a text without words has the priors."""
        out, sizes = [], []
        for _, data, offsets in chunks(column):
            words, first = word_hashes(data, offsets)
            n = np.diff(first)
            sums = np.zeros((len(n), len(self.domains)))
            if len(words):
                cells = cell(words)
                for k in range(len(self.domains)):
                    total = np.concatenate([[0.0], np.cumsum(self.log_likelihood[k][cells])])
                    sums[:, k] = total[first[1:]] - total[first[:-1]]
            logits = self.log_prior + sums / np.maximum(1.0, n[:, None] / self.temper)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            out.append(p / p.sum(axis=1, keepdims=True))
            sizes.append(n)
        return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros((0, len(self.domains))), np.zeros(0, np.int64))


def cell(words: np.ndarray) -> np.ndarray:
    return (mix(words) & np.uint64(CELLS - 1)).astype(np.int64)


def train(texts: list[str], labels: list[str], domains: list[str]) -> Classifier:
    counts = np.full((len(domains), CELLS), 0.5)
    prior = np.ones(len(domains))
    place = {d: k for k, d in enumerate(domains)}
    for _, data, offsets in chunks(pa.array(texts, pa.string())) if texts else []:
        words, first = word_hashes(data, offsets)
        cells = cell(words)
        rows = labels[: len(offsets) - 1]
        labels = labels[len(offsets) - 1 :]
        for i, label in enumerate(rows):
            np.add.at(counts[place[label]], cells[first[i] : first[i + 1]], 1)
            prior[place[label]] += 1
    return Classifier(domains, np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=1, keepdims=True)))


def labelled_sample(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[list[str], list[str]]:
    """Texts and domains of at most SAMPLE labelled documents of each domain, those with the smallest hashes; longer texts than SAMPLE_CHARS aren't trained on."""
    marks = labelled.filter("doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    found = bounded_sample(docs.select("doc_id", "text"), marks, "domain", domains, SAMPLE, SAMPLE_CHARS)
    return [t for d in domains for t in found[d]], [d for d in domains for _ in found[d]]


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """Adds tokens (words of the whole text) and p, the posteriors in the order of model.domains."""
    place, others = docs.columns.index("text"), [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # domains by cells, of fixed size

    def rows(batches):
        for b in batches:
            p, n = shared.value.posteriors(b.column(place))
            k = p.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * k, pa.int32()), pa.array(p.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != place], pa.array(n.astype(np.int64)), lists], [*others, "tokens", "p"])

    kinds = [f"`{c}` {t}" for c, t in docs.dtypes if c != "text"]
    return docs.mapInArrow(rows, ", ".join([*kinds, "tokens long, p array<double>"]))


def _rate(gradients: list[np.ndarray], least: float, most: float, p: str = "p"):
    """A document's rate after projected steps, replayed from the gradients so far."""
    rate = F.lit(1.0)
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in gradients]).cast("array<array<double>>")
    move = lambda g: F.aggregate(F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(steps, rate, lambda r, g: F.least(F.greatest(r - move(g), F.lit(float(least))), F.lit(float(most))))


def fit_rates(rows: DataFrame, weights: list[float], least: float = 0.0, most: float = 1e9, total: float | None = None, steps: int = 200, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], dict]:
    """Gradients whose replay gives the rates, and a report, for rows (tokens, p).

    Targets are weights * total; total: all tokens by default, or the least total
    that needs no rate below ``least`` if least > 0. A step moves rates by p . g,
    where g are the weighed residuals: gradient descent in the metric that weighs a
    document by its tokens. Where steps only lead away from targets that no rates
    reach, as of a domain without documents, the nearest rates so far are given.

    Residuals are weighed by the inverse of c = sum of tokens p p' over the
    documents that were within their bounds after the last step, so that a step
    is as long as their curvature allows; a thousandth of the sum over all
    documents keeps it bounded where few are left. Each step is one job that
    returns k sums and k (k + 1) / 2 products.
    """
    k = len(weights)
    w = np.array(weights) / sum(weights)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def summed(rate, free) -> tuple[np.ndarray, np.ndarray]:
        own = rows.select("tokens", "p", rate.alias("r")).withColumn("f", F.when(free, F.col("tokens")).otherwise(0))
        got = own.agg(*[F.sum(F.col("r") * F.col("tokens") * F.col("p")[i]) for i in range(k)], *[F.sum(F.col("f") * F.col("p")[i] * F.col("p")[j]) for i, j in pairs]).first()
        c = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k:], strict=True):
            c[i, j] = c[j, i] = x or 0.0
        return np.array([x or 0.0 for x in got[:k]]), c

    natural, whole = summed(F.lit(1.0), F.lit(True))
    if total is None:
        total = natural.sum() if least <= 0 else max([natural.sum() * least, *(least * natural[w > 0] / w[w > 0])])
    target = w * total
    gradients: list[np.ndarray] = []
    totals, c, best, nearest, mark = natural, whole, np.inf, (0, natural), (0, np.inf)
    for _ in range(steps):
        off = totals - target
        error = float(np.abs(off).sum() / max(total, 1e-12))
        if error < best:
            best, nearest = error, (len(gradients), totals)
        if error < 0.98 * mark[1]:
            mark = len(gradients), error
        # Twelve steps that gain less than a fiftieth mean that no rates reach the targets.
        if error < tolerance or total == 0 or len(gradients) >= mark[0] + 12:
            break
        gradients.append(np.linalg.solve(c + 1e-3 * whole + np.eye(k) * max(1e-9 * np.trace(whole) / k, 1e-12), off))
        totals, c = summed(_rate(gradients, least, most), F.expr(f"r > {least!r}D and r < {most!r}D"))
    if np.abs(totals - target).sum() > np.abs(nearest[1] - target).sum():
        gradients, totals = gradients[: nearest[0]], nearest[1]
    tidy(rows.sparkSession)
    return gradients, {"target": target.tolist(), "expected": totals.tolist(), "steps": len(gradients), "error": float(np.abs(totals - target).sum() / max(total, 1e-12))}


def mix_rates(spark: SparkSession, docs: DataFrame, labelled: DataFrame, weights: dict[str, float], least: float = 0.0, most: float = 1e9) -> tuple[DataFrame, dict]:
    """(doc_id, tokens, p, rate) of every document, and the report of the fit.

    labelled: (doc_id, domain). Documents without words count 0 tokens and have
    the rate that the priors give. A null doc_id is kept. Without documents, or
    without labelled ones, rates are those of the priors. Repeated rows give a row
    each; other columns are ignored.
    """
    domains = sorted(weights)
    scratch = Scratch(spark)
    own = docs.select("doc_id", "text")
    model = train(*labelled_sample(own, labelled, domains), domains)
    rows = scratch.save(memberships(own, model), "memberships")
    gradients, report = fit_rates(rows, [weights[d] for d in domains], least, most)
    return rows.withColumn("rate", _rate(gradients, least, most)), report


def repeated(docs: DataFrame, model: Classifier, gradients: list[np.ndarray], least: float = 0.0, most: float = 1e9) -> DataFrame:
    """``docs`` with each row as often as its rate says; no shuffle. The same row always gets the same number."""

    @F.arrow_udf("struct<tokens: bigint, p: array<double>>")
    def member(text: pa.Array) -> pa.Array:
        p, n = model.posteriors(text)
        k = p.shape[1]
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * k, pa.int32()), pa.array(p.reshape(-1)))], ["tokens", "p"])

    names = docs.columns
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 20)) / float(1 << 20)
    rows = docs.withColumn("__m", member("text")).withColumn("__p", F.col("__m.p"))
    rows = rows.withColumn("__n", F.floor(_rate(gradients, least, most, "__p") + 1 - chance - 2.0**-21).cast("int"))
    return rows.select(*names, F.explode(F.array_repeat(F.lit(0), F.col("__n"))).alias("__c")).drop("__c")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that mix the languages to TARGETS; the labelled table gives the ids of documents whose language is known."""
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.join(known, "doc_id").select("doc_id", F.col("lang").alias("domain"))
    rates, report = mix_rates(spark, docs, labelled, TARGETS)
    domains = sorted(TARGETS)
    # miss: share of the tokens that the fit leaves beside their targets, as where a domain has no documents
    return rates.select("doc_id", "tokens", "rate", F.lit(report["error"]).alias("miss"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)])


QUERIES = {"op7_mixing": op7_mixing}
SQL: dict[str, str] = {}
