"""Mixing documents to target weights of soft domains.

A classifier fitted on labelled rows gives each document posterior shares of
the domains. Rates, one per document, are then fitted so that the expected
tokens of each domain, the sum of rate * tokens * share, meet its target:
least squares of the totals' errors relative to their targets, over rates from
0 to MOST_COPIES, by projected-gradient steps that are implicit (see fit_rates).
A step's gradient is one vector of a number per domain, summed over all
documents; a document's rate follows from its shares and the list of those
vectors, so steps keep no state per document. Tokens are words between blanks.

Targets may be out of reach, as where a domain is nearly absent and its
documents may come MOST_COPIES times only. Then rates stay near 1 for documents
that can't help: a step weighs squares against distance from the rates before
it, by EASE, and a further step is taken only if it halves the largest error.

Classifier: softmax regression on which of `vocabulary` words a text holds
(those whose presence tells domains apart best by chi-square) and on a few
shares of characters and words. It is fitted on at most `labelled_rows` labelled
documents, those with the smallest hashes of their ids (of rows that share an id, the
smallest text; of an id's labels, the worst domain); everything else runs over all documents.

Whole copies: a document comes floor(rate) times, and once more where a hash
of its id falls below the fraction, so totals meet the targets in expectation.

Contract: a null text has no tokens; its shares follow from the classifier. A
document without tokens adds to no total and keeps a rate of 1. Labels with null values count as 0. Documents may repeat
or lack ids. Without labelled rows, all shares go to the first domain. If all
totals are 0, rates are 1.
"""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.files import frugal
from tessera.session import column, stored

log = logging.getLogger(__name__)

DOMAINS = ("clean", "low", "toxic")
#: Share of all tokens that each domain should get.
TARGETS = {"clean": 0.96, "low": 0.03, "toxic": 0.01}
#: Classifier sample and words.
LABELLED_ROWS, VOCABULARY = 6000, 1500
#: Classifier's steps; most passes of the fit, and the relative error at which it ends.
FIT_STEPS, RATE_STEPS, GAP = 400, 60, 1e-3
#: A document's highest rate: repeats beyond four add little to what a model learns (published scaling results on repeated data).
MOST_COPIES = 4.0
#: Weight of staying near the rates before the first step, against relative squares.
EASE = 0.1
MARKS = re.compile(r"[#*$%&|<>!]")


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.coalesce(F.col(toxic), F.lit(0)) == 1, 2).when(F.coalesce(F.col(quality), F.lit(1)) == 0, 1).otherwise(0)


def words_in(text: str) -> list[str]:
    return [w.decode() for w in text.encode().lower().split()]


def shape(text: str, words: list[str]) -> list[float]:
    """Shares of marks and capitals, words per distinct word, length of words, length of the text; all small numbers."""
    chars, n = max(1, len(text)), max(1, len(words))
    return [1.0, 10 * len(MARKS.findall(text)) / chars, 4 * sum(map(str.isupper, text)) / chars, len(set(words)) / n, sum(map(len, words)) / n / 5 - 1, np.log1p(len(words)) / 5]


SHAPE = 6


class Classifier:
    def __init__(self, words: list[str], weights: np.ndarray):
        self.index = {w: k for k, w in enumerate(words)}
        self.weights = weights

    def features(self, text: str) -> tuple[list[int], list[float], int]:
        words = words_in(text)
        core = {w.strip(".,;:!?") for w in words}
        return [self.index[w] for w in self.index.keys() & core], shape(text, words), len(words)

    def shares(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        z, n = np.empty((len(texts), self.weights.shape[1])), []
        for k, text in enumerate(texts):
            own, form, tokens = self.features(text)
            z[k] = self.weights[own].sum(0) + np.array(form) @ self.weights[len(self.index) :]
            n.append(tokens)
        e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return e / e.sum(1, keepdims=True), n


def fit_classifier(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, vocabulary: int = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Softmax regression, by accelerated gradient steps on the bounded sample."""
    chosen = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), domain_of().alias("y")).groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(labelled_rows)
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min("text").alias("text"))  # labelled_rows rows at most
    sample = stored(sample.withColumn("words", F.array_distinct(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+$", "")))), "labelled")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    k = len(DOMAINS)
    if not sizes:
        weights = np.zeros((SHAPE, k))
        weights[0, 0] = 50.0
        return Classifier([], weights)
    total = sum(sizes.values())
    by_word = sample.select("y", F.explode("words").alias("w")).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("y") == y).alias(f"n{y}") for y in range(k)))
    chi = sum((F.pow(F.col(f"n{y}") - F.col("n") * (sizes.get(y, 0) / total), F.lit(2.0)) / (F.col("n") * (sizes.get(y, 0) / total) + 1e-9) for y in range(k) if sizes.get(y)), F.lit(0.0))
    words = [r["w"] for r in by_word.filter(F.col("n") >= 3).orderBy(F.desc(F.round(chi, 9)), "w").limit(vocabulary).collect()]
    blank = Classifier(words, np.zeros((len(words) + SHAPE, k)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [blank.features(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([[float(x) for x in r[1]] for r in rows], pa.list_(pa.float64()))], ["y", "own", "form"])

    rows = sample.select("_id", "y", "text").select("y", "text").mapInArrow(frugal(features), "y int, own array<int>, form array<double>").collect()  # labelled_rows rows at most
    x = np.zeros((len(rows), len(words) + SHAPE), np.float32)
    y = np.zeros((len(rows), k), np.float32)
    for i, r in enumerate(sorted(rows, key=lambda r: (r["y"], r["own"], r["form"]))):
        x[i, r["own"]] = 1
        x[i, len(words) :] = r["form"]
        y[i, r["y"]] = 1
    w = np.zeros((x.shape[1], k), np.float32)
    v = w.copy()
    step = 4.0 / float((x * x).sum(1).mean() + 1)
    for t in range(FIT_STEPS):
        ahead = w + t / (t + 3) * (w - v)
        z = x @ ahead
        e = np.exp(z - z.max(1, keepdims=True))
        v, w = w, ahead - step * (x.T @ (e / e.sum(1, keepdims=True) - y) / len(x) + 1e-4 * ahead)
    return Classifier(words, w.astype(float))


def _scored(classifier: Classifier, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares, n = [], []
            texts = b.column(text_at).to_pylist()
            for at in range(0, len(texts), 500):
                p, tokens = classifier.shares([x or "" for x in texts[at : at + 500]])
                shares += p.tolist()
                n += tokens
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shares, pa.list_(pa.float64())), pa.array(n, pa.int64())], [*b.schema.names, "shares", "n_tokens"])

    return run


def scored(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """docs, its columns renamed c0, c1, ..., with shares and n_tokens. No shuffle."""
    numbered = docs.select(*[column(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    schema = T.StructType([*numbered.schema.fields, T.StructField("shares", T.ArrayType(T.DoubleType())), T.StructField("n_tokens", T.LongType())])
    return numbered.mapInArrow(frugal(_scored(classifier, docs.columns.index(text_col))), schema)


def _dot(g: Column, k: int) -> Column:
    return sum((F.get(F.col("shares"), F.lit(j)) * F.get(g, F.lit(j)) for j in range(k)), F.lit(0.0))


def rate(steps: list[list[float]], k: int, most: float = math.inf) -> Column:
    """The rate that the steps so far give a row with `shares` and `n_tokens`."""
    if not steps:
        return F.lit(1.0)
    all_steps = F.array(*[F.array(*map(F.lit, g)) for g in steps])
    return F.when(F.col("n_tokens") > 0, F.aggregate(all_steps, F.lit(1.0), lambda r, g: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r - _dot(g, k))))).otherwise(1.0)


def totals(rows: DataFrame, steps: list[list[float]], most: float = math.inf) -> list[float]:
    """Expected tokens of each domain as shares of all tokens before; rows: shares, n_tokens."""
    *now, tokens = rows.agg(*[F.sum(rate(steps, len(DOMAINS), most) * F.col("n_tokens") * F.get(F.col("shares"), F.lit(j))) for j in range(len(DOMAINS))], F.sum("n_tokens")).first()
    return [(x or 0.0) / tokens if tokens else 0.0 for x in now]


def fit_rates(rows: DataFrame, targets: dict[str, float] = TARGETS, limit: int = RATE_STEPS, gap: float = GAP, most: float = math.inf, ease: float = EASE) -> list[list[float]]:
    """Vectors of the projected steps. rows: stored shares, n_tokens.

    A step from rates r0 is implicit: r is r0 - g.p brought into 0 .. most,
    where g is the gradient of the relative squares at r itself, over `ease`, which falls tenfold each step.
    That r is the least of squares + ease / 2 * (mean of (r - r0)^2 by tokens).
    Such g is the minimum of a convex function of one number per domain, found
    by Newton's method: its value, gradient and curvature are one pass of sums
    over the rows, the curvature over those with rates within the bounds.

    The fit ends when each total is within `gap` of its target, relative to the
    target, or when a further step doesn't halve the largest relative error (that
    step is dropped), or after `limit` passes. Totals are logged beside their
    targets, as a warning where these are missed.
    """
    k = len(DOMAINS)
    want = np.array([targets.get(d, 0.0) for d in DOMAINS])
    unit = np.maximum(want, gap)
    p = [F.get(F.col("shares"), F.lit(j)) for j in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    tokens = rows.agg(F.sum("n_tokens")).first()[0]
    if not tokens:
        return []

    def at(steps: list[list[float]], g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of a step g after `steps`: the convex function's sum over rows, totals, and the mean p p' where rates are within the bounds."""
        free, r, n = F.col("free"), F.col("r"), F.col("n_tokens") / float(tokens)
        own = rows.filter("n_tokens > 0").withColumn("free", rate(steps, k, most) - _dot(F.array(*map(F.lit, g.tolist())), k)).withColumn("r", F.least(F.lit(float(most)), F.greatest(F.lit(0.0), free)))
        on = F.when((free > 0) & (free < most), n).otherwise(0.0)
        value, *more = own.agg(F.sum(n * (r * free - r * r / 2)), *[F.sum(n * r * x) for x in p], *[F.sum(on * p[i] * p[j]) for i, j in pairs]).first()
        curve = np.zeros((k, k))
        for (i, j), x in zip(pairs, more[k:], strict=True):
            curve[i, j] = curve[j, i] = x
        return value, np.array(more[:k]), curve

    steps: list[list[float]] = []
    here = at(steps, np.zeros(k))
    got, passes, end = here[1], 1, "pass limit"
    error = abs(got - want) / unit
    while passes < limit:
        if error.max() <= gap:
            end = "targets met"
            break
        g = np.zeros(k)
        while passes < limit:
            value = here[0] + want @ g + ease / 2 * (unit * unit * g * g).sum()
            down = want - here[1] + ease * unit * unit * g
            if (abs(down) <= gap / 10 * unit).all():
                break
            curve = here[2] + ease * np.diag(unit * unit)
            scale = 1 / np.sqrt(np.diag(curve))
            move = -scale * np.linalg.solve(curve * np.outer(scale, scale) + 1e-13 * np.eye(k), scale * down)
            part, better = 1.0, None
            while passes < limit:
                ahead = g + part * move
                better = at(steps, ahead)
                passes += 1
                if better[0] + want @ ahead + ease / 2 * (unit * unit * ahead * ahead).sum() <= value + 1e-4 * part * (down @ move) + 1e-12 * abs(value):
                    break
                part /= 2
            if better is None:
                break
            g, here = ahead, better
        after = abs(here[1] - want) / unit
        if steps and after.max() > error.max() / 2:
            end = "targets out of reach"
            break
        steps.append(g.tolist())
        got, error, ease = here[1], after, ease / 10
        here = at(steps, np.zeros(k))
        passes += 1
    say = log.warning if end != "targets met" else log.info
    say("rates: %s after %d passes; %s", end, passes, ", ".join(f"{d} {x:.6g} (target {t:g})" for d, x, t in zip(DOMAINS, got, want, strict=True)))
    return steps


def copies(steps: list[list[float]], key: Column, k: int = len(DOMAINS), most: float = math.inf) -> Column:
    r = rate(steps, k, most)
    u = F.pmod(F.xxhash64(key, F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(r) + F.when(u < r - F.floor(r), 1).otherwise(0)).cast("int")


def mixing_report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", most: float = MOST_COPIES) -> DataFrame:
    """doc_id, n_tokens, a share per domain, rate, copies; one row per input row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    classifier = fit_classifier(own, labels.withColumnRenamed(id_col, "doc_id"))
    rows = stored(scored(own, classifier).select(F.col("c0").alias("doc_id"), "n_tokens", "shares"), "shares")
    steps = fit_rates(rows, targets, most=most)
    return rows.select("doc_id", "n_tokens", *[F.get("shares", F.lit(j)).alias(f"share_{d}") for j, d in enumerate(DOMAINS)], rate(steps, len(DOMAINS), most).alias("rate"), copies(steps, F.col("doc_id"), most=most).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", most: float = MOST_COPIES) -> DataFrame:
    """The rows of docs, each as often as its rate says; columns as they are."""
    classifier = fit_classifier(docs, labels, id_col=id_col, text_col=text_col)
    steps = fit_rates(stored(scored(docs.select(text_col), classifier, text_col).select("shares", "n_tokens"), "shares"), targets, most=most)
    out = scored(docs, classifier, text_col).withColumn("n", copies(steps, F.col(f"c{docs.columns.index(id_col)}"), most=most)).filter("n > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
