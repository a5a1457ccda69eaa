"""Toxicity by weak supervision.

Lexicon voters (a word is present), pattern voters (a word starts with a stem) and shape voters
(shouting, exclamation) each fire or not on a document. A generative model with one hidden class
estimates by expectation-maximisation how often each voter fires in either class, and from the
residual correlations within a class how much of a voter's evidence others already gave. A linear
classifier is then trained on the posterior labels and scores every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subloom.llm.arrays import release
from subloom.operators.skew import checked_broadcast
from subloom.session import materialize

# Labelled rows the model is fitted on at most, and terms that become voters at most.
FIT_ROWS, FIT_TERMS = 10_000, 400
STEMS = (4, 5, 6)
# Least log-likelihood ratio of a term against independence of the label.
EVIDENCE = 12.0
# Different words that must precede a term in documents of label 1.
USES = 4
# A term must be used LEAST times as often in documents of label 1 as in the others; up to MOST
# times, if it takes that for PRECISE uses with label 1 to one without.
LEAST, MOST, PRECISE = 4, 24, 3
WORD = re.compile(r"[^\W\d_]+")
SHAPES = ("!shouting", "!exclaiming", "!stretched")
CAPITALS = re.compile("[A-Z]+")
STRETCHED = re.compile(r"([^\W\d_])\1{3}")


def terms_of(text: str | None) -> dict[str, tuple[str, str]]:
    """Words in lower case and the stems of longer words with a star, each with the words before
    and after its first use; shapes with the first words."""
    words = WORD.findall((text or "").lower())
    out = dict.fromkeys(shapes_of(text), tuple((*words, "", "")[:2]))
    for before, word, after in zip(("", *words), words, (*words[1:], "")):
        if word not in out:
            for term in (word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]):
                out.setdefault(term, (before, after))
    return out


def shapes_of(text: str | None) -> list[str]:
    text = text or ""
    on = (
        len(text) - len(CAPITALS.sub("", text)) > 0.3 * len(text),
        text.count("!") > 2,
        bool(STRETCHED.search(text)),
    )
    return [name for name, x in zip(SHAPES, on) if x]


@dataclass(frozen=True)
class LabelModel:
    """``fire``: firing rates of each voter, clean class first; ``covered``: shares of rows with
    any vote; ``weight``: the share of a voter's evidence that counts; ``prior``: of label 1."""

    fire: np.ndarray
    covered: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """A voter that doesn't fire abstains; that none fires is evidence of its own."""
        ratio = votes @ (np.log(self.fire[1] / self.fire[0]) * self.weight)
        silent = math.log((1 - self.covered[1]) / (1 - self.covered[0]))
        ratio = ratio + np.where(votes.any(axis=1), 0, silent) + math.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 20) -> LabelModel:
    """Expectation-maximisation from the first guess ``start`` of each row's class; then the
    correlations that remain within a class set the weights."""
    q, votes = start.astype(float), votes.astype(float)
    weight, anyone = np.ones(votes.shape[1]), votes.any(axis=1).astype(float)
    for _ in range(rounds):
        classes = (1 - q, q)
        fire = np.array([(w @ votes + 0.1) / (w.sum() + 0.2) for w in classes])
        covered = np.array([(w @ anyone + 0.1) / (w.sum() + 0.2) for w in classes])
        prior = min(max(q.mean(), 1e-4), 1 - 1e-4)
        q = LabelModel(fire, covered, weight, prior).posterior(votes)
    together = np.zeros((votes.shape[1],) * 2)
    for w, rate in zip(classes, fire):
        rest = (votes - rate) / np.sqrt(rate * (1 - rate) * (w.sum() + 1e-9))
        together = np.maximum(together, (rest * w[:, None]).T @ rest)
    np.fill_diagonal(together, 0)
    together[together < 0.1] = 0
    weight = 1 / (1 + np.clip(together, 0, 1).sum(axis=0))
    return LabelModel(fire, covered, weight, prior)


@dataclass(frozen=True)
class ToxicityModel:
    terms: dict[str, int]
    coefficients: tuple[float, ...]
    intercept: float
    labels: LabelModel | None = None

    def score(self, text: str | None) -> float:
        at = voters_on(text, self.terms)
        z = self.intercept + sum(self.coefficients[i] for i in at)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def voters_on(text: str | None, terms: dict[str, int]) -> list[int]:
    """The voters that fire on a text."""
    words = set(WORD.findall((text or "").lower()))
    hit = {terms[w] for w in words if w in terms}
    for n in STEMS:
        hit |= {terms[s] for s in {f"{w[:n]}*" for w in words if len(w) > n} if s in terms}
    return sorted(hit | {terms[s] for s in shapes_of(text) if s in terms})


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows that nothing is learnt from; a null key is not one of them, nor has it a label."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, limit: int
) -> DataFrame:
    """Rows (text, label) of at most ``limit`` labelled documents outside the held-out fold,
    chosen by a hash of the id. A document labelled more than once has its largest label."""
    known = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
        .dropna()
        .filter(~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    chosen = materialize(known.orderBy(F.xxhash64("id"), "id").limit(limit))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return materialize(rows.join(checked_broadcast(chosen), "id").select("text", "label"))


def telling_terms(sample: DataFrame, most: int) -> list[str]:
    """Terms that are evidence for label 1, the strongest first. A passage that is copied keeps
    the words around a term: for either label it is one use, and a copied text is one text."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = {
                (term, label == 1, zlib.crc32(before.encode()), zlib.crc32(after.encode()))
                for text, label in zip(batch["text"], batch["label"])
                for term, (before, after) in terms_of(text).items()
            }
            out = pd.DataFrame(seen, columns=["term", "toxic", "before", "after"])
            del seen
            yield out
            del out
            release()

    texts = sample.select((F.col("label") == 1).alias("toxic"), F.xxhash64("text").alias("t")).distinct()
    found = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    ones, zeros = found.get(True, 0), found.get(False, 0)
    share = ones / (ones + zeros)
    # A term has at most one row for each document of the sample.
    uses = (
        sample.mapInPandas(listed, "term string, toxic boolean, before long, after long")
        .repartition("term")
        .dropDuplicates()
    )
    counts = (
        uses.groupBy("term", "before")
        .agg(F.count_if("toxic").alias("u1"), F.count_if(~F.col("toxic")).alias("u0"))
        .groupBy("term")
        .agg(F.sum("u0").alias("u0"), F.sum("u1").alias("u1"), F.count_if(F.col("u1") > 0).alias("words"))
        .filter(F.col("words") >= USES)
    )
    n = F.col("u0") + F.col("u1")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    evidence = part(F.col("u1"), share) + part(F.col("u0"), 1 - share)
    times = max(LEAST, min(MOST, PRECISE * zeros / ones))
    strong = counts.withColumn("e", evidence).filter(
        (F.col("e") >= EVIDENCE) & (F.col("u1") * zeros > times * F.col("u0") * ones)
    )
    ranked = strong.orderBy(F.desc("e"), F.desc("u1"), F.desc(F.length("term")), "term").limit(4 * most)
    return without_nested([r["term"] for r in ranked.collect()])[:most]


def without_nested(terms: list[str]) -> list[str]:
    """Of terms of which one is a stem of the other, only the first stays."""
    kept: list[str] = []
    stems: set[str] = set()  # of the kept terms, each term itself included
    for term in terms:
        body = term.rstrip("*")
        own = {f"{body[:n]}*" for n in STEMS if n <= len(body)} | {term}
        if own.isdisjoint(kept) and term not in stems:
            kept.append(term)
            stems |= own
    return kept


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    fit_rows: int = FIT_ROWS,
    fit_terms: int = FIT_TERMS,
) -> ToxicityModel:
    """Fit on at most ``fit_rows`` labelled documents outside the held-out fold and at most
    ``fit_terms`` term voters, both bounds whatever the size of the corpus. Without labels of both
    kinds, or without telling terms, the model scores the share of label 1 (at most 0.49)."""
    # here, so that the workers that score need not load it
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    sample = labelled_sample(docs, labels, id_column, text_column, label_column, fit_rows)
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    ones, zeros = seen.get(1, 0), sum(n for k, n in seen.items() if k != 1)
    share = min(ones / max(ones + zeros, 1), 0.49)
    flat = ToxicityModel({}, (), math.log(max(share, 1e-3) / (1 - share)))
    if not ones or not zeros:
        return flat
    terms = {t: i for i, t in enumerate(telling_terms(sample, fit_terms))}
    if not terms:
        return flat

    def fired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            on = [voters_on(t, terms) for t in batch["text"]]
            yield pd.DataFrame({"on": on, "label": batch["label"]})

    rows = sample.mapInPandas(fired, "on array<int>, label int").collect()
    votes = np.zeros((len(rows), len(terms)), np.float32)
    for k, row in enumerate(rows):
        votes[k, row["on"]] = 1
    model = fit_label_model(votes, np.where(votes.any(axis=1), 0.9, 0.02))
    soft = model.posterior(votes)
    spark, width = docs.sparkSession, votes.shape[1]
    train = [
        (Vectors.sparse(width, row["on"], [1.0] * len(row["on"])), label, float(weight))
        for row, p in zip(rows, soft)
        for label, weight in ((1.0, p), (0.0, 1 - p))
        if weight > 1e-3
    ]
    frame = spark.createDataFrame(train, ["features", "label", "weight"])
    classifier = LogisticRegression(
        weightCol="weight", regParam=1e-4, maxIter=50, standardization=False
    ).fit(frame)
    return ToxicityModel(terms, tuple(classifier.coefficients.toArray()), classifier.intercept, model)


def score_toxicity(
    docs: DataFrame,
    model: ToxicityModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    score_column: str = "toxicity",
) -> DataFrame:
    """``docs`` with the column ``score_column`` (0 to 1), which replaces one of that name. Only the
    text is an input. Null and empty texts are scored as texts on which no voter fires. Repeated
    rows are scored each; other columns stay as they are. An empty table gives no rows."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:  # one text at a time becomes a Python string
        release()
        return pa.array((model.score(t.as_py()) for t in texts), pa.float64())

    return docs.withColumn(score_column, score(F.col(text_column)))
