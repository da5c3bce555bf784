"""Toxicity by a classifier chain.

Linear models predict one category after another.  Each later model gets the
earlier categories' probabilities as features; it is trained on out-of-fold
probabilities, so that it sees earlier predictions as good as they will be on
new documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# The categories in the chain's order: (name, column of labels, value that counts as the category).
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
SAMPLE_ROWS, TERMS, FOLDS, LEAST_TEXTS = 16_000, 150, 3, 3
STEM, ROUNDS, RATE, DECAY, THRESHOLD = 4, 300, 0.5, 1e-4, 0.35
# Bytes: A-Z in lower case, every other ASCII character that is no letter or digit a blank.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(data: bytes) -> set[bytes]:
    """The different terms of a UTF-8 text: words (letters, digits and non-ASCII bytes) and the stems of longer ones.

    A stem is a word's first ``STEM`` bytes and ``*``; it stands for a family of
    inflected or compounded words of which the sample holds only some.
    """
    words = set(data.translate(_FOLD).split())
    return words.union([w[:STEM] + b"*" for w in words if len(w) > STEM])


@dataclass
class Chain:
    """One linear model a category: weights of the vocabulary's terms, of the earlier probabilities, and the intercept."""

    names: tuple[str, ...]
    terms: dict[bytes, int]
    weights: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        n = len(rows)
        length = np.fromiter(map(len, rows), np.int64, n)
        col = np.fromiter((c for r in rows for c in r), np.int64, length.sum())
        row, out = np.repeat(np.arange(n), length), np.zeros((n, len(self.names)))
        for j in range(len(self.names)):
            z = np.bincount(row, self.weights[j][col], n) if len(self.terms) else np.zeros(n)
            out[:, j] = sigmoid(z + out[:, :j] @ self.links[j] + self.intercepts[j])
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(row: np.ndarray, col: np.ndarray, n_terms: int, dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on 0/1 terms (their places) and dense features, by Adam; (weights, dense weights, intercept)."""
    n, d = len(y), n_terms + dense.shape[1]
    w, m, v, b = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), float(y.mean())
    if not 0 < b < 1:
        return w[:n_terms], w[n_terms:d], 20.0 if b else -20.0
    w[d] = np.log(b / (1 - b))
    for step in range(1, ROUNDS + 1):
        p = sigmoid(np.bincount(row, w[col], n) + dense @ w[n_terms:d] + w[d])
        r = (p - y) / n
        g = np.concatenate((np.bincount(col, r[row], n_terms), dense.T @ r, [r.sum()])) + DECAY * np.append(w[:d], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE / (1 + 3 * step / ROUNDS) * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n_terms], w[n_terms:d], float(w[d])


def fit_chain(names: Sequence[str], terms: list[bytes], rows: list[list[int]], labels: np.ndarray, folds: int = FOLDS) -> Chain:
    """labels: [rows, categories], NaN where unknown.  Row i is in fold i % folds."""
    chain = Chain(tuple(names), {t: i for i, t in enumerate(terms)})
    n = len(rows)
    length = np.fromiter(map(len, rows), np.int64, n)
    row, col = np.repeat(np.arange(n), length), np.fromiter((c for r in rows for c in r), np.int64, length.sum())
    earlier, fold = np.zeros((n, 0)), np.arange(n) % folds

    def fit(use: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        if not use.any():
            return np.zeros(len(terms)), np.zeros(earlier.shape[1]), -20.0
        new = np.cumsum(use) - 1
        on = use[row]
        return fit_linear(new[row[on]], col[on], len(terms), earlier[use], y[use])

    for j in range(len(names)):
        y = labels[:, j]
        known = ~np.isnan(y)
        out = np.zeros(n)
        for k in range(folds if j + 1 < len(names) else 0):
            w, u, b = fit(known & (fold != k), y)
            out += np.where(fold == k, sigmoid((np.bincount(row, w[col], n) if len(terms) else 0) + earlier @ u + b), 0)
        w, u, b = fit(known, y)
        chain.weights.append(w)
        chain.links.append(u)
        chain.intercepts.append(b)
        earlier = np.column_stack((earlier, out))
    return chain


def sample_terms(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, one column a category (1, 0 or null) and terms of at most ``sample_rows`` labelled documents, chosen by a hash of doc_id.

    Of several texts with one doc_id the one with the least list of terms counts.
    """
    y = [F.max(F.when(F.col(c) == v, F.lit(1.0)).when(F.col(c).isNotNull(), F.lit(0.0))).alias(f"y{j}") for j, (_, c, v) in enumerate(chain)]
    chosen = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    names = [f"y{j}" for j in range(len(chain))]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", *names, "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(terms_of(t.as_buffer().to_pybytes())) if t.is_valid else [] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(terms, pa.list_(pa.binary()))], names=["doc_id", *names, "terms"])

    return cut(rows.mapInArrow(split, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", terms array<binary>").groupBy("doc_id", *names).agg(F.min("terms").alias("terms")))


def telling_terms(sample: DataFrame, category: str, terms: int = TERMS, least: int = LEAST_TEXTS) -> list[bytes]:
    """The ``terms`` terms with the largest chi-square against a category."""
    known = sample.filter(F.col(category).isNotNull())
    n, pos = known.agg(F.count("*"), F.coalesce(F.sum(category), F.lit(0.0))).first()
    if not 0 < pos < n:
        return []
    counts = known.select(category, F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum(category).alias("hits")).filter(F.col("n") >= least)
    gap = F.col("hits") * n - F.col("n") * pos
    chi = gap * gap / (F.col("n") * (n + 1 - F.col("n")))
    return [bytes(r.term) for r in counts.orderBy(chi.desc(), "term").limit(terms).collect()]


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample_rows: int = SAMPLE_ROWS, terms: int = TERMS, folds: int = FOLDS) -> Chain:
    """Fits the chain on the bounded sample; the driver gets places in the vocabulary only."""
    sample = sample_terms(docs, labels, chain, sample_rows)
    names = [f"y{j}" for j in range(len(chain))]
    vocabulary = sorted({t for n in names for t in telling_terms(sample, n, terms)})
    place = {t: i for i, t in enumerate(vocabulary)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [sorted(place[t] for t in r.as_py() if t in place) for r in batch.column("terms")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(places, pa.list_(pa.int32()))], names=["doc_id", *names, "places"])

    found = sample.mapInArrow(find, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", places array<int>")
    rows = sorted(found.collect(), key=lambda r: r.doc_id)  # at most sample_rows
    labels_ = np.array([[np.nan if r[n] is None else r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))
    return fit_chain([c[0] for c in chain], vocabulary, [r.places for r in rows], labels_, folds)


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """``docs`` and p, an array of the categories' probabilities, as columns row and p."""
    kept = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = model.terms.keys().__and__
        for batch in batches:
            rows = [[model.terms[t] for t in get(terms_of(v.as_buffer().to_pybytes()))] if v.is_valid else [] for v in batch.column("text")]
            p = pa.array(list(model.probabilities(rows)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), p], names=["row", "p"])

    return kept.mapInArrow(rate, kept.select("row", F.array(F.lit(0.0)).alias("p")).schema)


def judge_toxicity(docs: DataFrame, labels: DataFrame, chain=CHAIN, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, p_<category> for each category, toxic (the last one's probability reaches the threshold), kept.

    Null and empty texts are judged by the intercepts.  Repeated rows are judged
    one by one, rows with a null doc_id too.  Very long texts enter whole.  An
    empty table gives an empty result; without labels, or where all agree, a
    category gets that value.  Further columns are left out.
    """
    out = score(docs.select("doc_id", "text"), train(docs, labels, chain, sample_rows))
    p = [F.get("p", F.lit(j)).alias(f"p_{name}") for j, (name, _, _) in enumerate(chain)]
    toxic = F.get("p", F.lit(len(chain) - 1)) >= threshold
    return out.select(F.col("row.doc_id").alias("doc_id"), *p, toxic.alias("toxic"), (~toxic).alias("kept"))


def drop_toxic(docs: DataFrame, labels: DataFrame, chain=CHAIN, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not toxic, as they are.

    Null and empty texts are judged by the intercepts, repeated rows and rows
    without a doc_id one by one.  Very long texts enter whole; an empty table
    stays empty; columns may have any names.
    """
    out = score(docs, train(docs, labels, chain, sample_rows)).filter(F.get("p", F.lit(len(chain) - 1)) < threshold)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns))
