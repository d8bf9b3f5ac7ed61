"""Operator 5, toxicity: cumulative-link ordinal regression.

Severity has four grades.  Clean texts have grade 0; the toxic texts of the
training sample are graded 1 to 3 by thirds of how many of the features that
mark toxic texts they have.  The regression gives P(grade >= j) = logistic(w.x - t_j)
with one weight vector shared by the ordered thresholds t_1 < t_2 < t_3, and
the expected severity is the sum of the three probabilities.

Features of a text are its distinct words (lower-cased, signs at either end
removed) and the beginnings of longer words, hashed; kept are those that a
z-test finds more often in toxic texts and that are rare in clean ones, so a
clean text has next to none; their weights are not negative.  Near copies
would make any of their words look telling, so of training texts with the same
least hash over their three-word sequences one is learned.  At most
``TRAIN_ROWS`` labelled rows of each class are learned; all rows are scored.

Defined results: null texts count as empty and have no features.  Very long
texts are scored whole.  Of several texts under one labelled id one is
learned.  Null labels and null ids are not learned; rows without an id are
scored.  Without toxic or without clean labels nothing can be learned:
severity 0.0 for all rows.  Equal texts get equal results.  Other columns are
not read, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, text_or_empty
from .words import CACHE_WORDS

BUCKETS = 1 << 18
TRAIN_ROWS = 2500
GRADES = 3
LEAST_Z = 5.0
LEAST_TEXTS = 4
#: A feature's share of clean texts over its share of toxic ones is at most this.
MOST_CLEAN = 0.05
BEGINNINGS = (4, 5, 6)
SIGNS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def distinct_words(text: str) -> set[str]:
    words = {w.strip(SIGNS) for w in set(text.lower().split())}
    words.discard("")
    return words


def word_features(word: str) -> tuple[int, ...]:
    """The word itself, and those of its beginnings that are shorter."""
    return (_hash(word), *[_hash("^" + word[:n]) for n in BEGINNINGS if len(word) > n])


def least_hash(text: str) -> int:
    """The least CRC-32 of a text's three-word sequences; near copies mostly share it."""
    words = text.lower().split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class OrdinalRegression:
    """Weights over hashed features and ordered thresholds, fitted by AdaGrad on the log-likelihood."""

    def __init__(self) -> None:
        self.weights: dict[int, float] = {}
        self.thresholds = np.array([1.0, 2.0, 3.0])

    def fit(self, rows: list[np.ndarray], toxic: np.ndarray, steps: int = 600, rate: float = 0.5, l2: float = 1e-5) -> OrdinalRegression:
        flat = np.concatenate(rows).astype(np.int32) if len(rows) else np.zeros(0, np.int32)
        row_of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        of_toxic = toxic[row_of]
        bad, good = np.bincount(flat[of_toxic], minlength=BUCKETS), np.bincount(flat[~of_toxic], minlength=BUCKETS)
        n_bad, n_good = toxic.sum(), (~toxic).sum()
        rate_all = (bad + good) / len(toxic)
        z = (bad / n_bad - good / n_good) / np.sqrt(np.maximum(rate_all * (1 - rate_all), 1e-9) * (1 / n_bad + 1 / n_good))
        chosen = np.flatnonzero((z >= LEAST_Z) & (bad >= LEAST_TEXTS) & (good / n_good <= MOST_CLEAN * bad / n_bad))
        place = np.full(BUCKETS, -1)
        place[chosen] = np.arange(len(chosen))
        held = place[flat] >= 0
        at, row = place[flat[held]], row_of[held]
        marks = np.bincount(row, minlength=len(rows))
        grade = np.zeros(len(rows), int)
        cuts = np.quantile(marks[toxic], [1 / 3, 2 / 3])
        grade[toxic] = 1 + np.searchsorted(cuts, marks[toxic], side="left")
        w, t = np.zeros(len(chosen)), np.array([1.0, 0.0, 0.0])  # the first threshold, then logs of the steps between them
        gw, gt = np.full(len(chosen), 1e-6), np.full(GRADES, 1e-6)
        share = np.where(toxic, 0.5 / n_bad, 0.5 / n_good)
        for _ in range(steps):
            theta = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
            eta = np.bincount(row, w[at], len(rows))
            f = logistic(eta[:, None] - theta)
            upper = np.concatenate([np.ones((len(rows), 1)), f, np.zeros((len(rows), 1))], axis=1)
            take = np.arange(len(rows))
            a, b = upper[take, grade], upper[take, grade + 1]
            p = np.maximum(a - b, 1e-9)
            d_eta = (1 - a - b) * share
            d_theta = np.zeros(GRADES)
            np.add.at(d_theta, grade[grade > 0] - 1, (-a * (1 - a) / p * share)[grade > 0])
            np.add.at(d_theta, grade[grade < GRADES], (b * (1 - b) / p * share)[grade < GRADES])
            dw = np.bincount(at, d_eta[row], len(chosen)) - l2 * w / max(1, len(chosen)) ** 0.5
            dt = np.array([d_theta.sum(), *[d_theta[j:].sum() * np.exp(t[j]) for j in range(1, GRADES)]])
            gw += dw * dw
            gt += dt * dt
            w = np.maximum(0.0, w + rate * dw / np.sqrt(gw))
            t += rate * dt / np.sqrt(gt)
        self.thresholds = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
        self.weights = dict(zip(chosen.tolist(), w.tolist(), strict=True))
        return self

    def margins(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        weights, out = self.weights, np.zeros(len(texts))
        for i, text in enumerate(texts):
            if len(known) > CACHE_WORDS:
                known.clear()
            total = 0.0
            for word in sorted(distinct_words(text)):
                part = known.get(word)
                if part is None:
                    part = known[word] = sum(weights.get(f, 0.0) for f in word_features(word))
                total += part
            out[i] = total
        return out

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), P(grade >= 3) of each text."""
        return logistic(margins[:, None] - self.thresholds)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> OrdinalRegression | None:
    """A regression fitted on at most ``rows`` labelled texts of each class."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    first = lambda kind: known.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    some = first(F.col("toxic") > 0).unionByName(first(F.col("toxic") <= 0))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))

    @F.pandas_udf("struct<n:int,least:long,ids:array<int>>")
    def sparse(batch: pd.Series) -> pd.DataFrame:
        sets = [distinct_words(t) for t in batch]
        return pd.DataFrame({"n": [len(s) for s in sets], "least": [least_hash(t) for t in batch], "ids": [sorted({f for w in s for f in word_features(w)}) for s in sets]})

    got = texts.select("doc_id", "toxic", sparse("text").alias("f")).select("doc_id", "toxic", "f.n", "f.least", "f.ids").toPandas()
    got = got.sort_values(["doc_id", "n"]).drop_duplicates("least")
    toxic = got["toxic"].to_numpy() > 0
    if not toxic.any() or toxic.all():
        return None
    return OrdinalRegression().fit(got["ids"].tolist(), toxic)


def grade_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, severity (0 to 3), p_toxic, grade (likeliest), toxic."""
    model = train(docs, labels, rows)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).alias("grade"), F.lit(False).alias("toxic"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<severity:double,p_toxic:double,grade:int>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for batch in batches:
            p = sent.value.at_least(sent.value.margins(batch.tolist(), known))
            each = -np.diff(np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], axis=1), axis=1)
            yield pd.DataFrame({"severity": p.sum(axis=1), "p_toxic": p[:, 0], "grade": each.argmax(axis=1)})

    scored = docs.select("doc_id", score(text_or_empty()).alias("s")).select("doc_id", "s.severity", "s.p_toxic", "s.grade")
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)
