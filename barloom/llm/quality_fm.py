"""Operator 4, quality classifier: a factorisation machine.

Features of a text are its hashed words, weighted by frequency and scaled to
unit length, and one bin for each of the statistics of its structure and
lengths.  The machine has a bias, a weight for each feature and low-rank
vectors whose inner products weigh all pairs of features; a text is scored in
time linear in its features by the identity
sum over pairs <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.

It is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the
id; scoring runs on all rows.  Neither labels nor id, language or source are
inputs of a score.

Defined results: null texts count as empty, and an empty text gets the score
of its structure.  Without any labelled rows every score is 1.0, as nothing
speaks against a text.  Rows with a null id are scored and count as not held
out.  Very long texts are scored whole.  Equal texts get equal scores, and
repeated rows a row each.  Further columns are not read (``keep_good`` returns
them), whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, spare_name, text_or_empty
from .words import BINS, STRUCTURES, HashedWords, structure

WORD_BUCKETS = 1 << 17
FEATURES = WORD_BUCKETS + STRUCTURES * BINS
TRAIN_ROWS = 8000
FACTORS = 8
THRESHOLD = 0.7


def features(texts: list[str], hashed: HashedWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, values and row starts of the features of texts."""
    ids, values, sizes = [], [], []
    offsets = WORD_BUCKETS + np.arange(STRUCTURES) * BINS
    for text in texts:
        words = text.lower().split()
        counts = Counter(words)
        own = np.array(hashed.ids(list(counts)), np.int32)
        x = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
        ids += [own, (offsets + structure(text, words, counts)).astype(np.int32)]
        values += [x / max(1e-6, float(np.sqrt(x @ x))), np.ones(STRUCTURES, np.float32)]
        sizes.append(len(own) + STRUCTURES)
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return join(ids, np.int32), join(values, np.float32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


class FactorisationMachine:
    """Bias, weights and factors; fitted by AdaGrad on the logistic loss."""

    def __init__(self, n: int = FEATURES, factors: int = FACTORS, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (n, factors)).astype(np.float32)

    def margin(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[ids] * x[:, None]
        total = np.add.reduceat(vx, starts[:-1], axis=0)
        squares = np.add.reduceat(vx * vx, starts[:-1], axis=0)
        linear = np.add.reduceat(self.w[ids] * x, starts[:-1])
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1), vx, total

    def score(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each text's probability; a text's score does not depend on the others in its batch."""
        if len(starts) < 2:
            return np.zeros(0)
        z = self.margin(ids, x, starts)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.08, l2: float = 1e-5, batch: int = 128, seed: int = 7) -> FactorisationMachine:
        rng, n = np.random.default_rng(seed), len(y)
        self.bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        gw, gv, gb = np.full(self.w.shape, 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(n)
            for rows in np.array_split(order, max(1, n // batch)):
                take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
                size = starts[rows + 1] - starts[rows]
                own = np.concatenate([[0], np.cumsum(size)])
                i, xi = ids[take], x[take]
                z, vx, total = self.margin(i, xi, own)
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
                each = np.repeat(g, size).astype(np.float32)
                used, back = np.unique(i, return_inverse=True)
                dw = np.bincount(back, each * xi, len(used)).astype(np.float32) + l2 * self.w[used]
                push = (each * xi)[:, None] * (np.repeat(total, size, axis=0) - vx)
                dv = np.stack([np.bincount(back, push[:, f], len(used)) for f in range(push.shape[1])], axis=1).astype(np.float32) + l2 * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += float(g.sum()) ** 2
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.bias -= rate * float(g.sum()) / np.sqrt(gb)
        return self


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id must not be learned: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> pa.Table:
    """Features of at most ``rows`` labelled texts that are not held out, chosen by a hash of the id, in order of the id."""
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label"))
    some = wanted.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    hashed = HashedWords(WORD_BUCKETS)

    @F.pandas_udf("struct<ids:array<int>,x:array<float>>")
    def sparse(batch: pd.Series) -> pd.DataFrame:
        ids, x, starts = features(batch.tolist(), hashed)
        cut = lambda a: [a[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)]
        return pd.DataFrame({"ids": cut(ids), "x": cut(x)})

    return one.select("doc_id", "label", sparse("text").alias("f")).select("doc_id", "label", "f.ids", "f.x").orderBy("doc_id").toArrow()


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorisationMachine | None:
    """A machine fitted on the bounded sample, None if there are no labels."""
    bound_batches(docs.sparkSession)
    got = labelled_sample(docs, labels, "quality", rows)
    if not got.num_rows:
        return None
    lists, x = got["ids"].combine_chunks(), got["x"].combine_chunks()
    starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    y = (got["label"].to_numpy() > 0).astype(np.float32)
    ids, x = lists.flatten().to_numpy(), x.flatten().to_numpy()
    del got, lists
    return FactorisationMachine().fit(ids, x, starts, y)


def scorer(docs: DataFrame, model: FactorisationMachine | None):
    """A column function from text to score."""
    if model is None:
        return lambda text: F.lit(1.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, hashed = sent.value, HashedWords(WORD_BUCKETS)
        for batch in batches:
            texts = batch.tolist()
            parts = [machine.score(*features(texts[i : i + 256], hashed)) for i in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scorer(docs, train(docs, labels, rows))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(text_or_empty()).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    name = spare_name(docs, "score")
    scored = docs.withColumn(name, scorer(docs, train(docs, labels, rows))(text_or_empty()))
    return scored.where(F.col(name) >= THRESHOLD).drop(name)
