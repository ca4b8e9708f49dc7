"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a linear model that minimises the non-negative unbiased risk: positives
counted with the class prior, unlabelled rows as negatives, less the positives hidden among them, never below zero.
The prior is estimated over all documents: where a first model scores highest, next to no negatives are left, so the
share of documents there against the share of positives there bounds the prior from above.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm._shared import drop_settled, give_back, lean, read_table, settle, text_slices

MAX_POSITIVES = 40_000  # defaults of ``fit``: rows that weights are fitted on, drawn evenly by hash
MAX_UNLABELLED = 80_000
BINS = 256  # of the score histograms that the prior comes from
THRESHOLD = 0.3

# ------------------------------------------------------------------- features

_SETS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".,;:", b"!?",
    b"'\"-", b"()[]{}<>", b"$#*%&@|_=+/\\~^`", bytes(range(128, 256)),
]
CLASSES = len(_SETS) + 1
_CLASS = np.full(256, CLASSES - 1, dtype=np.int64)
for _k, _s in enumerate(_SETS):
    _CLASS[list(_s)] = _k
EXTRAS = 8
WIDTH = CLASSES * CLASSES + EXTRAS


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text (of a slice): how often each class of byte follows each, and eight figures on words and lines."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    pairs = CLASSES * CLASSES
    size = np.array([len(t) for t in texts], dtype=np.int64)
    kinds = _CLASS[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    row = np.repeat(np.arange(len(texts)), size)
    same = row[1:] == row[:-1]
    code = (row[1:] * pairs + kinds[:-1] * CLASSES + kinds[1:])[same]
    count = np.bincount(code, minlength=len(texts) * pairs).reshape(len(texts), pairs)
    out[:, :pairs] = np.sqrt(count / np.maximum(1, size - 1)[:, None])
    for i, text in enumerate(texts):
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        n, m = max(1, len(words)), max(1, len(lines))
        long = max(map(len, words), default=0)
        out[i, pairs:] = (
            np.log1p(len(text)) / 10,
            len(set(words)) / n,
            len(text) / n / 20,
            1 - len(set(lines)) / m,
            np.log1p(len(text) / m) / 10,
            np.log1p(long) / 5,
            sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / m,
            np.log1p(len(words) / m) / 5,
        )
    return out


def stored_features(texts: list[bytes]) -> np.ndarray:
    """Features as they are stored and scored: 16-bit floats."""
    return features(texts).astype(np.float16)


def feature_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x): the features of every text as 16-bit floats."""

    @partial(lean, owner="quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                x = stored_features(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "x"]
                )

    return docs.select(key, text).mapInArrow(run, "key long, x binary")


def as_matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float16).astype(np.float32).reshape(-1, WIDTH)


# ------------------------------------------------------------------- the model


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, non_negative: bool = True, epochs: int = 60, seed: int = 7, decay: float = 1e-4) -> Model:
    """Adam on the non-negative risk with the logistic loss, in batches of both kinds.

    Where the negative part of a batch falls below zero, its gradient is taken the other way, which undoes the
    overfitting that caused it. Without ``non_negative`` it is plain positives against unlabelled rows.
    """
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.02
    p, u = positive - mean, unlabelled - mean
    for x in (p, u):  # in place: the driver holds the drawn rows once more, not twice
        x /= scale
    rng = np.random.default_rng(seed)
    w, b = np.zeros(p.shape[1]), 0.0
    moment, square, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    size = 2048
    rounds = max(1, -(-len(u) // size))
    for epoch in range(epochs):
        rate = 0.02 / (1 + epoch / 8)
        order_u, order_p = rng.permutation(len(u)), rng.permutation(len(p))
        for k in range(rounds):
            xu = u[order_u[k * size : (k + 1) * size]]
            xp = p[np.take(order_p, np.arange(k * size, k * size + min(size, len(p))), mode="wrap")]
            sp, su = _sigmoid(xp @ w + b), _sigmoid(xu @ w + b)
            if non_negative:
                # losses: positive -log s, negative -log(1 - s); their slopes in z: s - 1 and s
                hidden = prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-9)))
                negative = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-9))) - hidden
                gp, gu = prior * (sp - 1) / len(sp), su / len(su)
                if negative >= 0:
                    gp = gp - prior * sp / len(sp)
                else:
                    gp, gu = prior * sp / len(sp), -su / len(su)
            else:
                gp, gu = 0.5 * (sp - 1) / len(sp), 0.5 * su / len(su)
            g = np.append(gp @ xp + gu @ xu + decay * w, gp.sum() + gu.sum())
            step += 1
            moment = 0.9 * moment + 0.1 * g
            square = 0.999 * square + 0.001 * g * g
            move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return Model(mean.astype(np.float32), scale.astype(np.float32), w.astype(np.float32), float(b), prior)


def estimate_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """The class prior from histograms of scores, lowest bin first: the least upper bound over the upper tails.

    Each tail's bound is its share of all rows over its share of positives, both moved against it by a
    two-sigma margin, so thin tails do not win by chance.
    """
    u, p = (np.cumsum(h[::-1]) for h in (unlabelled.astype(float), positive.astype(float)))
    if not len(u) or u[-1] == 0 or p[-1] == 0:
        return 0.5
    share_u, share_p = u / u[-1], p / p[-1]
    margin_u = 2 * np.sqrt(share_u * (1 - share_u) / u[-1] + 1 / u[-1] ** 2)
    margin_p = 2 * np.sqrt(share_p * (1 - share_p) / p[-1] + 1 / p[-1] ** 2)
    bound = (share_u + margin_u) / np.maximum(share_p - margin_p, 1e-9)
    return float(np.clip(bound[share_p > 0.05].min(initial=1.0), 0.02, 0.98))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0. Null ids are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _draw(df: DataFrame, most: int) -> np.ndarray:
    """Features of at most about ``most`` rows (binomially, by hash of key and features), in the order of their bytes."""
    rows = df.count()
    keep = 1.0 if rows <= most else most / rows
    mark = F.pmod(F.xxhash64("key", "x"), F.lit(1 << 30)) < F.lit(int(keep * (1 << 30)))
    return as_matrix(sorted(df.where(mark).select("x").toArrow().column("x").to_pylist()))


def score_histogram(table: DataFrame, model: Model) -> np.ndarray:
    """How many rows score in each of BINS bins of the model's logit rank, over all rows."""

    @partial(lean, owner="quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                z = model.score(as_matrix(batch.column(0).to_pylist()))
                total += np.bincount(np.minimum((z * BINS).astype(int), BINS - 1), minlength=BINS)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(range(BINS), pa.int32()), "n": pa.array(total, pa.int64())})

    out = np.zeros(BINS)
    for r in table.select("x").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r.bin] = r.n
    return out


def fit(table: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Learn from a feature table and labels (doc_id, quality); None where there is nothing to learn from.

    The weights are fitted on about ``max_positives`` trusted positives and ``max_unlabelled`` other rows at most, drawn
    evenly by hash from all; the class prior is estimated over all rows.
    Trusted positives are documents whose every label outside the held-out fold is 1; labels of 0 are not used.
    """
    trusted = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("key"))
        .agg(F.min("quality").alias("least"))
        .where("least = 1")
        .select("key")
    )
    positives = settle(table.join(trusted, "key", "left_semi"), "positives")
    p, u = _draw(positives, max_positives), _draw(table, max_unlabelled)
    if not len(p) or not len(u):
        return None
    first = fit_pu(p, u, 0.5, non_negative=False, epochs=20)
    prior = estimate_prior(score_histogram(table, first), score_histogram(positives, first))
    drop_settled(positives)
    model = fit_pu(p, u, prior)
    del p, u
    give_back()
    return model


def score_column(model: Model | None, x: np.ndarray) -> np.ndarray:
    return model.score(x) if model else np.full(len(x), 0.5)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, prior) of every document.

    Null and empty texts get the score of an empty text; null ids are held out of nothing and scored like others;
    repeated rows repeat their score. Without any trusted positive all scores are 0.5. Only doc_id and text are
    read of the documents, doc_id and quality of the labels.
    """
    table = settle(feature_table(docs, "doc_id", "text"), "features")
    model = fit(table, labels)

    @partial(lean, owner="quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_column(model, as_matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["key", "score"])

    scored = table.mapInArrow(run, "key long, score double")
    return scored.select(
        F.col("key").alias("doc_id"),
        held_out(F.col("key")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.lit(model.prior if model else 0.5).alias("prior"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the threshold."""
    table = settle(feature_table(docs, "doc_id", "text"), "features")
    model = fit(table, labels)
    schema = docs.schema
    at = docs.columns.index("text")

    @partial(lean, owner="quality")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(score_column(model, stored_features(texts).astype(np.float32)) >= THRESHOLD))

    return docs.mapInArrow(run, schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
