"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model of hashed byte
n-grams and a few shapes of the text.  It minimises the non-negative unbiased
risk (Kiryo et al. 2017)

    prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])

with the logistic loss, batch by batch; where the second term falls below zero
the step goes back up its gradient.  The positives are a bounded sample of the
labelled rows, the unlabelled are all documents: every task goes over its own and
the tasks' weights are averaged.

The class prior needs no negatives.  A first model tells one half of the
positives from all documents; then, for the other half and all documents,

    prior = least over t of P_u(score >= t) / P_p(score >= t),

since documents scored above t are at least the prior's share of the positives
there.  A logistic curve over the margin, fitted on the labelled rows, turns
margins into probabilities; that is all that negatives are used for.

Null and empty texts have all-zero n-grams and get the score of that point.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.llm.annotate import annotate
from swarmframe.llm.quality_rules import base_metrics, ngram_buckets
from swarmframe.llm.store import fitted
from swarmframe.llm.textbuf import Words, slices

BUCKETS = 2_048
#: Labelled rows (positives are trusted, negatives only calibrate) that the fit may use.
LABELLED_BOUND = 4_000
#: Documents of a step; a task with fewer steps than STEPS goes over its documents again.
BATCH, STEPS, RATE, L2 = 64, 250, 0.02, 1e-4
#: Bins of scores for the prior, and the least share of the positives above a threshold that counts.
BINS, LEAST_SHARE = 400, 0.2
THRESHOLD = 0.7
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True


def features(words: Words) -> np.ndarray:
    """A row for each text: log counts of hashed n-grams at unit length, then the shapes."""
    n_docs = len(words.counts)
    codes, at = ngram_buckets(words.data, words.text_offsets)
    owner = np.repeat(np.arange(n_docs), np.diff(at))
    counts = np.bincount(owner * BUCKETS + (codes >> 5), minlength=n_docs * BUCKETS).reshape(n_docs, BUCKETS)
    grams = np.log1p(counts, dtype=np.float32)
    grams /= np.maximum(np.sqrt((grams * grams).sum(axis=1, keepdims=True)), 1e-9)
    base = base_metrics(words)
    n_bytes = np.maximum(np.diff(words.text_offsets), 1)
    n_words = np.maximum(base["n_words"], 1)
    shapes = np.column_stack([
        base["n_symbols"] / n_bytes * 5,
        words.per_doc(_UPPER[words.data]) / n_bytes * 2,
        words.per_doc(words.data == 0x7C) / n_words,
        words.per_doc(words.data == 0x21) / n_words,
        base["n_repeat_words"] / n_words,
        base["n_dup_lines"] / n_words * 5,
        np.log1p(base["n_words"]) / 8,
    ])
    return np.column_stack([grams * 2, shapes.astype(np.float32)])


@dataclass
class PUModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def scores(self, words: Words) -> np.ndarray:
        margin = features(words) @ self.weights + self.bias
        return 1 / (1 + np.exp(-(self.slope * margin.astype(float) + self.shift)))


class Learner:
    """Adam on the non-negative risk; a step takes a batch of unlabelled rows and as many positives, in turn."""

    def __init__(self, positive: np.ndarray, prior: float, w: np.ndarray, b: float):
        self.positive, self.prior, self.w, self.b = positive, prior, w.copy(), b
        self.m, self.v, self.step, self.at = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0, 0

    def learn(self, unlabelled: np.ndarray) -> None:
        n_u = len(unlabelled)
        p = self.positive.take(np.arange(self.at, self.at + n_u), axis=0, mode="wrap")
        self.at = (self.at + n_u) % len(self.positive)
        x = np.concatenate([p, unlabelled])
        f = x @ self.w + self.b
        s = 1 / (1 + np.exp(-f))
        loss = np.logaddexp(0, f)
        slope = np.empty(len(x), np.float32)
        slope[:n_u] = -self.prior * s[:n_u] / n_u  # of -prior * E_p[l(-f)]
        slope[n_u:] = s[n_u:] / n_u
        if loss[n_u:].mean() >= self.prior * loss[:n_u].mean():
            slope[:n_u] += self.prior * (s[:n_u] - 1) / n_u
        else:
            slope = -slope
        grad = np.append(x.T @ slope + L2 * self.w, slope.sum())
        self.step += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad**2 - self.v)
        move = RATE * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)
        self.w -= move[:-1].astype(np.float32)
        self.b -= float(move[-1])


def _pass(texts: DataFrame, positive: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Weights and bias after all texts: every task starts from w and b and learns from its own; their mean by rows.

    Sums are made in two steps, so no task and not the driver holds more than about
    the square root of the number of tasks at a time.
    """
    groups = max(1, round(texts.rdd.getNumPartitions() ** 0.5))

    def run(batches):
        learner, kept, n = Learner(positive, prior, w, b), [], 0
        for batch in batches:
            for part in slices(batch):
                x = features(Words.of(part.column(0)))
                n += len(x)
                if learner.step < STEPS:
                    kept.append(x.astype(np.float16))
                for at in range(0, len(x), BATCH):
                    learner.learn(x[at : at + BATCH])
        while n and learner.step < STEPS:  # then all of the task's rows are kept
            for x in kept:
                for at in range(0, len(x), BATCH):
                    learner.learn(x[at : at + BATCH].astype(np.float32))
        if n:
            task = TaskContext.get().partitionId()
            flat = np.append(learner.w, learner.b).astype("<f8") * n
            yield pa.RecordBatch.from_arrays([pa.array([task % groups], pa.int32()), pa.array([task], pa.int32()), pa.array([n]), pa.array([flat.tobytes()])], ["g", "task", "n", "weights"])

    def total(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        flat = sum(np.frombuffer(x, "<f8") for x in rows["weights"].to_pylist())
        return pa.table({"g": rows["g"][:1], "n": pa.array([sum(rows["n"].to_pylist())]), "weights": pa.array([flat.tobytes()])})

    rows = texts.mapInArrow(run, "g int, task int, n long, weights binary").groupBy("g").applyInArrow(total, "g int, n long, weights binary").toArrow().sort_by("g")
    if not len(rows):
        return w, b
    flat = sum(np.frombuffer(x, "<f8") for x in rows["weights"].to_pylist()) / sum(rows["n"].to_pylist())
    return flat[:-1].astype(np.float32), float(flat[-1])


def _bins(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    return np.minimum(BINS / (1 + np.exp(-(x @ w + b).astype(float))), BINS - 1).astype(np.int64)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """From counts of scores by bin: the least ratio of the shares above a threshold."""
    above = [np.cumsum(c[::-1]) / max(1, c.sum()) for c in (positive, unlabelled)]
    enough = above[0] >= LEAST_SHARE
    ratio = above[1][enough] / above[0][enough]
    return float(np.clip(ratio.min(initial=1.0), 0.02, 0.98))


def _score_counts(texts: DataFrame, w: np.ndarray, b: float) -> np.ndarray:
    """Numbers of texts by bin of their scores."""

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += np.bincount(_bins(features(Words.of(part.column(0))), w, b), minlength=BINS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bin", "n"])

    rows = texts.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BINS, np.int64)
    counts[rows["bin"].to_numpy()] = rows["n"].to_numpy()
    return counts


def calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the logistic curve; the identity without both labels."""
    from swarmframe.llm.toxicity import fit_logistic

    if len(np.unique(label)) < 2:
        return 1.0, 0.0
    slope, shift = fit_logistic(margin[:, None].astype(float), label.astype(float), l2=1e-3)
    return (float(slope[0]), shift) if slope[0] > 0 else (1.0, 0.0)


def _known(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (half precision), labels, and the half of each labelled row; copies of a text are in one half."""
    made = [features(Words.of(p.column("text"))) for b in rows.to_batches() for p in slices(b)]
    x = np.concatenate(made) if made else np.zeros((0, BUCKETS + 7), np.float32)
    half = np.array([zlib.crc32(t.encode()) >> 8 & 1 for t in rows["text"].to_pylist()], bool)
    return x.astype(np.float16), rows["label"].to_numpy(), half


def fit(labelled: DataFrame, docs: DataFrame) -> PUModel:
    """labelled: (doc_id, text, label) of the training fold, a bounded sample; docs: all documents.

    Without positives every document scores the share of label 1, without any label 0.5.
    """
    x, label, half = fitted(labelled.select("doc_id", "text", "label"), _known)
    x = x.astype(np.float32)
    width = BUCKETS + 7
    if not (label == 1).any():
        share = float(label.mean()) if len(label) else 0.5
        p = min(max(share, 1e-3), 1 - 1e-3)
        return PUModel(np.zeros(width, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))), share)
    texts = docs.select("text")
    first, other = (label == 1) & half, (label == 1) & ~half
    if not first.any() or not other.any():
        first = other = label == 1
    # with a prior of 1/2 the risk tells positives from unlabelled texts
    w, b = _pass(texts, x[first], 0.5, np.zeros(width, np.float32), 0.0)
    prior = estimate_prior(np.bincount(_bins(x[other], w, b), minlength=BINS), _score_counts(texts, w, b))
    w, b = _pass(texts, x[label == 1], prior, np.zeros(width, np.float32), 0.0)
    slope, shift = calibrate(x @ w + b, label)
    return PUModel(w, b, slope, shift, prior)


def apply(docs: DataFrame, model: PUModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score (0 to 1) and predicted (1 if score >= 0.7), for every row of docs."""

    def run(part):
        score = model.scores(Words.of(part.column("text")))
        return {"score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return annotate(docs, run, "score double, predicted int", keep)
