"""Quality rules: log-likelihood ratio of hashed n-grams, trusted target against raw corpus.

Every document gives its byte n-grams (n = 4, hashed to 65,536 buckets).  One
multinomial is estimated from trusted documents, one from all documents.  The
mean log ratio per n-gram is a document's score; a fixed threshold, fitted on
labelled rows that the target did not use, decides on every document alike.

Counts of the raw corpus cover all documents: each task adds up its own, Spark
adds up by bucket, and only the table of buckets (a fixed size) reaches the
driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmframe.llm.annotate import annotate
from swarmframe.llm.store import fitted
from swarmframe.llm.textbuf import Words, first_of_equals, slices, text_buffer

BUCKETS = 1 << 16
WIDTH = 4
#: Labelled rows that the target and the threshold may use.
LABELLED_BOUND = 6_000
#: Every so many of the labelled rows sets the threshold instead of the target.
CALIBRATE_EVERY = 3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

BASE_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte n-grams that lie in one text, and the n + 1 offsets of each text's."""
    n = len(data)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    code = np.zeros(n - WIDTH + 1, dtype=np.uint32)
    for k in range(WIDTH):
        code |= data[k : n - WIDTH + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(16)
    inside = np.ones(len(code), dtype=bool)
    for k in range(1, WIDTH):
        cut = offsets[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(code))]] = False
    kept = np.zeros(len(code) + 1, dtype=np.int64)
    np.cumsum(inside, out=kept[1:])
    return code[inside], kept[np.minimum(offsets, len(code))]


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """Counts of each bucket over all texts of docs."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                codes, _ = ngram_buckets(*text_buffer(part.column(0)))
                total += np.bincount(codes, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


@dataclass(frozen=True)
class QualityModel:
    """ratio: log p_target / p_raw of each bucket; threshold: the least score that is kept."""

    ratio: np.ndarray
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, at = ngram_buckets(data, offsets)
        sums = np.zeros(len(codes) + 1)
        np.cumsum(self.ratio[codes], out=sums[1:])
        return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the gap that separates the two best; wrongly dropped good rows cost twice."""
    if len(good) == 0:
        return -np.inf
    if len(bad) == 0:
        return float(good.min() - abs(good.min()) - 0.5)
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    passed = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    cost = 2 * lost + passed
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    gaps = np.concatenate([[0.0], values[1:] - values[:-1]])[best]
    return float(cuts[best[np.argmax(gaps)]])


def fit(docs: DataFrame, labelled: DataFrame) -> QualityModel:
    """docs: the raw corpus (text). labelled: (doc_id, text, label) of a bounded sample, label 1 trusted.

    With no trusted row nothing is rejected by the ratio.
    """
    raw = bucket_counts(docs)
    return fitted(labelled.select("doc_id", "text", "label"), lambda rows: _fit(raw, rows))


def _fit(raw: np.ndarray, rows: pa.Table) -> QualityModel:
    parts = [p for batch in rows.to_batches() for p in slices(batch)]
    label = rows["label"].to_numpy()
    if not (label == 1).any():
        return QualityModel(np.zeros(BUCKETS, np.float32), -np.inf)
    # copies of one text go to the same part, or the threshold would see what the target has seen
    held = np.array([zlib.crc32((t or "").encode()) % CALIBRATE_EVERY == 0 for p in parts for t in p.column("text").to_pylist()])
    use = (label == 1) & ~held
    if not use.any():
        use = label == 1
    target, at_row = np.zeros(BUCKETS, np.int64), 0
    for part in parts:
        codes, at = ngram_buckets(*text_buffer(part.column("text")))
        chosen = np.repeat(use[at_row : at_row + len(part)], np.diff(at))
        target += np.bincount(codes[chosen], minlength=BUCKETS)
        at_row += len(part)
    prior = (raw + 1.0) / (raw.sum() + BUCKETS)
    # the raw multinomial smooths the target, so what the sample has not met stays near zero
    smooth = 0.02 * max(1, target.sum())
    p = (target + smooth * prior) / (target.sum() + smooth)
    ratio = np.log(p / prior).astype(np.float32)
    model = QualityModel(ratio, -np.inf)
    score = np.concatenate([model.scores(*text_buffer(part.column("text"))) for part in parts])
    failed = np.concatenate([base_metrics(Words.of(part.column("text")))["base_failed"] for part in parts])
    held &= ~failed
    if not (held & (label == 0)).any() or not (held & (label == 1)).any():
        held = ~failed
    return QualityModel(ratio, best_threshold(score[held & (label == 1)], score[held & (label == 0)]))


def base_metrics(words: Words) -> dict[str, np.ndarray]:
    n_docs = len(words.counts)
    chars = words.solid & ((words.data & 0xC0) != 0x80)
    starts, ends, line_doc = words.lines()
    # lines part words, so a line holds a word iff one begins in it
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, line_doc = starts[filled], ends[filled], line_doc[filled]
    again, _ = first_of_equals(line_doc, words.span_hash(starts, ends))
    first, grams = words.ngrams(3, words.hashes())
    _, times = first_of_equals(words.doc[first], grams)
    covered = np.zeros(len(words.starts), dtype=bool)
    for k in range(3):
        covered[first[times >= 2] + k] = True
    n_repeat = np.bincount(words.doc[covered], minlength=n_docs)
    n_words = words.counts
    return {
        "n_words": n_words,
        "word_chars": words.per_doc(chars),
        "n_symbols": words.per_doc(_SYMBOL[words.data]),
        "n_dup_lines": np.bincount(line_doc[again], minlength=n_docs),
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < 50) | (100 * n_repeat > 50 * n_words),
    }


def apply(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the base figures, llr (mean log ratio) and kept, for every row of docs.

    Null and empty texts have no words, fail the base rules and are not kept.
    """

    def run(part):
        words = Words.of(part.column("text"))
        out = base_metrics(words)
        out["llr"] = model.scores(words.data, words.text_offsets)
        out["kept"] = ~out["base_failed"] & (out["llr"] >= model.threshold)
        return out

    return annotate(docs, run, f"{BASE_FIELDS}, kept boolean, llr double", keep)
