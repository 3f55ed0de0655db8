"""Scores of the learned operators against plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swarmframe.llm import language_model as lm
from swarmframe.llm import quality_rules, toxicity
from swarmframe.llm.textbuf import Words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_the_distance():
    rng = np.random.default_rng(8)
    letters = list("abcñж中")
    word = lambda n: "".join(rng.choice(letters, n))
    words = sorted({word(int(n)) for n in rng.integers(3, 8, 12)})
    stems = ["cab", "жжa"]
    harmless = {word(int(n)) for n in rng.integers(4, 9, 60)}
    a = toxicity.build_automaton(words, stems, harmless)
    tried = {word(int(n)) for n in rng.integers(1, 9, 1_500)} | set(words) | {w[:-1] for w in words} | {w + "x" for w in words} | {"cabx", "cab", "ca"}
    for t in tried - {""}:
        codes = np.array([ord(c) for c in t], np.uint32)
        got = int(a.run(codes, np.array([0]), np.array([len(codes)]))[0])
        exact = t in words or any(t.startswith(s) for s in stems)
        near = any(len(w) >= toxicity.FUZZY_LENGTH and distance(t, w) <= 1 for w in words) and t not in harmless
        assert got == (toxicity.EXACT if exact else toxicity.NEAR if near else toxicity.NONE), t


def test_language_model_gradients():
    """Of a window with texts that begin and places without a token: as differences of the loss in double precision."""
    rng = np.random.default_rng(5)
    gru = lm.Gru(70)
    steps, streams, n = 5, 4, lm.HIDDEN
    source = rng.integers(0, 70 + lm.TAILS + 1, (steps, streams))
    target = rng.integers(0, 70 + lm.TAILS, (steps, streams))
    target[3:, 1] = -1
    fresh = rng.random((steps, streams)) < 0.3
    start = rng.standard_normal((streams, n)).astype(np.float32) * 0.3
    grads = {k: np.zeros_like(v) for k, v in gru.p.items()}
    last, real = gru.gradients(source, target, fresh, start, grads)
    assert real == (target >= 0).sum()

    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - np.log(np.exp(x).sum())

    def loss(p):
        total, ends = 0.0, []
        for s in range(streams):
            h = start[s].astype(float)
            for k in range(steps):
                h = h * (not fresh[k, s])
                gates = p["emb"][source[k, s]] @ p["w"] + p["b"]
                z, r = sigmoid(gates[:n] + h @ p["u"][:, :n]), sigmoid(gates[n : 2 * n] + h @ p["u"][:, n : 2 * n])
                g = np.tanh(gates[2 * n :] + (r * h) @ p["u"][:, 2 * n :])
                h = (1 - z) * g + z * h
                code = target[k, s]
                if code < 0:
                    continue
                classes = log_softmax(h @ p["wc"] + p["bc"])
                if code < 70:
                    span = slice(code // lm.CLASS_SIZE * lm.CLASS_SIZE, (code // lm.CLASS_SIZE + 1) * lm.CLASS_SIZE)
                    total -= classes[code // lm.CLASS_SIZE] + log_softmax(p["wo"][span] @ h + p["bo"][span])[code % lm.CLASS_SIZE]
                else:
                    total -= classes[gru.classes + code - 70]
            ends.append(h)
        return total, np.array(ends)

    p = {k: v.astype(float) for k, v in gru.p.items()}
    assert np.allclose(loss(p)[1], last, atol=1e-5)
    for k, g in grads.items():
        for at in np.argsort(-np.abs(g.ravel()))[: 6 * 9 : 9].tolist() + rng.integers(0, g.size, 4).tolist():
            if p[k].ravel()[at] < -1e8:  # a place of the last class that no word has
                continue
            was, ends = p[k].flat[at], []
            for by in (1e-5, -1e-5):
                p[k].flat[at] = was + by
                ends.append(loss(p)[0])
            p[k].flat[at] = was
            assert abs((ends[0] - ends[1]) / 2e-5 - g.flat[at]) < 1e-3 * (1 + abs(g.flat[at])), (k, at)


def test_language_model_score(spark, sf):
    """The state runs on from token to token over the whole text; rare words share their class by add-one counts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text")).limit(60)
    model = lm.fit(docs, epochs=1)
    rows = {r["doc_id"]: r for r in lm.score(docs, model).collect()}
    given = docs.collect()
    counts, tails = {}, {}
    tokens = {}
    for r in given:
        keys, _ = lm.keys_of(Words.of(pa.array([r["text"]])))
        tokens[r["doc_id"]] = keys.tolist()
        if not rows[r["doc_id"]]["held_out"]:
            for k in keys.tolist():
                counts[k] = counts.get(k, 0) + 1
    place = dict(zip(model.vocabulary.keys.tolist(), model.vocabulary.place.tolist(), strict=True))
    head, p = model.gru.head, model.gru.p
    mass = dict.fromkeys(range(lm.TAILS), 1.0)
    for k, c in counts.items():
        if place.get(k, head) >= head:
            mass[k % lm.TAILS] += c + 1
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n = lm.HIDDEN
    for i, keys in list(tokens.items())[::6]:
        h, x, total = np.zeros(n), head + lm.TAILS, 0.0
        for k in keys:
            gates = p["emb"][x].astype(float) @ p["w"] + p["b"]
            z, r = sigmoid(gates[:n] + h @ p["u"][:, :n]), sigmoid(gates[n : 2 * n] + h @ p["u"][:, n : 2 * n])
            g = np.tanh(gates[2 * n :] + (r * h) @ p["u"][:, 2 * n :])
            h = (1 - z) * g + z * h
            at = place.get(k, -1)
            code = at if 0 <= at < head else head + k % lm.TAILS
            logits = h @ p["wc"] + p["bc"]
            cls = code // lm.CLASS_SIZE if code < head else model.gru.classes + code - head
            total += logits[cls] - math.log(np.exp(logits).sum())
            if code < head:
                span = slice(cls * lm.CLASS_SIZE, (cls + 1) * lm.CLASS_SIZE)
                inner = p["wo"][span] @ h + p["bo"][span]
                total += inner[code - cls * lm.CLASS_SIZE] - math.log(np.exp(inner).sum())
            else:
                total += math.log((counts.get(k, 0) + 1) / mass[k % lm.TAILS])
            x = code
        assert rows[i]["score"] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


def test_training_goes_over_segments():
    """Every token is a target once, also those of texts longer than a segment."""
    lengths = np.array([3, lm.SEGMENT, lm.SEGMENT + 1, 5 * lm.SEGMENT + 7, 1])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    target, fresh = lm._streams(np.arange(offsets[-1]), offsets)
    assert sorted(target[target >= 0].tolist()) == list(range(offsets[-1]))
    assert fresh.sum() == sum(-(-n // lm.SEGMENT) for n in lengths) and set(offsets[:-1]) <= set(target[fresh].tolist())


def test_quality_ratio(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = docs.select("doc_id", "text", (~F.col("text").contains("***")).cast("int").alias("label"))
    model = quality_rules.fit(docs, labelled)
    rows = {r["doc_id"]: r for r in quality_rules.apply(docs, model).collect()}
    for r in docs.collect()[::7]:
        data = (r["text"] or "").encode()
        grams = [int.from_bytes(data[k : k + 4], "little") * 0x9E3779B1 % (1 << 32) >> 16 for k in range(len(data) - 3)]
        llr = sum(float(model.ratio[g]) for g in grams) / max(len(grams), 1)
        got = rows[r["doc_id"]]
        assert got["llr"] == pytest.approx(llr, abs=1e-6)
        assert got["kept"] == (not got["base_failed"] and got["llr"] >= model.threshold)
    raw = quality_rules.bucket_counts(docs)
    want = np.zeros(quality_rules.BUCKETS, np.int64)
    for r in docs.collect():
        data = (r["text"] or "").encode()
        for k in range(len(data) - 3):
            want[int.from_bytes(data[k : k + 4], "little") * 0x9E3779B1 % (1 << 32) >> 16] += 1
    assert (raw == want).all()
