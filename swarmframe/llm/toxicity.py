"""Toxicity: Levenshtein automata intersected with a lexicon trie, read in context windows.

1. A lexicon is learned from a bounded sample of labelled documents: words, and
   stems (a word's beginning, any ending), that mark toxic documents far beyond
   chance.
2. The trie of its words meets the Levenshtein automaton of distance 1 (words of
   five letters or more; stems and shorter words match exactly).  The product is
   made deterministic by subset construction, giving one table of transitions.
   Forms that the sample's other documents use (a near miss that is a word of
   its own) are accepted as harmless in the same table.
3. All words of a slice of texts run through the table at once, code point by
   code point.  Words are cut by the Unicode letters that the lexicon is learned on.
4. A hit is weighed by a window of eight words around it: inside quotation marks
   or beside a word of reporting it counts as quoted, otherwise as abuse.
5. A logistic model of these counts, fitted on the same sample, gives the score.

Null and empty texts have no hits and get the score of a document without hits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swarmframe.llm.annotate import annotate
from swarmframe.llm.store import fitted
from swarmframe.llm.textbuf import Words, slices, text_buffer

#: Labelled rows that the lexicon and the weights may use.
LABELLED_BOUND = 8_000
#: Shortest word that may match at distance 1, and lengths of stems, in letters.
FUZZY_LENGTH = 5
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
WINDOW = 8
THRESHOLD = 0.7

#: Words of reporting in the four languages of the texts: fixed values.
REPORTING = (
    "said says wrote called quote quoted quoting word term "
    "dit disait cite mot terme "
    "sagte schrieb nannte zitat wort begriff "
    "dijo cita palabra llamó término"
).split()

_LETTERS = re.compile(r"[^\W_]+")


# ---------------------------------------------------------------- the lexicon


def learn_lexicon(texts: list[str], label: np.ndarray) -> tuple[list[str], list[str], set[str]]:
    """Words and stems that mark label 1, and the forms that other documents use.

    A candidate must be a mark of nearly only toxic texts (0.9) and so frequent
    there that no candidate of its kind would be by chance.  Copies and near
    copies of a text (same three least word hashes) count once.  Candidates are
    taken greedily by the texts they newly explain; then words that no other
    text uses join them on their own evidence.
    """
    seen: set[tuple[int, ...]] = set()
    toxic: dict[str, set[int]] = defaultdict(set)
    other: Counter[str] = Counter()
    n_toxic = n_other = 0
    harmless: set[str] = set()
    for i, text in enumerate(texts):
        words = set(_LETTERS.findall(text.lower()))
        sketch = tuple(sorted(zlib.crc32(w.encode()) for w in words)[:3])
        if sketch in seen:
            if not label[i]:
                harmless |= words
            continue
        seen.add(sketch)
        marks = words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}
        if label[i]:
            n_toxic += 1
            for m in marks:
                toxic[m].add(i)
        else:
            n_other += 1
            other.update(marks)
            harmless |= words
    if not n_toxic or not n_other:
        return [], [], harmless
    base = n_toxic / (n_toxic + n_other)
    support = Counter(len(v) for v in toxic.values())
    as_frequent = {k: sum(n for s, n in support.items() if s >= k) for k in support}

    def gain(m: str) -> bool:
        a, b = len(toxic[m]), other[m]
        rate = a / (a + b)
        if a < 3 or rate < 0.9:
            return False
        evidence = a * np.log(rate / base) + (b * np.log((1 - rate) / (1 - base)) if b else 0)
        return evidence > np.log(as_frequent[a]) + 5

    candidates = {m for m in toxic if gain(m)}
    certain = {m for m in candidates if not m.endswith("*") and not other[m] and len(toxic[m]) >= 8}
    words, stems, explained = [], [], set()
    while candidates:
        new = {m: len(toxic[m] - explained) for m in candidates}
        candidates = {m for m in candidates if new[m] >= 3}
        if not candidates:
            break
        # the fewest other texts, then the longest mark, decides between equals
        best = min(candidates, key=lambda m: (-new[m] + 3 * other[m], other[m], m.endswith("*"), -len(m), m))
        explained |= toxic[best]
        candidates.discard(best)
        (stems if best.endswith("*") else words).append(best.rstrip("*"))
    known = set(words)
    words += [m for m in certain if m not in known and not m.startswith(tuple(stems))]
    return sorted(words), sorted(stems), harmless


# -------------------------------------------------------------- the automaton

#: Kinds of acceptance.
NONE, EXACT, NEAR = 0, 1, 2


@dataclass
class Automaton:
    """next[state * n_classes + class]; accept by state; state 0 is the dead one, 1 the start."""

    classes: np.ndarray
    next: np.ndarray
    accept: np.ndarray
    n_classes: int
    #: class of each code point; 0, the last one's too, is that of all that no entry uses
    lexicon: list[str] = field(default_factory=list)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The kind of acceptance of each span of code points; all spans step at once, dead ones leave."""
        out = np.zeros(len(starts), dtype=np.int8)
        alive = np.arange(len(starts))
        at, last = starts.copy(), ends
        state = np.ones(len(starts), dtype=np.int32)
        while len(alive):
            state = self.next[state * self.n_classes + self.classes.take(data[at], mode="clip")]
            at = at + 1
            done = at >= last
            if done.any():
                out[alive[done]] = self.accept[state[done]]
            go = ~done & (state != 0)
            alive, at, last, state = alive[go], at[go], last[go], state[go]
        return out


def _trie(words: list[str]) -> tuple[list[dict[int, int]], dict[int, str]]:
    children: list[dict[int, int]] = [{}]
    final = {}
    for w in words:
        node = 0
        for b in map(ord, w):
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
            node = children[node][b]
        final[node] = w
    return children, final


def build_automaton(words: list[str], stems: list[str], harmless: set[str]) -> Automaton:
    """Subset construction of (trie node, edits) for words, (trie node) for stems and exact forms."""
    fuzzy = [w for w in words if len(w) >= FUZZY_LENGTH]
    near = _near_forms(fuzzy, harmless)
    ftrie, ffinal = _trie(fuzzy)
    etrie, efinal = _trie(words)
    strie, sfinal = _trie(stems)
    htrie, hfinal = _trie(sorted(near))
    used = sorted({b for t in (ftrie, etrie, strie, htrie) for c in t for b in c})
    classes = np.zeros(max(used, default=0) + 2, dtype=np.int32)
    for k, b in enumerate(used):
        classes[b] = k + 1
    n_classes = len(used) + 1  # class 0: every letter that no entry uses

    def closure(nodes: set[tuple[int, int]]) -> frozenset:
        out, todo = set(nodes), list(nodes)
        while todo:  # a letter of the entry may be missing
            node, e = todo.pop()
            if e == 0:
                for child in ftrie[node].values():
                    if (child, 1) not in out:
                        out.add((child, 1))
                        todo.append((child, 1))
        return frozenset(out)

    def step(state, letter: int | None):
        nodes, exact, stem, harm = state
        new: set[tuple[int, int]] = set()
        for node, e in nodes:
            if letter is not None and letter in ftrie[node]:
                new.add((ftrie[node][letter], e))
            if e == 0:
                new.add((node, 1))
                new.update((child, 1) for child in ftrie[node].values())
        follow = lambda trie, at: trie[at].get(letter, -1) if at >= 0 and letter is not None else -1
        stem_next = -2 if stem == -2 else follow(strie, stem)
        if stem_next in sfinal:
            stem_next = -2  # accepted, whatever follows
        return closure(new), follow(etrie, exact), stem_next, follow(htrie, harm)

    start = (closure({(0, 0)}) if fuzzy else frozenset(), 0, 0, 0)
    dead = (frozenset(), -1, -1, -1)
    number, todo, rows, accept = {dead: 0, start: 1}, [start], {0: [0] * n_classes}, {0: NONE}
    while todo:
        state = todo.pop()
        row = []
        for letter in [None, *used]:
            to = step(state, letter)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows[number[state]] = row
        nodes, exact, stem, harm = state
        if stem == -2 or exact in efinal:
            accept[number[state]] = EXACT
        elif harm not in hfinal and any(n in ffinal for n, _ in nodes):
            accept[number[state]] = NEAR
        else:
            accept[number[state]] = NONE
    n = len(number)
    table = np.array([rows[i] for i in range(n)], dtype=np.int32).ravel()
    return Automaton(classes, table, np.array([accept[i] for i in range(n)], dtype=np.int8), n_classes, words + [s + "*" for s in stems])


def _near_forms(fuzzy: list[str], harmless: set[str]) -> set[str]:
    """Forms of harmless texts at distance 1 from an entry."""
    found = set()
    by_length = defaultdict(list)
    for w in fuzzy:
        by_length[len(w)].append(w)
    for e in harmless:
        for size in (len(e) - 1, len(e), len(e) + 1):
            for w in by_length.get(size, ()):
                i = 0
                while i < min(len(e), size) and e[i] == w[i]:
                    i += 1
                j = 0
                while j < min(len(e), size) - i and e[-1 - j] == w[-1 - j]:
                    j += 1
                if max(len(e), size) - i - j == 1:
                    found.add(e)
    return found


# -------------------------------------------------------- hits in their context

_PLANE = 1 << 16


def _lower(code: int) -> int:
    low = chr(code).lower()
    return ord(low) if len(low) == 1 else code


#: Of the first plane's code points; those of the others are rare and looked up one by one.
_LETTER = np.array([chr(c).isalnum() for c in range(_PLANE)])
_LOWER = np.array([_lower(c) for c in range(_PLANE)], dtype=np.uint32)
_REPORTING_FORM = re.compile(r"(?:^|\W)(?:" + "|".join(REPORTING) + r")(?:\W|$)")


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts and the byte at which each begins; a broken one is of no letter."""
    begins = (data & 0xC0) != 0x80
    begins[offsets[offsets < len(data)]] = True
    first = np.flatnonzero(begins)
    head, size = data[first], np.diff(np.append(first, len(data)))
    out = np.where(head < 0x80, head, 0xFFFD).astype(np.uint32)
    for n, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = np.flatnonzero((size == n) & (head >= low) & (head < high))
        found = head[at].astype(np.uint32) - low
        for k in range(1, n):
            found = found << 6 | data[first[at] + k] & 0x3F
        out[at] = np.where(found < 0x110000, found, 0xFFFD)
    return out, first


def letters_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case of code points, and whether they stand in words: letters and digits of any script."""
    near = np.minimum(codes, _PLANE - 1)
    lowered, letters = _LOWER[near], _LETTER[near]
    far = np.flatnonzero(codes >= _PLANE)
    if len(far):
        which, inverse = np.unique(codes[far], return_inverse=True)
        lowered[far] = np.array([_lower(int(c)) for c in which], dtype=np.uint32)[inverse]
        letters[far] = np.array([chr(c).isalnum() for c in which])[inverse]
    return lowered, letters


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "replace")


FEATURES = ("exact", "near", "quoted", "dense", "any")


def hit_features(data: np.ndarray, offsets: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A row of features for each text, and the hits (text, first and last byte, kind, quoted)."""
    n_docs = len(offsets) - 1
    codes, first = code_points(data, offsets)
    lowered, letters = letters_of(codes)
    first = np.append(first, len(data))
    offsets = np.searchsorted(first, offsets)
    edge = np.zeros(len(codes) + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    starts = np.flatnonzero(letters & (edge[:-1] | ~before))
    ends = np.flatnonzero(letters & (edge[1:] | ~after)) + 1
    kind = automaton.run(lowered, starts, ends) if len(starts) else np.zeros(0, np.int8)
    hit = np.flatnonzero(kind)
    doc = np.searchsorted(offsets, starts[hit], side="right") - 1
    quoted = np.zeros(len(hit), dtype=bool)
    dense = np.zeros(len(hit), dtype=np.int64)
    for k, h in enumerate(hit):
        i = doc[k]
        lo, hi = max(h - WINDOW, 0), min(h + WINDOW, len(starts) - 1)
        a, b = max(starts[lo], offsets[i]), min(ends[hi], offsets[i + 1])
        left = _text(lowered[a : starts[h]]).rpartition("\n")[2]
        right = _text(lowered[ends[h] : b]).partition("\n")[0]
        opened = left.count("“") + left.count("«") - left.count("”") - left.count("»") > 0
        opened |= left.count('"') % 2 == 1 and '"' in right
        near_left = " ".join(left.split()[-4:])
        quoted[k] = opened or bool(_REPORTING_FORM.search(near_left))
        dense[k] = np.searchsorted(hit, hi, side="right") - np.searchsorted(hit, lo) - 1
    out = np.zeros((n_docs, len(FEATURES)))
    plain = ~quoted
    exact = kind[hit] == EXACT
    for j, mask in enumerate((plain & exact, plain & ~exact, quoted, plain & (dense > 0), plain)):
        out[:, j] = np.bincount(doc[mask], minlength=n_docs)
    out[:, :4] = np.log1p(out[:, :4])
    out[:, 4] = out[:, 4] > 0
    return out, {"doc": doc, "start": first[starts[hit]], "end": first[ends[hit]], "kind": kind[hit], "quoted": quoted}


# ------------------------------------------------------------------- the model


@dataclass
class ToxicityModel:
    automaton: Automaton
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, _ = hit_features(data, offsets, self.automaton)
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5) -> tuple[np.ndarray, float]:
    """Newton steps on the penalised log-likelihood; the bias is free."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], l2)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-(z @ w)))
        grad = z.T @ (p - y) + penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def fit(labelled: DataFrame) -> ToxicityModel:
    """labelled: (doc_id, text, label) of a bounded sample.

    Without both labels in it, every document scores the share of label 1.  The
    lexicon is learned in a task, and only the model comes to the driver.
    """
    return fitted(labelled.select("doc_id", "text", "label"), _fit)


def _fit(rows: pa.Table) -> ToxicityModel:
    label = rows["label"].to_numpy().astype(float)
    texts = [t or "" for t in rows["text"].to_pylist()]
    automaton = build_automaton(*learn_lexicon(texts, label))
    if len(label) == 0:
        return ToxicityModel(automaton, np.zeros(len(FEATURES)), -3.0)
    x = np.concatenate([hit_features(*text_buffer(p.column("text")), automaton)[0] for b in rows.to_batches() for p in slices(b)])
    weights, bias = fit_logistic(x, label)
    weights = np.maximum(weights, [0, 0, -np.inf, 0, 0])  # no sign of abuse may lower a score
    return ToxicityModel(automaton, weights, bias)


def apply(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score (0 to 1) and predicted (1 if score >= 0.7), for every row of docs."""

    def run(part: pa.RecordBatch):
        score = model.scores(*text_buffer(part.column("text")))
        return {"score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    return annotate(docs, run, "score double, predicted int", keep)


def hits(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, term, near, quoted: one row for each hit in docs."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words.of(part.column("text"))
                _, h = hit_features(words.data, words.text_offsets, model.automaton)
                ids = part.column("doc_id").take(pa.array(h["doc"]))
                terms = [words.data[a:b].tobytes().decode("utf-8", "ignore") for a, b in zip(h["start"], h["end"], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(terms, pa.string()), pa.array(h["kind"] == NEAR), pa.array(h["quoted"])], ["doc_id", "term", "near", "quoted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, term string, near boolean, quoted boolean")
