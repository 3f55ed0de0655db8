"""Byte-pair encoding by a tokenization automaton.

The automaton (Berglund, Martens and van der Merwe, 2024) reads tokens; its paths
are exactly the right tokenizations.  It starts with one state for each base
symbol, every symbol allowed everywhere, and takes one merge gadget for each
merge (u, v) -> w in order of rank k:

* w becomes a state.  An arc p -w-> is there iff p -u-> was there at time k, and
  the arcs that leave w are those that left v at time k.
* the arc u -v-> goes: that pair would have been merged.
* if u = v, the arc u -w-> goes too, since runs merge from the left.

All gadgets are built, in order, when a file is loaded.  Nearly all arcs are there,
so a state's row is kept as the arcs that are not, by the gadget that took them:
gadget k takes (u, v), so it is written to the row of u and to the column of v.  The
state w starts with the row that v had at time k and with the column that u had, which
is what its gadget says; arcs taken from them afterwards stay.  An arc (t, x) is there
iff the row of t and the column of x name no gadget in common.  Rows and columns
together have about 40 entries for each token.

Encoding walks a word's symbols through a trie of arc labels and keeps, for each
position, the one state that has an allowed path to it; arcs that were asked for are
kept in a table of transitions.  Decoding emits the labels of the arcs.

Special tokens in a text are found first, as the tokenizers library does; the
library's own normalizer and pre-tokenizer split words.  Null counts as empty.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from swarmframe.llm.annotate import annotate

#: Entries that a worker's tables may hold before they start afresh; a piece takes about 280 bytes.
PIECES_KEPT = 1_000_000
ARCS_KEPT = 400_000
#: Birth of a token that no text is ever cut into.
NEVER = -2


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


BYTE_SYMBOL = _byte_symbols()
SYMBOL_BYTE = {ord(c): b for b, c in BYTE_SYMBOL.items()}
#: Letters of Latin-1 and Latin Extended-A that normal form C and lower-casing treat one by one.
_LATIN = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
#: The file's own rule for words, and the same for those letters.
_LATIN_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: In UTF-8 after lower-casing: every byte from 0x80 is part of such a letter.
_LATIN_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\t-\r a-z0-9\x80-\xff]+")


class MergeAutomaton:
    """States are token ids; ``arc(t, x)`` tells whether x may follow t."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        size = max(vocab.values()) + 1
        self.born = [-1] * size
        self.size = size
        gadgets = [(vocab[u], vocab[v], vocab[u + v]) for u, v in merges]
        for k, (_, _, w) in enumerate(gadgets):
            self.born[w] = k
        # by token: the gadgets that took arcs which leave it, and which enter it, ascending
        self.leaving: list[list[int]] = [[] for _ in range(size)]
        self.entering: list[list[int]] = [[] for _ in range(size)]
        for k, gadget in enumerate(gadgets):
            self._add_gadget(k, *gadget)
        # labels inside a word and at its end (without the suffix), and the longest of them
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        for token, i in vocab.items():
            n = len(self.symbols(token))
            if self.born[i] >= 0 or n == 1 and self.born[i] != NEVER:
                if suffix and token.endswith(suffix) and token != suffix:
                    self.last[token[: -len(suffix)]] = i
                else:
                    self.inner[token] = i
        if not suffix:
            self.last = self.inner
        self.longest = max(map(len, [*self.inner, *self.last]), default=1)
        self.table: dict[int, bool] = {}

    def symbols(self, token: str) -> list[str]:
        """Base symbols of a token: characters, the last one with the word's end."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = list(token[: -len(self.suffix)])
            body[-1] += self.suffix
            return body
        return list(token)

    def arc(self, t: int, x: int) -> bool:
        cell = t * self.size + x
        known = self.table.get(cell)
        if known is None:
            if len(self.table) >= ARCS_KEPT:
                self.table.clear()
            known = self.table[cell] = set(self.leaving[t]).isdisjoint(self.entering[x])
        return known

    def _add_gadget(self, k: int, u: int, v: int, w: int) -> None:
        """The merge (u, v) -> w of rank k; 2 * k names the arc u -v-> that it takes, 2 * k + 1 the arc u -w->.

        Where an earlier gadget has taken the arc, the pair never stands side by side, and w is no state.
        """
        if self.born[u] == NEVER or self.born[v] == NEVER or not set(self.leaving[u]).isdisjoint(self.entering[v]):
            if self.born[w] == k:
                self.born[w] = NEVER
            return
        self.leaving[u].append(2 * k)
        self.entering[v].append(2 * k)
        if self.born[w] != k:
            return
        self.leaving[w] = self.leaving[v][: bisect_left(self.leaving[v], 2 * k)]
        self.entering[w] = self.entering[u][: bisect_left(self.entering[u], 2 * k)]
        if u == v:
            self.leaving[u].append(2 * k + 1)
            self.entering[w].append(2 * k + 1)

    def encode_sorted(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of pre-split words in ascending order; a word goes on from its prefix in the word before.

        state[j] is the one token that ends at j on an allowed path, come[j] where it begins.
        """
        out, state, come, before = [], [-1], [0], ""
        inner, last, table, size, longest = self.inner.get, self.last.get, self.table, self.size, self.longest
        for piece in pieces:
            n = len(piece)
            same = 0
            for x, y in zip(before, piece, strict=False):
                if x != y:
                    break
                same += 1
            same = min(same, n - 1, len(state) - 1)
            del state[same + 1 :], come[same + 1 :]
            before = piece
            for j in range(same + 1, n + 1):
                label = last if j == n else inner
                for i in range(max(0, j - longest), j):
                    x = label(piece[i:j])
                    if x is None:
                        continue
                    if i:
                        t = state[i]
                        ok = table.get(t * size + x)
                        if ok is None:
                            ok = self.arc(t, x)
                        if not ok:
                            continue
                    state.append(x)
                    come.append(i)
                    break
                else:
                    raise ValueError(f"no path for {piece!r}")
            ids, at = [], n
            while at:
                ids.append(state[at])
                at = come[at]
            out.append(ids[::-1])
            # the last state used the labels of a word's end
            del state[n:], come[n:]
        return out

    def encode(self, piece: str) -> list[int]:
        """Token ids of one pre-split word."""
        return self.encode_sorted([piece])[0] if piece else []


class Encoder:
    """A tokenizers file, encoded word by word through its automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self._special = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        #: whether the file splits and lowers words as _LATIN_PIECE does
        self._latin = _LATIN_RULE in json.dumps(spec["pre_tokenizer"]) and "Lowercase" in json.dumps(spec["normalizer"])
        self._pieces: dict[bytes | int, tuple[bytes, bytes]] = {}
        self._decimal = {i: f" {i}".encode() for i in self.labels}
        self._spaced = {i: f" {t}".encode() for i, t in self.labels.items()}

    def _cut(self, text: str) -> list[bytes | int]:
        """Pre-split words (UTF-8) and ids of special tokens of a text."""
        out, at = [], 0
        for m in self._special.finditer(text) if "<|" in text else ():
            out += [*self._split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[bytes]:
        """Pre-split words; those of Latin texts without a call of the library."""
        if self._latin and _LATIN.fullmatch(text):
            return _LATIN_PIECE.findall(text.lower().encode())
        library = self.library
        normal = library.normalizer.normalize_str(text) if library.normalizer else text
        return [p.translate(SYMBOL_BYTE).encode("latin-1") for p, _ in library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, pieces: set[bytes]) -> None:
        """Put pre-split words into the table of entries."""
        named = sorted((p.decode("latin-1").translate(BYTE_SYMBOL), p) for p in pieces)
        ids = self.automaton.encode_sorted([n for n, _ in named])
        self._pieces.update((p, self._entry(i)) for (_, p), i in zip(named, ids, strict=True))

    def _entry(self, ids: list[int]) -> tuple[bytes, bytes]:
        """The ids' decimals and their labels, each led by a space."""
        labels, decimal = self._spaced, self._decimal
        return b"".join([decimal[i] for i in ids]), b"".join([labels[i] for i in ids])

    def digests(self, texts: list[str]) -> dict[str, list]:
        """n_tokens, ids_sha256, decoded_sha256 of each text."""
        counts, ids_digest, text_digest = [], [], []
        cut = [self._cut(t) for t in texts]
        if len(self._pieces) >= PIECES_KEPT:
            self._pieces.clear()
        new: set[bytes] = set()
        for pieces in cut:
            new.update(pieces)
        self.learn({p for p in new if isinstance(p, bytes) and p not in self._pieces})
        self._pieces.update((i, self._entry([i])) for i in self.special.values())
        get = self._pieces.__getitem__
        for pieces in cut:
            ids, labels = zip(*map(get, pieces), strict=True) if pieces else ((), ())
            whole = b"".join(ids)
            counts.append(whole.count(b" "))
            ids_digest.append(hashlib.sha256(whole[1:]).hexdigest())
            text_digest.append(hashlib.sha256(b"".join(labels)[1:]).hexdigest())
        return {"n_tokens": counts, "ids_sha256": ids_digest, "decoded_sha256": text_digest}

    def encode(self, text: str) -> list[int]:
        out = []
        for p in self._cut(text):
            out += [p] if isinstance(p, int) else self.automaton.encode(p.decode("latin-1").translate(BYTE_SYMBOL))
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined as the library does without a decoder."""
        return " ".join(self.labels[i] for i in ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and process; Python workers are used again by later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 of every row of docs.

    path: the tokenizers file, on each executor; by default the public one that
    lies beside the installed package there.
    """

    def run(part):
        texts = part.column("text").to_pylist()
        return encoder(path or default_path()).digests([t or "" for t in texts])

    return annotate(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)


def encoded(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and ids (array) of every row of docs."""

    def run(part):
        e = encoder(path or default_path())
        return {"ids": [e.encode(t or "") for t in part.column("text").to_pylist()]}

    return annotate(docs, run, "ids array<int>", keep)
