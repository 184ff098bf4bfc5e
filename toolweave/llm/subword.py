"""Averaged subword-bag embeddings under a linear softmax, trained in numpy.

A word's vector is the mean of the embeddings of its character n-grams (hashed
to a fixed number of rows) and of the word itself; a text's vector is the mean
over its words; a linear softmax gives class probabilities. Embeddings and
weights are trained together by mini-batch gradient descent with per-row step
sizes. Words never seen share the n-grams of those that were.

With a ``window`` a text counts as its best-scoring run of so many words: the
first epoch averages whole texts, later ones only that run, in texts of either
label, so that a few telling words in a long text are not averaged away.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

EDGE = ".,;:!?\"'()[]{}<>|$%*&#~^_`=+/\\-"
#: Words whose scores a worker keeps; it starts anew beyond that.
CACHED_WORDS = 250_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str) -> list[str]:
    return text.lower().split()


def gram_rows(words: list[str], shortest: int, longest: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of the words' n-grams and of the words themselves, and which word each belongs to.

    A word is bracketed by marks and loses its outer punctuation (unless it is nothing else).
    """
    bare = [f"<{w.strip(EDGE) or w}>" for w in words]
    code = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, bare), np.int64, len(bare))
    owner = np.repeat(np.arange(len(words)), size)
    last = np.cumsum(size)
    left = np.repeat(last, size) - np.arange(len(code))  # characters from here to the word's end
    shift = np.uint64(64 - bits)
    power = np.cumprod(np.full(int(size.max(initial=0)), _MIX, np.uint64)) if len(words) else np.zeros(0, np.uint64)
    whole = np.add.reduceat(code * power[left - 1], last - size) if len(words) else np.zeros(0, np.uint64)
    rows, owners = [((whole ^ (whole >> np.uint64(29))) * _MIX) >> shift], [np.arange(len(words))]
    for k in range(shortest, longest + 1):
        n = len(code) - k + 1
        if n <= 0:
            break
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = (h ^ code[j : j + n]) * _MIX
            h ^= h >> np.uint64(31)
        ok = left[:n] >= k
        rows.append(((h * _MIX) >> shift)[ok])
        owners.append(owner[:n][ok])
    return np.concatenate(rows).astype(np.int64), np.concatenate(owners)


def _sums(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``at``."""
    return np.stack([np.bincount(at, values[:, c], n) for c in range(values.shape[1])], 1).astype(np.float32)


@dataclass
class SubwordModel:
    classes: int
    bits: int = 16
    width: int = 10
    shortest: int = 3
    longest: int = 5
    step: float = 0.5
    seed: int = 7
    window: int = 0
    embedding: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    bias: np.ndarray = field(init=False)
    trained: np.ndarray = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.embedding = (rng.random((1 << self.bits, self.width), np.float32) - 0.5) / self.width
        self.weights = rng.normal(0, 0.1, (self.width, self.classes)).astype(np.float32)
        self.bias = np.zeros(self.classes, np.float32)
        self.trained = np.zeros(1 << self.bits, bool)

    def fit(self, texts: Iterable[list[str]], labels: np.ndarray, epochs: int = 4, batch: int = 64) -> SubwordModel:
        """``texts`` are lists of words, read once; texts without words are left out. Classes count alike, whatever their sizes."""
        vocabulary: dict[str, int] = {}
        ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t], np.int32) for t in texts]
        labels = np.asarray(labels, np.int64)[np.array([len(t) > 0 for t in ids], bool)] if ids else np.zeros(0, np.int64)
        ids = [t for t in ids if len(t)]
        if not ids:
            return self
        flat, owner = gram_rows(list(vocabulary), self.shortest, self.longest, self.bits)
        order = np.argsort(owner, kind="stable")
        flat, size = flat[order].astype(np.int32), np.bincount(owner, minlength=len(vocabulary))
        del order, owner, vocabulary
        self.trained[flat] = True
        first = np.append(0, np.cumsum(size))
        rng = np.random.default_rng(self.seed)
        grad2_e, grad2_w = np.full(len(self.embedding), 1e-8, np.float32), np.full(self.weights.shape, 1e-8, np.float32)
        share = np.bincount(labels, minlength=self.classes) / len(labels)
        weight = 1 / np.maximum(share * np.count_nonzero(share), 1e-9)
        steps, done = epochs * -(-len(ids) // batch), 0
        for epoch in range(epochs):
            if self.window and epoch:
                value = (self.embedding @ (self.weights[:, 1] - self.weights[:, 0]))[flat]
                value = np.add.reduceat(value, first[:-1]) / size
            shuffled = rng.permutation(len(ids))
            for k in range(0, len(ids), batch):
                docs = shuffled[k : k + batch]
                bags = [ids[d] for d in docs]
                if self.window and epoch:
                    bags = [b[best_run(value[b], self.window)[1] :][: self.window] for b in bags]
                rate, done = self.step * (1 - done / steps), done + 1
                lengths = np.array([len(b) for b in bags])
                words, place = np.unique(np.concatenate(bags), return_inverse=True)
                n = size[words]
                before = np.append(0, np.cumsum(n)[:-1])
                rows = flat[np.repeat(first[words] - before, n) + np.arange(n.sum())]
                vectors = np.add.reduceat(self.embedding[rows], before) / n[:, None]
                doc_of = np.repeat(np.arange(len(bags)), lengths)
                part = (1 / lengths)[doc_of][:, None].astype(np.float32)
                mean = _sums(vectors[place] * part, doc_of, len(bags))
                logits = mean @ self.weights + self.bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(bags)), labels[docs]] -= 1
                p *= (weight[labels[docs]] / len(bags))[:, None]
                g_words = _sums((p @ self.weights.T)[doc_of] * part, place, len(words)) / n[:, None]
                g_w = mean.T @ p
                touched, where = np.unique(rows, return_inverse=True)
                g_rows = _sums(np.repeat(g_words, n, axis=0), where, len(touched))
                grad2_e[touched] += (g_rows**2).mean(1)
                self.embedding[touched] -= rate * g_rows / np.sqrt(grad2_e[touched])[:, None]
                grad2_w += g_w**2
                self.weights -= rate * g_w / np.sqrt(grad2_w)
                self.bias -= 0.1 * rate * p.sum(0)
        return self

    def scorer(self, trained_only: bool = False) -> WordScores:
        """Scores by row; with ``trained_only`` rows that no training text holds say nothing of any class."""
        table = (self.embedding @ self.weights).astype(np.float32)
        if trained_only:
            table[~self.trained] = 0.0
        return WordScores(table, self.shortest, self.longest, self.bits)


def best_run(value: np.ndarray, window: int) -> tuple[float, int]:
    """Mean and start of the run of ``window`` words (all words, if there are fewer) with the highest mean."""
    if len(value) <= window:
        return float(value.mean()), 0
    total = np.append(0, np.cumsum(value, dtype=np.float64))
    sums = total[window:] - total[:-window]
    at = int(np.argmax(sums))
    return float(sums[at] / window), at


class WordScores:
    """Class scores of words from the trained table alone, kept for words seen before."""

    def __init__(self, table: np.ndarray, shortest: int, longest: int, bits: int):
        self.table, self.grams = table, (shortest, longest, bits)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.matrix = np.zeros((1 << 12, self.table.shape[1]), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """A row of class scores per word."""
        distinct = set(words)
        new = list(distinct.difference(self.at))
        if new and len(self.at) + len(new) > CACHED_WORDS:
            self.clear()
            new = list(distinct)
        if new:
            rows, owner = gram_rows(new, *self.grams)
            n = len(self.at)
            while n + len(new) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[n : n + len(new)] = _sums(self.table[rows], owner, len(new)) / np.bincount(owner, minlength=len(new))[:, None]
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
        return self.matrix[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


def text_chunks(texts: list[str], characters: int = 1_000_000) -> list[list[str]]:
    """Consecutive texts in lists of about so many characters."""
    out, size = [[]], 0
    for t in texts:
        if size > characters:
            out, size = [*out, []], 0
        out[-1].append(t)
        size += len(t)
    return out
