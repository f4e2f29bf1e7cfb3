"""A linear softmax over averaged hashed subword embeddings, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

import functools
import io
from dataclasses import dataclass

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if len(counts) else np.empty(0, np.int64)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, joined."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) - np.repeat(_starts(counts), counts) + np.repeat(starts, counts)


def _add_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``to[rows] += values`` with repeated rows added up; flat indices are five times as fast."""
    width = to.shape[1]
    np.add.at(to.reshape(-1), (rows[:, None] * width + np.arange(width)).reshape(-1), values.astype(to.dtype).reshape(-1))


@functools.lru_cache(maxsize=1)
def _powers(n: int = 1 << 12) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, _STEP), out=out[1:])
    return out


def hashed_subwords(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- to 4-grams of each ``<word>`` and of the whole word: (word index, bucket), by word index within each length."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, hashes = [], []
    with np.errstate(over="ignore"):
        h = codes.copy()
        for n in (2, 3, 4):
            if len(codes) < n:
                break
            h = h[:-1] * _STEP + codes[n - 1 :]
            inside = owner[: len(h)] == owner[n - 1 :]
            owners.append(owner[: len(h)][inside])
            hashes.append(h[inside] + np.uint64(n))
        place = spread(np.zeros(len(sizes), np.int64), sizes) % len(_powers())
        whole = np.add.reduceat(codes * _powers()[place], _starts(sizes)) if len(words) else codes
        owners.append(np.arange(len(words)))
        hashes.append(whole + np.uint64(77))
        buckets = (np.concatenate(hashes) * _MULTIPLIER) >> np.uint64(64 - bits)
    return np.concatenate(owners), buckets.astype(np.int64)


@dataclass
class SubwordModel:
    """``table[b]``: embedding of bucket b times the output weights, so a text's logits are a mean of rows plus the bias."""

    table: np.ndarray
    bias: np.ndarray
    scale: float
    bits: int

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, table=self.table, bias=self.bias, numbers=np.array([self.scale, self.bits]))
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> SubwordModel:
        held = np.load(io.BytesIO(data))
        scale, bits = held["numbers"].tolist()
        return SubwordModel(held["table"], held["bias"], scale, int(bits))

    def word_sums(self, words: list[str]) -> np.ndarray:
        """For each word the summed rows of its subwords and, in the last column, their number."""
        owner, bucket = hashed_subwords(words, self.bits)
        out = np.zeros((len(words), self.table.shape[1] + 1), np.float32)
        cuts = np.flatnonzero(np.diff(owner) < 0) + 1
        for own, buck in zip(np.split(owner, cuts), np.split(bucket, cuts), strict=True):
            if len(own):
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                out[own[first], :-1] += np.add.reduceat(self.table[buck], first, axis=0)
                out[own[first], -1] += np.diff(np.append(first, len(own)))
        return out

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of texts from the added-up ``word_sums`` of their words."""
        logits = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) * self.scale
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[list[str]], labels: np.ndarray, classes: int, *, bits: int = 16, dim: int = 16, epochs: int = 6, rate: float = 0.06, batch: int = 256, seed: int = 3) -> SubwordModel:
    """Fit on lists of words. A tenth of the texts is held out to fit the temperature of the probabilities.

    After half of the epochs, texts whose label the model finds improbable are left out, since labels are partly wrong.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in t), np.int64, len(t)) for t in texts]
    owner, bucket = hashed_subwords(list(vocabulary), bits)
    order = np.argsort(owner, kind="stable")
    bucket, per_word = bucket[order], np.bincount(owner, minlength=len(vocabulary))
    first = _starts(per_word)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, classes), np.float32), np.zeros(classes, np.float32)
    shuffled = rng.permutation(len(texts))
    held, used = shuffled[: len(texts) // 10], shuffled[len(texts) // 10 :]

    def forward(rows: np.ndarray):
        counts = np.fromiter((len(ids[i]) for i in rows), np.int64, len(rows))
        words, back = np.unique(np.concatenate([ids[i] for i in rows]), return_inverse=True)
        subs = bucket[spread(first[words], per_word[words])]
        vectors = np.add.reduceat(table[subs], _starts(per_word[words]), axis=0)
        total = np.add.reduceat(per_word[words][back], _starts(counts))
        mean = np.add.reduceat(vectors[back], _starts(counts), axis=0) / total[:, None]
        return counts, words, back, subs, total, mean

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    # each row of parameters has its own step, divided by the root of its squared gradients so far, so that
    # subwords that a batch holds thousands of times move no further than rare ones
    seen = [np.full((len(p), 1), 1e-8, np.float32) for p in (table, weights, bias[:, None])]

    def move(parameters: np.ndarray, gradient: np.ndarray, squares: np.ndarray, step: float) -> None:
        squares += np.mean(gradient * gradient, axis=1, keepdims=True)
        parameters -= step * gradient / np.sqrt(squares)

    for epoch in range(epochs):
        if epoch == epochs // 2:
            keep = [softmax(forward(c)[5] @ weights + bias)[np.arange(len(c)), labels[c]] > 0.2 for c in np.array_split(used, max(1, len(used) // 1024)) if len(c)]
            used = used[np.concatenate(keep)] if keep else used
        rng.shuffle(used)
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(used), batch):
            rows = used[at : at + batch]
            counts, words, back, subs, total, mean = forward(rows)
            wrong = softmax(mean @ weights + bias)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            toward = (wrong @ weights.T) / total[:, None]
            move(weights, mean.T @ wrong, seen[1], step)
            move(bias[:, None], wrong.sum(axis=0)[:, None], seen[2], step)
            by_word = np.zeros((len(words), dim), np.float32)
            _add_rows(by_word, back, toward[np.repeat(np.arange(len(rows)), counts)])
            held_rows = np.zeros(len(table), bool)
            held_rows[subs] = True
            touched = np.flatnonzero(held_rows)  # rows that no text of the batch holds don't move
            number = np.empty(len(table), np.int64)
            number[touched] = np.arange(len(touched))
            gradient = np.zeros((len(touched), dim), np.float32)
            _add_rows(gradient, number[subs], np.repeat(by_word, per_word[words], axis=0))
            seen[0][touched] += np.mean(gradient * gradient, axis=1, keepdims=True)
            table[touched] -= step * gradient / np.sqrt(seen[0][touched])
    if not np.isfinite(table).all():
        raise ArithmeticError("the training diverged")
    scale = 1.0
    if len(held):
        scale = temperature(forward(held)[5] @ weights + bias, labels[held])
    return SubwordModel((table @ weights).astype(np.float32), bias, scale, bits)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The factor of the logits under which labels that are partly wrong are most probable, on all texts that were held out.

    How often a class bears which label is read off the texts of the larger margins, where the choice is hardly ever wrong. The likelihood of
    a label is then that of any class times how often the class bears it, so wrong labels don't flatten the probabilities.
    """
    classes = logits.shape[1]
    best, ordered = logits.argmax(axis=1), np.sort(logits, axis=1)
    sure = ordered[:, -1] - ordered[:, -2] >= np.median(ordered[:, -1] - ordered[:, -2])
    borne = 0.5 * np.eye(classes) + 0.01
    np.add.at(borne, (best[sure], labels[sure]), 1)
    borne /= borne.sum(axis=1, keepdims=True)

    def loss(factor: float) -> float:
        e = np.exp((logits - ordered[:, -1:]) * factor)
        return -np.log((e / e.sum(axis=1, keepdims=True) * borne[:, labels].T).sum(axis=1)).mean()

    return float(min(np.geomspace(0.25, 8, 41), key=loss))
