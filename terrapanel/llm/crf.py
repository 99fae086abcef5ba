"""Linear-chain conditional random fields over the words of texts, in numpy.

A word's features are hashed affixes, byte n-grams and the word itself, and
flags for the lexicons it is in.  A model holds a weight for each feature and
label, transitions between labels, and a start score for each label.

Texts are processed many at a time: chains are cut into segments of bounded
length, the segments' transfer matrices carry messages across the cuts, and all
segments step forward and backward together.  The result is that of
forward-backward over each whole text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

#: Words of a segment.
SEGMENT = 256
#: Words that a worker remembers scores of, and whose features are made at a time.
CACHE_WORDS, WORD_BLOCK = 100_000, 10_000

#: A-Z to a-z, digits to 0, other ASCII characters to a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 48 if 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII bytes, with A-Z lower-cased and digits as 0."""
    return text.translate(TABLE).split()


@dataclass(frozen=True)
class FeatureSpace:
    bits: int = 18
    ngrams: tuple[int, ...] = (2, 3, 4)
    prefixes: tuple[int, ...] = (1, 2, 3, 4, 5)
    suffixes: tuple[int, ...] = (1, 2, 3, 4, 5)
    lexicons: tuple[frozenset[bytes], ...] = field(default=(), repr=False)

    @property
    def size(self) -> int:
        return (1 << self.bits) + len(self.lexicons)

    def features(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, feature) as two arrays, for distinct words."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
        start = np.cumsum(length) - length
        word = np.repeat(np.arange(n), length)
        left = np.repeat(start + length, length) - np.arange(len(text))
        rows, hashes = [np.arange(n)], [np.fromiter(map(zlib.crc32, words), np.uint64, n)]
        h = np.zeros(len(text), np.uint64)
        for k in range(1, 1 + max((0, *self.ngrams, *self.prefixes, *self.suffixes))):
            # h[i] becomes the hash of the k bytes from i on; it is used only where they are in one word.
            follow = np.zeros(len(text), np.uint64)
            if k <= len(text):
                follow[: len(text) - k + 1] = text[k - 1 :]
            h = (h * np.uint64(0x100000001B3)) ^ (follow + np.uint64(1))
            long = length >= k
            for use, kind in ((self.prefixes, 1), (self.suffixes, 2)):
                if k in use:
                    at = start[long] if kind == 1 else (start + length - k)[long]
                    rows.append(np.flatnonzero(long))
                    hashes.append(h[at] + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64))
            if k in self.ngrams:
                at = np.flatnonzero(left >= k)
                rows.append(word[at])
                hashes.append(h[at])
        mixed = np.concatenate(hashes)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        found = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        rows = np.concatenate(rows)
        for n_lex, lexicon in enumerate(self.lexicons):
            known = np.fromiter((w in lexicon for w in words), bool, n)
            rows = np.concatenate([rows, np.flatnonzero(known)])
            found = np.concatenate([found, np.full(known.sum(), (1 << self.bits) + n_lex)])
        return rows, found


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Rows of values added up by index."""
    return np.stack([np.bincount(index, values[:, k], size) for k in range(values.shape[1])], axis=1)


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and number within its text of every segment."""
    count = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(np.cumsum(lengths) - lengths, count) + number * SEGMENT
    return first, np.minimum(SEGMENT, lengths[text] - number * SEGMENT), number


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=tuple(range(1, x.ndim)), keepdims=True)


def forward_backward(score: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of each word; their product is its marginal up to a factor.

    score: words x labels; lengths: words of each text, in order.
    """
    n, k = score.shape
    b = np.exp(score - score.max(axis=1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    start = np.exp(begin - begin.max())
    lengths = lengths[lengths > 0]
    first, size, number = _segments(lengths)
    count = len(first)
    incoming = np.tile(start, (count, 1))
    outgoing = np.ones((count, k))
    cut = np.repeat(-(-lengths // SEGMENT), -(-lengths // SEGMENT)) > 1
    if cut.any():
        own = np.flatnonzero(cut)
        order = own[np.argsort(-size[own], kind="stable")]
        product = b[first[order], :, None] * np.eye(k)
        for step in range(1, size[order[0]]):
            m = np.searchsorted(-size[order], -step)  # those longer than step
            product[:m] = _scaled((product[:m].reshape(-1, k) @ t).reshape(m, k, k) * b[first[order[:m]] + step, None, :])
        across = np.zeros((count, k, k))
        across[order] = product
        last_number = number.max()
        for s in range(1, last_number + 1):
            at = np.flatnonzero(number == s)
            incoming[at] = _scaled(np.einsum("si,sij->sj", incoming[at - 1], across[at - 1]) @ t)
        for s in range(last_number, 0, -1):
            at = np.flatnonzero(number == s)
            outgoing[at - 1] = _scaled(np.einsum("sij,sj->si", across[at], outgoing[at]) @ t.T)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    forward, backward = np.empty((n, k)), np.empty((n, k))
    a = incoming[order]
    for step in range(size[0] if count else 0):
        m = np.searchsorted(-size, -step)
        at = first[:m] + step
        a = _scaled((a[:m] @ t if step else a[:m]) * b[at])
        forward[at] = a
    a = outgoing[order]
    for step in range(size[0] if count else 0):
        m = np.searchsorted(-size, -step)
        at = first[:m] + size[:m] - 1 - step
        a = _scaled((b[at + 1] * a[:m]) @ t.T) if step else a[:m]
        backward[at] = a
    return forward, backward


@dataclass
class Crf:
    labels: list[str]
    space: FeatureSpace
    weights: np.ndarray
    transitions: np.ndarray
    begin: np.ndarray

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        out = np.empty((len(words), len(self.labels)))
        for at in range(0, len(words), WORD_BLOCK):
            own = words[at : at + WORD_BLOCK]
            rows, found = self.space.features(own)
            for k in range(len(self.labels)):
                out[at : at + len(own), k] = np.bincount(rows, self.weights[found, k], len(own))
        return out

    def marginals(self, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not len(score):
            return np.zeros((0, len(self.labels)))
        forward, backward = forward_backward(score, lengths, self.transitions, self.begin)
        return _scaled(forward * backward)


class Scores:
    """A worker's memory of words' scores; emptied when full."""

    def __init__(self, model: Crf):
        self.model, self.rows, self.table = model, {}, np.zeros((CACHE_WORDS, len(model.labels)))

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words) if w not in self.rows]
        if len(self.rows) + len(new) > CACHE_WORDS:
            self.rows.clear()
            new = list(set(words))
            if len(new) > CACHE_WORDS:
                at = {w: n for n, w in enumerate(new)}
                return self.model.word_scores(new)[[at[w] for w in words]]
        if new:
            n = len(self.rows)
            self.table[n : n + len(new)] = self.model.word_scores(new)
            self.rows.update(zip(new, range(n, n + len(new)), strict=True))
        return self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]


def train(labels: list[str], space: FeatureSpace, texts: list[list[bytes]], gold: list[np.ndarray], rounds: int = 20, rate: float = 0.5, l2: float = 1e-6) -> Crf:
    """Fit by gradient ascent on the mean log-likelihood of the label sequences (adaptive steps)."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    y = np.concatenate([*gold, np.zeros(0, np.int64)]).astype(np.int64)
    k, n = len(labels), max(1, len(ids))
    model = Crf(labels, space, np.zeros((space.size, k)), np.zeros((k, k)), np.zeros(k))
    if not len(ids):
        return model
    rows, found = space.features(list(number))
    once = np.zeros((n, k))
    once[np.arange(n), y] = 1
    ends = np.cumsum(lengths[lengths > 0])
    starts = ends - lengths[lengths > 0]
    inner = np.ones(n, bool)
    inner[ends - 1] = False
    inner = np.flatnonzero(inner)
    squares = [np.full(x.shape, 1e-8) for x in (model.weights, model.transitions, model.begin)]
    for _ in range(rounds):
        score = np.stack([np.bincount(rows, model.weights[found, c], len(number)) for c in range(k)], axis=1)[ids]
        forward, backward = forward_backward(score, lengths, model.transitions, model.begin)
        marginal = _scaled(forward * backward)
        after = np.exp(score[inner + 1] - score[inner + 1].max(axis=1, keepdims=True)) * backward[inner + 1]
        t = np.exp(model.transitions - model.transitions.max())
        factor = np.einsum("ni,ij,nj->n", forward[inner], t, after)
        expected = np.einsum("ni,nj->ij", forward[inner] / factor[:, None], after) * t
        seen = np.zeros((k, k))
        np.add.at(seen, (y[inner], y[inner + 1]), 1)
        by_word = _sums(ids, once - marginal, len(number))
        steps = (
            np.stack([np.bincount(found, by_word[rows, c], space.size) for c in range(k)], axis=1) / n - l2 * model.weights,
            (seen - expected) / n,
            (once[starts] - marginal[starts]).sum(axis=0) / n,
        )
        for x, step, square in zip((model.weights, model.transitions, model.begin), steps, squares, strict=True):
            square += step**2
            x += rate * step / np.sqrt(square)
    return model


def in_groups(texts, most_words: int):
    """Consecutive (first text, word lists) with about ``most_words`` words at most, a longer text on its own."""
    group, size, first = [], 0, 0
    for n, t in enumerate(texts):
        words = words_of(t)
        if group and size + len(words) > most_words:
            yield first, group
            group, size, first = [], 0, n
        group.append(words)
        size += len(words)
    if group:
        yield first, group
