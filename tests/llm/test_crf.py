import itertools

import numpy as np

from terrapanel.llm import crf
from terrapanel.llm.crf import Crf, FeatureSpace, Scores, forward_backward, train


def brute(score, transitions, begin):
    n, k = score.shape
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        s = begin[path[0]] + sum(score[i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path))
        for i, y in enumerate(path):
            out[i, y] += np.exp(s)
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_match_all_paths(monkeypatch):
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 0, 2, 5, 6, 3])
    score = rng.normal(size=(lengths.sum(), 3)) * 2
    transitions, begin = rng.normal(size=(3, 3)), rng.normal(size=3)
    for segment in (2, 3, 256):
        monkeypatch.setattr(crf, "SEGMENT", segment)
        forward, backward = forward_backward(score, lengths, transitions, begin)
        got = forward * backward
        got /= got.sum(axis=1, keepdims=True)
        at = 0
        for n in lengths:
            if n:
                np.testing.assert_allclose(got[at : at + n], brute(score[at : at + n], transitions, begin), atol=1e-9)
            at += n


def test_training_learns_words_and_transitions():
    rng = np.random.default_rng(2)
    texts, gold = [], []
    for _ in range(60):
        y = np.repeat(rng.integers(0, 2, 6), 5)
        texts.append([b"%s%d" % (b"ab" if v else b"cd", rng.integers(0, 50)) for v in y])
        gold.append(y)
    model = train(["x", "y"], FeatureSpace(bits=12), texts, gold)
    assert np.trace(model.transitions) > model.transitions[0, 1] + model.transitions[1, 0]
    words = [b"ab999"] * 3 + [b"cd998"] * 3
    marginal = model.marginals(Scores(model).of(words), np.array([6]))
    assert (marginal.argmax(axis=1) == [1, 1, 1, 0, 0, 0]).all()


def test_remembered_scores_are_the_same(monkeypatch):
    monkeypatch.setattr(crf, "CACHE_WORDS", 5)
    space = FeatureSpace(bits=8, lexicons=(frozenset([b"b"]),))
    model = Crf(["x", "y"], space, np.random.default_rng(3).normal(size=(space.size, 2)), np.zeros((2, 2)), np.zeros(2))
    scores = Scores(model)
    for words in ([b"a", b"b", b"a"], [b"c", b"d", b"e", b"f"], [b"%d" % i for i in range(9)], [b"a", b"b"]):
        np.testing.assert_allclose(scores.of(words), np.vstack([model.word_scores([w]) for w in words]))
