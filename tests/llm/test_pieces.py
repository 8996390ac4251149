import itertools
import math
import random

import numpy as np
import pytest

pytest.importorskip("fenceline.llm")

from fenceline.llm.pieces import _UNKNOWN, START, STRETCH, PieceModel, expected_pieces, fit, word_log_probabilities  # noqa: E402

PIECES = [START, START + "a", "a", "b", "ab", "ba", "aba", START + "ab", "c"]
R = np.random.default_rng(1)
TABLE = R.random((len(PIECES), 3))
TABLE /= TABLE.sum(axis=0)
INDEX = {p: i for i, p in enumerate(PIECES)}


def segmentations(text):
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at, out = 0, []
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                out.append(text[at:i])
                at = i
        if all(p in INDEX or len(p) == 1 for p in out):
            yield out


def brute(word):
    p = np.zeros(3)
    for seg in segmentations(START + word):
        p += np.prod([TABLE[INDEX[x]] if x in INDEX else np.full(3, _UNKNOWN) for x in seg], axis=0)
    return np.log(p)


@pytest.mark.parametrize("word", ["a", "ab", "aba", "abab", "cabba", "azb", "z", "abcabcab"])
def test_forward_sums_over_all_segmentations(word):
    assert np.allclose(word_log_probabilities([word], INDEX, 4, TABLE)[0], brute(word))


def test_many_words_at_once():
    r = random.Random(2)
    words = ["".join(r.choices("abcz", k=r.randrange(1, 9))) for _ in range(300)] + [""]
    assert np.allclose(word_log_probabilities(words, INDEX, 4, TABLE), [brute(w) for w in words])


def test_long_words_don_t_underflow():
    got = word_log_probabilities(["ab" * 5000, "z" * 1000], INDEX, 4, TABLE)
    assert np.isfinite(got).all()
    assert got[1][0] == pytest.approx(1000 * math.log(_UNKNOWN) + math.ceil(1000 / STRETCH) * math.log(TABLE[0, 0]))


def test_expected_counts():
    word, weight = "abab", np.array([[2.0, 1.0, 0.0]])
    got = expected_pieces([word], weight, INDEX, 4, TABLE)
    want, total = np.zeros_like(TABLE), np.exp(brute(word))
    for seg in segmentations(START + word):
        p = np.prod([TABLE[INDEX[x]] for x in seg], axis=0) / total * weight[0]
        for x in seg:
            want[INDEX[x]] += p
    assert np.allclose(got, want)


def test_fit_tells_languages_apart_and_models_travel():
    import pickle

    model = fit(["x", "y"], PIECES, {"x": {"ab": 50, "aba": 20}, "y": {"ba": 50, "cab": 20}})
    model.most_words = 3
    for m in (model, pickle.loads(pickle.dumps(model))):
        for words in (["ab", "ba", "ab"], ["c", "a"], ["ab", "ba", "aba", "caba"]):
            ids = m.ids(words)
            rel = m.relative()[ids]
            assert rel.shape == (len(words), 2) and (rel <= np.log(2) + 1e-6).all()
        ids = m.ids(["ab", "ba"])  # may make room, so before relative()
        rel = m.relative()[ids]
        assert rel[0][0] > rel[0][1] and rel[1][1] > rel[1][0]


def test_model_without_words():
    assert PieceModel(["x"], PIECES, TABLE[:, :1]).ids([]).shape == (0,)
