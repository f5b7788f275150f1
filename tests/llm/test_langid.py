import itertools

import cases
import numpy as np

from wattspan.llm.langid import BLOCK, identify_languages, word_posteriors

TONGUES = {"en": "an er the of ing tion re ea st ou wh nd", "de": "schen heit und der ung ver ge lich ü ö", "fr": "eau ai qu é ment les ou ier"}


def brute(scores, transitions):
    """Label probabilities by summing over all label sequences."""
    n, k = scores.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        start = np.log(np.exp(transitions).mean(0)[path[0]])
        weight = np.exp(start + sum(scores[i, p] for i, p in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total[np.arange(n), path] += weight
    return total / total.sum(1, keepdims=True)


def test_forward_backward_equals_all_paths():
    draw = np.random.default_rng(2)
    transitions = draw.standard_normal((3, 3))
    lengths = [1, 6, 0, 4]
    scores = draw.standard_normal((sum(lengths), 3))
    first = np.r_[0, np.cumsum(lengths)]
    got = word_posteriors(scores, first, transitions)
    for a, b in zip(first, first[1:]):
        if b > a:
            assert np.allclose(got[a:b], brute(scores[a:b], transitions))


def test_blocks_do_not_change_a_long_chain():
    draw = np.random.default_rng(3)
    n, transitions = BLOCK * 3 + 5, 2 * np.eye(3)
    scores = draw.standard_normal((n, 3))
    step, local = np.exp(transitions), np.exp(scores)
    forward, backward = np.zeros((n, 3)), np.ones((n, 3)) / 3
    state = np.ones(3) / 3
    for i in range(n):
        state = (state @ step) * local[i]
        forward[i] = state = state / state.sum()
    for i in range(n - 2, -1, -1):
        backward[i] = step @ (local[i + 1] * backward[i + 1])
        backward[i] /= backward[i].sum()
    expected = forward * backward
    assert np.allclose(word_posteriors(scores, np.array([0, n]), transitions), expected / expected.sum(1, keepdims=True))


def corpus(spark, n, seed):
    rows = [
        (i, cases.prose(5 + i % 60, seed * 1000 + i, TONGUES[lang]), lang)
        for i, lang in zip(range(n), itertools.cycle(TONGUES))
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_and_switched_texts(spark):
    train, held = corpus(spark, 300, 1), corpus(spark, 90, 2)
    got = held.join(identify_languages(held.drop("lang"), train), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    mixed = cases.prose(30, 5, TONGUES["de"]) + " " + cases.prose(80, 6, TONGUES["fr"])
    one = identify_languages(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), train).first()
    assert one.lang_pred == "fr" and 0.6 < one.score < 0.85


def test_awkward_rows(docs, empty, spark):
    train = corpus(spark, 60, 3)
    got = identify_languages(docs, train).collect()
    assert len(got) == docs.count()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (6, 7, 8, 13)} == {("und", 0.0)}
    assert all(r.lang_pred in TONGUES and 0 < r.score <= 1 for r in got if r.doc_id not in (6, 7, 8, 13))
    assert identify_languages(empty, train).collect() == []
    assert {r.lang_pred for r in identify_languages(docs, empty).collect()} == {"und"}
    assert {r.lang_pred for r in identify_languages(docs, train.where("lang = 'de'")).collect()} == {"und", "de"}
