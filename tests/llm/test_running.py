import math
import random
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspan.llm.mixing import mixing_scores
from wattspan.llm.running import BLOCK, CONSTANT, GATES, LEVELS, ORDERS, OWN, PRIOR, RATE, histories, running_scores


def plain(spelled, share, corpus, words):
    """log10 probability of one text, a word at a time with dictionaries."""
    weights = [[[0.0] * (LEVELS + 1) for _ in range(GATES)] for _ in range(LEVELS)]
    for k in range(LEVELS):
        for g in range(GATES):
            weights[k][g][k], weights[k][g][LEVELS] = OWN[k], CONSTANT[k]
    followers = [defaultdict(Counter) for _ in range(ORDERS)]
    total, steps = 0.0, []
    for i, w in enumerate(words):
        if i % BLOCK == 0:
            for k, g, j, by in steps:
                weights[k][g][j] += by
            steps = []
        known, ones, told = [sum(corpus)], [corpus[0]], [share[i]]
        for order in range(ORDERS):
            context = tuple(words[max(0, i - order) : i]) if i >= order else ("start", *words[:i])
            held = followers[order][context]
            n = sum(held.values())
            known.append(n)
            ones.append(n - len(held))
            told.append(held[w] / n if n else 0.0)
        odds = [math.log((a + PRIOR) / (n - a + PRIOR)) if n else 0.0 for a, n in zip(ones, known)]
        gates = [int(n > 1.5) + int(n > 4.5) for n in known]
        p, lam, credit = 10.0 ** spelled[i], [], []
        for k in range(LEVELS):
            w_ = weights[k][gates[k]]
            lam.append(1 / (1 + math.exp(-(sum(a * b for a, b in zip(w_, odds)) + w_[LEVELS]))) if known[k] else 0.0)
            p = lam[k] * told[k] + (1 - lam[k]) * p
            credit.append(lam[k] * told[k] / p)
        total += math.log10(p)
        left = 1.0
        for k in reversed(range(LEVELS)):
            slope = left * (credit[k] - lam[k]) if known[k] else 0.0
            left *= 1 - credit[k]
            steps += [(k, gates[k], j, RATE * slope * x) for j, x in enumerate([*odds, 1.0])]
        for order in range(ORDERS):
            context = tuple(words[max(0, i - order) : i]) if i >= order else ("start", *words[:i])
            followers[order][context][w] += 1
    return total


def laid(texts, spelled, share):
    words = np.concatenate([np.array(t, np.int64) for t in texts])
    return spelled[words], share[words], words, np.cumsum([0, *map(len, texts)])


def test_scores_equal_a_plain_pass_over_each_text():
    draw = random.Random(5)
    texts = [[draw.randrange(9) for _ in range(n)] for n in (1, 2, 3, 63, 64, 65, 300, 700)] + [[3] * 200, [1, 2, 3, 4] * 90]
    spelled, share = -np.linspace(0.3, 6, 9), np.linspace(0.2, 0, 9)
    corpus = np.tile([90.0, 9.0], (len(texts), 1))
    p, s, words, first = laid(texts, spelled, share)
    got = running_scores(p, s, corpus, words, first)
    assert got == pytest.approx([plain(spelled[t], share[t], corpus[0], t) for t in texts], rel=1e-5)
    alone = [running_scores(spelled[t], share[t], corpus[:1], np.array(t), np.array([0, len(t)]))[0] for t in texts]
    assert got == pytest.approx(alone, abs=1e-9)


def test_all_next_words_add_up_to_one():
    """Whatever was read before, the probabilities of the next word have a sum of one."""
    draw = random.Random(6)
    spelled, share = np.log10(np.full(5, 0.2)), np.array([0.5, 0.3, 0.2, 0, 0])
    for n in (0, 1, 5, 64, 200):
        past = [draw.randrange(3) for _ in range(n)]
        texts = [past + [w] for w in range(5)] + ([past] if n else [])
        p, s, words, first = laid(texts, spelled, share)
        got = running_scores(p, s, np.tile([9.0, 3.0], (len(texts), 1)), words, first)
        before = got[5] if n else 0.0
        assert (10 ** (got[:5] - before)).sum() == pytest.approx(1.0)


def test_words_of_no_probability_as_a_double_keep_their_digits():
    got = running_scores(np.array([-5000.0, -5000.0, -1.0]), np.zeros(3), np.zeros((2, 2)), np.array([0, 0, 1]), np.array([0, 2, 3]))
    assert -5010 < got[0] < -5000 and got[1] == pytest.approx(-1.0)


def test_order_phrases_and_repeats_count(spark):
    """A text that says the same line again scores above its own shuffle, bits per byte agree with the score."""
    line = cases.prose(60, 41).split()
    mixed = line * 6
    random.Random(1).shuffle(mixed)
    rows = [(i, cases.prose(200, i)) for i in range(60)] + [(100, " ".join(line * 6)), (101, " ".join(mixed)), (102, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.col("doc_id") < 60)
    got = {r.doc_id: r for r in mixing_scores(table, "train").collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score)
    assert got[100].score > 0.6 * got[101].score
    for key, text in rows:
        bits = -got[key].score / math.log10(2)
        assert got[key].bits_per_byte == pytest.approx(bits / (len((text or "").encode()) + 1))


def test_scores_hang_on_no_slice_of_the_table(docs):
    table = docs.withColumn("train", F.coalesce(F.col("doc_id") % 7 != 2, F.lit(False)))
    big, small = (sorted((str(r.doc_id), r.n_tokens, r.score) for r in mixing_scores(table, "train", chunk_bytes=n).collect()) for n in (8 << 20, 2000))
    assert [r[:2] for r in big] == [r[:2] for r in small]
    assert [r[2] for r in big] == pytest.approx([r[2] for r in small], rel=1e-4)


@pytest.mark.parametrize("scale", [1, 1 << 57])
def test_histories_equal_brute_force_and_order_no_positions_by_hashes(scale, monkeypatch):
    draw = np.random.default_rng(5)
    texts = [list(draw.integers(0, 4, n)) for n in (40, 1, 2, 0, 3, 25, 25)]
    texts.append(list(texts[0]))
    first = np.cumsum([0, *map(len, texts)])
    words = np.concatenate(texts).astype(np.int64) * scale
    expected = np.zeros((ORDERS, 3, len(words)))
    for t, text in enumerate(texts):
        for i in range(len(text)):
            for k in range(ORDERS):
                # a context at the start of a text is shorter than others
                after = [j for j in range(i) if k == 0 or (i >= k and j >= k and text[j - k : j] == text[i - k : i])]
                expected[k, :, first[t] + i] = len(after), sum(text[j] == text[i] for j in after), len({text[j] for j in after})
    sorted_ = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *more, **named: sorted_.append(len(x)) or argsort(x, *more, **named))
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    assert (histories(words, text, first[:-1]) == expected).all()
    assert not sorted_
    assert histories(words[:0], text[:0], first[:0]).shape == (ORDERS, 3, 0)
