import cases
import numpy as np
from pyspark.sql import functions as F

from wattspan.llm.quality import DIM, features, fit, grade_documents, tail_probabilities


def texts(n, seed):
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        grade = int(draw.integers(0, 3))
        words = cases.prose(60, seed * 10_000 + i).split()
        marks = {0: 30, 1: 10, 2: 0}[grade]
        for j in draw.integers(0, 60, marks):
            words[j] = words[j].upper() + "!!"
        out.append((" ".join(words), grade))
    return out


def test_held_out_accuracy_and_order(spark):
    train, held = texts(400, 1), texts(150, 2)
    rated = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train)], "doc_id long, text string, grade int")
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(held)], "doc_id long, text string, truth int")
    got = {r.doc_id: r for r in grade_documents(docs, rated, grades=3).collect()}
    right = [round(got[i].expected_grade) == g for i, (_, g) in enumerate(held)]
    assert np.mean(right) > 0.9
    assert all(r.tail[0] >= r.tail[1] and abs(sum(r.tail) - r.expected_grade) < 1e-9 for r in got.values())


def test_thresholds_are_ordered():
    x = features([t.encode() for t, _ in texts(80, 3)])
    index = [np.flatnonzero(r) for r in x]
    value = np.concatenate([r[i] for r, i in zip(x, index)])
    first = np.r_[0, np.cumsum([len(i) for i in index])]
    _, cuts = fit(np.concatenate(index), value, first, np.arange(80) % 3, 3, rounds=3)
    assert cuts[0] < cuts[1]
    assert tail_probabilities(np.array([0.0]), cuts).shape == (1, 2)


def test_awkward_rows(docs, empty):
    rated = docs.withColumn("grade", F.when(F.col("doc_id") > 5, F.col("doc_id") % 4))
    got = grade_documents(docs, rated, grades=3).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.expected_grade <= 2 for r in got)
    assert sum(r.doc_id is None for r in got) == 1
    assert {tuple(r.tail) for r in grade_documents(docs, rated.where("false"), grades=3).collect()} == {(0.5, 0.5)}
    assert grade_documents(empty, rated, grades=3).collect() == []


def test_a_fit_stands_where_the_likelihood_is_highest():
    """The likelihood, written out for single rows, falls to both sides of every fitted number."""
    draw = np.random.default_rng(4)
    x = draw.standard_normal((300, 3))
    noise = np.log(1 / draw.random(300) - 1)
    grade = np.digitize(x @ np.array([1.0, -0.5, 0.0]) + noise, [-1.0, 0.2, 1.5])
    weights, cuts = fit(np.tile(np.arange(3), 300), x.ravel(), np.arange(301) * 3, grade, 4, rounds=1500)

    def loss(theta):
        total = 0.0
        for row, y in zip(x, grade):
            tail = [1.0, *(1 / (1 + np.exp(c - row @ theta[:3])) for c in theta[3:]), 0.0]
            total -= np.log(tail[y] - tail[y + 1])
        return total / len(x) + 0.5e-5 * (theta[:3] ** 2).sum()

    assert np.all(np.diff(cuts) > 0) and np.abs(weights[3:DIM]).max() == 0
    best = np.r_[weights[:3].astype(float), cuts]
    for i in range(len(best)):
        step = np.zeros(len(best))
        step[i] = 0.05
        assert loss(best + step) > loss(best) < loss(best - step)
        assert abs(loss(best + step / 50) - loss(best - step / 50)) / 2e-3 < 2e-3
