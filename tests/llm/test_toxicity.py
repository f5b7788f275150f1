import cases
import numpy as np
from pyspark.sql import functions as F

from wattspan.llm import toxicity
from wattspan.llm.toxicity import WINDOW, Network, cover, score_toxicity


def test_windows_overlap_and_cover_every_word():
    first = np.array([0, 0, 1, 33, 33 + 100, 233 + 48])
    start, length, text = cover(first)
    for t, (a, b) in enumerate(zip(first, first[1:])):
        own = [(s, n) for s, n, x in zip(start, length, text) if x == t]
        assert own and {i for s, n in own for i in range(s, s + n)} == set(range(a, b))


def test_gradients_equal_differences():
    net, draw = Network(np.zeros(0, np.uint64)), np.random.default_rng(0)
    net.p = {n: x.astype(np.float64) for n, x in net.p.items()}
    net.moments = {n: [np.zeros_like(x), np.zeros_like(x)] for n, x in net.p.items()}
    word, sizes = draw.integers(0, 50, 20), draw.integers(0, 5, 20)
    first = np.r_[0, np.cumsum(sizes)]
    ids, at = draw.integers(0, 60, first[-1]), draw.integers(0, 20, (WINDOW, 5))
    there, y = np.arange(WINDOW)[:, None] < np.array([32, 10, 3, 0, 20]), np.array([1.0, 0, 1, 0, 0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.inputs(word, ids, first), at, there)))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    net.learn(word, ids, first, at, there, y, np.ones(5), rate=0.0)
    for name, values in net.p.items():
        flat, slope = values.reshape(-1), net.moments[name][0].reshape(-1) * 10
        i = int(np.abs(slope).argmax())
        held = flat[i]
        flat[i] = held + 1e-4
        up = loss()
        flat[i] = held - 1e-4
        down = loss()
        flat[i] = held
        assert abs((up - down) / 2e-4 + 1e-4 * held * (values.ndim == 2) - slope[i]) < 1e-4 * (1 + abs(slope[i])), name


def test_forward_equals_a_plain_pass_word_by_word():
    """Windows of every length, one empty, against gates and attention written out for single words."""
    net, draw = Network(np.zeros(0, np.uint64)), np.random.default_rng(3)
    net.p = {n: draw.standard_normal(x.shape) * 0.4 for n, x in net.p.items()}
    sizes = [WINDOW, 10, 1, 0, 5]
    x, at = draw.standard_normal((20, net.p["gate_f"].shape[0])), draw.integers(0, 20, (WINDOW, len(sizes)))
    there = np.arange(WINDOW)[:, None] < np.array(sizes)
    got = net.forward(x, at, there)

    def logistic(v):
        return 1 / (1 + np.exp(-v))

    def read(words, side):
        wide = len(net.p["loop_" + side])
        h, out = np.zeros(wide), []
        for v in words:
            gates, again = v @ net.p["gate_" + side] + net.p["bias_" + side], h @ net.p["loop_" + side]
            z, r = logistic(gates[:wide] + again[:wide]), logistic(gates[wide : 2 * wide] + again[wide : 2 * wide])
            h = (1 - z) * np.tanh(gates[2 * wide :] + r * again[2 * wide :]) + z * h
            out.append(h)
        return out

    for w, n in enumerate(sizes):
        words = [x[at[t, w]] for t in range(n)]
        states = [np.concatenate(pair) for pair in zip(read(words, "f"), read(words[::-1], "b")[::-1])]
        heed = np.array([np.exp(s @ net.p["attend"]) for s in states])
        pooled = sum((a * s for a, s in zip(heed / heed.sum(), states)), np.zeros(len(net.p["out"])))
        assert abs(got[w] - (pooled @ net.p["out"] + net.p["base"][0])) < 1e-4


def corpus(spark, n, seed):
    draw, rows = np.random.default_rng(seed), []
    for i in range(n):
        words, bad = cases.prose(int(draw.integers(5, 200)), seed * 1000 + i).split(), int(i % 3 == 0)
        for j in draw.integers(0, len(words), 3 * bad):
            words[j] = ("idiot", "scum", "lostra" + words[j])[draw.integers(0, 3)]
        rows.append((i, " ".join(words), bad))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_texts(spark):
    train, held = corpus(spark, 300, 1), corpus(spark, 150, 2)
    got = held.join(score_toxicity(held.drop("toxic"), train), "doc_id").collect()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in got]) > 0.93
    # one toxic passage at the very end of a long text is seen
    long = held.where("doc_id = 1").withColumn("text", F.concat(F.lit(cases.prose(5000, 8)), F.lit(" you idiot scum")))
    assert score_toxicity(long, train).first().score > 0.7


def test_long_texts_are_learned_from(spark):
    """All toxic texts are longer than what is taken of one."""
    train = corpus(spark, 150, 5)
    toxic = F.concat(F.lit("scum idiot "), F.repeat(F.concat("text", F.lit(" scum idiot ")), 20))
    train = train.withColumn("text", F.when(F.col("toxic") == 1, toxic).otherwise(F.col("text")))
    long = train.withColumn("text", F.when(F.col("toxic") == 1, F.repeat("text", 10)).otherwise(F.col("text")))
    assert long.where("toxic = 1").agg(F.min(F.length("text"))).first()[0] > 8000
    held = corpus(spark, 60, 6)
    got = held.join(score_toxicity(held.drop("toxic"), long), "doc_id").collect()
    assert any(r.score >= 0.7 for r in got if r.toxic) and len({r.score for r in got}) > 10


def test_awkward_rows(docs, empty, spark):
    train = corpus(spark, 60, 3)
    got = score_toxicity(docs, train).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (6, 7, 8)}) == 1
    assert score_toxicity(empty, train).collect() == []
    assert {r.score for r in score_toxicity(docs, train.where("false")).collect()} == {0.5}
    assert len(score_toxicity(docs, train.withColumn("toxic", F.lit(1))).collect()) == docs.count()
    assert toxicity.STRIDE * 2 == WINDOW
