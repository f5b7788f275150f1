"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a learned vector of the word, if it is in the lexicon, and
those of its byte trigrams and four-grams, so parts of unseen words count too. Two
gated recurrent layers read a window of WINDOW words from both ends; attention weighs
their states, and the pooled state gives the window's log odds. Windows overlap by
half and cover the whole text; the score of a text is that of its most toxic window.

The network is trained in numpy, by back-propagation through time, on a bounded sample of
labelled texts. Only whole texts are labelled, so a toxic text teaches with the window
that looks most toxic to the network so far, at first by the log odds of its words, and
a clean one with its most toxic window and another.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.textarrays import Words, longs_as_text, mix, parts, to_bytes

WINDOW, STRIDE, WIDTH, STATE = 32, 16, 12, 8
GRAMS, LEXICON, STEPS = 1 << 15, 4096, 30


def gram_ids(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams and four-grams of the chosen words and their edges, one word
    after the other, and where each word begins."""
    data = words.data.astype(np.uint64)
    begin, end = np.maximum(words.starts[chosen] - 1, 0), np.minimum(words.ends[chosen] + 1, len(data))
    ids, owner = [], []
    for n in (3, 4):
        count = np.maximum(end - begin - n + 1, 0)
        at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        gram = np.full(len(at), n, np.uint64)
        for i in range(n):
            byte = data[at + i]
            gram = gram << np.uint64(8) | np.where(byte < 33, np.uint64(32), byte)
        ids.append((mix(gram, 140) & np.uint64(GRAMS - 1)).astype(np.int64))
        owner.append(np.repeat(np.arange(len(chosen)), count))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(chosen) + 1))


def cover(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of overlapping windows over all words; an empty text has an empty one."""
    counts = np.diff(first)
    many = np.maximum(1, -(-(counts - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(counts)), many)
    start = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return first[text] + start, np.minimum(WINDOW, counts[text] - start), text


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _sums(table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of table rows over ids[first[i]:first[i + 1]], zero for an empty range."""
    out = np.zeros((len(first) - 1, table.shape[1]), table.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(table[ids], first[:-1][full], axis=0)
    return out


class Network:
    def __init__(self, lexicon: np.ndarray, seed: int = 11):
        draw = np.random.default_rng(seed)
        shapes = {
            "word": (LEXICON + 1, WIDTH), "gram": (GRAMS, WIDTH), "gate_f": (WIDTH, 3 * STATE), "gate_b": (WIDTH, 3 * STATE),
            "loop_f": (STATE, 3 * STATE), "loop_b": (STATE, 3 * STATE), "bias_f": (3 * STATE,), "bias_b": (3 * STATE,),
            "attend": (2 * STATE,), "out": (2 * STATE,), "base": (1,),
        }
        scale = {"word": 0.05, "gram": 0.05, "bias_f": 0, "bias_b": 0, "base": 0}
        self.lexicon = lexicon
        self.p = {n: (draw.standard_normal(s) * scale.get(n, 0.4)).astype(np.float32) for n, s in shapes.items()}
        self.moments = {n: [np.zeros_like(x), np.zeros_like(x)] for n, x in self.p.items()}
        self.steps = 0

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the lexicon; the last row stands for all other words."""
        if not len(self.lexicon):
            return np.full(len(hashes), LEXICON)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, LEXICON)

    def inputs(self, word: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.p["word"][word] + _sums(self.p["gram"], ids, first) / np.sqrt(np.maximum(np.diff(first), 1))[:, None].astype(np.float32)

    def _read(self, gates: np.ndarray, there: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States after each word (step, window, state), from the front or the back."""
        loop, steps = self.p["loop_" + side], range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
        h = np.zeros((gates.shape[1], STATE), np.float32)
        states = np.empty((WINDOW, len(h), STATE), np.float32)
        for t in steps:
            again = h @ loop
            zr = _logistic(gates[t, :, : 2 * STATE] + again[:, : 2 * STATE])
            z, r = zr[:, :STATE], zr[:, STATE:]
            n = np.tanh(gates[t, :, 2 * STATE :] + r * again[:, 2 * STATE :])
            new = np.where(there[t][:, None], n + z * (h - n), h)
            if keep is not None:
                keep.append((t, h, z, r, n, again[:, 2 * STATE :]))
            h = states[t] = new
        return states

    def forward(self, x: np.ndarray, at: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log odds of windows: ``x`` are word inputs, ``at`` (step, window) their places."""
        trace = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        both = [self._read((x @ self.p["gate_" + s] + self.p["bias_" + s])[at], there, s, trace[s]) for s in "fb"]
        states = np.concatenate(both, 2)
        heed = np.where(there, states @ self.p["attend"], -1e9)
        heed = np.exp(heed - heed.max(0)) * there
        heed /= np.maximum(heed.sum(0), 1e-9)
        pooled = np.einsum("tw,tws->ws", heed, states)
        if keep is not None:
            keep.update(trace=trace, states=states, heed=heed, pooled=pooled)
        return pooled @ self.p["out"] + self.p["base"]

    def learn(self, word, ids, first, at, there, label, weight, rate=0.01) -> None:
        """One step of Adam on windows; the words of all windows are numbered by ``at``."""
        x, keep = self.inputs(word, ids, first), {}
        wrong = ((_logistic(self.forward(x, at, there, keep)) - label) * weight / len(label)).astype(np.float32)
        p, states, heed = self.p, keep["states"], keep["heed"]
        g = {"out": keep["pooled"].T @ wrong, "base": wrong.sum(keepdims=True)}
        d_pool = wrong[:, None] * p["out"]
        d_heed = np.einsum("ws,tws->tw", d_pool, states)
        d_heed = heed * (d_heed - (heed * d_heed).sum(0))
        g["attend"] = np.einsum("tw,tws->s", d_heed, states)
        d_states = heed[..., None] * d_pool + d_heed[..., None] * p["attend"]
        d_x = np.zeros_like(x)
        for i, s in enumerate("fb"):
            loop = p["loop_" + s]
            d_loop, d_gates = np.zeros_like(loop), np.zeros((*at.shape, 3 * STATE), np.float32)
            d_h = np.zeros((at.shape[1], STATE), np.float32)
            for t, h, z, r, n, again in reversed(keep["trace"][s]):
                d_h = d_h + d_states[t, :, i * STATE : (i + 1) * STATE]
                on = there[t][:, None]
                d_n = d_h * (1 - z) * (1 - n**2)
                pre = np.concatenate([d_h * (h - n) * z * (1 - z), d_n * again * r * (1 - r), d_n], 1) * on
                d_gates[t] = pre
                back = pre.copy()
                back[:, 2 * STATE :] *= r
                d_loop += h.T @ back
                d_h = np.where(on, d_h * z, d_h) + back @ loop.T
            flat = np.zeros((len(x), 3 * STATE), np.float32)
            np.add.at(flat, at[there], d_gates[there])
            g["loop_" + s], g["bias_" + s], g["gate_" + s] = d_loop, flat.sum(0), x.T @ flat
            d_x += flat @ p["gate_" + s].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], word, d_x)
        sizes = np.diff(first)
        np.add.at(g["gram"], ids, np.repeat(d_x / np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32), sizes, axis=0))
        self.steps += 1
        for name, x in p.items():
            slope = g[name] + (1e-4 * x if x.ndim == 2 else 0)
            m, v = self.moments[name]
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            x -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Log odds of the most toxic window of each text."""
        words = Words(texts)
        hashes = words.hashes()
        start, length, text = cover(words.first)
        unique, chosen, back = np.unique(hashes, return_index=True, return_inverse=True)
        ids, first = gram_ids(words, chosen)
        x = self.inputs(self.word_ids(unique), ids, first) if len(unique) else np.zeros((1, WIDTH), np.float32)
        odds = np.empty(len(start), np.float32)
        for a in range(0, len(start), 4096):
            at, there = _places(start[a : a + 4096], length[a : a + 4096], back)
            odds[a : a + 4096] = self.forward(x, at, there)
        return np.maximum.reduceat(odds, np.searchsorted(text, np.arange(len(texts))))


def _places(start: np.ndarray, length: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(WINDOW)[:, None]
    there = step < length
    at = np.minimum(start + step, max(len(back) - 1, 0))
    return (back[at] if len(back) else np.zeros(at.shape, np.int64)), there


def fit(texts: list[bytes], label: np.ndarray, rounds: int = 14, seed: int = 4) -> Network:
    """A network trained on texts with labels 0 and 1."""
    draw = np.random.default_rng(seed)
    words = Words(texts)
    hashes = words.hashes()
    start, length, text = cover(words.first)
    unique, chosen, back = np.unique(hashes, return_index=True, return_inverse=True)
    # in how many texts of either label a word is
    pair = np.unique(np.stack([back, words.doc]), axis=1)
    seen = np.stack([np.bincount(pair[0], label[pair[1]] == y, len(unique)) for y in (0, 1)])
    network = Network(np.sort(unique[np.argsort(-seen.sum(0), kind="stable")[:LEXICON]]))
    word = network.word_ids(unique)
    ids, first = gram_ids(words, chosen)
    total = np.array([(label == 0).sum(), (label == 1).sum()])[:, None]
    if not total.all():
        network.p["base"][:] = 6.0 if total[1] else -6.0
        network.p["out"][:] = 0
        return network
    # a gram's log odds tell more than those of rare words
    gram_doc = np.unique(np.repeat(np.arange(len(unique)), np.diff(first)) * np.int64(GRAMS) + ids)
    doc_gram = np.stack([np.bincount(gram_doc % GRAMS, seen[y][gram_doc // GRAMS], GRAMS) for y in (0, 1)])
    grade = np.log((doc_gram[1] + 1) / total[1]) - np.log((doc_gram[0] + 1) / total[0])
    evidence = np.maximum.reduceat(grade[ids], first[:-1])
    at, there = _places(start, length, back)
    odds = np.where(there, evidence[at], -9).max(0)
    begins = np.searchsorted(text, np.arange(len(texts)))
    amount = np.diff(np.r_[begins, len(text)])
    for epoch in range(rounds):
        if epoch in (3, 6, 9, 11):
            x = network.inputs(word, ids, first)
            odds = np.concatenate([network.forward(x, *_places(start[a : a + 4096], length[a : a + 4096], back)) for a in range(0, len(start), 4096)])
        order = np.lexsort((odds, text))
        top = order[np.r_[begins[1:], len(text)] - 1]
        other = begins + draw.integers(0, amount)
        clean = np.flatnonzero(label == 0)
        picked = np.r_[top, other[clean]]
        truth = np.r_[label, np.zeros(len(clean))].astype(np.float32)
        weight = np.where(truth == 1, (truth == 0).sum() / (2 * max((truth == 1).sum(), 1)), 1.0).astype(np.float32)
        rate = 0.01 if epoch < 8 else 0.003
        # a small sample is gone through several times, for as many steps as a large one needs
        order = np.concatenate([draw.permutation(len(picked)) for _ in range(max(1, -(-STEPS * 64 // len(picked))))])
        for some in np.array_split(order, max(1, len(order) // 64)):
            at, there = _places(start[picked[some]], length[picked[some]], back)
            used, spot = np.unique(at, return_inverse=True)
            sizes = np.diff(first)[used]
            flat = ids[np.repeat(first[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            # some words are hidden, so that their parts are learned as well
            names = np.where(draw.random(len(used)) < 0.3, LEXICON, word[used])
            network.learn(names, flat, np.r_[0, np.cumsum(sizes)], spot.reshape(at.shape), there, truth[some], weight[some], rate)
    del network.moments
    return network


def score_toxicity(
    docs: DataFrame,
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    per_label: int = 1200,
    longest: int = 8000,
) -> DataFrame:
    """(key, score) of each row of ``docs``: the probability of its most toxic window, between 0 and 1.

    Learned from the rows of ``labelled`` whose label is 0 or 1: about ``per_label`` texts of
    each label, whatever their length; of one over ``longest`` characters a run of that many, begun at a place that a hash chooses,
    which bounds what is learned from. Every text is scored in whole. A null or blank text has the score of an empty
    window. Without labels every score is one half. Null keys and repeated rows are
    kept; an empty table gives an empty result.
    """
    rated = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull())
    begin = F.pmod(F.xxhash64(key, text, F.lit(1)), F.greatest(F.char_length(text) - longest + 1, F.lit(1))) + 1
    part = F.substring(text, begin.cast("int"), F.lit(longest)).alias(text)
    rated = rated.select(part, F.col(label).cast("int").alias("y"), F.xxhash64(key, text).alias("h"))
    counts = {r["y"]: r["count"] for r in rated.groupBy("y").count().collect()}
    share = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for y, n in counts.items():
        keep = keep | ((F.col("y") == y) & (share < per_label / n))
    sample = rated.where(keep).toPandas().sort_values("h") if counts else pd.DataFrame()
    network = fit(to_bytes(sample[text], fold=True), sample["y"].to_numpy()) if len(sample) else None

    def run(batches):
        for rows in batches:
            texts = to_bytes(rows[text], fold=True)
            for a, b in parts(texts, most=20_000):
                odds = network.score(texts[a:b]) if network else np.zeros(b - a)
                yield pd.DataFrame({key: rows[key].iloc[a:b], "score": _logistic(odds.astype(np.float64))})

    done = longs_as_text(docs.select(key, text)).mapInPandas(run, f"`{key}` string, score double")
    return done.withColumn(key, F.col(key).cast(docs.schema[key].dataType))
