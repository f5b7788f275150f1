"""Online logistic mixing over the words of a running text.

A word is predicted in levels. The lowest is its spelling; above it stand the word counts of the
corpus, then the words of the text so far: all of them, and those that followed the same one, two
and three words. Each level has a bit, "the word is one that this context has had before", whose
predictor counts how often that was so (ones) and how often a word was new there (zeros). A mixer adds the
log odds of all levels with weights of the gate that the level's evidence selects, which gives the
share of the level in the word's probability; the rest goes to the levels below. All
shares are of distributions over words, so the probabilities of all next words add up to one.

Weights start alike for every text and are refined as the text goes on, a step per run of
``BLOCK`` words, so a score depends on the text and the corpus alone, not on its neighbours.
"""

import numpy as np

ORDERS, BLOCK, RATE, PRIOR = 4, 64, 0.02, 0.4
LEVELS, GATES = ORDERS + 1, 3
#: texts that are stepped through at once
TOGETHER = 128
#: weight of a level's own log odds and its constant input, at the start of a text: corpus, text, one, two and three words
OWN, CONSTANT = (0.0, 0.5, 0.5, 1.0, 1.0), (0.0, -2.5, -1.5, 0.0, 1.0)
FLOOR = -290.0  # smallest log10 probability that is mixed as a double


def start_weights(texts: int) -> np.ndarray:
    """(text, level, gate, input): the inputs are the levels' log odds and a constant."""
    weights = np.zeros((texts, LEVELS, GATES, LEVELS + 1))
    for level in range(LEVELS):
        weights[:, level, :, level], weights[:, level, :, LEVELS] = OWN[level], CONSTANT[level]
    return weights


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by columns of whole numbers from zero, of equal ones the earlier first, and at each the one where
    its equals begin."""
    count = len(columns[0])
    index, bits = np.arange(count), [int(c.max(initial=0)).bit_length() for c in (*columns, np.array([count]))]
    if sum(bits) <= 64:
        # in one number each, which sorts several times as fast as an order is found
        key = np.zeros(count, np.uint64)
        for column, wide in zip((*columns, index), bits):
            key = key << np.uint64(wide) | column.astype(np.uint64)
        key.sort()
        order = (key & np.uint64((1 << bits[-1]) - 1)).astype(np.int64)
        fresh = np.diff(key >> np.uint64(bits[-1]), prepend=np.uint64(0)) != 0
    else:
        order = np.lexsort(columns[::-1])
        fresh = np.any([np.diff(c[order], prepend=0) != 0 for c in columns], axis=0)
    return order, np.maximum.accumulate(np.where(fresh, index, 0))


def histories(words: np.ndarray, text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(order, 3, position): for the words of some texts, laid end to end, after 0, 1, 2 ... words of the same text: the
    earlier positions of this context, those of them with the same word, and the distinct words at them. ``first``
    is the first position of each text.

    A context of some words is the context and word of one position before, and these are found among the positions
    whose shorter ones come more than once."""
    out = np.zeros((ORDERS, 3, len(words)), np.float32)
    at = np.arange(len(words)) - first[text]
    order, begin = grouped(text, words)
    for k in range(ORDERS):
        index = np.arange(len(order))
        out[k, 1, order] = index - begin
        new = out[k, 1] == 0
        if k == 0:
            before = np.cumsum(new) - new
            out[k, 0], out[k, 2] = at, before - before[first[text]]
        else:
            earlier = np.cumsum(new[after] & inside) - (new[after] & inside)
            out[k, 0, after[inside]] = (out[k - 1, 1])[after[inside] - 1]
            out[k, 2, after[inside]] = (earlier - earlier[start])[inside]
        if k + 1 < ORDERS:
            after, start = np.minimum(order + 1, len(words) - 1), begin
            inside = (after > order) & (at[after] > 0)
            named = np.full(len(words), -1)
            repeated = (np.bincount(begin, minlength=len(order)) > 1)[begin]
            named[order[repeated]] = begin[repeated]
            among = np.flatnonzero((named[1:] >= 0) & (named[:-1] >= 0) & (at[1:] > 0)) + 1
            order, begin = grouped(named[among - 1], named[among])
            order = among[order]
    return out


def running_scores(spelled: np.ndarray, share: np.ndarray, corpus: np.ndarray, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each of some texts, laid end to end.

    Per position: the log10 probability of its spelling, its word's share of the words of the
    corpus, and its word's number; per text: (ones, zeros) of the corpus level, and its first position
    (one more than texts)."""
    sizes = np.diff(first)
    texts = len(sizes)
    text = np.repeat(np.arange(texts), sizes)
    past = histories(words, text, first[:-1])
    low = np.maximum(spelled, FLOOR)
    # a row per level, a column per position
    told, zeros, ones = (np.empty((LEVELS, len(words)), np.float32) for _ in range(3))
    told[0], zeros[0], ones[0] = share, corpus[text, 1], corpus[text, 0]
    told[1:] = past[:, 1] / np.maximum(past[:, 0], 1)
    zeros[1:], ones[1:] = past[:, 2], past[:, 0] - past[:, 2]
    known = ones + zeros
    # a row per position; the last input is constant
    inputs = np.ones((len(words), LEVELS + 1), np.float32)
    inputs[:, :LEVELS] = np.where(known > 0, np.log((ones + PRIOR) / (zeros + PRIOR)), 0).T
    gate = np.where(known > 0, (known > 1.5).astype(np.int8) + (known > 4.5), -1).astype(np.int8)
    result = np.bincount(text, np.where(told.any(0), 0.0, spelled - low), texts)
    order = np.argsort(-sizes, kind="stable")
    weights = start_weights(texts).reshape(texts, LEVELS * GATES, LEVELS + 1)
    for step in range(0, int(sizes.max(initial=0)), BLOCK):
        going = int(np.searchsorted(-sizes[order], -step, "left"))
        for begin in range(0, going, TOGETHER):
            active = order[begin : min(begin + TOGETHER, going)]
            at = step + np.arange(min(BLOCK, int(sizes[active[0]]) - step))
            inside = at < sizes[active][:, None]
            place = first[active][:, None] + np.where(inside, at, 0)
            x, held = inputs[place].astype(float), weights[active]
            logits = held @ x.transpose(0, 2, 1)
            p, lam, credit, gates = 10.0 ** low[place], [], [], []
            for k in range(LEVELS):
                g, f, own = gate[k][place], told[k][place], logits[:, k * GATES : (k + 1) * GATES]
                gates.append(g)
                own = np.where(g == 0, own[:, 0], np.where(g == 1, own[:, 1], own[:, 2]))
                lam.append(np.where(g >= 0, 1 / (1 + np.exp(-np.clip(own, -12, 12))), 0.0))
                own = lam[k] * f
                p = own + (1 - lam[k]) * p
                credit.append(own / np.maximum(p, 1e-320))
            result[active] += np.where(inside, np.log10(np.maximum(p, 1e-320)), 0.0).sum(1)
            left, parts = inside * RATE, logits
            for k in reversed(range(LEVELS)):
                slope = left * (credit[k] - lam[k])
                left = left * (1 - credit[k])
                for j in range(GATES):
                    np.multiply(slope, gates[k] == j, out=parts[:, k * GATES + j])
            weights[active] = held + parts @ x
    return result
