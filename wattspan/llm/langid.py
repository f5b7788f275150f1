"""Language identification with a linear-chain conditional random field.

Each word gets a label by forward-backward over the whole text, so a text that switches
language in the middle is labelled piece by piece. A word's evidence is the sum of
learned weights of its affixes, its byte n-grams and, if it is in the lexicon of
frequent training words, of the word itself; learned transitions tie neighbours
together. The language of a document is the one with the largest sum of word
probabilities.

The model is fitted on a bounded sample: ``per_language`` documents of each language on
average, of each one run of SPAN words at a place chosen by the hash of its key. Runs
of different languages are joined to code-switched training sequences.
"""

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.textarrays import Words, longs_as_text, mix, text_slices, to_bytes

SPAN, BLOCK, BITS = 64, 64, 18
LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


def word_features(words: Words, chosen: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the chosen words, one word after the other, and where each word
    begins: prefixes and suffixes of one to three bytes, n-grams of two to four bytes within
    the word and its edges, and the word if it is in the (sorted) lexicon."""
    mask, data = np.uint64((1 << BITS) - 1), words.data.astype(np.uint64)
    starts, ends = words.starts[chosen], words.ends[chosen]
    ids, owner = [], []

    def add(values: np.ndarray, who: np.ndarray, kind: int) -> None:
        ids.append((mix(values, 60 + kind) & mask).astype(np.int32))
        owner.append(who)

    who = np.arange(len(chosen))
    for n in (1, 2, 3):
        fits = ends - starts >= n
        head, tail = np.zeros(fits.sum(), np.uint64), np.zeros(fits.sum(), np.uint64)
        for i in range(n):
            head = head << np.uint64(8) | data[starts[fits] + i]
            tail = tail << np.uint64(8) | data[ends[fits] - n + i]
        add(head, who[fits], n)
        add(tail, who[fits], 10 + n)
    for n in (2, 3, 4):
        # the bytes on both sides of a word are white space and mark its edges
        begins, count = np.maximum(starts - 1, 0), np.maximum(ends + 1 - np.maximum(starts - 1, 0) - n + 1, 0)
        count = np.minimum(count, len(data) - n + 1 - begins)
        at = np.repeat(begins - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        gram = np.zeros(len(at), np.uint64)
        for i in range(n):
            byte = data[at + i]
            gram = gram << np.uint64(8) | np.where(byte < 33, np.uint64(32), byte)
        add(gram, np.repeat(who, count), 20 + n)
    if len(lexicon):
        spot = np.minimum(np.searchsorted(lexicon, hashes[chosen]), len(lexicon) - 1)
        known = lexicon[spot] == hashes[chosen]
        add(hashes[chosen][known], who[known], 30)
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(chosen) + 1))


def evidence(texts: list[bytes], weights: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed weights of each word, and where each text's words begin."""
    words = Words(texts)
    hashes = words.hashes()
    if not len(hashes):
        return np.zeros((0, weights.shape[1])), words.first
    _, chosen, back = np.unique(hashes, return_index=True, return_inverse=True)
    ids, first = word_features(words, chosen, hashes, lexicon)
    return np.add.reduceat(weights[ids], first[:-1], axis=0)[back], words.first


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)


def word_posteriors(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of each word, each text being a chain of its own.

    Texts are cut into blocks of BLOCK words. The product of a block's matrices carries
    messages from block to block, so long texts do not hold up the blocks that are
    worked side by side; the result is that of the whole chain.
    """
    labels = transitions.shape[0]
    step = np.exp(transitions)
    local = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -60.0)) if len(scores) else scores
    counts = np.diff(first)
    blocks = -(-counts // BLOCK)
    n = int(blocks.sum())
    if not n:
        return np.zeros((0, labels))
    doc = np.repeat(np.arange(len(counts)), blocks)
    head = np.r_[0, np.cumsum(blocks)]
    order = np.arange(n) - head[doc]
    begin = first[doc] + order * BLOCK
    length = np.minimum(BLOCK, first[doc + 1] - begin)
    at = np.minimum(begin + np.arange(BLOCK)[:, None], len(local) - 1)
    there = np.arange(BLOCK)[:, None] < length
    # words beyond a block's end are passed over by rows that stay as they are
    carry = np.broadcast_to(np.eye(labels), (n, labels, labels)).copy()
    several = blocks[doc] > 1
    for t in range(BLOCK):
        rows = np.flatnonzero(there[t] & several)
        if not len(rows):
            continue
        new = (carry[rows].reshape(-1, labels) @ step).reshape(-1, labels, labels) * local[at[t, rows], None]
        carry[rows] = new / new.sum((1, 2), keepdims=True)
    before, after = np.full((n, labels), 1.0 / labels), np.full((n, labels), 1.0 / labels)
    for j in range(1, int(blocks.max())):
        rows = head[:-1][blocks > j] + j
        before[rows] = _scaled(np.einsum("ri,rij->rj", before[rows - 1], carry[rows - 1]))
    for j in range(1, int(blocks.max())):
        rows = head[1:][blocks > j] - 1 - j
        after[rows] = _scaled(np.einsum("rij,rj->ri", carry[rows + 1], after[rows + 1]))
    forward = np.empty((BLOCK, n, labels))
    for t in range(BLOCK):
        new = (before @ step) * local[at[t]]
        before = np.where(there[t][:, None], _scaled(new), before)
        forward[t] = before
    out = np.empty((len(local), labels))
    for t in range(BLOCK - 1, -1, -1):
        rows = np.flatnonzero(there[t])
        out[at[t, rows]] = _scaled(forward[t, rows] * after[rows])
        after[rows] = _scaled((local[at[t, rows]] * after[rows]) @ step.T)
    return out


def fit(texts: list[bytes], labels: np.ndarray, count: int, lexicon_size: int, rounds: int = 6, rate: float = 0.3, seed: int = 5):
    """(weights, transitions, lexicon) from runs of words and their labels (0 .. count - 1)."""
    draw = np.random.default_rng(seed)
    words = Words(texts)
    hashes = words.hashes()
    label = labels[words.doc]
    names, times = np.unique(hashes, return_counts=True)
    lexicon = np.sort(names[np.argsort(-times, kind="stable")[:lexicon_size]])
    unique, chosen, back = np.unique(hashes, return_index=True, return_inverse=True)
    ids, first = word_features(words, chosen, hashes, lexicon)
    weights, square = np.zeros((1 << BITS, count)), np.full((1 << BITS, count), 1e-3)
    transitions, moved = np.eye(count), np.full((count, count), 1e-3)
    # sequences: whole runs, and runs of different languages cut and joined
    own = [np.arange(a, b) for a, b in zip(words.first[:-1], words.first[1:], strict=True) if b > a]
    half = len(own) // 2
    joined = []
    for i in range(half):
        some = [own[j] for j in draw.integers(0, len(own), 3)]
        cuts = [x[(s := draw.integers(0, len(x))) : s + draw.integers(4, 24)] for x in some]
        joined.append(np.concatenate(cuts))
    every = own + joined
    for epoch in range(rounds):
        for batch in np.array_split(draw.permutation(len(every)), max(1, len(every) // 128)):
            seqs = [every[i] for i in batch]
            at = np.concatenate(seqs)
            start = np.r_[0, np.cumsum([len(s) for s in seqs])]
            used, where = np.unique(back[at], return_inverse=True)
            sizes = first[used + 1] - first[used]
            flat = ids[np.repeat(first[used] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
            cut = np.r_[0, np.cumsum(sizes)[:-1]]
            scores = np.add.reduceat(weights[flat], cut, axis=0)[where]
            chance = word_posteriors(scores, start, transitions)
            wrong = chance.copy()
            wrong[np.arange(len(at)), label[at]] -= 1
            per_word = np.zeros((len(used), count))
            np.add.at(per_word, where, wrong / len(seqs))
            features, spot = np.unique(flat, return_inverse=True)
            slope = np.zeros((len(features), count))
            np.add.at(slope, spot, np.repeat(per_word, sizes, axis=0))
            slope += 1e-5 * weights[features]
            square[features] += slope**2
            weights[features] -= rate * slope / np.sqrt(square[features])
            # pair probabilities of neighbours against the pairs of labels
            follow = np.ones(len(at), bool)
            follow[start[:-1]] = False
            right = np.flatnonzero(follow)
            pair = chance[right - 1][:, :, None] * np.exp(transitions)[None] * chance[right][:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            slope = pair.sum(0)
            np.add.at(slope, (label[at[right - 1]], label[at[right]]), -1)
            slope /= len(seqs)
            moved += slope**2
            transitions -= 0.1 * slope / np.sqrt(moved)
            transitions -= transitions.mean()
    return weights.astype(np.float32), transitions, lexicon


def identify_languages(
    docs: DataFrame,
    training: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 1500,
    lexicon_size: int = 4096,
) -> DataFrame:
    """(key, lang_pred, score) of each row of ``docs``, learned from the rows of ``training`` with text and language.

    A null text or one without a letter is ``und`` with score 0, as is every text if
    there is nothing to learn from. score is the mean probability of the language over
    the text's words. Null keys and repeated rows are kept; an empty table gives an
    empty result. ``per_language`` bounds the sample that is learned from, on average.
    """
    training = training.where(f"`{lang}` IS NOT NULL AND `{text}` IS NOT NULL").select(key, text, lang)
    counts = {r[lang]: r["count"] for r in training.groupBy(lang).count().collect()}  # a row per language
    names = sorted(counts)
    chance = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for name in names:
        keep = F.when(F.col(lang) == name, chance < per_language / counts[name]).otherwise(keep)
    words = F.split(F.trim(text), "[ \t-\r]+")
    start = F.pmod(F.xxhash64(key, F.lit(1)), F.greatest(F.size("w") - SPAN + 1, F.lit(1))).cast("int")
    runs = training.where(keep).select(lang, key, words.alias("w")).select(lang, F.array_join(F.slice("w", start + 1, SPAN), " ").alias("run"))
    sample = runs.toPandas() if names else pd.DataFrame({lang: [], "run": []})  # per_language runs of SPAN words each
    learned = len(sample) > 0
    if learned:
        sample = sample.sort_values([lang, "run"])
        labels = sample[lang].map({n: i for i, n in enumerate(names)}).to_numpy()
        weights, transitions, lexicon = fit(to_bytes(sample["run"], fold=True), labels, len(names), lexicon_size)

    def run(batches):
        for rows in batches:
            for a, b, texts in text_slices(rows[text], fold=True):
                spoken = [isinstance(t, str) and LETTER.search(t) is not None for t in rows[text].iloc[a:b]]
                found, score = [UNDETERMINED] * (b - a), np.zeros(b - a)
                if learned:
                    scores, first = evidence(texts, weights, lexicon)
                    chance = word_posteriors(scores, first, transitions)
                    total = np.diff(np.vstack([np.zeros(len(names)), np.cumsum(chance, axis=0)])[first], axis=0)
                    best = total.argmax(1)
                    score = total.max(1) / np.maximum(np.diff(first), 1)
                    found = [names[i] if s else UNDETERMINED for i, s in zip(best, spoken, strict=True)]
                yield pd.DataFrame(
                    {key: rows[key].iloc[a:b], "lang_pred": found, "score": np.clip(np.where(spoken, score, 0.0), 0.0, 1.0)}
                )

    done = longs_as_text(docs.select(key, text)).mapInPandas(run, f"`{key}` string, lang_pred string, score double")
    return done.withColumn(key, F.col(key).cast(docs.schema[key].dataType))
