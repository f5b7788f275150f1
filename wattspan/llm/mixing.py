"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words, with A-Z lower-cased, and an end mark; a word is spelled byte
by byte with a space behind it, a byte in the binary decisions of a Huffman code of the
corpus. For each decision several predictors, one per context of preceding bytes of the word,
give the counts of zeros and ones that training words had there; a mixer adds
their log odds with weights of the gate that the amount of evidence selects, and an
adaptive map per decision node corrects the result. All decisions of a code form a
tree, so the probabilities of all spellings add up to one. The spelling is the lowest level of
what predicts a word of a running text: the levels above it, and how they are mixed online in
text order, are those of :mod:`wattspan.llm.running`.

The class of a document, one of a few found by clustering the word counts of all training
texts, is coded before its words and is part of every context; its cost is part of the
score.

Words repeat, so each distinct word of a class is spelled once: tasks send the distinct words
of their slice of documents to buckets, where counts over all training documents are
added up; the counts feed the predictors; the bucket scores its spellings and sends the
scores back to each slice, which reads its texts in order. Weights are learned online in one pass over all training
words, in several parts side by side whose weights are averaged; a word is left out of the
counts that predict it. Predictors have tables of fixed size, whatever the corpus.
"""

import heapq
import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.durable import durable, remove, scratch_path
from wattspan.llm.running import running_scores
from wattspan.llm.textarrays import BYTE, Words, longs_as_text, mix, parts, powers, text_slices, to_bytes

END, SPACE = b"\xff", 0x20  # no UTF-8 text holds the byte 255
#: bits of the table of each predictor: one to four preceding bytes, and the word so far, each with the class
TABLES = (16, 18, 20, 20, 22)
FIRST = np.cumsum([0, *(1 << b for b in TABLES)])
BLOCK, GATES, STEPS, PRIOR = 1 << 16, 25, 24, 0.4
CLASSES, VECTOR, ROUNDS, FIXED, TEXTS = 8, 1024, 5, 1 << 24, 2048
#: bytes of words that are worked on at once where no order matters
SMALL = 1 << 14
NODE = mix(np.arange(256, dtype=np.uint64), 100)


class Code:
    """A Huffman code of the 256 bytes; every byte counts once more than it was seen."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        kids, fresh = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            kids[fresh] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
            fresh += 1
        walks, todo = [[] for _ in range(256)], [(fresh - 1, [])]
        while todo:
            at, walk = todo.pop()
            if at < 256:
                walks[at] = walk
            else:
                todo += [(kid, walk + [(at - 256, bit)]) for bit, kid in enumerate(kids[at])]
        self.length = np.array([len(w) for w in walks])
        self.first = np.cumsum(self.length) - self.length
        self.node = np.array([n for w in walks for n, _ in w])
        self.mixed = NODE[self.node]
        self.bit = np.array([b for w in walks for _, b in w])


def vectors(hashes: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """Hashed word counts of texts, as square roots, of length one."""
    at = doc * VECTOR + (hashes & np.uint64(VECTOR - 1)).astype(np.int64)
    x = np.sqrt(np.bincount(at, minlength=count * VECTOR).reshape(count, VECTOR))
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)


def cluster(x: np.ndarray, count: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """Centres of ``count`` classes by spherical k-means, each start far from the others."""
    if not len(x):
        return np.zeros((1, VECTOR))
    centres = x[:1]
    while len(centres) < min(count, len(x)):
        centres = np.vstack([centres, x[(x @ centres.T).max(1).argmin()]])
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        centres = np.stack([x[nearest == j].sum(0) if (nearest == j).any() else c for j, c in enumerate(centres)])
        centres /= np.maximum(np.sqrt((centres**2).sum(1, keepdims=True)), 1e-12)
    return centres


def decisions(words: bytes, classes: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots, nodes, bits, words): for words of some classes, each followed by a space, the table slot of
    each predictor at each decision (a row per predictor), and the word it belongs to."""
    data = np.frombuffer(words, np.uint8)
    begin = np.r_[0, np.flatnonzero(data == SPACE)[:-1] + 1]
    sizes = np.diff(np.r_[begin, len(data)])
    owner = np.repeat(np.arange(len(begin)), sizes)
    rel = np.arange(len(data)) - begin[owner]
    context, seen, cls = [], np.zeros(len(data), np.uint64), (classes.astype(np.uint64) << np.uint64(40))[owner]
    for back in range(1, 5):
        before = np.where(rel >= back, data[np.maximum(np.arange(len(data)) - back, 0)], np.uint8(SPACE)).astype(np.uint64)
        seen = seen << np.uint64(8) | before
        context.append(mix(seen | cls, 110 + back))
    value = BYTE[data] * powers(int(sizes.max()))[rel]
    total = np.cumsum(value) - value
    context.append(mix(mix(total - total[begin][owner] + rel.astype(np.uint64), 120) + cls, 121))
    times = code.length[data]
    ends = np.cumsum(times)
    step = np.arange(ends[-1]) + np.repeat(code.first[data] - (ends - times), times)
    mixed = code.mixed[step]
    slots = np.empty((len(TABLES), len(step)), np.uint64)
    for i, bits in enumerate(TABLES):
        row = slots[i]
        np.bitwise_xor(np.repeat(context[i], times), mixed, out=row)
        row *= np.uint64(0x9FB21C651E98DF25)
        row >>= np.uint64(64 - bits)
        row += np.uint64(FIRST[i])
    return slots.view(np.int64), code.node[step], code.bit[step], np.repeat(owner, times)


def _learned(words: bytes, counts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Those of some words that were learned from, and which they are; ``counts`` may go on behind them."""
    data = np.frombuffer(words, np.uint8)
    space = data == SPACE
    used = counts[: np.count_nonzero(space)] > 0
    return (words if used.all() else data[used[np.cumsum(space) - space]].tobytes()), np.flatnonzero(used)


def _slices(blob: bytes, size: int = 1 << 16):
    """Parts of whole words of about ``size`` bytes, and the number of words before each."""
    at = before = 0
    while at < len(blob):
        end = blob.find(b" ", min(at + size, len(blob) - 1)) + 1
        yield blob[at:end], before
        before += blob.count(b" ", at, end)
        at = end


def log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + PRIOR) / (zeros + PRIOR))


def gate_parts(near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gate is the sum of what the evidence of the third and of the last predictor give."""
    return np.searchsorted([0.5, 4.5, 32.5, 512.5], near), np.searchsorted([0.5, 2.5, 16.5, 256.5], far) * 5


class Evidence:
    """What the counts of each slot say, worked out once for all decisions that meet it: log odds and gate. If words are
    ``left_out`` of the counts that predict them, twice for each slot, for a zero and for a one."""

    def __init__(self, counts: np.ndarray, left_out: bool):
        self.wide = 2 if left_out else 1
        self.odds = np.empty((len(counts), self.wide), np.float64 if left_out else np.float32)
        total = [np.empty((FIRST[i + 1] - FIRST[i], self.wide), np.int8) for i in (2, 4)]
        for begin in range(0, len(counts), BLOCK):
            here = slice(begin, begin + BLOCK)
            for bit in range(self.wide):
                zeros, ones = counts[here, 0], counts[here, 1]
                if left_out:
                    zeros, ones = np.maximum(zeros - np.float64(1 - bit), 0), np.maximum(ones - np.float64(bit), 0)
                self.odds[here, bit] = log_odds(zeros, ones)
                for k, i in enumerate((2, 4)):
                    if FIRST[i] <= begin < FIRST[i + 1]:
                        total[k][begin - FIRST[i] : begin - FIRST[i] + BLOCK, bit] = gate_parts(zeros + ones, zeros + ones)[k]
        self.odds = self.odds.ravel()
        self.near, self.far = (t.ravel() for t in total)

    def met(self, slots: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gate) of some decisions."""
        inputs = np.empty((len(TABLES) + 1, slots.shape[1]))
        at = slots * 2 + bit if self.wide == 2 else slots
        for row, place in zip(inputs, at):
            row[:] = self.odds[place]
        inputs[-1] = 0.3
        return inputs, self.far[at[4] - FIRST[4] * self.wide].astype(np.int64) + self.near[at[2] - FIRST[2] * self.wide]


class Mixer:
    """Gated weights and an adaptive map for each node, learned online."""

    def __init__(self, weights: np.ndarray | None = None, map_: np.ndarray | None = None):
        inputs = len(TABLES) + 1
        self.weights = np.full((GATES, inputs), 0.3) if weights is None else weights
        self.square = np.full((GATES, inputs), 1e-2)
        grid = 1 / (1 + np.exp(-np.linspace(-12, 12, STEPS + 1)))
        ones = np.stack([1 - grid, grid], -1)[None].repeat(256, 0)
        self.map = 20.0 * ones if map_ is None else map_

    def mixed(self, inputs: np.ndarray, gate: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mixed probability of a one, place on the map and what is left to the next)."""
        logit = np.clip(np.einsum("ij,ij->j", self.weights.T.take(gate, axis=1), inputs), -11.99, 11.99)
        place = (logit + 12) * (STEPS / 24)
        low = place.astype(np.int64)
        return 1 / (1 + np.exp(-logit)), node * (STEPS + 1) + low, place - low

    def predict(self, zeros: np.ndarray, ones: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one, gate), from the counts that each predictor has."""
        inputs = np.concatenate([log_odds(zeros, ones), np.full((1, zeros.shape[1]), 0.3)])
        gate = sum(gate_parts(zeros[2] + ones[2], zeros[4] + ones[4]))
        return self.corrected(inputs, gate, node), gate

    def corrected(self, inputs: np.ndarray, gate: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The probability of a one, from log odds and gate."""
        mixed, low, share = self.mixed(inputs, gate, node)
        held = (self.map[..., 1] / self.map.sum(-1)).ravel()
        fixed = held[low] * (1 - share) + held[low + 1] * share
        return np.clip(0.4 * mixed + 0.6 * fixed, 1e-7, 1 - 1e-7)

    def learn(self, inputs, gate, node, bit, weight) -> None:
        """One online step on a run of decisions."""
        mixed, low, share = self.mixed(inputs, gate, node)
        wrong = (bit - mixed) * weight
        slope = np.stack([np.bincount(gate, wrong * x, GATES) for x in inputs], 1) / weight.sum()
        self.square += slope**2
        self.weights += 0.15 * slope / np.sqrt(self.square)
        flat = low * 2 + bit
        for offset, part in ((0, 1 - share), (2, share)):
            self.map += np.bincount(flat + offset, weight * part, self.map.size).reshape(self.map.shape)


def _vectors(text: str):
    """The word count vectors of documents that have words."""

    def run(batches):
        for rows in batches:
            for a, b, texts in text_slices(rows[text], fold=True, most=2048):
                words = Words(texts)
                x = vectors(words.hashes(), words.doc, b - a)[np.diff(words.first) > 0]
                yield pd.DataFrame({"x": [v.tobytes() for v in x.astype(np.float16)]})

    return run


def _stacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float16).reshape(-1, VECTOR).astype(np.float64)


def _nearest(centres: np.ndarray):
    """The sum of the vectors next to each centre, in whole numbers so that no order of adding changes it."""

    def run(batches):
        total = np.zeros(centres.shape, np.int64)
        for rows in batches:
            x = _stacked(rows["x"])
            nearest = (x @ centres.T).argmax(1)
            for j in np.unique(nearest):
                total[j] += np.rint(x[nearest == j] * FIXED).astype(np.int64).sum(0)
        yield pd.DataFrame({"class": np.arange(len(centres)), "x": [v.tobytes() for v in total]})

    return run


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(VECTOR, np.int64)
    for x in rows["x"]:
        total += np.frombuffer(x, np.int64)
    return pd.DataFrame({"class": [rows["class"].iloc[0]], "x": [total.tobytes()]})


def find_classes(texts: DataFrame, text: str, start: float, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the classes: rounds of spherical k-means over all ``texts``. The first round starts
    from the clusters of a share ``start`` of them."""
    path = scratch_path(texts.sparkSession, "vectors")
    texts.select(text).mapInPandas(_vectors(text), "x binary").write.parquet(path)
    found = texts.sparkSession.read.schema("x binary").parquet(path)
    some = found.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(min(1.0, start) * (1 << 30)))
    centres = cluster(_stacked(sorted(bytes(r["x"]) for r in some.collect())))
    for _ in range(rounds):
        sums = found.mapInPandas(_nearest(centres), "class int, x binary").groupBy("class").applyInPandas(_add, "class int, x binary")
        for row in sums.collect():  # a row per class
            x = np.frombuffer(row["x"], np.int64) / FIXED
            if x.any():
                centres[row["class"]] = x / np.sqrt((x**2).sum())
    remove(texts.sparkSession, path)
    return centres


def _gather(docs: DataFrame, key: str, text: str, train: str, buckets: int, chunk_bytes: int, centres: np.ndarray) -> DataFrame:
    """Per slice of documents: a row per bucket with its distinct words by class and their
    training counts, and a row per document with its class, its bytes and the places of its words
    among those, in text order."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        for rows in batches:
            texts = [t + b" " + END for t in to_bytes(rows[text], fold=True)]
            learned = rows[train].to_numpy(bool)
            for a, b in parts(texts, chunk_bytes):
                buffers, hashes, starts, ends, docs_, own, shift = [], [], [], [], [], [], 0
                for c, d in parts(texts[a:b], most=2048):
                    words = Words(texts[a + c : a + d])
                    hashes.append(words.hashes())
                    own.append((vectors(hashes[-1], words.doc, d - c) @ centres.T).argmax(1).astype(np.uint8))
                    starts.append(words.starts + shift)
                    ends.append(words.ends + shift)
                    docs_.append(words.doc + c)
                    buffers.append(words.data.tobytes())
                    shift += len(words.data)
                blob, docs_, own, hashes = b"".join(buffers), np.concatenate(docs_), np.concatenate(own), np.concatenate(hashes)
                _, at, back = np.unique(_paired(hashes, own[docs_]), return_index=True, return_inverse=True)
                starts, ends = np.concatenate(starts)[at], np.concatenate(ends)[at]
                count = np.bincount(back, learned[a:b][docs_], len(at)).astype("<u4")
                place = (mix(hashes[at], 13) & np.uint64(buckets - 1)).astype(np.int64)
                order = np.argsort(place, kind="stable")
                local = np.empty(len(order), np.int64)
                local[order] = np.arange(len(order))
                bounds = np.searchsorted(place[order], np.arange(buckets + 1))
                spelled = [blob[s:e] for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True)]
                kinds = own[docs_][at][order]
                sent = [
                    (number, i, b" ".join(spelled[x:y]) + b" ", count[order[x:y]].tobytes(), kinds[x:y].tobytes())
                    for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False))
                    if y > x
                ]
                out = pd.DataFrame(sent, columns=["chunk", "bucket", "words", "counts", "classes"])
                out[key], out[train], out["places"], out["size"] = None, None, None, None
                yield out
                seq = local[back]
                cuts = np.searchsorted(docs_, np.arange(b - a + 1))
                # the four bytes of a place are kept apart: the upper ones compress well
                bags = [seq[x:y].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                out = pd.DataFrame({"chunk": number, "bucket": -1, key: rows[key].iloc[a:b], train: learned[a:b]})
                out["size"] = [len(t) - 2 for t in texts[a:b]]
                out["places"], out["words"], out["counts"], out["classes"] = bags, None, None, [bytes([c]) for c in own]
                yield out
                number += 1

    return docs.mapInPandas(run, f"chunk long, bucket int, words binary, counts binary, classes binary, `{key}` string, `{train}` boolean, places binary, size long")


def _paired(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return mix(hashes + (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F), 14)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for a bucket: its distinct words with their counts over all slices, and for
    each slice where its words are among them."""
    rows = rows.sort_values("chunk")
    blob = b"".join(rows["words"])
    words = Words([blob])
    hashes, kinds = words.hashes(), np.frombuffer(b"".join(rows["classes"]), np.uint8)
    sent = np.frombuffer(b"".join(rows["counts"]), "<u4")
    _, at, back = np.unique(_paired(hashes, kinds), return_index=True, return_inverse=True)
    counts = np.bincount(back, sent, len(at)).astype("<i8")
    _, word = np.unique(hashes[at], return_inverse=True)
    whole = np.bincount(word, counts).astype("<i8")
    spelled = b" ".join([blob[s:e] for s, e in zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)]) + b" "
    cuts = np.cumsum([0, *(len(x) // 4 for x in rows["counts"])])
    index = [back[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    data = np.frombuffer(spelled, np.uint8)
    owner = np.cumsum(data == SPACE) - (data == SPACE)
    frequency = np.bincount(data, counts[owner], 256).astype(np.int64)
    one = (rows["bucket"].iloc[0], spelled, counts.tobytes(), kinds[at].tobytes(), whole[word].tobytes(), int(counts.sum()))
    one += (int((whole > 0).sum()), frequency, rows["chunk"].to_numpy(), index)
    return pd.DataFrame([one], columns=["bucket", "words", "counts", "classes", "whole", "total", "known", "frequency", "chunks", "places"])


MERGED = "bucket int, words binary, counts binary, classes binary, whole binary, total long, known long, frequency array<long>, chunks array<long>, places array<binary>"


def _tally(code: Code):
    """Counts of zeros and ones in the slots of a part of the words, by blocks of slots."""

    def run(batches):
        table = np.zeros((FIRST[-1], 2), np.int64)
        flat = table.reshape(-1)
        for rows in batches:
            for blob, counts, classes in zip(rows["words"], rows["counts"], rows["classes"], strict=True):
                classes = np.frombuffer(classes, np.uint8)
                counts = np.frombuffer(counts, "<i8")
                for piece, before in _slices(blob, SMALL):
                    piece, used = _learned(piece, counts[before:])
                    if piece:
                        slots, _, bit, owner = decisions(piece, classes[before:][used], code)
                        weight = counts[before:][used][owner]
                        for row in slots:
                            np.add.at(flat, row * 2 + bit, weight)
        for block in range(0, len(table), BLOCK):
            at = np.flatnonzero(table[block : block + BLOCK].any(1))
            if len(at):
                yield pd.DataFrame({"block": [block // BLOCK], "at": [at.astype("<u2").tobytes()], "n": [table[block + at].tobytes()]})

    return run


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of some parts of a block."""
    total = np.zeros((BLOCK, 2), np.int64)
    for at, n in zip(rows["at"], rows["n"], strict=True):
        total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.int64).reshape(-1, 2)
    at = np.flatnonzero(total.any(1))
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "at": [at.astype("<u2").tobytes()], "n": [total[at].tobytes()]})


def _in_groups(rows: DataFrame, by: str | None, parts_: int, add, result: str) -> DataFrame:
    """Rows added up in two levels, at most 32 rows at once below and as few groups as that allows
    above, so that no task holds what every part of the input sends."""
    keys = [by] if by else []
    while parts_ > 32:
        parts_ = math.ceil(parts_ / 32)
        rows = rows.withColumn("_of", F.pmod(F.xxhash64("n"), F.lit(parts_))).groupBy(*keys, "_of").applyInPandas(add, result)
    return rows.groupBy(*keys).applyInPandas(add, result)


def _train(code: Code, table):
    """An online pass over a part of the training words."""

    def run(batches):
        mixer, seen, start = Mixer(), 0.0, Mixer().map
        evidence = Evidence(table.value, left_out=True)
        for rows in batches:
            for blob, counts, classes in zip(rows["words"], rows["counts"], rows["classes"], strict=True):
                classes = np.frombuffer(classes, np.uint8)
                counts = np.frombuffer(counts, "<i8").astype(np.float64)
                for piece, before in _slices(blob):
                    piece, used = _learned(piece, counts[before:])
                    if piece:
                        slots, node, bit, owner = decisions(piece, classes[before:][used], code)
                        weight = counts[before:][used][owner]
                        mixer.learn(*evidence.met(slots, bit), node, bit, weight)
                        seen += weight.sum()
        n = np.concatenate([[seen], (mixer.weights * seen).ravel(), (mixer.map - start).ravel()])
        yield pd.DataFrame({"n": [n.tobytes()]})

    return run


def _add_trained(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"n": [np.sum([np.frombuffer(n) for n in sorted(rows["n"])], axis=0).tobytes()]})


def _score(code: Code, table, weights: np.ndarray, map_: np.ndarray):
    """For each slice that sent words to a bucket: their counts and log10 probabilities."""

    def run(batches):
        mixer, evidence = Mixer(weights, map_), Evidence(table.value, left_out=False)
        for rows in batches:
            for _, row in rows.iterrows():
                classes, whole, found = np.frombuffer(row["classes"], np.uint8), np.frombuffer(row["whole"], "<i8"), []
                for piece, before in _slices(row["words"], SMALL):
                    slots, node, bit, owner = decisions(piece, classes[before:], code)
                    p = mixer.corrected(*evidence.met(slots, bit), node)
                    found.append(np.bincount(owner, np.log10(np.where(bit == 1, p, 1 - p))))
                value = np.concatenate(found).astype("<f4")
                told = [(np.frombuffer(x, "<u4")) for x in row["places"]]
                yield pd.DataFrame(
                    {
                        "chunk": row["chunks"],
                        "bucket": row["bucket"],
                        "c": [whole[x].tobytes() for x in told],
                        "p": [value[x].tobytes() for x in told],
                    }
                )

    return run


def _finish(key: str, train: str, total: int, known: int, kinds: np.ndarray):
    def run(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("bucket")
        count = np.frombuffer(b"".join(told["c"]), "<i8")
        spelled = np.frombuffer(b"".join(told["p"]), "<f4").astype(float)
        learned, bags, out = docs[train].to_numpy(bool), docs["places"].tolist(), []
        for a, b in parts(bags, most=TEXTS):
            places = [np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0] for x in bags[a:b]]
            first = np.cumsum([0, *map(len, places)])
            at, sizes = np.concatenate(places).astype(np.int64), np.diff(first)
            # a text that was learned from is predicted by the other occurrences of its words
            own = np.repeat(learned[a:b], sizes)
            others = count[at] - own
            share = others / np.maximum(total - own, 1)
            corpus = np.tile([float(max(total - known, 0)), float(known)], (b - a, 1))
            score = running_scores(spelled[at], share, corpus, at, first)
            score += kinds[np.frombuffer(b"".join(docs["classes"].iloc[a:b]), np.uint8)]
            sums = [np.add.reduceat(v, first[:-1]) for v in (np.log10(count[at] + 1.0), (count[at] > 0).astype(int))]
            out.append((sizes, sums[1], sums[0] - sizes * math.log10(total + known + 1), score))
        sizes, seen, base, score = (np.concatenate(column) for column in zip(*out, strict=True))
        frame = {key: docs[key], train: docs[train], "n_tokens": sizes, "n_known": seen, "train_tokens": total, "base_score": base, "score": score}
        return pd.DataFrame(frame | {"bits_per_byte": -score / math.log10(2) / (docs["size"].to_numpy(float) + 1)})

    return run


def mixing_scores(
    docs: DataFrame,
    train: str,
    key: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = 8 << 20,
    bucket_words: int = 1_000_000,
    part_chars: int = 150_000_000,
    sample: int = 2000,
) -> DataFrame:
    """Per row of ``docs``: key, the boolean column ``train``, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte.

    Tokens are words with A-Z lower-cased and one end per text; a null text has only
    its end. White space is not coded; bits_per_byte divides the score in bits by the bytes of the text and one for its end. The model learns from the rows where ``train`` is true. base_score is
    the add-one unigram log10 probability, score that of the mixing model. If nothing is
    learned from, the predictors know nothing and the code and the text so far decide. Null
    keys and repeated rows are kept; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    chars, count = docs.agg(F.sum(F.length(text)), F.count("*")).first()
    chars = chars or 0
    buckets = 1 << max(0, math.ceil(math.log2(max(1, chars / 6 / bucket_words))))
    cells = max(6, math.ceil(chars / part_chars))  # tables of fixed size are added up over so many parts
    slim = longs_as_text(docs.select(key, text, F.coalesce(F.col(train), F.lit(False)).alias(train)))
    centres = find_classes(slim.where(F.col(train)), text, sample / max(count or 0, 1))
    slices = durable(_gather(slim, key, text, train, buckets, chunk_bytes, centres), "slices")
    words = slices.where("bucket >= 0").select("chunk", "bucket", "words", "counts", "classes")
    merged = durable(words.groupBy("bucket").applyInPandas(_merge, MERGED), "merged")
    about = merged.agg(F.sum("total"), F.sum("known"), *(F.sum(F.col("frequency")[i]) for i in range(256))).first()
    total, known = about[0] or 0, about[1] or 0
    code = Code(np.array([x or 0 for x in about[2:]]))
    learned = merged.select("words", "counts", "classes").coalesce(cells)
    block = "block int, at binary, n binary"
    tallied = _in_groups(learned.mapInPandas(_tally(code), block), "block", cells, _sum, block)
    held = np.zeros((FIRST[-1], 2), np.float32)  # whole sums, rounded once for the log odds
    for row in tallied.toLocalIterator():  # one row per block of the tables
        held[row["block"] * BLOCK + np.frombuffer(row["at"], "<u2").astype(np.int64)] = np.frombuffer(row["n"], np.int64).reshape(-1, 2)
    table = spark.sparkContext.broadcast(held)  # FIRST[-1] pairs of counts
    del held
    trained = _in_groups(learned.mapInPandas(_train(code, table), "n binary"), None, cells, _add_trained, "n binary").collect()  # one row
    start = Mixer()
    n = np.frombuffer(trained[0]["n"]) if trained else np.zeros(1)
    cut = 1 + start.weights.size
    weights = n[1:cut].reshape(start.weights.shape) / n[0] if n[0] else start.weights
    map_ = start.map + (n[cut:].reshape(start.map.shape) if n[0] else 0.0)
    told = merged.select("bucket", "words", "classes", "whole", "chunks", "places")
    told = told.mapInPandas(_score(code, table, weights, map_), "chunk long, bucket int, c binary, p binary")
    bags = slices.where("bucket < 0").select("chunk", key, train, "places", "classes", "size")
    seen = {r["classes"][0]: r["count"] for r in bags.where(F.col(train)).groupBy("classes").count().collect()}
    kinds = np.array([1.0 + seen.get(c, 0) for c in range(len(centres))])
    kinds = np.log10(kinds / kinds.sum())
    result = f"`{key}` string, `{train}` boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    done = bags.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_finish(key, train, total, known, kinds), result)
    return done.withColumn(key, F.col(key).cast(docs.schema[key].dataType))
