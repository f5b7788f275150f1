"""Quality grades by ordinal (cumulative-link) regression on hashed text.

One weight vector is shared by all grades and ordered thresholds part them:
``P(grade > k) = logistic(w . x - t[k])`` with ``t[0] < t[1] < ...``. x holds the
logarithmic counts of hashed byte trigrams and word shapes of the whole text,
scaled to length one, and classes of how often its words repeat. Selection uses the probability of reaching a grade.

The model is fitted on a bounded sample of rated documents: ``sample`` rows on average,
of which the workers send hashed counts (at most DIM numbers a row), not texts.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.textarrays import Words, longs_as_text, mix, parts, to_bytes

DIM = 1 << 14
#: classes of bytes for word shapes: lower, upper, digit, beyond ASCII, other signs for themselves
SHAPE = np.arange(256, dtype=np.uint64)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 128


def features(texts: list[bytes]) -> np.ndarray:
    """A row of DIM hashed features for each text (zero for an empty one)."""
    words = Words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
    data = words.data.astype(np.uint64)
    gram = data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:] if len(data) > 2 else data[:0]
    same = doc[: len(gram)] == doc[2:] if len(gram) else np.zeros(0, bool)
    kept, owner = [mix(gram[same], 70)], [doc[: len(gram)][same]]
    if len(words.starts):
        # first, second and last byte classes of a word and whether it is longer than three, six
        size = words.ends - words.starts
        shape = SHAPE[words.data]
        code = shape[words.starts] << np.uint64(24) | shape[np.minimum(words.starts + 1, words.ends - 1)] << np.uint64(16)
        code |= shape[words.ends - 1] << np.uint64(8) | ((size > 3).astype(np.uint64) + (size > 6).astype(np.uint64))
        kept.append(mix(code, 71))
        owner.append(words.doc)
    at = np.concatenate(owner) * DIM + (np.concatenate(kept) & np.uint64(DIM - 1)).astype(np.int64)
    x = np.log1p(np.bincount(at, minlength=len(texts) * DIM).reshape(len(texts), DIM).astype(np.float32))
    x /= np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-12)
    # how often words repeat: the share of words met before in the text, and next to themselves
    hashes, count = words.hashes(), np.maximum(np.diff(words.first), 1)
    order = np.lexsort((hashes, words.doc))
    again = np.bincount(words.doc[order][1:][(np.diff(hashes[order]) == 0) & (np.diff(words.doc[order]) == 0)], minlength=len(texts))
    beside = np.bincount(words.doc[1:][(hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=len(texts))
    size = np.log2(count).astype(np.int64)
    for kind, value in ((72, size * 32 + np.ceil(20 * again / count).astype(np.int64)), (73, np.ceil(20 * beside / count).astype(np.int64))):
        spot = (mix(value.astype(np.uint64), kind) & np.uint64(DIM - 1)).astype(np.int64)
        x[np.arange(len(texts)), spot] += np.float32(0.3) * (np.diff(words.first) > 0)
    return x


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _ordered(free: np.ndarray) -> np.ndarray:
    """Increasing thresholds from free numbers: the first, then logarithms of the steps."""
    return np.cumsum(np.r_[free[:1], np.exp(free[1:])])


def tail_probabilities(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) of each score, a column for each threshold."""
    return _logistic(score[:, None] - thresholds)


def fit(index: np.ndarray, value: np.ndarray, first: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 30, seed: int = 3):
    """(weights, thresholds) from sparse rows: ``index`` and ``value`` of row i at first[i]:first[i + 1]."""
    draw = np.random.default_rng(seed)
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(0.01, 0.99)
    start = -np.log(share / (1 - share))
    free = np.r_[start[:1], np.log(np.maximum(np.diff(start), 0.1))]
    theta = np.r_[np.zeros(DIM), free]
    mean, square, t = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(rounds):
        for rows in np.array_split(draw.permutation(len(grade)), max(1, len(grade) // 256)):
            sizes = np.diff(first)[rows]
            flat = np.repeat(first[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            owner = np.repeat(np.arange(len(rows)), sizes)
            score = np.bincount(owner, theta[index[flat]] * value[flat], len(rows))
            cuts = _ordered(theta[DIM:])
            # P(grade) is the difference of two neighbouring tails
            tail = np.c_[np.ones(len(rows)), tail_probabilities(score, cuts), np.zeros(len(rows))]
            slope = tail * (1 - tail)
            y = grade[rows]
            every = np.arange(len(rows))
            chance = np.maximum(tail[every, y] - tail[every, y + 1], 1e-9)
            up, down = slope[every, y] / chance, slope[every, y + 1] / chance
            by_score = -(up - down)
            by_cut = np.zeros(grades + 1)
            np.add.at(by_cut, y, up)
            np.add.at(by_cut, y + 1, -down)
            by_cut = by_cut[1:grades]
            steps = np.cumsum(by_cut[::-1])[::-1] * np.r_[1.0, np.exp(theta[DIM + 1 :])]
            grad = np.r_[np.bincount(index[flat], by_score[owner] * value[flat], DIM), steps] / len(rows)
            grad[:DIM] += 1e-5 * theta[:DIM]
            t += 1
            mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
            theta = theta - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return theta[:DIM].astype(np.float32), _ordered(theta[DIM:])


def grade_documents(
    docs: DataFrame, rated: DataFrame, grades: int, key: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = 4000
) -> DataFrame:
    """(key, expected_grade, tail) of each row of ``docs``; tail is the array of
    P(grade >= 1), P(grade >= 2), ... .

    ``rated`` holds texts and grades from 0 to grades - 1; rows with a null text or a grade
    out of range are not learned from. Null texts count as empty. Without any usable
    rating every tail is one half. Null keys and repeated rows are kept; an
    empty table gives an empty result.
    """
    rated = rated.where(F.col(text).isNotNull() & F.col(grade).between(0, grades - 1))
    rated = rated.select(text, F.col(grade).cast("int").alias(grade), F.xxhash64(key, text).alias("h"))
    total = rated.count()
    chance = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)

    def sparse(batches):
        for rows in batches:
            texts = to_bytes(rows[text])
            for a, b in parts(texts, most=256):
                x = features(texts[a:b])
                at = [np.flatnonzero(r).astype("<i4") for r in x]
                out = pd.DataFrame({"h": rows["h"].iloc[a:b], "grade": rows[grade].iloc[a:b]})
                out["at"], out["value"] = [i.tobytes() for i in at], [r[i].astype("<f4").tobytes() for r, i in zip(x, at, strict=True)]
                yield out

    some = rated.where(chance < sample / max(total, 1)).mapInPandas(sparse, "h long, grade int, at binary, value binary")
    some = some.toPandas().sort_values("h")
    weights, cuts = np.zeros(DIM, np.float32), np.zeros(grades - 1)
    if len(some):
        index = np.frombuffer(b"".join(some["at"]), "<i4")
        value = np.frombuffer(b"".join(some["value"]), "<f4").astype(np.float64)
        first = np.r_[0, np.cumsum([len(x) // 4 for x in some["at"]])]
        weights, cuts = fit(index, value, first, some["grade"].to_numpy(), grades)

    def run(batches):
        for rows in batches:
            texts = to_bytes(rows[text])
            for a, b in parts(texts, most=256):
                tail = tail_probabilities((features(texts[a:b]) @ weights).astype(np.float64), cuts)
                yield pd.DataFrame({key: rows[key].iloc[a:b], "expected_grade": tail.sum(1), "tail": list(tail)})

    done = longs_as_text(docs.select(key, text)).mapInPandas(run, f"`{key}` string, expected_grade double, tail array<double>")
    return done.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rated documents of the tables: grade 0 for bad quality, 1 for good but toxic text, 2 for good text."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return docs.select("doc_id", "text").join(labels.select("doc_id", grade.alias("grade")), "doc_id")
