"""Exact substring de-duplication with fixed-block anchors.

A run of ``window`` words always holds a whole reference block of
``(window + 1) // 2`` words that starts at a multiple of the block size, so only those
blocks are indexed and every rolling run of the block size probes them. Around a
hit the run is extended to each full window that holds it, and equal windows at
two places are a repeat; overlapping ones join to a maximal repeat.

Texts are dealt into chunks once; the three passes read that one exchange. A
chunk sends each distinct hash once to a bucket, so a passage that fills a third of
all rows costs one entry per chunk. A bucket holds a fixed number of words on
average: ``bucket_words``. Probes carry 32 bits beyond the bucket number, which lets
a few in a million pass falsely, at every size; the windows that decide carry 64
bits beyond it.
"""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.textarrays import longs_as_text, mix, to_bytes, windows, word_hashes

SENT = "__chunk int, __bucket long, __index binary, __probe binary, __twice binary"
FOUND = "__chunk int, __bucket long, __hit binary"


def _valid(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of runs of ``width`` words that lie in one text."""
    starts = np.zeros(max(0, first[-1] - width + 1), np.int8)
    counts = np.diff(first)
    for begin, count in zip(first[:-1][counts >= width], counts[counts >= width], strict=True):
        starts[begin : begin + count - width + 1] = 1
    return starts.astype(bool)


def _place(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes, 11) & np.uint64(buckets - 1)).astype(np.int64)


def _send(chunk: int, place: np.ndarray, values: np.ndarray, indexed: np.ndarray) -> pd.DataFrame:
    """A row per bucket: the distinct values, those of indexed places and those met twice."""
    order = np.lexsort((values, place))
    place, values, indexed = place[order], values[order], indexed[order]
    new = np.r_[True, (np.diff(place) != 0) | (values[1:] != values[:-1])][: len(values)]
    at = np.flatnonzero(new)
    many = np.diff(np.r_[at, len(values)]) > 1
    block = np.add.reduceat(indexed.astype(np.int64), at) > 0 if len(at) else np.zeros(0, bool)
    place, values = place[at], values[at]
    cut = np.flatnonzero(np.r_[True, np.diff(place) != 0][: len(place)])
    rows = []
    for a, b in zip(cut, np.r_[cut[1:], len(place)], strict=True):
        one = values[a:b]
        rows.append((chunk, int(place[a]), one[block[a:b]].tobytes(), one.tobytes(), one[many[a:b]].tobytes()))
    return pd.DataFrame(rows, columns=["__chunk", "__bucket", "__index", "__probe", "__twice"])


def _member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value lies in the sorted table, and whether it does."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _match(kind: type):
    """Of one bucket: the indexed values met at two places, told to every chunk that has them."""

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        index = np.unique(np.concatenate([np.frombuffer(x, kind) for x in rows["__index"]]))
        met = np.zeros(len(index), np.int64)
        for column in ("__probe", "__twice"):
            for x in rows[column]:
                at, hit = _member(np.frombuffer(x, kind), index)
                met[at[hit]] += 1
        shared, out = index[met > 1], []
        for chunk, bucket, x in zip(rows["__chunk"], rows["__bucket"], rows["__probe"], strict=True):
            probe = np.frombuffer(x, kind)
            if (hit := _member(probe, shared)[1]).any():
                out.append((chunk, bucket, probe[hit].tobytes()))
        return pd.DataFrame(out, columns=["__chunk", "__bucket", "__hit"])

    return match


def _hits(rows: pd.DataFrame, kind: type) -> list[tuple[int, np.ndarray]]:
    return [(b, np.frombuffer(x, kind)) for b, x in zip(rows["__bucket"], rows["__hit"], strict=True)]


def _told(place: np.ndarray, values: np.ndarray, hits: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Which values are among the hits of their bucket."""
    out = np.zeros(len(values), bool)
    order = np.argsort(place, kind="stable")
    bounds = place[order]
    for bucket, table in hits:
        own = order[np.searchsorted(bounds, bucket) : np.searchsorted(bounds, bucket, "right")]
        out[own] |= _member(values[own], table)[1]
    return out


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    window: int = 35,
    key: str = "doc_id",
    chunk_chars: int = 2_000_000,
    bucket_words: int = 500_000,
    with_text: bool = True,
) -> DataFrame:
    """All rows and columns of ``docs`` and n_words, n_removed, kept_sha256 and
    kept_text: the words not covered by a repeated window, joined by one space. Without
    ``with_text`` neither the text nor kept_text is returned.

    A window is judged on the input: it is repeated if its words also start anywhere
    else, in the same text or another. Null and empty texts have no words; texts
    shorter than the window lose nothing; repeated rows are repeats of each
    other. Columns of ``docs`` with the names of the result are replaced. An empty
    table gives an empty result.
    """
    made = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_chars))
    buckets = 1 << max(0, math.ceil(math.log2(max(1, total / 6 / bucket_words))))
    block = (window + 1) // 2
    docs = docs.drop(*[c for c in made if c != text and c in docs.columns])
    docs = docs.withColumn("__chunk", F.pmod(F.xxhash64(key, text), F.lit(chunks)))

    def probes(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, first = word_hashes(to_bytes(rows[text]))
        runs = windows(hashes, block)
        keep = _valid(first, block)
        if not keep.any():
            return pd.DataFrame(columns=["__chunk", "__bucket", "__index", "__probe", "__twice"])
        within = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        runs, aligned = runs[keep], (within[: len(runs)] % block == 0)[keep]
        low = (runs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return _send(int(rows["__chunk"].iloc[0]), _place(runs, buckets), low, aligned)

    def extend(rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["__chunk", "__bucket", "__index", "__probe", "__twice"])
        if not len(rows) or not len(hits):
            return empty
        hashes, first = word_hashes(to_bytes(rows[text]))
        runs = windows(hashes, block)
        low = (runs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        anchors = np.flatnonzero(_told(_place(runs, buckets), low, _hits(hits, np.uint32)) & _valid(first, block))
        full = _valid(first, window)
        near = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(near, np.maximum(anchors - (window - block), 0), 1)
        np.add.at(near, anchors + 1, -1)
        at = np.flatnonzero((np.cumsum(near)[: len(full)] > 0) & full)
        if not len(at):
            return empty
        values = windows(hashes, window, 3)[at]
        return _send(int(rows["__chunk"].iloc[0]), _place(windows(hashes, window, 5)[at], buckets), values, np.ones(len(at), bool))

    shape = docs.drop("__chunk").schema
    docs = longs_as_text(docs.withColumn("__chunk", F.col("__chunk").cast("int")))
    others = [c for c in shape.names if with_text or c != text]
    names = ", ".join(f"`{c}` {t}" for c, t in docs.select(others).dtypes)
    result = f"{names}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def cut(rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        texts = to_bytes(rows[text])
        hashes, first = word_hashes(texts)
        gone = np.zeros(len(hashes) + 1, np.int64)
        if len(hits):
            full = _valid(first, window)
            values = windows(hashes, window, 3)
            at = np.flatnonzero(_told(_place(windows(hashes, window, 5), buckets), values, _hits(hits, np.uint64)) & full)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        out = rows[others].copy()
        lost = np.diff(np.r_[0, np.cumsum(covered)][first])
        kept = []
        for i, body in enumerate(texts):
            words = body.split()
            if lost[i]:
                words = [w for w, c in zip(words, covered[first[i] : first[i + 1]].tolist(), strict=True) if not c]
            kept.append(b" ".join(words))
        out["n_words"], out["n_removed"] = np.diff(first), lost
        out["kept_sha256"] = [hashlib.sha256(x).hexdigest() for x in kept]
        if with_text:
            out["kept_text"] = [x.decode() for x in kept]
        return out

    dealt = docs.groupBy("__chunk")
    anchored = docs.groupBy("__chunk").applyInPandas(probes, SENT).groupBy("__bucket").applyInPandas(_match(np.uint32), FOUND)
    extended = dealt.cogroup(anchored.groupBy("__chunk")).applyInPandas(extend, SENT)
    repeated = extended.groupBy("__bucket").applyInPandas(_match(np.uint64), FOUND)
    done = dealt.cogroup(repeated.groupBy("__chunk")).applyInPandas(cut, result)
    return done.withColumns({c: F.col(f"`{c}`").cast(shape[c].dataType) for c in others if shape[c].dataType.simpleString() == "bigint"})
