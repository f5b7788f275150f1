"""Words of many texts as flat numpy arrays, with hashes that depend on content alone.

A word is a maximal run of bytes other than space and the ASCII controls 9-13,
which is what ``bytes.split()`` yields. All hashes are 64 bits, the same on every
executor and in every run.
"""

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(256, dtype=np.uint64), 7)
WORD_BYTE = np.where(SPACE, np.uint64(0), BYTE)
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """STEP ** 0 .. STEP ** (n - 1) modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 1024) * 2, STEP, np.uint64)])
    return _powers[:n]


class Words:
    """The words of some texts: ``data`` holds the bytes, word ``i`` spans
    ``starts[i]:ends[i]`` and belongs to text ``doc[i]``; text ``d`` has the words
    ``first[d]:first[d + 1]``."""

    def __init__(self, texts: Sequence[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.r_[True, space].view(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.r_[0, np.cumsum(lengths + 1)]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """One hash per word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        begin = self.starts[0]
        gaps = np.diff(np.r_[self.starts, len(self.data)])
        within = np.arange(begin, len(self.data)) - np.repeat(self.starts, gaps)
        values = WORD_BYTE[self.data[begin:]] * powers(int(gaps.max()))[within]
        return mix(np.add.reduceat(values, self.starts - begin) + (self.ends - self.starts).astype(np.uint64))


def parts(texts: Sequence[bytes], size: int = 1 << 20, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of about ``size`` bytes and at most ``most`` texts (one at least)."""
    begin = total = 0
    for i, text in enumerate(texts):
        total += len(text) + 1
        if total >= size or i + 1 - begin == most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word (one more than texts)."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for a, b in parts(texts):
        words = Words(texts[a:b])
        found.append(words.hashes())
        counts.append(np.diff(words.first))
    return np.concatenate(found), np.cumsum(np.concatenate(counts))


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words, by its start."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    factor = np.uint64((0xA0761D6478BD642F + 2 * seed * 0xE7037ED1A0B428DB) & (2**64 - 1))
    for i in range(width):
        total = total * factor + hashes[i : i + n]
    return mix(total, seed)


def to_bytes(texts, fold: bool = False) -> list[bytes]:
    """UTF-8 of each text (null: empty), with A-Z lower-cased if ``fold``."""
    made = [t.encode() if isinstance(t, str) else b"" for t in texts]
    return [t.lower() for t in made] if fold else made


def text_slices(column, fold: bool = False, size: int = 1 << 20, most: int = 1 << 30) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive index ranges of a text column and their texts as bytes, a slice at a time."""
    for a, b in parts([t if isinstance(t, str) else "" for t in column], size, most):
        yield a, b, to_bytes(column.iloc[a:b], fold)


def longs_as_text(df: DataFrame) -> DataFrame:
    """64-bit columns as text: pandas holds a long column with nulls as doubles, which lose digits."""
    return df.select([F.col(f"`{c}`").cast("string").alias(c) if t == "bigint" else F.col(f"`{c}`") for c, t in df.dtypes])
