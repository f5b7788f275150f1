"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is split into paragraphs at line breaks, and long paragraphs further after
words whose hash has three zero bits or after sixteen words, so that an edit changes the pieces it touches and no
others. Each piece, with the number of its earlier copies in the text, has a
64-bit digest. A sketch adds every digest to one cell in each of three parts of its cells,
as a count, a sum of digests and a sum of check hashes. The difference of
two sketches holds only digests that the texts do not share; cells with a single one are
peeled until nothing is left. If something is left, both texts are sketched
again with twice the cells.

A batch of texts is one matrix of cells, so sketching, subtracting and peeling are array
operations over all of its texts.
"""

import base64
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from wattspan.llm.textarrays import BYTE, Words, mix, powers

PARTS, CELLS, CUT, LIMIT = 3, 12, np.uint64(7), 16
RANGES = 8192


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of each text's pieces and where each text's begin. Every byte is in a
    piece: a piece reaches up to the first word of the next one."""
    words = Words(texts)
    count = len(words.starts)
    line = np.cumsum(words.data == 10)
    last = np.ones(count, bool)
    if count > 1:
        last[:-1] = (words.doc[1:] != words.doc[:-1]) | (line[words.starts[1:]] != line[words.starts[:-1]])
        last |= (words.hashes() & CUT) == 0
        at = np.arange(count)
        last |= (at - np.maximum.accumulate(np.where(np.r_[True, last[:-1]], at, 0))) % LIMIT == LIMIT - 1
    opens = np.flatnonzero(np.r_[True, last[:-1]][:count])
    # a text's first piece starts at its first byte, also if the text has no words
    texts_at, own = words.offsets[:-1], np.diff(words.offsets) > 1
    begins = np.union1d(words.starts[opens][np.r_[True, np.diff(words.doc[opens]) > 0][: len(opens)] == 0], texts_at[own])
    doc = np.searchsorted(words.offsets, begins, "right") - 1
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    ends = np.minimum(np.r_[begins[1:], len(words.data)], words.offsets[doc + 1] - 1)
    gaps = np.diff(np.r_[begins, len(words.data)])
    within = np.arange(begins[0], len(words.data)) - np.repeat(begins, gaps)
    value = BYTE[words.data[begins[0] :]] * powers(int(gaps.max()))[within]
    value[within >= np.repeat(ends - begins, gaps)] = 0
    digest = mix(np.add.reduceat(value, begins - begins[0]) + (ends - begins).astype(np.uint64), 81)
    # the n-th copy within a text is an item of its own
    order = np.lexsort((digest, doc))
    new = np.r_[True, (digest[order][1:] != digest[order][:-1]) | (doc[order][1:] != doc[order][:-1])]
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    digest[order] = mix(digest[order] + nth.astype(np.uint64), 82)
    return digest, np.searchsorted(doc, np.arange(len(texts) + 1))


def _cell(digest: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each digest in each part, for a sketch of this size."""
    own = cells // PARTS
    return np.stack([mix(digest, 90 + p * 97 + cells) % np.uint64(own) + np.uint64(p * own) for p in range(PARTS)]).astype(np.int64)


class Sketches:
    """One sketch per text: counts, sums of digests and sums of checks, ``cells`` wide."""

    def __init__(self, digest: np.ndarray, owner: np.ndarray, texts: int, cells: int):
        self.cells = cells
        self.count = np.zeros(texts * cells, np.int64)
        self.total, self.check = np.zeros(texts * cells, np.uint64), np.zeros(texts * cells, np.uint64)
        self.add(digest, owner, np.ones(len(digest), np.int64))

    def add(self, digest: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        check, signs = mix(digest, 83), sign.astype(np.uint64)
        for cell in _cell(digest, self.cells):
            at = owner * self.cells + cell
            np.add.at(self.count, at, sign)
            np.add.at(self.total, at, digest * signs)
            np.add.at(self.check, at, check * signs)

    def names(self, sizes: np.ndarray) -> list[str]:
        """Each sketch, and the number of its items, as text."""
        rows = [x.reshape(-1, self.cells) for x in (self.count.astype("<i4"), self.total.astype("<u8"), self.check.astype("<u8") >> np.uint64(32))]
        packed = zip(rows[0], rows[1], rows[2].astype("<u4"), sizes, strict=True)
        return [base64.b64encode(np.int32(n).tobytes() + a.tobytes() + b.tobytes() + c.tobytes()).decode() for a, b, c, n in packed]

    def minus(self, other: "Sketches") -> "Sketches":
        self.count -= other.count
        self.total -= other.total
        self.check -= other.check
        return self

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digests, owners, signs, solved): the items left in the sketches, which side has
        them, and whether a sketch was emptied. The sketches are used up."""
        found = []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            digest = self.total[at] * sign.astype(np.uint64)
            pure = mix(digest, 83) * sign.astype(np.uint64) == self.check[at]
            at, sign, digest = at[pure], sign[pure], digest[pure]
            if not len(at):
                break
            owner = at // self.cells
            order = np.lexsort((digest, owner))
            new = np.r_[True, (np.diff(owner[order]) != 0) | (digest[order][1:] != digest[order][:-1])]
            once = order[new]
            digest, owner, sign = digest[once], owner[once], sign[once]
            found.append((digest, owner, sign))
            self.add(digest, owner, -sign)
        empty = (self.count == 0) & (self.total == 0) & (self.check == 0)
        solved = empty.reshape(-1, self.cells).all(1)
        kinds = (np.uint64, np.int64, np.int64)
        joined = [np.concatenate([np.zeros(0, k), *(f[i] for f in found)]) for i, k in enumerate(kinds)]
        return joined[0], joined[1], joined[2], solved


def differing(digest: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, cells: int = CELLS):
    """(digests, pairs, signs) of the items that the texts left[i] and right[i] do not
    share: +1 for those of the left text. Unsolved pairs are tried again with twice the cells."""
    todo, out = np.arange(len(left)), []

    def sketch(which: np.ndarray) -> Sketches:
        sizes = np.diff(first)[which]
        flat = np.repeat(first[which] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        return Sketches(digest[flat], np.repeat(np.arange(len(which)), sizes), len(which), cells)

    while len(todo):
        items, owner, sign, solved = sketch(left[todo]).minus(sketch(right[todo])).peel()
        keep = solved[owner]
        out.append((items[keep], todo[owner[keep]], sign[keep]))
        todo, cells = todo[~solved], cells * 2
    kinds = (np.uint64, np.int64, np.int64)
    return tuple(np.concatenate([np.zeros(0, k), *(o[i] for o in out)]) for i, k in enumerate(kinds))


def likeness(digest: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The share of the items of both texts that the other one has too (1 for two empty texts)."""
    _, pair, _ = differing(digest, first, left, right)
    size = np.diff(first)
    both = size[left] + size[right]
    return np.where(both > 0, 1.0 - np.bincount(pair, minlength=len(left)) / np.maximum(both, 1), 1.0)


def ranged(docs: DataFrame, key: str, text: str, bucket_chars: int) -> DataFrame:
    """(bucket, guest, at, h, key, text): every document in a key range of its own, and
    the first document of each range once more, as guest, in the range before it.

    Ranges are cut at keys of a hash sample of about fifty per range. Only the text
    itself is shuffled; a range is read as a sorted stream, so it may be of any size and
    there are at most RANGES of them: what reaches the driver does not grow beyond that."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("at", F.coalesce("key", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    about = docs.agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n")).first()
    count = min(RANGES, max(1, math.ceil((about.chars or 0) / bucket_chars)))
    share = min(1.0, 50 * count / max(about.n, 1))
    some = docs.where(F.pmod(F.xxhash64("at"), F.lit(1 << 30)) < int(share * (1 << 30))).select("at").distinct()
    keys = np.sort(np.array([r[0] for r in some.collect()], np.int64))  # at most about fifty per range
    cuts = np.unique(keys[np.linspace(0, len(keys) - 1, count + 1).astype(int)[1:-1]]) if len(keys) else keys

    @F.pandas_udf(IntegerType())
    def bucket(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, at.to_numpy(), "left").astype(np.int32))

    heads = docs.select("at", "h", bucket("at").alias("bucket")).groupBy("bucket").agg(F.max(F.struct("at", "h")).alias("head"))
    heads = sorted(((r["bucket"], r["head"]["at"], r["head"]["h"]) for r in heads.collect()), reverse=True)  # one per range
    # the range of the next larger keys; the largest key's guest goes to the smallest keys
    before = {b: heads[i - 1][0] for i, (b, _, _) in enumerate(heads)}
    first = {b: (at, h) for b, at, h in heads}

    @F.pandas_udf(ArrayType(IntegerType()))
    def homes(at: pd.Series, h: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, at.to_numpy(), "left").tolist()
        return pd.Series([[b, before[b]] if first[b] == (x, y) else [b] for b, x, y in zip(own, at.tolist(), h.tolist(), strict=True)])

    placed = docs.select("*", F.posexplode(homes("at", "h")).alias("guest", "bucket"))
    order = ["bucket", "guest", F.desc("at"), F.desc("h")]
    return placed.repartition("bucket").sortWithinPartitions(*order)


def edit_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_chars: int = 4_000_000) -> DataFrame:
    """Per row of ``docs``: the key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The next document is that of the next smaller key, after the smallest that of the
    largest; equal keys are ordered by the hash of their texts, and a null key is the
    smallest. The edited text has the last half of its code points replaced by the first as
    many of the next document. A null text counts as empty. A single document is its
    own next. Repeated rows are kept; an empty table gives an empty result.
    """
    result = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = ranged(docs, key, text, bucket_chars).select("bucket", "guest", F.col("key").cast("string").alias("key"), "text")

    def work(held: list[tuple[int, int, str, str]]) -> pd.DataFrame:
        """The rows of ``held`` but guests and the last; the text behind a row is its next one."""
        texts = [h[3] for h in held]
        own = [i for i in range(len(held) - 1) if not held[i][1]]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
        coded = [t.encode() for t in edited]
        digest, first = pieces([t.encode() for t in texts] + coded)
        at, new = np.array(own, np.int64), len(texts) + np.arange(len(own))
        sizes = np.diff(first)
        names = Sketches(digest, np.repeat(np.arange(len(sizes)), sizes), len(sizes), CELLS).names(sizes)
        return pd.DataFrame(
            {
                "key": [held[i][2] for i in own],
                "n_chars": [len(texts[i]) for i in own],
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in coded],
                "fingerprint": [names[i] for i in own],
                "edited_fingerprint": names[len(texts) :],
                "near_edited": likeness(digest, first, at, new),
                "near_next": likeness(digest, first, at, at + 1),
            }
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(batch["bucket"], batch["guest"], batch["key"], batch["text"], strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20:
                    yield work(held)
                    held, size = held[-1:], len(row[3])
        if held:
            yield work(held + [(-1, 1, None, "")])

    done = rows.mapInPandas(run, result.replace("key long", "key string"))
    return done.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)
