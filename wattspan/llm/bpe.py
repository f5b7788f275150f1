"""Byte-level BPE encoding and decoding with a contiguous rank array.

A piece of text is an array of parts and, beside it, the array of the ranks of
adjacent parts. The least rank is looked for by a plain scan, its boundary is
deleted, which moves the rest of both arrays one place, and the ranks of the
two neighbours are looked up again, until no adjacent pair has a rank. Pieces are
short, so a scan beats a heap; many pieces are worked at once as the rows of a matrix.
Only a piece of more than LONG bytes goes through a heap of its pairs.

A worker keeps the ids of pieces it has met, up to a bound.
"""

import hashlib
import heapq
import json
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.llm.textarrays import longs_as_text, parts

#: fixed: white space, and how the tokenizer splits text into pieces
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+")
#: coarser: a run without white space never shares a piece with another
RUNS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
NONE, LONG = np.int64(1 << 40), 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: visible ones for
    themselves, the others in order from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Codec:
    """Encodes and decodes with the vocabulary and merges of a tokenizers file."""

    def __init__(self, path: str, held: int = 700_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, added = spec["model"]["vocab"], spec["added_tokens"]
        letters = byte_letters()
        self.single = np.array([vocab[x] for x in letters], np.int64)
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
        left, right, whole = (
            np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]), strict=True)
        )
        pair = left * self.size + right
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks, self.whole = pair[order], order, whole
        self.special = {t["content"]: t["id"] for t in added}
        self.breaks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        back = {letter: b for b, letter in enumerate(letters)}
        spelled = [b""] * self.size
        for token, i in vocab.items():
            spelled[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.lengths = np.array([len(x) for x in spelled], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(spelled), np.uint8)
        self.held, self.runs, self.known = held, {}, {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair; NONE without one or beyond the end (-1)."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (b >= 0), self.ranks[at], NONE)

    def _rows(self, words: list[bytes], width: int) -> list[bytes]:
        """Merges words of at most ``width`` bytes, one per row."""
        data = np.frombuffer(b"".join(w.ljust(width + 1, b"\0") for w in words), np.uint8).reshape(len(words), width + 1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        columns = np.arange(width + 1)
        part = np.where(columns < lengths[:, None], self.single[data], -1)
        rank = np.full(part.shape, NONE)
        rank[:, :-1] = self.rank(part[:, :-1], part[:, 1:])
        live, out = np.arange(len(words)), [b""] * len(words)
        while len(live):
            at = rank.argmin(1)
            least = rank[np.arange(len(live)), at]
            more = least < NONE
            if not more.all():
                for i, row in zip(live[~more], part[~more].astype("<i4"), strict=True):
                    out[i] = row[: np.count_nonzero(row >= 0)].tobytes()
                live, part, rank, at, least = live[more], part[more], rank[more], at[more], least[more]
                if not len(live):
                    break
            every = np.arange(len(live))
            part[every, at] = self.whole[least]
            # the boundary behind the merged part goes; what follows moves up
            move = np.minimum(columns + (columns > at[:, None]), width)
            part = np.take_along_axis(part, move, 1)
            rank = np.take_along_axis(rank, np.minimum(columns + (columns >= at[:, None]), width), 1)
            part[:, -1], rank[:, -1] = -1, NONE
            rank[every, at] = self.rank(part[every, at], part[every, np.minimum(at + 1, width)])
            before = np.flatnonzero(at > 0)
            spot = at[before]
            rank[before, spot - 1] = self.rank(part[before, spot - 1], part[before, spot])
        return out

    def _long(self, word: bytes) -> bytes:
        """The same merges with a heap of pairs, for one long piece."""
        part = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        ranks = self.rank(np.array(part[:-1]), np.array(part[1:])).tolist()
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(ranks) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = int(self.whole[r]), -2
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    new = int(self.rank(np.array([part[x]]), np.array([part[y]]))[0])
                    if new < NONE:
                        heapq.heappush(heap, (new, x, part[x], part[y]))
        return np.array([p for p in part if p >= 0], "<i4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each piece."""
        out, groups = [b""] * len(words), {}
        for i, w in enumerate(words):
            groups.setdefault(min(-(-len(w) // 4) * 4, LONG + 4), []).append(i)
        for width, own in groups.items():
            if width > LONG:
                done = [self._long(words[i]) for i in own]
            else:
                done = self._rows([words[i] for i in own], width)
            for i, x in zip(own, done, strict=True):
                out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit numbers."""
        split = []
        for text in texts:
            if self.breaks and any(s in text for s in self.special):
                split.append([y for x in self.breaks.split(text) for y in ([x] if x in self.special else RUNS.findall(x))])
            else:
                split.append(RUNS.findall(text))
        wanted = set().union(*split)
        if len(self.runs) + len(wanted) > self.held:
            self.runs.clear()
        if len(self.known) > self.held:
            self.known.clear()
        for token, i in self.special.items():
            self.runs[token] = np.array([i], "<i4").tobytes()
        wanted = [w for w in wanted if w not in self.runs]
        # a run of white space is one piece
        pieces = [PIECES.findall(w) if not w.isspace() else [w] for w in wanted]
        fresh = [*set().union(*pieces).difference(self.known)]
        self.known.update(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
        for w, own in zip(wanted, pieces, strict=True):
            self.runs[w] = b"".join([self.known[p] for p in own])
        return [b"".join([self.runs[w] for w in words]) for words in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of id sequences; bytes that are no UTF-8 become the replacement sign."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        lengths = self.lengths[flat]
        ends = np.cumsum(lengths)
        spot = np.repeat(self.begins[flat] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        spelled = self.letters[spot].tobytes()
        cuts = np.r_[0, ends][np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int64)].tolist()
        return [spelled[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a tokenizer file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _over(docs: DataFrame, columns: list[str], result: str, work) -> DataFrame:
    """``work`` on slices of about a megabyte of the first column; the other columns go along."""

    def run(batches):
        for rows in batches:
            values = [x if isinstance(x, str | bytes) else "" for x in rows[columns[0]]]
            for a, b in parts(values, 1 << 21):
                out = rows[columns[1:]].iloc[a:b].copy()
                for name, column in work(values[a:b]).items():
                    out[name] = column
                yield out

    slim = longs_as_text(docs.select(columns))
    kept = [(c, t) for c, t in slim.dtypes if c in columns[1:]]
    done = slim.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kept) + ", " + result)
    return done.withColumns({c: F.col(f"`{c}`").cast(docs.schema[c].dataType) for c, _ in kept})


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every whole text, little-endian unsigned 32-bit numbers in
    a binary column. A null text counts as empty and has no ids; null keys and
    repeated rows are kept; an empty table gives an empty result."""
    return _over(docs, [text, key], "ids binary", lambda texts: {"ids": codec(tokenizer).encode(texts)})


def decode_documents(coded: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from what :func:`encode_documents` returns; null ids give an empty text."""
    work = lambda ids: {"text": codec(tokenizer).decode([x or b"" for x in ids])}
    return _over(coded, ["ids", key], "text string", work)


def round_trip_digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass."""

    def work(texts: list[str]) -> dict[str, list]:
        own = codec(tokenizer)
        ids = own.encode(texts)
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in own.decode(ids)],
        }

    return _over(docs, [text, key], "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
