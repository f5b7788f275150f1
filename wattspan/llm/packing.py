"""Packing token sequences with little padding by minimum bin slack.

Each document is cut into full windows and one remainder. How remainders share
windows depends only on how many there are of each length, a histogram of at most
``capacity`` numbers, so the plan is made on the driver for any number of
documents: the longest remainder opens a window, a bitset of reachable sums over
the other lengths finds the fill closest to capacity, and walking the bitsets back
gives the count of each length. A filling is repeated as often as the histogram
allows. Lengths that can't fill a window to within ``slack`` are cut at powers of two,
which fill windows exactly; the last of them stand alone, unpadded.

Which document takes which place follows from its rank among the remainders of
its length. Ranks come from counts per (length, salt), so copies of one document,
all of one length, are not ranked in one task.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.llm.bpe import byte_letters
from wattspan.llm.textarrays import longs_as_text, parts, to_bytes

PIECE = "start long, length int, crc long, cuts array<long>, doc_tokens long"
#: a letter and an ASCII sign behind it (but the apostrophe) are never in one token
BORDER = re.compile(rb"([a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([!-&(-/:-@\[-`{-~])")
#: runs of lower-case letters that normalising leaves as they are, or of signs: one piece each
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+")
LETTERS = dict(enumerate(byte_letters()))
_cache: dict[str, dict[bytes, bytes]] = {}
_libraries: dict[str, object] = {}


def encode_all(texts: list[bytes], tokenizer: str, held: int = 1_000_000) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    For tokenizers that lower-case and drop white space no token spans white space, so a
    text's ids are those of its words; a worker keeps up to ``held`` words it has seen.
    Words that are one piece as they stand go straight to the tokenizer's model.
    """
    from tokenizers import Tokenizer

    if tokenizer not in _libraries:
        _libraries[tokenizer] = Tokenizer.from_file(tokenizer)
        _libraries[tokenizer].no_truncation()
        _libraries[tokenizer].no_padding()
        _cache[tokenizer] = {}
    library, known = _libraries[tokenizer], _cache[tokenizer]
    split = [t.split() if b"<|" in t else BORDER.sub(rb"\1 \2", t.lower()).split() for t in texts]
    wanted = set().union(*split).difference(known)
    if len(known) + len(wanted) > held:
        known.clear()
        wanted = set().union(*split)
    plain = {w for w in wanted if PLAIN.fullmatch(w)}
    for word in plain:
        ids = [t.id for t in library.model.tokenize(word.decode("latin-1").translate(LETTERS))]
        known[word] = np.array(ids, "<u4").tobytes()
    wanted = list(wanted - plain)
    found = library.encode_batch_fast([w.decode() for w in wanted], add_special_tokens=False)
    for word, one in zip(wanted, found, strict=True):
        known[word] = np.array(one.ids, "<u4").tobytes()
    return [b"".join([known[w] for w in words]) for words in split]


def powers_of_two(length: int) -> list[int]:
    """The powers of two that sum to ``length``, the largest first."""
    return [1 << i for i in range(length.bit_length() - 1, -1, -1) if length >> i & 1]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """The pieces of every document, a null text counting as empty: the key, start, length,
    crc (of the ids), cuts (crc of each power-of-two part of a shorter piece),
    doc_tokens, and with ``with_ids`` the ids as bytes. Every document has at least the
    piece of its end id."""

    def run(batches):
        last = np.array([end_id], "<u4").tobytes()
        for rows in batches:
            texts, out = to_bytes(rows[text]), []
            for a, b in parts(texts):
                for doc, ids in zip(rows[key].iloc[a:b], encode_all(texts[a:b], tokenizer), strict=True):
                    ids += last
                    count = len(ids) // 4
                    for start in range(0, count, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        cuts, at = [], 0
                        if len(piece) < 4 * capacity:
                            for n in powers_of_two(len(piece) // 4):
                                cuts.append(zlib.crc32(piece[at : at + 4 * n]))
                                at += 4 * n
                        out.append((doc, start, len(piece) // 4, zlib.crc32(piece), cuts, count) + (piece,) * with_ids)
            yield pd.DataFrame(out, columns=[key, "start", "length", "crc", "cuts", "doc_tokens"] + ["ids"] * with_ids)

    done = longs_as_text(docs.select(key, text)).mapInPandas(run, f"`{key}` string, {PIECE}" + ", ids binary" * with_ids)
    return done.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def fill(counts: Counter, room: int) -> dict[int, int]:
    """The multiset of the counted lengths with the largest sum of at most ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            before = reach
            reach |= (reach << (length * take)) & mask
            if reach != before:
                steps.append((length, take, before))
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return used


def plan(histogram: dict[int, int], capacity: int, slack: int) -> tuple[list[tuple[int, ...]], Counter, int]:
    """(segments, lengths left over, number of sequences). A segment says where ranks
    ``first`` to ``end`` of a length go: (length, first, end, places per window, first window,
    offset of the first place)."""
    counts, ranks = Counter({k: v for k, v in histogram.items() if v}), Counter()
    segments, left, windows = [], Counter(), 0
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fill(counts, capacity - seed)
        counts[seed] += 1
        used[seed] += 1
        if capacity - sum(x * n for x, n in used.items()) > slack:
            left[seed] = counts.pop(seed)
            continue
        times, offset = min(counts[x] // n for x, n in used.items()), 0
        for length, n in used.items():
            segments.append((length, ranks[length], ranks[length] + times * n, n, windows, offset))
            offset += length * n
            ranks[length] += times * n
            counts[length] -= times * n
            if not counts[length]:
                del counts[length]
        windows += times
    return segments, left, windows


def _ranked(pieces: DataFrame, key: str, count: int, size: int = 20_000) -> DataFrame:
    """``pieces`` with the rank of each among those of its length, from 0."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(key, "start", "crc"), F.lit(max(1, count // size + 1))))
    salted = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy(key, "start", "crc")) - 1)
    sizes = durable(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "sizes")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return salted.join(sizes, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("salt", "own", "before")


def _place(ranked: DataFrame, segments: list[tuple[int, ...]], base: int) -> DataFrame:
    """sequence_id and offset of each ranked piece that a segment covers; null for the others.

    The segments number at most a few for each fill, and fills at most a few for each
    length up to the capacity, whatever the number of pieces."""
    table = np.array(sorted(segments), np.int64).reshape(-1, 6)
    wide = np.int64(1) << 44

    def run(batches):
        keys = table[:, 0] * wide + table[:, 1]
        for rows in batches:
            rank = rows["rank"].to_numpy().astype(np.int64)
            at = np.searchsorted(keys, rows["length"].to_numpy().astype(np.int64) * wide + rank, "right") - 1
            length, first, end, places, window, offset = table[np.maximum(at, 0)].T if len(table) else np.zeros((6, len(rows)), np.int64)
            there = (at >= 0) & (length == rows["length"]) & (rank < end)
            places = np.maximum(places, 1)
            rows["sequence_id"] = pd.Series(base + window + (rank - first) // places, dtype="Int64").where(there.to_numpy())
            rows["offset"] = pd.Series(offset + (rank - first) % places * length, dtype="Int64").where(there.to_numpy())
            yield rows

    ranked = longs_as_text(ranked.withColumn("rank", F.col("rank").cast("double")))
    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes)
    return ranked.mapInPandas(run, schema + ", sequence_id long, offset long").drop("rank")


def pack(pieces: DataFrame, capacity: int = 2048, slack: int = 16, key: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset, some of them cut into smaller pieces.

    Sequences hold at most ``capacity`` tokens, are filled to within ``slack`` tokens or
    have a power of two of them, and have no gaps. Equal pieces may change places
    between runs. Null keys are kept. An empty table gives an empty result.
    """
    pieces = durable(pieces, "pieces")
    kind = pieces.schema[key].dataType
    names = [c for c in pieces.columns if c not in ("cuts",)]

    def longs(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c).cast("long") for c in ("start", "crc", "doc_tokens", "length")}).withColumn(key, F.col(key).cast(kind))

    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    total = sum(histogram.values())
    segments, left, used = plan(histogram, capacity, slack)
    placed = durable(longs(_place(_ranked(pieces, key, total), segments, 0)), "placed")
    whole = placed.where("sequence_id IS NOT NULL").select(*names, "sequence_id", "offset")
    if not left:
        return whole
    # what fits no window is cut at powers of two
    small = Counter()
    for length, n in left.items():
        for part in powers_of_two(length):
            small[part] += n
    rest = placed.where("sequence_id IS NULL")
    every = F.array(*[F.lit(1 << i).cast("long") for i in range(capacity.bit_length() - 1, -1, -1)])
    sizes = F.filter(every, lambda p: F.col("length").bitwiseAND(p) > 0)
    rest = rest.withColumn("sizes", sizes).select("*", F.posexplode("cuts").alias("part", "cut"))
    rest = rest.withColumn("before", F.aggregate(F.slice("sizes", 1, F.col("part")), F.lit(0).cast("long"), lambda s, x: s + x))
    changed = {"start": F.col("start") + F.col("before"), "crc": F.col("cut"), "length": F.get("sizes", F.col("part")).cast("int")}
    if "ids" in names:
        changed["ids"] = F.substring("ids", (4 * F.col("before") + 1).cast("int"), (4 * F.get("sizes", F.col("part"))).cast("int"))
    rest = durable(rest.select(*[changed.get(c, F.col(c)).alias(c) for c in names]), "cut")
    segments, alone, more = plan(small, capacity, 0)
    base = used + more
    for length, n in alone.items():  # fewer than a window in all
        segments += [(length, small[length] - n + i, small[length] - n + i + 1, 1, more + i, 0) for i in range(n)]
        more += n
    cut = longs(_place(_ranked(rest, key, sum(small.values())), segments, used))
    return whole.unionByName(cut.select(*names, "sequence_id", "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence as bytes, from pieces made with ``with_ids``."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one entry per token of a window
    return packed.groupBy("sequence_id").agg(
        F.aggregate(held, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["ids"])).alias("ids")
    )
