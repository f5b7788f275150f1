"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming search.

A signature has ``chunks`` times ``SYMBOLS`` symbols of 16 bits, one per hash function. Two
signatures that differ in at most ``chunks * (ERRORS + 1) - 1`` symbols differ in at most
ERRORS symbols of some chunk (pigeonhole). Every way to leave out ERRORS symbols of
a chunk is a key, so all pairs under that distance share a key; ``chunks`` is the
least number at which a pair of just the wanted similarity shares none with a
probability of at most ``miss``. Candidates are confirmed on whole shingle sets.

Documents with equal sets form one class, and only class representatives are
joined. Of a key's classes each is first compared with the smallest one; after the
components of these links are known, only pairs of classes of one key that lie in
different components are left. Their members get a longer signature of one bit per hash
function, and all pairs within its distance threshold are compared as well; a linked
pair lies beyond it with a probability of less than one in a million. These pairs are looked at and
confirmed inside the tasks, a key's classes in blocks: a task is sent classes and sends links,
of each block pair no more than join its components, never its pairs.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.llm.components import connected_components
from wattspan.llm.textarrays import longs_as_text, mix, parts, to_bytes, windows, word_hashes

SYMBOLS, ERRORS = 5, 1
#: 64-bit numbers of a long signature, and how many standard deviations are allowed for
LONGS, DEVIATIONS = 32, 5.0
#: numbers of a long signature that are compared first, and pairs that a task looks at at once
HEAD, PAIRS = 12, 1 << 16
#: shingles that the sets of a block hold on average
SHINGLES = 1 << 21


def chunk_count(similarity: float, miss: float = 1e-6) -> int:
    """The least number of chunks at which a pair of ``similarity`` is missed with at most ``miss``."""
    kept = similarity**SYMBOLS + SYMBOLS * (1 - similarity) * similarity ** (SYMBOLS - 1)
    return max(2, math.ceil(math.log(miss) / math.log(1 - kept)))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins.

    A text with fewer words than ``width`` has its whole word sequence as one
    shingle, a text without words none.
    """
    hashes, first = word_hashes(texts)
    count = np.diff(first)
    runs = windows(hashes, width, 1)
    doc = np.repeat(np.arange(len(texts)), count)
    whole = doc[: len(runs)] == doc[width - 1 :] if len(runs) else np.zeros(0, bool)
    values, owner = [runs[whole]], [doc[: len(runs)][whole]]
    for d in np.flatnonzero((count > 0) & (count < width)):
        own = hashes[first[d] : first[d + 1]]
        values.append(mix(windows(own, len(own), 2), len(own)))
        owner.append(np.array([d]))
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])][: len(values)]
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def _signatures(key: str, text: str, width: int, symbols: int):
    """Per document: size of its set, a 128-bit name of the set, its signature."""

    def run(batches):
        for rows in batches:
            texts = to_bytes(rows[text], fold=True)
            for a, b in parts(texts):
                values, first = shingle_sets(texts[a:b], width)
                size = np.diff(first)
                full = np.flatnonzero(size)
                at = first[:-1][full]
                name, signature = np.zeros((b - a, 2), np.uint64), np.zeros((b - a, symbols), np.uint16)
                if len(full):
                    for i in range(2):
                        name[full, i] = np.add.reduceat(mix(values, 20 + i), at)
                    for i in range(symbols):
                        # the least of a scrambled order; 16 bits of its scrambled value are the symbol
                        factor = mix(np.array([i], np.uint64), 30)[0] | np.uint64(1)
                        least = np.minimum.reduceat(values * factor, at)
                        signature[full, i] = mix(least, 40) & np.uint64(0xFFFF)
                yield pd.DataFrame(
                    {
                        key: rows[key].iloc[a:b].to_numpy(),
                        "n_shingles": size,
                        "h": rows["h"].iloc[a:b].to_numpy(),
                        "name": [x.tobytes() if n else None for x, n in zip(name, size, strict=True)],
                        "signature": [x.tobytes() if n else None for x, n in zip(signature, size, strict=True)],
                    }
                )

    return run


def _key_table(signatures, chunks: int) -> np.ndarray:
    """The keys of each signature, one for each chunk and each left-out symbol."""
    sig = np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, chunks, SYMBOLS).astype(np.uint64)
    keys = np.empty((len(sig), chunks, SYMBOLS), np.int64)
    for left in range(SYMBOLS):
        rest = [i for i in range(SYMBOLS) if i != left]
        value = sum(sig[:, :, s] << np.uint64(16 * i) for i, s in enumerate(rest))
        at = np.arange(chunks, dtype=np.uint64) * np.uint64(SYMBOLS) + np.uint64(left)
        keys[:, :, left] = mix(mix(value, 50) + at, 51).astype(np.int64)
    return keys.reshape(len(sig), chunks * SYMBOLS)


def _keys(chunks: int):
    def run(batches):
        for rows in batches:
            if not len(rows):
                continue
            for keys in _key_table(rows["signature"], chunks).T:
                yield pd.DataFrame({"key": keys, "id": rows["id"].to_numpy(), "n": rows["n"].to_numpy()})

    return run


def bit_threshold(similarity: float) -> int:
    """How many bits of two long signatures may differ."""
    bits, differ = 64 * LONGS, (1 - similarity) / 2
    return math.ceil(bits * differ + DEVIATIONS * math.sqrt(bits * differ * (1 - differ)))


def _bits(batches):
    """Long signatures: the lowest bit of the scrambled least value of each hash function."""
    for rows in batches:
        for a, b in parts(rows["items"].tolist()):
            sets = [np.frombuffer(x, np.uint64) for x in rows["items"].iloc[a:b]]
            values, at = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
            out = np.empty((b - a, 64 * LONGS), np.uint8)
            for i in range(64 * LONGS):
                factor = mix(np.array([i], np.uint64), 31)[0] | np.uint64(1)
                out[:, i] = mix(np.minimum.reduceat(values * factor, at), 41) & np.uint64(1)
            known = rows[["id", "name"]].iloc[a:b].reset_index(drop=True)
            yield known.assign(bits=[x.tobytes() for x in np.packbits(out, axis=1)])


def _sets(text: str, width: int):
    def run(batches):
        for rows in batches:
            texts = to_bytes(rows[text], fold=True)
            for a, b in parts(texts):
                values, first = shingle_sets(texts[a:b], width)
                held = [values[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pd.DataFrame({"id": rows["id"].iloc[a:b].to_numpy(), "name": rows["name"].iloc[a:b].to_numpy(), "items": held})

    return run


def _confirm(percent: int):
    def run(batches):
        for rows in batches:
            keep = []
            for x, y in zip(rows["left"], rows["right"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield rows.loc[keep, ["a", "b"]]

    return run


def _block_pairs(batches):
    """Of rows sorted by key, x and y those of one block pair after the other."""
    held, last = [], None
    for rows in batches:
        if not len(rows):
            continue
        at = rows[["key", "x", "y"]].to_numpy()
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
        for a, b in zip(first, np.r_[first[1:], len(at)], strict=True):
            # the last one of a batch may go on in the next
            if held and tuple(at[a]) != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(rows.iloc[a:b])
            last = tuple(at[a])
    if held:
        yield pd.concat(held, ignore_index=True)


def _open_pairs(rows: pd.DataFrame, chunks: int, percent: int):
    """Places i, j in the rows of a block pair, i ascending: classes of different components within the distance of long
    signatures, each pair under the first of its common keys."""
    key, x, y, lead, lead_n = rows[["key", "x", "y", "lead", "lead_n"]].iloc[0].tolist()
    ids, n, component, own = (rows[c].to_numpy() for c in ("id", "n", "component", "own"))
    if (component == component[0]).all():
        return
    bits = np.frombuffer(b"".join(rows["bits"]), "<u8").reshape(-1, LONGS)
    keys, most = None, bit_threshold(percent / 100)
    # all pairs of the smallest class are stars
    left, right = (np.flatnonzero((own == block) & ((ids != lead) | (n != lead_n))) for block in (x, y))
    step = max(1, PAIRS // max(1, len(right)))
    for begin in range(0, len(left), step):
        i, j = left[begin : begin + step, None], right[None, :]
        some = component[i] != component[j]
        if x == y:
            some &= ids[i] < ids[j]
        some &= 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        i, j = np.nonzero(some)
        i, j = left[begin + i], right[j]
        apart = np.zeros(len(i), np.int64)
        for part in (slice(0, HEAD), slice(HEAD, LONGS)):
            apart += np.bitwise_count(bits[i, part] ^ bits[j, part]).sum(1, dtype=np.int64)
            i, j, apart = (v[apart <= most] for v in (i, j, apart))
        if not len(i):
            continue
        keys = _key_table(rows["signature"], chunks) if keys is None else keys
        common = keys[i] == keys[j]
        here = keys[i, common.argmax(1)] == key
        if here.any():
            yield i[here], j[here]


def _to_confirm(chunks: int, percent: int):
    """The rows of each block pair that are in one of its open pairs."""

    def run(batches):
        for rows in _block_pairs(batches):
            wanted = np.zeros(len(rows), bool)
            for i, j in _open_pairs(rows, chunks, percent):
                wanted[i] = wanted[j] = True
            if wanted.any():
                yield rows[wanted]

    return run


def _joining(chunks: int, percent: int):
    """Links among the open pairs of each block pair, confirmed on whole sets: as many as join the components that have one."""

    def run(batches):
        for rows in _block_pairs(batches):
            ids, part, links = rows["id"].to_numpy(), rows["component"].to_numpy().copy(), []
            sets = [np.frombuffer(x, np.uint64) for x in rows["items"]]
            size = np.array([len(x) for x in sets])
            values, number = np.unique(np.concatenate(sets), return_inverse=True)
            sets, held = np.split(number, np.cumsum(size)[:-1]), np.zeros(len(values), bool)
            for i, j in _open_pairs(rows, chunks, percent):
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                for a, others in zip(i[first], np.split(j, first[1:]), strict=True):
                    others = others[part[others] != part[a]]
                    held[sets[a]] = True
                    common = np.array([np.count_nonzero(held[sets[b]]) for b in others], np.int64)
                    held[sets[a]] = False
                    for b in others[100 * common >= percent * (size[a] + size[others] - common)]:
                        if part[a] != part[b]:
                            part[part == part[b]] = part[a]
                            links.append((ids[a], ids[b]))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, miss: float = 1e-6, block: int = 2000
) -> DataFrame:
    """One row per row of ``docs``: the key, n_shingles, component_id, kept.

    Documents are linked if the Jaccard similarity of their sets of ``width``-word
    shingles (A-Z lower-cased) is at least ``percent`` in a hundred; component_id is
    the smallest key that can be reached over links. Null, empty and blank texts have
    an empty set and are linked with nothing; a null key is a component of its own
    and never stands for others. Repeated rows are equal texts; rows with one key
    share the component of the first class of that key. An empty table gives an empty
    result. Other columns are not looked at. ``block`` classes of one key on average, against as many, are the work
    of one group: the result does not depend on it.
    """
    chunks = chunk_count(percent / 100, miss)
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    signed = longs_as_text(docs).withColumn("h", F.xxhash64(text)).mapInPandas(
        _signatures(key, text, width, chunks * SYMBOLS), f"`{key}` string, n_shingles long, h long, name binary, signature binary"
    )
    signed = durable(signed.withColumn(key, F.col(key).cast("long")), "signed")
    some = signed.where(f"n_shingles > 0 AND `{key}` IS NOT NULL")
    classes = durable(
        some.groupBy("name").agg(F.min(key).alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")),
        "classes",
    )
    keys = durable(classes.mapInPandas(_keys(chunks), "key long, id long, n long"), "keys")
    # keys of a single class are left out
    first = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("f"), F.max("id").alias("last"))
    first = durable(first.where("f.id <> last").select("key", F.col("f.id").alias("a"), F.col("f.n").alias("na")), "first")
    met = durable(keys.join(first.select("key"), "key"), "met")
    like = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    star = met.select("key", F.col("id").alias("b"), F.col("n").alias("nb")).join(first, "key").where(f"a <> b AND {like}")
    star = durable(star.select("a", "b").distinct(), "star")
    # whole sets of the classes that share a key with another; texts are dealt out this once.
    # Rows of one key with other texts are left to the class that stands for them.
    wanted = met.select("id").distinct().join(classes.select("id", "name"), "id")
    wanted = wanted.join(some.select(F.col(key).alias("id"), "name", "h"), ["id", "name"]).groupBy("id", "name").agg(F.min("h").alias("h"))
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), text)
    # once per text, where the join has put its rows; later joins read a plain table, whose hot keys can be split
    texts = texts.join(wanted, ["id", "h"]).dropDuplicates(["id", "h"])
    sets = durable(texts.mapInPandas(_sets(text, width), "id long, name binary, items binary"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("right")), "b")
        both = both.join(sets.select(F.col("id").alias("a"), F.col("items").alias("left")), "a")
        return durable(both.mapInPandas(_confirm(percent), "a long, b long"), "links")

    links = confirmed(star)
    parts_ = durable(connected_components(links), "components")
    # what the stars leave open: classes of one key in different components
    held = met.join(parts_, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    held = durable(held, "held")
    ends = [F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.struct("id", "n")).alias("f")]
    # the classes of a key meet in blocks, so that a key of many is the work of many tasks, and large sets fill smaller blocks
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / SHINGLES)).cast("int").alias("blocks")
    open_ = held.groupBy("key").agg(*ends, blocks).where("x <> y").select("key", F.col("f.id").alias("lead"), F.col("f.n").alias("lead_n"), "blocks")
    held = durable(held.join(open_, "key"), "open")
    bits = sets.join(held.select("id").distinct(), "id", "left_semi").mapInPandas(_bits, "id long, name binary, bits binary")
    # several classes may have one id, where keys repeat
    known = durable(bits.join(classes.drop("id"), "name"), "bits")
    held = held.drop("n").join(known, "id").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = [F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")]
    held = held.select("key", *ends, "own", "lead", "lead_n", "id", "name", "n", "component", "signature", "bits")

    def by_block_pair(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    rest = durable(by_block_pair(held).mapInPandas(_to_confirm(chunks, percent), held.schema), "rest")
    more = by_block_pair(rest.join(sets, ["id", "name"])).mapInPandas(_joining(chunks, percent), "a long, b long")
    more = durable(more, "links")
    if not more.isEmpty():
        # stars again over the first components: their nodes and the new links
        stars = parts_.select(F.col("id").alias("a"), F.col("component").alias("b"))
        parts_ = durable(connected_components(stars.union(more)), "components")
    named = classes.join(parts_, "id", "left").select("name", F.coalesce("component", "id").alias("component_id"))
    out = signed.join(named, "name", "left").select(
        key, "n_shingles", F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
