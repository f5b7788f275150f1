import zlib
from collections import Counter

import cases
import numpy as np
import pytest

from wattspan.llm.packing import fill, pack, plan, powers_of_two, sequences, token_pieces


def best_sum(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(20))
def test_fill_is_the_best_multiset(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 60, 12).tolist()
    room = int(draw.integers(1, 200))
    counts = Counter(lengths)
    used = fill(counts, room)
    assert sum(x * n for x, n in used.items()) == best_sum(lengths, room)
    assert all(n <= counts[x] for x, n in used.items())


def test_plan_places_every_piece_once_and_leaves_little():
    counts = {700: 1000, 13: 5, 2048: 3, 100: 41}
    segments, left, windows = plan(counts, 2048, 16)
    placed = Counter()
    for length, first, end, places, _, _ in segments:
        placed[length] += end - first
        assert (end - first) % places == 0
    assert placed + left == Counter(counts)
    assert windows >= 3


def check(got, expected, capacity):
    """Pieces cover each document once, sequences have no gaps and are full or a power of two."""
    for r in got:
        ids = expected[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.crc == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    by_sequence, pad = {}, 0
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
        if at & (at - 1):
            pad += capacity - at
    return pad


def test_pieces_of_whole_texts(spark, docs, word_bpe):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe)
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    expected = {
        r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4") for r in some.collect()
    }
    got = pack(token_pieces(some, word_bpe)).collect()
    assert check(got, expected, 2048) <= 16 * len(got)
    for key, ids in expected.items():
        own = sorted((r.start, r.length) for r in got if r.doc_id == key)
        assert [s for s, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        assert sum(n for _, n in own) == len(ids)


def test_one_length_for_a_third_and_cut_at_powers_of_two(spark, word_bpe):
    rows = [(i, "the " * 699, None, None, None, 1, 2, "b", "k") for i in range(30)]
    docs = cases.documents(spark, rows)
    got = pack(token_pieces(docs, word_bpe, with_ids=True))
    found = got.collect()
    assert sum(r.length for r in found) == 30 * 700
    assert check(found, _ids(found), 2048) == 0
    assert {len(r.ids) // 4 for r in sequences(got).collect()} <= {2048, *(1 << i for i in range(11))}


def _ids(found):
    """Ids put together again from the pieces."""
    out = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        out[r.doc_id] = out.get(r.doc_id, b"") + bytes(r.ids)
    return {k: np.frombuffer(v, "<u4") for k, v in out.items()}


def test_null_keys_repeated_rows_and_no_rows(docs, empty, word_bpe):
    got = pack(token_pieces(docs, word_bpe)).collect()
    assert sum(r.doc_id is None for r in got) >= 1
    assert sum(r.length for r in got if r.doc_id == 16) == 2 * next(r.doc_tokens for r in got if r.doc_id == 16)
    assert pack(token_pieces(empty, word_bpe)).collect() == []
    assert powers_of_two(700) == [512, 128, 32, 16, 8, 4]
