import hashlib

import cases
import numpy as np
import pytest

from pyspark.sql import functions as F

from wattspan.llm import fingerprint
from wattspan.llm.fingerprint import Sketches, differing, edit_fingerprints, likeness, pieces


def edited(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def test_peeling_recovers_the_difference():
    draw = np.random.default_rng(1)
    for shared, left, right in ((50, 0, 0), (200, 3, 2), (0, 0, 5), (10, 300, 400)):
        common = draw.integers(0, 2**63, shared).astype(np.uint64)
        a, b = draw.integers(0, 2**63, left).astype(np.uint64), draw.integers(0, 2**63, right).astype(np.uint64)
        digest = np.concatenate([common, a, common, b])
        first = np.array([0, shared + left, len(digest)])
        items, pair, sign = differing(digest, first, np.array([0]), np.array([1]))
        assert set(items[sign == 1].tolist()) == set(a.tolist())
        assert set(items[sign == -1].tolist()) == set(b.tolist())


def test_a_full_sketch_is_not_taken_for_solved():
    digest = np.arange(1, 200, dtype=np.uint64)
    sketch = Sketches(digest, np.zeros(199, np.int64), 1, 12)
    assert not sketch.peel()[3][0]


def test_pieces_cover_every_byte():
    texts = [b"", b" \n ", b"a b c", b"a  b c", b"x\ny", b"x\n\ny", b"w " * 100, cases.prose(500, 1).encode()]
    digest, first = pieces(texts)
    sets = [tuple(digest[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert len(set(sets)) == len(texts)
    again, bounds = pieces(texts[::-1])
    assert sets == [tuple(again[a:b].tolist()) for a, b in zip(bounds, bounds[1:])][::-1]


@pytest.mark.parametrize("bucket,ranges", [(1000, 8192), (1000, 2), (10_000_000, 8192)])
def test_edits_and_next_documents(docs, bucket, ranges, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGES", ranges)
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in some.collect()), reverse=True)
    got = {r.doc_id: r for r in edit_fingerprints(some, bucket_chars=bucket).collect()}
    assert len(got) == len(rows)
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        new = edited(text, following)
        assert got[key].n_chars == len(text)
        assert got[key].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        digest, first = pieces([text.encode(), new.encode(), following.encode()])
        sets = [set(digest[a:b].tolist()) for a, b in zip(first, first[1:])]
        for name, other in (("near_edited", 1), ("near_next", 2)):
            both = len(sets[0]) + len(sets[other])
            assert got[key][name] == pytest.approx(1 - len(sets[0] ^ sets[other]) / both if both else 1.0)
        assert (got[key].fingerprint == got[key].edited_fingerprint) == (text == new)
    assert got[1].fingerprint == got[2].fingerprint
    assert got[11].near_edited > 0.4 > got[11].near_next


def test_rows_of_one_key_do_not_reach_the_driver(spark):
    ids = spark.range(30_000)
    drawn = ids.orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30))).first()["id"]  # the first key that a sample takes
    key = F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(drawn))
    rows = ids.select(key.alias("doc_id"), F.col("id").cast("string").alias("text"))
    seen, collect = [], type(rows).collect
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows), "collect", lambda df: seen.append(collect(df)) or seen[-1])
        done = edit_fingerprints(rows, bucket_chars=20_000)
    assert 0 < max(map(len, seen)) < 100 * 8  # a third of all rows has one key
    assert done.count() == 30_000


def test_single_row_null_keys_and_empty(docs, empty, spark):
    one = edit_fingerprints(docs.where("doc_id = 12")).collect()
    assert one[0].near_edited < 1 and one[0].near_next == 1
    assert len(edit_fingerprints(docs).collect()) == docs.count()
    assert edit_fingerprints(empty).collect() == []
    digest, first = pieces([b"", b""])
    assert likeness(digest, first, np.array([0]), np.array([1])).tolist() == [1.0]
