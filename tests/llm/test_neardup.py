import random

import cases
import pytest

from wattspan.durable import durable
from wattspan.llm import neardup
from wattspan.llm.components import connected_components
from wattspan.llm.neardup import SYMBOLS, bit_threshold, chunk_count, near_duplicates


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute(rows, width, percent):
    sets = {k: shingles(t, width) for k, t in rows}
    keys, parent = sorted(sets), {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(k, len(sets[k]), root(k), root(k) == k) for k in keys}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(docs, width, percent):
    some = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    expected = brute([(r.doc_id, r.text) for r in some.collect()], width, percent)
    assert {tuple(r) for r in near_duplicates(some, width=width, percent=percent).collect()} == expected


@pytest.mark.parametrize("block", [3, 2000])
def test_a_group_whose_members_are_linked_by_others_only(spark, block):
    """Copies that drift from one to the next: far from the first, near to their neighbours."""
    draw, words, rows = random.Random(3), cases.prose(200, 50).split(), []
    for i in range(40):
        rows.append((100 - i, " ".join(words)))
        words[draw.randrange(200)] = f"w{i}"
    rows += [(200 + i, " ".join(w if draw.random() > 0.06 else f"v{i}{j}" for j, w in enumerate(words))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(table, width=3, percent=85, block=block).collect()
    assert {tuple(r) for r in got} == brute(rows, 3, 85)


def test_null_keys_repeated_rows_and_no_rows(docs, empty):
    got = near_duplicates(docs).collect()
    assert len(got) == docs.count()
    null = next(r for r in got if r.doc_id is None)
    assert null.component_id is None and null.kept
    assert {(r.component_id, r.kept) for r in got if r.doc_id == 16} == {(16, True)}
    assert {r.component_id for r in got if r.doc_id in (6, 7, 8)} == {6, 7, 8}
    assert near_duplicates(empty).collect() == []


def test_components(spark):
    draw = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (5, 5), (None, 1)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    draw.shuffle(chain)
    edges = spark.createDataFrame(chain + star, "a long, b long")
    got = dict(tuple(r) for r in connected_components(edges).collect())
    assert got == {i: 100 for i in range(100, 161)} | {i: 1000 for i in range(1000, 1080)} | {3: 3, 7: 3}
    assert connected_components(edges.where("false")).collect() == []


def test_parameters_follow_from_the_similarity():
    kept = 0.85**SYMBOLS + SYMBOLS * 0.15 * 0.85 ** (SYMBOLS - 1)
    assert (1 - kept) ** chunk_count(0.85) <= 1e-6 < (1 - kept) ** (chunk_count(0.85) - 1)
    assert bit_threshold(1.0) == 0


def test_near_copies_that_are_no_links_do_not_meet_as_rows(spark, monkeypatch):
    """Copies of one text, each changed in its own places: alike enough for a common key, few of them linked."""

    def largest(copies):
        draw, words, written = random.Random(5), cases.prose(300, 60).split(), {}
        rows = [(i, " ".join(w if draw.random() > 0.02 else f"c{i}x{j}" for j, w in enumerate(words))) for i in range(copies)]

        def counted(df, label="table"):
            table = durable(df, label)
            written[label] = max(written.get(label, 0), table.count())
            return table

        monkeypatch.setattr(neardup, "durable", counted)
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=80).collect()
        assert {tuple(r) for r in got} == brute(rows, 5, 80)
        return written

    one, two = largest(60), largest(180)
    # three times the copies: about three times the rows of every table, not nine times
    assert {k: (one[k], n) for k, n in two.items() if n > 5 * one[k] + 50} == {}
