import math
import random

import pytest

from wattspan.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, id string, cell int, v string"


def brute(vectors, asked, k, scale=64):
    whole = {}
    for key, v, *_ in vectors:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[key] = [math.floor(scale * x) for x in v]
    out = set()
    for q in asked:
        if q in whole:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), key) for key, v in whole.items() if key != q)
            out |= {(q, i + 1, key, -s) for i, (s, key) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block,group", [(16, 4), (100_000, 256)])
def test_equals_brute_force_with_ties_and_bad_vectors(spark, block, group):
    draw = random.Random(1)
    rows = [(i, [draw.randint(-8, 8) / 16 for _ in range(6)], "x", 1, "y") for i in range(120)]
    rows += [(i, [0.5] * 6, "x", 1, "y") for i in range(200, 260)]  # a third are one vector
    rows += [(300, None, "x", 1, "y"), (301, [1.0, None], None, 1, "y"), (302, [float("nan")] * 6, "x", 1, "y")]
    rows += [(303, [float("inf")] * 6, "x", 1, "y"), (304, [0.25], "x", 1, None), (305, [], "x", 1, None), (None, [0.5] * 6, "x", 1, "y")]
    table = spark.createDataFrame(rows, SCHEMA)
    asked = [r[0] for r in rows if r[0] is not None and r[0] % 5 == 0]
    got = top_k(table, table.where("vec_id % 5 = 0"), k=7, pivots=8, sample=40, block=block, group_queries=group).collect()
    assert {tuple(r) for r in got} == brute(rows, asked, 7)
    assert len(got) == len({tuple(r) for r in got})


def test_fewer_vectors_than_wanted_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (20, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in top_k(table, table, k=20).collect()} == {(0, 1, 20, 64 * 64 * 11), (20, 1, 0, 64 * 64 * 11)}
    assert top_k(table.where("vec_id < 0"), table).collect() == []
    assert top_k(table, table.where("vec_id < 0")).collect() == []


@pytest.mark.parametrize("block", [2, 100_000])
def test_repeated_rows_of_a_key_are_candidates_each_and_one_query(spark, block):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), *[(5, [0.5, 0.25])] * 4, (6, [0.25, 0.0]), (7, [-1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(table, table.where("vec_id = 0"), k=5, pivots=2, block=block).collect())
    assert got == [(0, i, 5, 64 * 32) for i in range(1, 5)] + [(0, 5, 6, 64 * 16)]
