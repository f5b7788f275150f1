"""What the exact and the hashed search carry, and their results on odd rows."""

import numpy as np
import pandas as pd
import pytest

from wattspan.models import neighbours


def table(spark, x, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "id long, features array<double>").repartition(4)


def carried(monkeypatch, run):
    """Rows that a search deals out to its tasks."""
    seen, plain = [], neighbours._search

    def counted(asked, base, *rest):
        seen.append(asked.count() + base.count())
        return plain(asked, base, *rest)

    monkeypatch.setattr(neighbours, "_search", counted)
    run().count()
    return sum(seen)


def test_rows_without_structure_are_carried_a_fixed_number_of_times(spark, monkeypatch):
    """Every query meets nearly every cell, yet neither side is sent once per cell or pair of blocks."""
    rng = np.random.default_rng(4)
    for n in (600, 2_400):
        df = table(spark, rng.normal(size=(n, 32)))
        assert carried(monkeypatch, lambda: neighbours.nearest_rows(df, df, 5, True)) <= 2 * neighbours.PARTS * n


def test_hashed_rows_are_carried_once_per_table(spark, monkeypatch):
    """One bucket of 5,000 rows on both sides is one block."""
    df = table(spark, np.random.default_rng(5).normal(size=(5_000, 16)))
    assert carried(monkeypatch, lambda: neighbours.hashed_nearest_rows(df, df, 5, True, tables=2, hashes=1)) <= 2 * 2 * 5_000


def test_blocks_ties_repeated_and_null_ids(spark):
    """Rows on a small grid have many equal distances; ids repeat and one is null."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (240, 3)).astype(float)
    ids = [int(i) for i in rng.integers(0, 200, 239)] + [None]
    df = table(spark, x, ids)
    key = lambda i: (i is not None, i or 0)
    want = []
    for i in set(ids):
        pairs = []
        for a in (a for a in range(len(x)) if ids[a] == i):
            d = [(float(np.sqrt(((x[a] - x[b]) ** 2).sum())), key(ids[b]), ids[b]) for b in range(len(x)) if i is None or ids[b] != i]
            pairs += sorted(d)[:7]
        want += [(i, n, d) for d, _, n in sorted(pairs)[:7]]
    for block in (9, 65_536):
        got = neighbours.nearest_rows(df, df, 7, True, pivots=70, block_rows=block).collect()
        assert sorted(((r["query"], r["neighbour"], r["distance"]) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("far, near", [(0.0, 1.0), (1e4, 1e-3), (1e12, 1.0)])
def test_products_lose_no_neighbour(far, near):
    """Points far from the origin and near each other, and one that is much farther away."""
    draw = np.random.default_rng(7)
    x = far + near * draw.standard_normal((700, 7))
    x[3] = 1e6 * (1 + far)
    rows = pd.DataFrame({"id": np.arange(700), "features": list(x), "mask": None})
    search = neighbours._Search(rows.iloc[:60], 6, True)
    for begin in range(0, 700, 90):
        search.meet(rows.iloc[begin : begin + 90])
    got = search.result().groupby("query")["distance"].agg(list)
    for i in range(60):
        exact = np.sqrt(((np.delete(x, i, axis=0) - x[i]) ** 2).sum(1))
        assert np.array_equal(got[i], np.sort(exact)[:6])
