"""The forest's samples are fair, its trees follow from them node by node, and its scores from the trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspan.models.iforest import average_path, fit_forest, forest_scorer, tree_samples


def numbered(spark, n):
    return spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("features"))


@pytest.mark.parametrize("n", [1_000, 60_000])
def test_samples_are_fair_and_of_one_another_independent(spark, n):
    trees, size = 100, 256
    drawn = tree_samples(numbered(spark, n), n, trees=trees, sample=size).select("tree", "id").toPandas()
    assert not drawn.duplicated().any() and (drawn.groupby("tree").size() == size).all()
    parts = np.bincount(drawn["id"] * 10 // n, minlength=10)
    want = trees * size / 10
    assert (np.abs(parts - want) < 6 * math.sqrt(want)).all()  # every tenth of the rows has its share
    assert (np.abs(drawn.groupby("tree")["id"].mean() - n / 2) < 6 * n / math.sqrt(12 * size)).all()
    # pairs of trees share as many rows as two fair draws do, neighbouring trees as far ones
    taken = np.zeros((trees, n), np.float32)
    taken[drawn["tree"], drawn["id"]] = 1
    shared = taken @ taken.T
    want = size * size / n
    for apart in (1, 2, 10, 50):
        met = np.diagonal(shared, apart)
        assert abs(met.mean() - want) < 6 * math.sqrt(want / len(met))


def test_rows_of_one_id_and_null_ids_take_part(spark):
    rows = numbered(spark, 3000).withColumn("id", F.when(F.col("id") % 3 > 0, F.col("id")))
    assert tree_samples(rows, 3000, trees=5).count() == 5 * 256
    assert tree_samples(numbered(spark, 1), 1, trees=3).count() == 3


def test_trees_follow_from_their_samples_node_by_node(spark):
    made = np.random.default_rng(3)
    body = made.normal(size=(5000, 4)).round(1)
    body[:, 3] = 7.0  # never splits
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(body)], "id long, features array<double>")
    trees, n = 12, len(body)
    limit = math.ceil(math.log2(256))
    drawn = tree_samples(rows, n, trees=trees).select("tree", "id").toPandas()
    nodes = fit_forest(rows, n, trees=trees).toPandas().set_index(["tree", "node"]).sort_index()
    paths = np.zeros(n)
    for tree in range(trees):
        met, todo = set(), [(0, drawn[drawn["tree"] == tree]["id"].to_numpy(), np.arange(n), 0)]
        while todo:
            number, members, asked, depth = todo.pop()
            node, x = nodes.loc[(tree, number)], body[members]
            met.add(number)
            if node["feature"] < 0:
                assert depth == limit or len(x) <= 1 or (x.min(0) == x.max(0)).all()
                assert node["path"] == pytest.approx(depth + float(average_path(len(x))))
                paths[asked] += node["path"]
                continue
            at, cut = int(node["feature"]), node["threshold"]
            assert depth < limit and x[:, at].min() <= cut < x[:, at].max()
            for side, mine, theirs in (("left", x[:, at] <= cut, body[asked, at] <= cut), ("right", x[:, at] > cut, body[asked, at] > cut)):
                todo.append((int(node[side]), members[mine], asked[theirs], depth + 1))
        assert met == set(nodes.loc[tree].index)
    score = forest_scorer(spark, nodes_of(spark, nodes), 256)
    got = rows.select("id", score("features").alias("s")).orderBy("id").toPandas()["s"]
    np.testing.assert_allclose(got, -np.exp2(-paths / trees / float(average_path(256))), rtol=1e-12)


def nodes_of(spark, nodes):
    return spark.createDataFrame(nodes.reset_index())
