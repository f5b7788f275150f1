"""Isolation Forest (Liu, Ting and Zhou, 2008) as a distributed fit and score.

Each tree needs at most 256 rows, so rows are assigned to trees by a hash, one
small group per tree is grown in parallel, and the forest (a table of a few
ten thousand nodes) travels to the scoring tasks. Hashes of the row id and the
seed replace random draws: results do not depend on partitioning.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TREES = 200
SAMPLE = 256
# candidates per wanted row: a tree of 256 is short of rows with a probability below 1e-80
SPARE = 3.0
EULER_GAMMA = 0.5772156649

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    many = 2.0 * (np.log(np.maximum(n - 1, 1)) + EULER_GAMMA) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, many))


def tree_samples(vectors: DataFrame, n: int, seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Rows of (tree, id, features): ``min(sample, n)`` distinct rows for every tree.

    Every row is a candidate of each tree with a chance that leaves a tree near three times
    its sample; of those the smallest of as many fresh draws are taken. A row's first tree
    comes from one number, as the length of a run of misses, so a row of a large table that serves no tree costs one hash. The
    rule and a tree's work are the same at every size of data. A tree that is short all the same stops the fit.
    """
    size = min(sample, n)
    keep = min(1.0, SPARE * size / max(n, 1))
    below = -(2**63) + min(int(keep * 2.0**64), 2**64 - 1)
    draw = lambda t, kind: F.xxhash64("id", t, F.lit(seed), F.lit(kind))
    if keep < 1.0:
        unit = (F.shiftrightunsigned(draw(F.lit(-1), 0), 11) + 0.5) * 2.0**-53
        misses = F.floor(F.ln(unit) / math.log1p(-keep))
    else:
        misses = F.lit(0).cast("bigint")
    served = vectors.withColumn("_first", misses).where(F.col("_first") < trees).withColumn("_first", F.col("_first").cast("int"))
    after = F.filter(F.sequence(F.col("_first"), F.lit(trees - 1)), lambda t: (t == F.col("_first")) | (draw(t, 1) <= F.lit(below)))
    thinned = served.select(*vectors.columns, F.explode(after).alias("tree")).withColumn("_draw", draw(F.col("tree"), 2))
    first = Window.partitionBy("tree").orderBy("_draw", "id")
    return thinned.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= size).drop("_at", "_draw")


def _grow(seed: int, depth_limit: int, size: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) != size:
            raise ValueError(f"tree {rows['tree'].iloc[0]} has {len(rows)} of {size} rows")
        rows = rows.sort_values("id", kind="stable")
        tree = int(rows["tree"].iloc[0])
        x = np.stack(rows["features"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        pending = [(np.arange(len(x)), 0, -1, False)]
        while pending:
            members, depth, parent, is_right = pending.pop()
            number = len(nodes)
            if parent >= 0:
                nodes[parent][5 if is_right else 4] = number
            here = x[members]
            growing = depth < depth_limit and len(members) > 1
            low, high = (here.min(axis=0), here.max(axis=0)) if growing else (0.0, 0.0)
            splittable = np.flatnonzero(high > low)
            if len(splittable) == 0:
                path = depth + float(average_path(len(members)))
                nodes.append([tree, number, -1, 0.0, -1, -1, path])
                continue
            feature = int(rng.choice(splittable))
            threshold = float(rng.uniform(low[feature], high[feature]))
            nodes.append([tree, number, feature, threshold, -1, -1, 0.0])
            goes_left = here[:, feature] <= threshold
            pending.append((members[~goes_left], depth + 1, number, True))
            pending.append((members[goes_left], depth + 1, number, False))
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return grow


def fit_forest(vectors: DataFrame, n: int, seed: int = 42, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Node table of the forest; ``vectors`` has ``id`` and ``features`` and ``n`` rows."""
    depth_limit = max(1, math.ceil(math.log2(max(min(sample, n), 2))))
    samples = tree_samples(vectors.select("id", "features"), n, seed, trees, sample)
    return samples.groupBy("tree").applyInPandas(_grow(seed, depth_limit, min(sample, n)), NODE_SCHEMA)


def _flatten(nodes: pd.DataFrame):
    """Forest as flat arrays with node numbers made global, and the root of each tree."""
    nodes = nodes.sort_values(["tree", "node"])
    start = nodes.groupby("tree")["node"].transform("size").groupby(nodes["tree"]).first().cumsum().shift(fill_value=0)
    base = nodes["tree"].map(start).to_numpy()
    leaf = nodes["feature"].to_numpy() < 0
    own = base + nodes["node"].to_numpy()
    left = np.where(leaf, own, base + nodes["left"].to_numpy())
    right = np.where(leaf, own, base + nodes["right"].to_numpy())
    feature = np.where(leaf, 0, nodes["feature"].to_numpy())
    return feature, nodes["threshold"].to_numpy(), left, right, nodes["path"].to_numpy(), start.to_numpy()


def forest_scorer(spark: SparkSession, nodes: DataFrame, sample_size: int):
    """Vectorised function of a feature array: -2^(-mean path / c(sample)), lower is more unusual.

    Only the array crosses to Python. The forest is shipped once per executor;
    it has at most trees x (2 * sample - 1) nodes, whatever the size of the data.
    """
    depth_limit = max(1, math.ceil(math.log2(max(sample_size, 2))))
    norm = max(float(average_path(sample_size)), 1e-12)
    shared = spark.sparkContext.broadcast(_flatten(nodes.toPandas()))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        feature, threshold, left, right, path, roots = shared.value
        for batch in batches:
            if len(batch) == 0:
                yield pd.Series(dtype=float)
                continue
            x = np.stack(batch.to_numpy())
            total = np.zeros(len(x))
            rows = np.arange(len(x))
            for root in roots:
                at = np.full(len(x), root)
                for _ in range(depth_limit):
                    at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                total += path[at]
            yield pd.Series(-np.exp2(-total / len(roots) / norm))

    # not folded into later filters, which would score every row twice
    return score.asNondeterministic()
