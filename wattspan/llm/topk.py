"""Exact top-k inner products by a Voronoi join.

Vectors are whole numbers. Data falls into the cells of pivots taken from a
bounded sample; a cell member keeps its distance to the pivot. The same sample gives
each query a score that its k-th best cannot be below. With pivot p and distance d,
``<q, x> <= <q, p> + |q| d``; so a group of queries needs x of cell j only if
``max(<q, p_j> - floor(q)) + max|q| * d >= 0``. Only such members are sent to the
group, in blocks of bounded size, and each block is solved by one matrix
product. Queries are grouped by neighbouring cells; crowded cells are split.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.durable import durable

EXACT = 2.0**53


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a null vector or a null or
    non-finite component are left out."""
    good = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    values = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(good).select(
        F.col(key).cast("long").alias("id"), values.alias("v")
    )


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Centres of the sample by a few rounds of k-means, started at evenly spaced members."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(1) - 2 * sample @ centres.T).argmin(1)
        for j in np.unique(nearest):
            centres[j] = sample[nearest == j].mean(0)
    return centres


def _grouped(counts: dict[int, int], pivots: np.ndarray, size: int) -> dict[int, tuple[int, int]]:
    """Cell -> (first group, number of groups): neighbouring cells are put together up to
    ``size`` queries, a larger cell is split."""
    left, out, group, held = dict(counts), {}, 0, 0
    at = min(left) if left else None
    while left:
        n = left.pop(at)
        if held and held + n > size:
            group, held = group + 1, 0
        split = math.ceil(n / size)
        out[at] = (group, split)
        if split > 1:
            group, held = group + split, 0
        else:
            held += n
        if left:
            others = np.array(sorted(left))
            at = int(others[((pivots[others] - pivots[at]) ** 2).sum(1).argmin()])
    return out


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    pivots: int = 128,
    sample: int = 8192,
    group_queries: int = 256,
    block: int = 16_384,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest integer inner products of
    each query with all vectors but those of its own key; ties go to the smaller key;
    fewer rows if there are fewer vectors.

    Vectors that are null or hold null or non-finite components take no part, nor do
    null keys; a shorter vector counts as filled up with zeros. Repeated rows of a
    key are separate candidates and separate queries' results are those of
    one row per key. An empty table gives an empty result. Scores are exact as long as
    they are below 2 ** 53 in size, and wrap at 64 bits beyond that. ``sample`` bounds
    the rows that pivots and first scores are taken from; it changes what is sent,
    not the result.
    """
    spark = vectors.sparkSession
    data = durable(whole_vectors(vectors, key, vector, scale), "vectors")
    asked = durable(whole_vectors(queries, key, vector, scale).dropDuplicates(["id"]), "queries")
    result = "query_id long, rank int, vec_id long, score long"
    about = data.agg(
        F.count("*").alias("n"),
        F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))).alias("most"),
    ).first()
    if not about.n:
        return spark.createDataFrame([], result)
    width, n = max(1, about.width), about.n
    kind = np.int64 if about.most * about.most * width >= EXACT else np.float64
    head = data.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    known, known_ids = _matrix(head["v"], width), head["id"].to_numpy()
    centres = _pivots(known, pivots)
    square = (centres**2).sum(1)
    blocks = max(1, math.ceil(n / block))

    def assign(batches):
        for rows in batches:
            x = _matrix(rows["v"], width)
            away = np.maximum((x**2).sum(1)[:, None] + square - 2 * x @ centres.T, 0)
            cell = away.argmin(1)
            yield pd.DataFrame({"id": rows["id"], "v": rows["v"], "cell": cell, "away": np.sqrt(away[np.arange(len(x)), cell])})

    placed = "id long, v array<double>, cell int, away double"
    data = durable(data.mapInPandas(assign, placed), "cells")
    asked = durable(asked.mapInPandas(assign, placed), "asked")
    counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}  # a row per pivot at most
    groups = _grouped(counts, centres, group_queries)
    where = spark.createDataFrame([(c, g, s) for c, (g, s) in groups.items()], "cell int, first int, split int")
    asked = asked.join(where, "cell").select(
        "id", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("split"))).cast("int").alias("group")
    )
    asked = durable(asked, "grouped")

    def bounds(rows: pd.DataFrame) -> pd.DataFrame:
        q = _matrix(rows["v"], width)
        scores = q @ known.T
        scores[rows["id"].to_numpy()[:, None] == known_ids[None, :]] = -np.inf
        floor = np.partition(scores, -k, axis=1)[:, -k] if len(known) >= k else np.full(len(q), -np.inf)
        reach = (q @ centres.T - floor[:, None]).max(0)
        norm = float(np.sqrt((q**2).sum(1)).max())
        return pd.DataFrame({"group": rows["group"].iloc[0], "cell": np.arange(len(centres)), "reach": reach, "norm": norm})

    summary = durable(asked.groupBy("group").applyInPandas(bounds, "group int, cell int, reach double, norm double"), "bounds")
    # a little slack for the rounding of the bound; the scores themselves are whole
    near = F.expr("reach + norm * away >= -1e-6 * (1 + abs(reach) + norm * away)")
    sent = data.join(summary, "cell").where(near).select(
        "group", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v"
    )
    spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def solve(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        if not len(ask) or not len(have):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        have = have.sort_values("id")
        ids = have["id"].to_numpy()
        scores = _matrix(ask["v"], width).astype(kind) @ _matrix(have["v"], width).astype(kind).T
        out = []
        for query, row in zip(ask["id"], scores, strict=True):
            lo, hi = np.searchsorted(ids, query), np.searchsorted(ids, query, "right")
            own, row = np.r_[ids[:lo], ids[hi:]], np.r_[row[:lo], row[hi:]]
            if len(row) > k:
                edge = np.partition(row, -k)[-k]
                above = np.flatnonzero(row > edge)
                chosen = np.r_[above, np.flatnonzero(row == edge)[: k - len(above)]]
            else:
                chosen = np.arange(len(row))
            out.append(pd.DataFrame({"query_id": query, "vec_id": own[chosen], "score": row[chosen].astype(np.int64)}))
        return pd.concat(out)

    solved = spread.groupBy("group", "block").cogroup(sent.groupBy("group", "block"))
    solved = solved.applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
