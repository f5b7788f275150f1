"""Local Outlier Factor (Breunig et al., 2000) on top of exact or approximate neighbours.

Fit and score are joins and averages over (query, neighbour) rows. A row that
many others have as a neighbour makes the join key skewed; the rows are few and
narrow, and adaptive execution splits such a partition.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspan.durable import durable
from wattspan.models.graph import nearest_by_descent, probe_index, write_index
from wattspan.models.neighbours import hashed_nearest_rows, nearest_rows

NEIGHBOURS = 20
SEARCHES = {"exact": nearest_rows, "hashed": hashed_nearest_rows, "descent": nearest_by_descent}
# Fixed value: keeps a density finite among copies of one row.
TINY = 1e-10


def _density(found: DataFrame, k_distance: DataFrame) -> DataFrame:
    """Local reachability density of each query."""
    reach = F.greatest("distance", "k_distance")
    joined = found.join(k_distance.select(F.col("id").alias("neighbour"), "k_distance"), "neighbour")
    return joined.groupBy("query").agg((1 / (F.avg(reach) + TINY)).alias("density"))


def _factor(found: DataFrame, own: DataFrame, base_density: DataFrame) -> DataFrame:
    around = found.join(base_density.select(F.col("id").alias("neighbour"), F.col("density").alias("_d")), "neighbour")
    mean = around.groupBy("query").agg(F.avg("_d").alias("_around"))
    return mean.join(own, "query").select(F.col("query").alias("id"), (F.col("_around") / F.col("density")).alias("lof"))


def fit_lof(vectors: DataFrame, k: int = NEIGHBOURS, method: str = "exact", **options) -> tuple[DataFrame, DataFrame]:
    """The model (id, features, k_distance, density) and the factor of every training row.

    ``method`` is ``exact``, ``hashed`` or ``descent``; options go to that search. Only the last one takes about as much
    work per row for any number of rows.
    """
    found = durable(SEARCHES[method](vectors, vectors, k, exclude_self=True, **options), "neighbours")
    k_distance = found.groupBy(F.col("query").alias("id")).agg(F.max("distance").alias("k_distance"))
    density = _density(found, k_distance)
    model = (
        vectors.select("id", "features")
        .join(k_distance, "id")
        .join(density.withColumnRenamed("query", "id"), "id")
    )
    model = durable(model, "lof")
    factor = _factor(found, model.select(F.col("id").alias("query"), "density"), model)
    return model, factor


def score_lof(
    queries: DataFrame, model: DataFrame, k: int = NEIGHBOURS, exclude_self: bool = False, method: str = "exact", **options
) -> DataFrame:
    """Factor of each query among the training rows.

    With ``exclude_self`` off, a training row finds itself at distance zero;
    with it on, the result is that of the fit.
    """
    found = durable(SEARCHES[method](queries, model, k, exclude_self, **options), "neighbours")
    return _factor(found, _density(found, model), model)


def save_index(model: DataFrame, path: str, **options) -> None:
    """Store what :func:`score_with_index` needs of a model."""
    write_index(model.select("id", "features", "k_distance", "density"), path, **options)


def score_with_index(queries: DataFrame, path: str, k: int = NEIGHBOURS, exclude_self: bool = False, **options) -> DataFrame:
    """Factor of each query among the rows of a stored index; only the folders that the queries meet are read."""
    found, rows = probe_index(queries, path, k, exclude_self, **options)
    found = durable(found, "neighbours")
    return _factor(found, _density(found, rows), rows)
