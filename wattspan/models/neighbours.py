"""Exact k nearest neighbours by cells around pivots.

Base rows belong to the cell of their nearest pivot. From its distances to the
pivots a query bounds the distance of its k-th neighbour and, by the triangle
inequality, skips every cell that cannot hold a nearer row. Queries of neighbouring cells
are a group; a task holds the queries of a group and lets a part of the base rows go by, cell by cell, each compared with the
queries that visit its cell. A query is carried once per part, a base row once per group that needs it, so what is
shuffled does not follow the number of pairs: there are PARTS groups and parts, fewer groups and more parts where
queries are few beside the base rows, and more groups where one would hold more than ``block_rows`` queries. A task emits only the k best rows per query, never all pairs. Where pivots can skip
little, the comparisons stay quadratic; which search runs is the caller's choice, never that of the size.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattspan.durable import durable

PIVOTS = 128
#: queries that a task holds while base rows go by, and the parts of the base rows beside them
BLOCK_ROWS, PARTS = 65_536, 8
#: numbers that a task compares at once
NUMBERS = 1 << 20
#: tasks that the groups of a search are dealt out to, at most
MOST_TASKS = 1024
#: stands for a null id
NO_ID = -(2**63)
# Room for rounding when squared distances come from a matrix product.
TOLERANCE = 1e-9
#: squared lengths up to which matrix products are taken in single precision
SINGLE = 1e18
PAIRS_AT_ONCE = 100_000
ROWS_AT_ONCE = 512

FOUND = "query long, neighbour long, distance double"


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squared = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squared, 0.0))


def choose_pivots(base: DataFrame, count: int = PIVOTS, seed: int = 42) -> np.ndarray:
    """``count`` base rows, first in the order of a hash; dense regions get more of them."""
    rows = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count).select("features").collect()
    return np.array([r["features"] for r in rows])


def assign_cells(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            d = _pivot_distances(np.stack(batch["features"].to_numpy()), pivots)
            cell = d.argmin(1)
            yield batch[["id", "features"]].assign(cell=cell.astype(np.int32), gap=d[np.arange(len(d)), cell])

    return base.select("id", "features").mapInPandas(assign, "id long, features array<double>, cell int, gap double")


def _cell_limits(cells: DataFrame, pivots: int, k: int):
    """Per cell: radius and the k smallest distances to the pivot. Both have at most pivots x k numbers."""
    radius = np.full(pivots, -np.inf)
    for row in cells.groupBy("cell").agg(F.max("gap").alias("r")).collect():
        radius[row["cell"]] = row["r"]
    nearest = np.full((pivots, k), np.inf)
    inner = Window.partitionBy("cell").orderBy("gap", "id")
    for row in cells.select("cell", "gap", F.row_number().over(inner).alias("at")).where(F.col("at") <= k).collect():
        nearest[row["cell"], row["at"] - 1] = row["gap"]
    return radius, nearest


def _visits(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, nearest: np.ndarray, k: int) -> DataFrame:
    """Each query with its own cell and, as the bits of ``mask``, the cells that can hold one of its k nearest rows."""
    between = _pivot_distances(pivots, pivots)
    words = -(-len(pivots) // 64)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["features"].to_numpy())
            d = _pivot_distances(x, pivots)
            limit = np.empty(len(d))
            for at in range(0, len(d), ROWS_AT_ONCE):  # each row meets pivots x k distances
                reach = (d[at : at + ROWS_AT_ONCE, :, None] + nearest[None]).reshape(-1, nearest.size)
                limit[at : at + ROWS_AT_ONCE] = np.partition(reach, k - 1, axis=1)[:, k - 1]
            slack = 1e-6 * (1.0 + d.max(1))
            limit = np.where(np.isfinite(limit), limit, np.inf) + slack
            own = d.argmin(1)
            apart = between[own]
            plane = (d**2 - (d.min(1) ** 2)[:, None]) / np.maximum(2 * apart, 1e-12)
            plane = np.where(apart > 0, plane, 0.0)
            keep = (d - radius[None, :] <= limit[:, None]) & (plane <= limit[:, None]) & np.isfinite(radius)[None, :]
            bits = np.zeros((len(keep), 64 * words), bool)
            bits[:, : keep.shape[1]] = keep
            mask = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            yield batch[["id", "features"]].assign(own=own.astype(np.int32), mask=list(mask))

    return queries.select("id", "features").mapInPandas(visit, "id long, features array<double>, own int, mask array<long>")


def _block_best(k: int, exclude_self: bool):
    def best(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or base.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        q, s = np.stack(queries["features"].to_numpy()), np.stack(base["features"].to_numpy())
        q_id, s_id = queries["id"].to_numpy(), base["id"].to_numpy()
        parts = []
        for start in range(0, len(q), 256):
            rows, ids = q[start : start + 256], q_id[start : start + 256]
            squared = (rows**2).sum(1)[:, None] + (s**2).sum(1)[None, :] - 2 * rows @ s.T
            if exclude_self:
                squared[ids[:, None] == s_id[None, :]] = np.inf
            cut = np.partition(squared, k - 1, axis=1)[:, k - 1] if k <= len(s) else np.full(len(rows), np.inf)
            size = (rows**2).sum(1) + (s**2).sum(1).max()
            maybe = np.isfinite(squared) & (squared <= (cut + TOLERANCE * size)[:, None])
            i, j = np.nonzero(maybe)
            exact = np.concatenate(
                [
                    np.sqrt(((rows[i[p : p + PAIRS_AT_ONCE]] - s[j[p : p + PAIRS_AT_ONCE]]) ** 2).sum(1))
                    for p in range(0, len(i), PAIRS_AT_ONCE)
                ]
                or [np.empty(0)]
            )
            order = np.lexsort((s_id[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            first = place < k
            parts.append(pd.DataFrame({"query": ids[i[first]], "neighbour": s_id[j[first]], "distance": exact[first]}))
        return pd.concat(parts, ignore_index=True)

    return best


def _products(x: np.ndarray, size: np.ndarray, kind, query: bool) -> tuple[np.ndarray, float]:
    """Rows whose product, of a query and a base row, is their squared distance less ``2 * room * size`` of the base row, and
    ``room``: rounding moves the product by at most ``room`` times both squared lengths. Pairs within a limit thus have a
    product of at most its square and ``2 * room * size`` of the query."""
    room = 2 * (x.shape[1] + 8) * float(np.finfo(kind).eps)
    rows = [-2 * x, np.ones((len(x), 1)), size[:, None]] if query else [x, (size * (1 - 2 * room))[:, None], np.ones((len(x), 1))]
    return np.concatenate(rows, axis=1).astype(kind), room


class _Search:
    """The k best rows so far of each query of a block, while base rows go by. What is held is the queries, their
    k best and the base rows of one batch."""

    def __init__(self, queries: pd.DataFrame, k: int, exclude_self: bool):
        self.k, self.exclude_self = k, exclude_self
        self.x, self.ids = np.stack(queries["features"].to_numpy()), queries["id"].to_numpy()
        self.size, self.sides = (self.x**2).sum(1), {}
        self.distance = np.full((len(self.x), k), np.inf)
        self.found = np.full((len(self.x), k), np.iinfo(np.int64).max)
        self.visits = None
        if queries["mask"].iloc[0] is not None:
            words = np.ascontiguousarray(np.stack(queries["mask"].to_numpy()).astype("<i8"))
            self.visits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(bool)

    def meet(self, base: pd.DataFrame) -> None:
        """Base rows, sorted by cell where queries visit some cells only."""
        s, ids = np.stack(base["features"].to_numpy()), base["id"].to_numpy()
        if self.visits is None:
            return self._compare(np.arange(len(self.x)), s, ids)
        cell = base["cell"].to_numpy()
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for a, b in zip(first, np.r_[first[1:], len(cell)]):
            self._compare(np.flatnonzero(self.visits[:, cell[a]]), s[a:b], ids[a:b])

    def _side(self, kind) -> tuple[np.ndarray, float]:
        if kind not in self.sides:
            self.sides[kind] = _products(self.x, self.size, kind, True)
        return self.sides[kind]

    def _near(self, own: np.ndarray, base: np.ndarray, size: float, s_id: np.ndarray, kind, cut_new: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Pairs, as places in ``own`` and ``base``, among which are all within the limits; ``size`` is the largest of ``base``."""
        side, room = self._side(kind)
        product = side[own] @ base.T
        cut = self.distance[own, -1] ** 2
        new = np.flatnonzero(~np.isfinite(cut))
        if len(new) and cut_new and self.k < len(base):
            first, ids = product[new], self.ids[own[new]]
            if self.exclude_self:
                first[(ids[:, None] == s_id[None, :]) & (ids != NO_ID)[:, None]] = np.inf
            cut[new] = np.partition(first, self.k - 1, axis=1)[:, self.k - 1] + 4 * room * (self.size[own[new]] + size)
        cut = np.nextafter((cut * (1 + 4 * room) + 2 * room * self.size[own]).astype(kind), kind(np.inf))
        i, j = np.divmod(np.flatnonzero(product <= cut[:, None]), len(base))
        if self.exclude_self:
            other = (self.ids[own[i]] != s_id[j]) | (s_id[j] == NO_ID)
            i, j = i[other], j[other]
        return i, j

    def _kind(self, s_size: np.ndarray):
        return np.float32 if max(self.size.max(), s_size.max()) < SINGLE else np.float64

    def _compare(self, at: np.ndarray, s: np.ndarray, s_id: np.ndarray) -> None:
        step, s_size = max(1, NUMBERS // len(s)), (s**2).sum(1)
        kind = self._kind(s_size)
        base, _ = _products(s, s_size, kind, False)
        for begin in range(0, len(at), step):
            own = at[begin : begin + step]
            i, j = self._near(own, base, s_size.max(), s_id, kind)
            for p in range(0, len(i), PAIRS_AT_ONCE):
                self._keep(own, i[p : p + PAIRS_AT_ONCE], s, s_id, j[p : p + PAIRS_AT_ONCE])

    def _keep(self, own: np.ndarray, i: np.ndarray, s: np.ndarray, s_id: np.ndarray, j: np.ndarray) -> None:
        at, ids = own[i], s_id[j]
        exact = np.sqrt(((self.x[at] - s[j]) ** 2).sum(1))
        last = self.distance[at, -1]
        better = (exact < last) | ((exact == last) & (ids < self.found[at, -1]))
        at, ids, exact = at[better], ids[better], exact[better]
        touched = np.unique(at)
        at = np.r_[np.repeat(touched, self.k), at]
        ids, exact = np.r_[self.found[touched].ravel(), ids], np.r_[self.distance[touched].ravel(), exact]
        order = np.lexsort((ids, exact, at))
        at, ids, exact = at[order], ids[order], exact[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        first = place < self.k
        self.distance[at[first], place[first]], self.found[at[first], place[first]] = exact[first], ids[first]

    def result(self) -> pd.DataFrame:
        i, j = np.nonzero(np.isfinite(self.distance))
        return pd.DataFrame({"query": self.ids[i], "neighbour": self.found[i, j], "distance": self.distance[i, j]})


def _searching(k: int, exclude_self: bool, kind=_Search):
    """For rows sorted by key, the queries of a key before its base rows: the k best of each query of each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, asked, search = None, [], None
        for batch in batches:
            if batch.empty:
                continue
            keys, is_base = batch["key"].to_numpy(), batch["is_base"].to_numpy()
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (is_base[1:] != is_base[:-1])])
            for a, b in zip(first, np.r_[first[1:], len(keys)]):
                if keys[a] != key:
                    if search:
                        yield search.result()
                    key, asked, search = keys[a], [], None
                rows = batch.iloc[a:b]
                if not is_base[a]:
                    asked.append(rows)
                elif asked:
                    search = search or kind(pd.concat(asked), k, exclude_self)
                    search.meet(rows)
        if search:
            yield search.result()

    return run


def _search(asked: DataFrame, base: DataFrame, k: int, exclude_self: bool, tasks: int | None = None) -> DataFrame:
    """The k best rows of each query within each key: ``asked`` has key, id, features and mask, ``base`` key, id, features and cell."""
    held = lambda is_base, mask, cell: ["key", F.lit(is_base).alias("is_base"), cell, F.coalesce("id", F.lit(NO_ID)).alias("id"), "features", mask]
    none = F.lit(None).cast("array<long>").alias("mask"), F.lit(-1).alias("cell")
    rows = asked.select(*held(False, F.col("mask"), none[1])).union(base.select(*held(True, none[0], F.col("cell").cast("int"))))
    rows = rows.repartition(tasks, "key") if tasks else rows.repartition("key")
    found = rows.sortWithinPartitions("key", "is_base", "cell").mapInPandas(_searching(k, exclude_self), FOUND)
    return found.select(*[F.nullif(c, F.lit(NO_ID)).alias(c) for c in ("query", "neighbour")], "distance")


def _chain(pivots: np.ndarray) -> np.ndarray:
    """The place of each pivot in a walk from one to the nearest that is left."""
    left, at, place = set(range(len(pivots))), 0, np.zeros(len(pivots), np.int64)
    for step in range(len(pivots)):
        place[at] = step
        left.discard(at)
        if left:
            others = np.array(sorted(left))
            at = int(others[((pivots[others] - pivots[at]) ** 2).sum(1).argmin()])
    return place


def nearest_rows(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    exclude_self: bool = False,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """The k nearest base rows of every query: (query, neighbour, distance, rank).

    Both inputs have a unique ``id`` and ``features`` (array<double>). Ties in
    distance go to the smaller id. ``exclude_self`` skips the base row with the
    query's own id. A task holds about ``block_rows`` queries.
    """
    centres = choose_pivots(base, pivots, seed)
    if len(centres) == 0:
        raise ValueError("no base rows")
    cells = durable(assign_cells(base, centres), "cells")
    wanted = k + 1 if exclude_self else k
    radius, nearest = _cell_limits(cells, len(centres), wanted)
    visits = durable(_visits(queries, centres, radius, nearest, wanted), "visits")
    spark, place = cells.sparkSession, _chain(centres)
    # queries of neighbouring cells are one group, in at least PARTS groups; a group needs the cells that any of its queries visits
    counts = {r["own"]: r["count"] for r in visits.groupBy("own").count().collect()}  # a row per pivot at most
    total = sum(counts.values())
    # both sides are sent about equally often by bytes, over PARTS * PARTS tasks at least
    few = math.ceil(PARTS * min(1.0, math.sqrt(total / max(cells.count(), 1))))
    groups, before, held = max(few, math.ceil(total / block_rows), 1), 0, [(-1, 0, 0)]
    parts = max(PARTS, PARTS * PARTS // groups)
    for c in sorted(counts, key=lambda c: place[c]):
        held.append((c, before, counts[c]))
        before += counts[c]
    share = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    group = F.floor((F.col("before") + share * F.col("count")) * groups / max(total, 1)).cast("long")
    placed = visits.join(F.broadcast(spark.createDataFrame(held, "own int, before long, count long")), "own")
    placed = placed.select("id", "features", "mask", F.least(group, F.lit(groups - 1)).alias("group"))
    words = -(-len(centres) // 64)
    needed = placed.groupBy("group").agg(*[F.bit_or(F.get("mask", F.lit(w))).alias(f"w{w}") for w in range(words)]).collect()  # a row per group
    by_cell = [(c, [r["group"] for r in needed if r[f"w{c // 64}"] >> (c % 64) & 1]) for c in range(len(centres))]
    by_cell = F.broadcast(spark.createDataFrame(by_cell, "cell int, groups array<long>"))
    part = F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(parts))
    number = lambda part: (F.col("group") * parts + part).alias("key")
    asked = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    asked = asked.select(number(F.col("part")), "id", "features", "mask")
    have = cells.join(by_cell, "cell").select("id", "features", "cell", F.explode("groups").alias("group"))
    have = have.select(number(part), "id", "features", "cell")
    return _best(_search(asked, have, k, exclude_self, min(groups * parts, MOST_TASKS)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    by_query = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def _solve(visits: DataFrame, cells: DataFrame, k: int, exclude_self: bool, block_rows: int, seed: int) -> DataFrame:
    """The k best rows of every block a query meets; both sides have ``cell``, ``id`` and
    ``features``, and crowded cells are split on both sides. Base rows go by the queries of a block."""
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(name))
    split = blocks(cells, "base_blocks").join(blocks(visits, "query_blocks"), "cell")
    spread = lambda name, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(name))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    # a block of queries and one of base rows meet under one number
    pair = F.xxhash64("cell", "base_block", "query_block").alias("key")
    base_side = (
        cells.join(split, "cell")
        .withColumn("base_block", spread("base_blocks", seed + 1))
        .withColumn("query_block", every("query_blocks"))
    )
    query_side = (
        visits.join(split, "cell")
        .withColumn("query_block", spread("query_blocks", seed + 2))
        .withColumn("base_block", every("base_blocks"))
    )
    asked = query_side.select(pair, "id", "features", F.lit(None).cast("array<long>").alias("mask"))
    return _search(asked, base_side.select(pair, "id", "features", F.lit(0).alias("cell")), k, exclude_self)


def collision(distance: float, width: float) -> float:
    """How likely two rows at a distance fall into one step of a Gaussian projection (Datar et al., 2004)."""
    ratio = width / max(distance, 1e-300)
    normal = 0.5 * (1 + math.erf(-ratio / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-(ratio**2) / 2))


def step_width(distance: float, tables: int, hashes: int, recall: float) -> float:
    """The smallest step with which rows at a distance share a bucket of some table with probability ``recall``."""
    low, high = distance * 1e-3, distance * 1e6
    for _ in range(100):
        middle = math.sqrt(low * high)
        if 1 - (1 - collision(distance, middle) ** hashes) ** tables < recall:
            low = middle
        else:
            high = middle
    return high


def hashed_nearest_rows(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    exclude_self: bool = False,
    tables: int = 12,
    hashes: int = 4,
    recall: float = 0.99,
    sample: int = 4096,
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Like :func:`nearest_rows`, but only rows that share a hashed bucket are compared.

    Each of ``tables`` tables cuts ``hashes`` random projections into steps. The step follows
    from ``recall`` and from how far the k-th neighbours of a bounded sample are, so
    the work adapts to the data and not to a switch. A row is carried once per table,
    whatever the number of rows; data without structure needs wide steps, and the
    search then compares nearly everything, as any search must.
    """
    head = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("features").collect()
    if not head:
        raise ValueError("no base rows")
    x = np.array([r["features"] for r in head])
    # the k-th neighbour among n rows is about the (k * share)-th among a share of them
    share = min(1.0, len(x) / max(base.count(), 1))
    at = max(1, math.ceil(k * share))
    probe = x[:256]
    squared = (probe**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * probe @ x.T
    far = np.sqrt(np.maximum(np.partition(squared, min(at, len(x) - 1), axis=1)[:, min(at, len(x) - 1)], 0))
    width = step_width(max(float(np.quantile(far, 0.9)), 1e-9), tables, hashes, recall)
    draw = np.random.default_rng(seed)
    planes = draw.standard_normal((x.shape[1], tables * hashes)) / width
    shifts = draw.random(tables * hashes)
    odd = draw.integers(1, 2**62, hashes) * 2 + 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            steps = np.floor(np.stack(batch["features"].to_numpy()) @ planes + shifts).astype(np.int64)
            keys = (steps.reshape(len(batch), tables, hashes) * odd).sum(2) * tables + np.arange(tables)
            yield batch[["id", "features"]].assign(cells=list(keys))

    # a row is stored once, with its buckets; it is carried to them when they meet
    schema = "id long, features array<double>, cells array<long>"
    spread = lambda df, label: durable(df.select("id", "features").mapInPandas(place, schema), label).select("id", "features", F.explode("cells").alias("cell"))
    cells = spread(base, "hashed")
    visits = cells if queries is base else spread(queries, "visits")
    found = _solve(visits, cells, k, exclude_self, block_rows, seed)
    return _best(found.dropDuplicates(["query", "neighbour"]), k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (or rows as near) that a search has found."""
    limit = exact.groupBy("query").agg(F.max("distance").alias("limit"), F.count(F.lit(1)).alias("n"))
    hits = limit.join(found.select("query", "distance"), "query", "left")
    counted = hits.groupBy("query", "n").agg(F.count_if(F.col("distance") <= F.col("limit") * (1 + 1e-12)).alias("hit"))
    return counted.agg(F.sum(F.least("hit", "n")) / F.sum("n")).first()[0]
