"""Robust scaling and repeatable k-means on descriptor columns.

All restarts run in the same pass. Points are put on an integer grid fine enough for
about nine significant digits, so cluster sums are exact integers and the result does
not depend on row order, partitioning or task retries.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..errors import ContractError
from ..session import materialize
from .quantiles import exact_quantiles


def robust_scale(df: DataFrame, cols):
    """``(scaled, centre, scale)``: median and interquartile range; a flat column keeps scale 1."""
    values = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols]
    q = exact_quantiles(df.select(F.inline(F.array(*values))), ["name"], "value", [0.25, 0.5, 0.75])
    found = {r["name"]: r["q"] for r in q.collect()}  # one row per descriptor column
    centre = {c: found[c][1] for c in cols}
    scale = {c: found[c][2] - found[c][0] for c in cols}
    scale = {c: s if s >= 1e-12 else 1.0 for c, s in scale.items()}
    scaled = df.select(
        *[x for x in df.columns if x not in cols],
        *[((F.col(c) - F.lit(centre[c])) / F.lit(scale[c])).alias(c) for c in cols],
    )
    return scaled, centre, scale


UNIT = 2.0**-30  # step of the grid the points lie on, the same for every table; larger than 2**32 is an error
_ROWS_PER_TASK = 50_000  # narrow rows; fewer would only add task overhead per iteration
_ROWS_PER_CALL = 16_384  # Arrow batches are short for images; points are taken in longer runs
_DRIVER_SUM_ROWS = 100_000  # points up to which the batches' partial sums go straight to the driver


@dataclass
class Clustering:
    assignments: DataFrame  # key column, cluster, distance2
    centres: np.ndarray  # [k, d], in the units of the input columns
    inertia: float


def _scramble(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of the public SplitMix64 generator."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, *salts) -> np.ndarray:
    x = keys.astype(np.uint64)
    for salt in salts:
        x = _scramble(x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances ``[n, k]``, accumulated per dimension to keep memory at ``n*k``."""
    out = np.zeros((len(points), len(centres)))
    for j in range(points.shape[1]):
        out += (points[:, j : j + 1] - centres[None, :, j]) ** 2
    return out


class _Points:
    """Grid points of a descriptor table: ``_key`` hash, ``_id`` text and integer columns."""

    def __init__(self, df: DataFrame, cols, key: str):
        self.key, self.dims = key, len(cols)
        self.n = df.count()
        self.unit = UNIT
        grid = F.array(*[F.round(F.col(c) / F.lit(self.unit)).cast("bigint") for c in cols])
        self.table = materialize(df.select(
            F.col(key).cast("string").alias("_id"), F.xxhash64(key).alias("_key"), grid.alias("_x")
        ).coalesce(max(1, -(-self.n // _ROWS_PER_TASK))))

    def run(self, visit, ddl: str) -> DataFrame:
        """Apply ``visit(ids, keys, integer points) -> pandas`` to runs of Arrow batches."""

        def call(held):
            pdf = held[0] if len(held) == 1 else pd.concat(held)
            return visit(pdf["_id"].to_numpy(), pdf["_key"].to_numpy(), np.stack(pdf["_x"].to_numpy()))

        def batches(frames):
            held, rows = [], 0
            for pdf in frames:
                held, rows = [*held, pdf], rows + len(pdf)
                if rows >= _ROWS_PER_CALL:
                    yield call(held)
                    held, rows = [], 0
            if rows:
                yield call(held)

        return self.table.mapInPandas(batches, ddl)


def _seed_centres(points: _Points, k: int, seed: int, restarts: int) -> np.ndarray:
    """k-means++ for every restart: distance-squared draws as an exponential race.

    The row maximising ``log(u) / distance^2`` is a draw proportional to the squared
    distance, with ``u`` a hash of ``(seed, restart, round, key)``. When every distance is
    zero the lowest key not yet used as a centre wins. One small aggregation per round.
    """
    unit = points.unit
    centres = np.zeros((restarts, 0, points.dims), dtype=np.int64)
    for step in range(k):
        chosen = centres.copy()

        def visit(ids, keys, x, chosen=chosen, step=step):
            first = int(np.argmin(ids))
            rows = []
            for r in range(restarts):
                u = _uniform(keys, seed, r, step)
                if step == 0:
                    score = u
                else:
                    d2 = _distances(x * unit, chosen[r] * unit).min(axis=1)
                    with np.errstate(divide="ignore"):
                        score = np.where(d2 > 0, np.log(u) / d2, -np.inf)
                best = int(np.lexsort((ids, -score))[0])
                if not np.isfinite(score[best]):
                    best = first
                value = float(score[best]) if np.isfinite(score[best]) else -1.7e308
                rows.append((r, value, ids[best], x[best].tolist()))
            return pd.DataFrame(rows, columns=["r", "score", "id", "x"])

        race = points.run(visit, "r int, score double, id string, x array<bigint>")
        # Highest score wins, lowest id on ties.
        order = F.struct((-F.col("score")).alias("s"), "id", "x")
        winners = race.groupBy("r").agg(F.min(order).alias("w"))
        found = {row["r"]: row["w"]["x"] for row in winners.collect()}  # one row per restart
        nxt = np.array([found[r] for r in range(restarts)], dtype=np.int64)[:, None, :]
        centres = np.concatenate([centres, nxt], axis=1)
    return centres


def kmeans(df: DataFrame, cols, k: int, seed: int = 2026, restarts: int = 8, max_iter: int = 100,
           key: str = "stem", engine: str = "exact", initial=None) -> Clustering:
    """Lloyd's algorithm from several seedings; the lowest inertia (first on ties) wins.

    ``initial`` gives the ``k`` first centres instead of a seeding, for one run from there.

    Points lie on a fixed grid of 2**-30 and are added exactly, so neither the number of rows,
    nor an outlier, nor the order of the sums can change a label. The grid points are stored
    once and each iteration reads them once. Per batch only partial sums leave the tasks, and
    only ``restarts x k`` rows reach the driver. A restart ends when its centres repeat.
    """
    if k < 1:
        raise ContractError("k must be at least 1")
    if engine == "mllib":
        return _kmeans_mllib(df, cols, k, restarts, max_iter, key)
    points = _Points(df, list(cols), key)
    if points.n < k:
        raise ContractError(f"{k} clusters need at least as many rows, found {points.n}")
    unit, dims = points.unit, points.dims
    if initial is None:
        centres = _seed_centres(points, k, seed, restarts) * unit
    else:
        centres = np.array(initial, dtype=float)[None]
        if centres.shape != (1, k, dims) or not np.isfinite(centres).all():
            raise ContractError(f"initial centres must be {k} rows of {dims} finite numbers")
    active = list(range(len(centres)))

    def nearest(x, centre_set):
        d2 = _distances(x, centre_set)
        return d2.argmin(axis=1), d2

    for step in range(max_iter):
        now, live = centres.copy(), list(active)

        def visit(ids, keys, x, now=now, live=live):
            out = []
            scaled = x * unit
            for r in live:
                a, _ = nearest(scaled, now[r])
                high, low = np.zeros((2, k, dims), dtype=np.int64)  # 32-bit halves cannot overflow within a batch
                np.add.at(high, a, x >> 32)
                np.add.at(low, a, x & 0xFFFFFFFF)
                size = np.bincount(a, minlength=k)
                for c in np.flatnonzero(size):
                    exact = [Decimal((int(h) << 32) + int(s)) for h, s in zip(high[c], low[c])]
                    out.append((r, int(c), int(size[c]), exact))
            return pd.DataFrame(out, columns=["r", "c", "size", "sums"])

        part = points.run(visit, "r int, c int, size bigint, sums array<decimal(38,0)>")
        total = _add_up(part, points, dims)
        for r in live:
            rows = {c: row for (q, c), row in total.items() if q == r}
            centres[r] = _updated(points, rows, now[r], k, nearest)
            if np.array_equal(centres[r], now[r]):
                active.remove(r)
        if not active:
            break

    inertia = _inertia(points, centres, nearest)
    best = int(np.argmin(inertia))
    final = centres[best]

    def label(ids, keys, x):
        a, d2 = nearest(x * unit, final)
        return pd.DataFrame({key: ids, "cluster": a.astype(np.int32), "distance2": d2.min(axis=1)})

    assigned = points.run(label, f"`{key}` string, cluster int, distance2 double")
    return Clustering(assigned, final, float(inertia[best]))


def _add_up(part: DataFrame, points: _Points, dims: int) -> dict:
    """Totals per ``(restart, cluster)`` of the batches' partial sums, at most ``restarts x k``.

    A few batches are added on the driver as they are; many are added by Spark first.
    """
    if points.n > _DRIVER_SUM_ROWS:
        part = part.groupBy("r", "c").agg(
            F.sum("size").alias("size"),
            F.array(*[F.sum(F.col("sums")[j]) for j in range(dims)]).alias("sums"),
        )
    total: dict = {}
    for row in part.collect():
        at = total.setdefault((row["r"], row["c"]), {"size": 0, "sums": np.zeros(dims, dtype=object)})
        at["size"] += row["size"]
        at["sums"] = at["sums"] + np.array([int(s) for s in row["sums"]], dtype=object)
    return total


def _updated(points: _Points, rows: dict, centres: np.ndarray, k: int, nearest) -> np.ndarray:
    """New centres from exact sums; empty clusters move to the farthest points in turn."""
    new = centres.copy()
    sums = {c: np.array(row["sums"], dtype=object) for c, row in rows.items()}
    size = {c: row["size"] for c, row in rows.items()}
    empty = [c for c in range(k) if c not in rows]
    if empty:
        far = iter(_farthest(points, centres, len(empty), nearest))
    for c in range(k):
        if size.get(c):
            new[c] = np.array([float(s) for s in sums[c]]) / size[c] * points.unit
            continue
        point, owner = next(far) if empty else (None, None)
        new[c] = np.array(point, dtype=float) * points.unit
        if owner > c and size.get(owner, 0):
            size[owner] -= 1
            sums[owner] = sums[owner] - np.array(point, dtype=object)
    return new


def _farthest(points: _Points, centres: np.ndarray, count: int, nearest):
    """The ``count`` points farthest from their centres (at most one per empty cluster)."""
    unit = points.unit

    def visit(ids, keys, x):
        a, d2 = nearest(x * unit, centres)
        near = d2.min(axis=1)
        top = np.lexsort((ids, -near))[:count]
        return pd.DataFrame({"d": near[top], "id": ids[top], "c": a[top].astype(np.int32), "x": list(x[top])})

    rows = points.run(visit, "d double, id string, c int, x array<bigint>")
    best = rows.orderBy(F.desc("d"), "id").limit(count).collect()
    return [(r["x"], r["c"]) for r in best]


def _inertia(points: _Points, centres: np.ndarray, nearest) -> np.ndarray:
    unit = points.unit

    def visit(ids, keys, x):
        sums = [float(nearest(x * unit, c)[1].min(axis=1).sum()) for c in centres]
        return pd.DataFrame({"r": np.arange(len(sums), dtype=np.int32), "v": sums})

    rows = points.run(visit, "r int, v double").groupBy("r").agg(F.sum("v").alias("v")).collect()
    found = {r["r"]: r["v"] for r in rows}
    # Ten digits: restarts that reached the same optimum compare equal in any summation order.
    return np.array([float(f"{found[r]:.10g}") for r in range(len(centres))])


def _kmeans_mllib(df, cols, k, restarts, max_iter, key) -> Clustering:
    """Spark ML's own k-means, one fit per seed; it may return fewer than ``k`` centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=list(cols), outputCol="_f").transform(df)
    fits = [KMeans(k=k, seed=s, maxIter=max_iter, featuresCol="_f", predictionCol="cluster").fit(table)
            for s in range(restarts)]
    model = min(fits, key=lambda m: m.summary.trainingCost)
    assigned = model.transform(table).select(F.col(key).cast("string").alias(key), "cluster")
    return Clustering(assigned, np.array(model.clusterCenters()), model.summary.trainingCost)


def cluster_distances(scaled: DataFrame, assignments: DataFrame, cols, centres: np.ndarray,
                      key: str = "stem") -> DataFrame:
    """``cluster, size, distance``: rows per cluster and centre distance to the global mean."""
    mean = scaled.agg(*[F.avg(c).alias(c) for c in cols]).first()
    middle = np.array([mean[c] for c in cols])
    gap = [float(f"{g:.12g}") for g in np.linalg.norm(centres - middle, axis=1)]
    sizes = {r["cluster"]: r["count"] for r in assignments.groupBy("cluster").count().collect()}
    rows = [(c, int(sizes.get(c, 0)), gap[c]) for c in range(len(centres))]  # one row per cluster
    return scaled.sparkSession.createDataFrame(rows, "cluster int, size bigint, distance double")
