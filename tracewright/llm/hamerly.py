"""Centroid clustering of vectors with Hamerly's bounds, in exact integers.

Components are scaled and rounded down to integers. Every vector keeps one upper bound of
the distance to its own centroid and one lower bound of the distance to the second
nearest; when centroids move, the first grows by its own centroid's drift and the second
shrinks by the greatest drift of the others. A vector whose upper bound lies strictly
under its lower bound, or under half the distance from its centroid to the next one, has
kept its centroid and is not looked at; else its upper bound is made exact, and only if
that does not settle it, all centroids are scanned in integers. Bounds are doubles, widened
by more than their rounding error, so they only spare work: assignments, sums and
distances are exact.

Vectors are packed into blocks, written once in buckets by block number. Bounds and
assignments are a second table in the same buckets, one row a block, so a round joins the
two without a shuffle and writes about a tenth of the vectors' bytes. A round sends each
block's change of sums, added up in each task, to ``k * (dim + 1)`` grouped rows; only
those and the centroids reach the driver. All tables lie in the shared folder, so a lost
executor costs the tasks it held.

Defined results: vectors that are null, of another length, or that hold null or non-finite
components take no part, nor do those with a component of 2**17 or more in magnitude, whose
distances may not fit a long. Repeated rows are each a vector; equal vectors go to the same
cluster. A null id is kept; its vector is the last choice as a first centroid. Of vectors
with equal ids the one with the least components comes first among first centroids. With
fewer than ``k`` vectors there are as many clusters as vectors; no vectors give no rows.
Other columns are ignored. There are no texts here, so none can be empty or very long.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, new_path, ship

_WIDER, _NARROWER = 1 + 1e-12, 1 - 1e-12


@dataclass(frozen=True)
class ClusterSettings:
    k: int = 8
    dim: int = 64
    scale: int = 1024
    rounds: int = 10
    seed: int = 3
    limit: int = 1 << 17  # components of this magnitude take no part
    block: int = 2048  # vectors in a row of the packed table
    bucket: int = 1 << 17  # vectors in a bucket, about


def integer_vectors(vectors: DataFrame, settings: ClusterSettings, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of ints); only vectors that take part."""
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == settings.dim)
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < settings.limit))
    return rows.where(whole).select("vec_id", F.transform("x", lambda c: F.floor(c * settings.scale).cast("int")).alias("v"))


def first_centroids(points: DataFrame, settings: ClusterSettings) -> np.ndarray:
    """The ``k`` vectors whose seeded ids have the least hashes, in that order."""
    name = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.select(name.alias("name"), "v").orderBy(F.col("name").asc_nulls_last(), "v").limit(settings.k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), settings.dim)


class Buckets:
    """Tables of one clustering, all in the same buckets by block number."""

    def __init__(self, spark: SparkSession, count: int) -> None:
        self.spark, self.count, self.made = spark, count, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        name = f"{label}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.count, "block").sortBy("block").option("path", new_path(self.spark, label)).saveAsTable(name)
        self.made.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        """Take the names off the catalog; the files of the last tables stay, as the result's plan reads them."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def packed(points: DataFrame, settings: ClusterSettings) -> DataFrame:
    """block, ids, missing (no id), points: ``settings.block`` vectors a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, missing, values, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row() -> pa.RecordBatch:
            parts = [np.concatenate(x) for x in (ids, missing, values)]
            names = ["block", "ids", "missing", "points"]
            return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names)

        for batch in batches:
            for start in range(0, batch.num_rows, settings.block):
                some = batch.slice(start, settings.block)
                ids.append(some.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8"))
                missing.append(some.column("none").to_numpy(zero_copy_only=False).astype("u1"))
                values.append(some.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4"))
                held += some.num_rows
                if held >= settings.block:
                    yield row()
                    block, ids, missing, values, held = block + 1, [], [], [], 0
        if held:
            yield row()

    rows = points.select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("none"), "v")
    return rows.mapInArrow(run, "block long, ids binary, missing binary, points binary")


def squared(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = points - centroid
    return np.einsum("ij,ij->i", gap, gap)


@dataclass(frozen=True)
class Moved:
    """Centroids of a round, and how far each has come since the round before."""

    centroids: np.ndarray
    drift: np.ndarray

    def guards(self) -> tuple[np.ndarray, np.ndarray]:
        """Per centroid: half the distance to the next one; the greatest drift of the others."""
        k = len(self.centroids)
        half, others = np.full(k, np.inf), np.zeros(k)
        for c in range(k):
            rest = np.delete(np.arange(k), c)
            if len(rest):
                half[c] = math.sqrt(squared(self.centroids[rest], self.centroids[c]).min()) / 2 * _NARROWER
                others[c] = self.drift[rest].max()
        return half, others


def assign(points: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New (own, upper, lower) of a block, and how many vectors got a full scan; own is -1 before the first round."""
    half, others = moved.guards()
    upper = (upper + moved.drift[own]) * _WIDER
    lower = np.maximum((lower - others[own]) * _NARROWER, 0.0)
    guard = np.maximum(lower, half[own])
    guard[own < 0] = 0.0
    open_ = np.flatnonzero(~(upper < guard))
    if len(open_):  # make the upper bound exact
        seen = open_[own[open_] >= 0]
        upper[seen] = np.sqrt(squared(points[seen], moved.centroids[own[seen]])) * _WIDER
        open_ = open_[~((upper[open_] < guard[open_]) & (own[open_] >= 0))]
    if len(open_):
        all_of = np.stack([squared(points[open_], c) for c in moved.centroids], axis=1)
        own = own.copy()
        own[open_] = all_of.argmin(axis=1)  # the smaller number of equal ones
        nearest = all_of[np.arange(len(open_)), own[open_]]
        upper[open_] = np.sqrt(nearest) * _WIDER
        if all_of.shape[1] > 1:
            lower[open_] = np.sqrt(np.partition(all_of, 1, axis=1)[:, 1]) * _NARROWER
        else:
            lower[open_] = np.inf
    return own, upper, lower, len(open_)


def change(points: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> np.ndarray | None:
    """What vectors that changed their cluster add to (sums, counts); k rows."""
    went = np.flatnonzero(before != after)
    if not len(went):
        return None
    total = np.zeros((k, points.shape[1] + 1), dtype=np.int64)
    for c in range(k):
        came, left = points[went[after[went] == c]], points[went[before[went] == c]]
        total[c, :-1] = came.sum(axis=0) - left.sum(axis=0)
        total[c, -1] = len(came) - len(left)
    return total


STATE = "block long, own binary, upper binary, lower binary, scanned long, change binary, distance binary"


def _round(blocks: DataFrame, state: DataFrame | None, moved: Moved, settings: ClusterSettings, last: bool) -> DataFrame:
    k, dim, first = len(moved.centroids), settings.dim, state is None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                points = np.frombuffer(row.points, "<i4").reshape(-1, dim).astype(np.int64)
                if first:
                    before = np.full(len(points), -1)
                    upper, lower = np.full(len(points), np.inf), np.zeros(len(points))
                else:
                    before = np.frombuffer(row.own, "<i4").astype(np.int64)
                    upper, lower = np.frombuffer(row.upper, "<f8"), np.frombuffer(row.lower, "<f8")
                after, upper, lower, scanned = assign(points, before, upper, lower, moved)
                delta = change(points, before, after, k)
                distance = squared(points, moved.centroids[after]).astype("<i8").tobytes() if last else None
                out.append((row.block, after.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes(), scanned, None if delta is None else delta.tobytes(), distance))
            yield pd.DataFrame(out, columns=["block", "own", "upper", "lower", "scanned", "change", "distance"])

    rows = blocks.select("block", "points")
    if state is not None:
        rows = rows.join(state.select("block", "own", "upper", "lower"), "block")
    return rows.mapInPandas(run, STATE)


def _totals(state: DataFrame, column: str, size: int, fold) -> list[int]:
    """Sums over all blocks of ``fold(row)``, an array of ``size`` longs; added up in each task first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for frame in frames:
            for row in frame.itertuples(index=False):
                total += fold(row)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"slot": some, "value": total[some]})

    rows = state.where(F.col(column).isNotNull()).select("own", column).mapInPandas(run, "slot long, value long")
    found = [0] * size
    for r in rows.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():  # at most ``size`` rows
        found[r["slot"]] = int(r["value"])
    return found


@dataclass(frozen=True)
class Clusters:
    rows: DataFrame  # vec_id, cluster, distance
    centroids: np.ndarray
    inertia: list[int]  # of each cluster
    scanned: list[int]  # full scans of each round


def cluster(vectors: DataFrame, settings: ClusterSettings = ClusterSettings(), id_col: str = "vec_id", vec_col: str = "embedding", trace: bool = False) -> Clusters | None:
    """Cluster ``vectors``; None if no vector takes part. ``trace``: count the full scans of each round."""
    spark = ship(vectors.sparkSession)
    points = integer_vectors(vectors, settings, id_col, vec_col)
    centroids = first_centroids(points, settings)
    k = len(centroids)
    if not k:
        return None
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // settings.bucket))
    buckets = Buckets(spark, count)
    blocks = buckets.write(packed(points, settings).repartition(count, "block"), "vectors")
    sums, state, scanned = [0] * (k * (settings.dim + 1)), None, []
    moved = Moved(centroids, np.zeros(k))
    for number in range(settings.rounds + 1):
        last = number == settings.rounds
        after = buckets.write(_round(blocks, state, moved, settings, last), "bounds")
        if state is not None:
            discard(state)
        state = after
        if trace:
            scanned.append(state.agg(F.sum("scanned")).first()[0])
        if last:
            break
        delta = _totals(state, "change", len(sums), lambda row: np.frombuffer(row.change, np.int64))
        sums = [a + b for a, b in zip(sums, delta, strict=True)]
        table = np.array(sums, dtype=object).reshape(k, settings.dim + 1)
        fresh = [[s // row[-1] for s in row[:-1]] if row[-1] else old for row, old in zip(table.tolist(), moved.centroids.tolist(), strict=True)]
        fresh = np.array(fresh, dtype=np.int64)
        drift = np.array([math.sqrt(squared(fresh[c : c + 1], moved.centroids[c])[0]) * _WIDER for c in range(k)])
        moved = Moved(fresh, drift)

    def spread(row) -> np.ndarray:
        total = np.zeros(k, dtype=np.int64)
        np.add.at(total, np.frombuffer(row.own, "<i4"), np.frombuffer(row.distance, "<i8"))
        return total

    inertia = _totals(state, "distance", k, spread)
    joined = blocks.select("block", "ids", "missing").join(state.select("block", "own", "distance"), "block")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids = pd.array(np.frombuffer(row.ids, "<i8"), dtype="Int64")
                ids[np.frombuffer(row.missing, "u1").astype(bool)] = pd.NA
                yield pd.DataFrame({"vec_id": ids, "cluster": np.frombuffer(row.own, "<i4"), "distance": np.frombuffer(row.distance, "<i8")})

    rows = joined.mapInPandas(unpack, "vec_id long, cluster int, distance long")
    buckets.forget()
    return Clusters(rows, moved.centroids, inertia, scanned)


def report(found: Clusters | None, spark: SparkSession) -> DataFrame:
    """One row a vector, with its cluster's inertia, all clusters' inertia and its centroid's hash."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if found is None:
        return spark.createDataFrame([], schema)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    at = F.col("cluster") + 1
    own = F.element_at(F.array(*(F.lit(x).cast("long") for x in found.inertia)), at)
    return found.rows.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(sum(found.inertia)).cast("long").alias("inertia"), F.element_at(F.array(*map(F.lit, names)), at).alias("centroid_sha256"))
