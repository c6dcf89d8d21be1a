"""Centroid clustering of integer vectors; nearest centroids by equal-average equal-variance search.

Centroids are sorted by the sum of their components. For a vector the scan starts
at its own sum and goes outward. With d components, sums S and deviations
V = sqrt(sum (x - S/d)^2), the squared distance of x and c is at least
(Sx - Sc)^2 / d, and at least that plus (Vx - Vc)^2. Once the first bound is over
the best distance so far, so it is for every centroid further out and the scan
ends; the second bound passes over single centroids. What is left is measured in
64-bit integers, so ties and distances are exact. Bounds are taken in floating
point with a margin far above their rounding.

A round is one pass of Spark tasks over the vectors. A task adds up its vectors per
cluster, Spark adds up the tasks in decimals of 38 digits, and the driver holds
the centroids alone: `clusters` vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.textblocks import column_of
from harrow.session import cut_lineage

# Beyond this many units a squared distance of 64 components might not fit a long.
LARGEST = 1 << 27
_ROWS = 4096
_NONE = np.iinfo(np.int64).max


class Search:
    """Exact nearest centroids of blocks of integer vectors."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.centroids = centroids[self.order]
        self.sums = sums[self.order]
        self.deviations = _deviations(self.centroids)
        self.measured = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller) and its squared distance."""
        n, d = x.shape
        k = len(self.sums)
        sums, deviations = x.sum(1), _deviations(x)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best, number = np.full(n, _NONE), np.full(n, k)
        at = np.arange(n)
        while len(at):
            to_left, to_right = left[at], right[at]
            below = np.where(to_left >= 0, sums[at] - self.sums[to_left], np.inf)
            above = np.where(to_right < k, self.sums[np.minimum(to_right, k - 1)] - sums[at], np.inf)
            place = np.where(below <= above, to_left, to_right)
            by_mean = np.minimum(below, above) ** 2 / d
            open_ = by_mean * (1 - 1e-12) <= best[at]
            open_ &= np.isfinite(by_mean)
            at, place, by_mean = at[open_], place[open_], by_mean[open_]
            goes_left = (below <= above)[open_]
            left[at[goes_left]] -= 1
            right[at[~goes_left]] += 1
            own, its = deviations[at], self.deviations[place]
            near = by_mean * (1 - 1e-12) + (own - its) ** 2 - 1e-9 * (own**2 + its**2) <= best[at]
            rows, place = at[near], place[near]
            apart = x[rows] - self.centroids[place]
            distance = np.einsum("ij,ij->i", apart, apart)
            self.measured += len(rows)
            found = self.order[place]
            better = (distance < best[rows]) | ((distance == best[rows]) & (found < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], found[better]
        return number, best


def _deviations(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - x.mean(1, keepdims=True)) ** 2).sum(1))


def whole_vectors(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each vector of that many finite components; others go."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # conditions are taken one by one: a null array has no size
    kept = vectors.select("vec_id", "embedding").where(F.coalesce((F.size(x) == components) & finite, F.lit(False)))

    def unit(e: Column) -> Column:
        e = e.cast("double") * scale
        return F.when(F.abs(e) < LARGEST, F.floor(e).cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("int")
        )

    return kept.select("vec_id", F.transform(x, unit).alias("v"))


def first_centroids(whole: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose sha256 of `seed:vec_id` is smallest, in that order; ties by components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.orderBy(name.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(at, _ROWS)
            flat = column_of(piece, "v").flatten().to_numpy(zero_copy_only=False)
            yield piece, flat.astype(np.int64).reshape(piece.num_rows, -1)


def next_centroids(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays."""
    k, d = centroids.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Search(centroids), np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches):
            number, _ = search(x)
            order = np.argsort(number, kind="stable")
            there, begins = np.unique(number[order], return_index=True)
            sums[there] += np.add.reduceat(x[order], begins, axis=0)
            counts += np.bincount(number, minlength=k)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": there, "n": counts[there], "sums": list(sums[there])})

    parts = whole.select("v").mapInArrow(add_up, "cluster long, n long, sums array<long>")
    # the count goes along as one more component
    each = parts.select("cluster", F.posexplode(F.concat("sums", F.array("n"))).alias("i", "s"))
    sums = each.groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    means: dict[int, list[int]] = {}
    for row in sums.collect():  # at most d + 1 numbers a cluster
        means.setdefault(row["cluster"], [0] * (d + 1))[row["i"]] = int(row["s"])
    out = centroids.copy()
    for j, (*total, n) in means.items():
        out[j] = [x // n for x in total]
    return out


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for piece, x in _blocks(batches):
            number, distance = search(x)
            yield pa.RecordBatch.from_arrays(
                [column_of(piece, "vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"],
            )

    kind = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


def centroid_clusters(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, components: int = 64, scale: int = 256, seed: int = 2
) -> DataFrame:
    """Cluster the `embedding` column: one row per kept vector.

    Columns: vec_id, cluster, distance (squared, exact), cluster_inertia and
    inertia (distances summed over the cluster and over all), centroid_sha256 (of
    the final centroid's components, joined by commas), centroid.

    Vectors that are null, of another length, or hold a null or a non-finite
    component are left out. Rows of equal vec_id are vectors of their own; a null
    vec_id is kept and starts no centroid while others are left. With fewer vectors
    than clusters each vector starts one; an empty table gives no rows. A component
    beyond 2^27 / scale ends the job with a message, since distances could leave the
    range of a long. Other columns are not read.
    """
    spark = vectors.sparkSession
    whole = cut_lineage(whole_vectors(vectors, components, scale))
    centroids = first_centroids(whole, clusters, seed)
    kind = whole.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame(
            [],
            f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
            "centroid_sha256 string, centroid array<long>",
        )
    for _ in range(rounds):
        centroids = next_centroids(whole, centroids)
    rows = cut_lineage(assigned(whole, centroids))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(total.alias("s")).collect()}
    facts = [
        (j, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c)
        for j, c in enumerate(centroids.tolist())
        if j in inertia
    ]
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    return rows.join(F.broadcast(spark.createDataFrame(facts, names)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"
    )
