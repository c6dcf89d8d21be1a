"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.session import cut_lineage


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("hi", "lo")).alias("x"),
        F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["x"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour moves to the smallest one in the neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(smallest, "u")
    return moved.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    smallest = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    others = edges.join(smallest, "hi").filter("lo > m")
    return (
        others.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .unionByName(smallest.select("hi", F.col("m").alias("lo")))
        .distinct()
    )


def connected_components(links: DataFrame) -> DataFrame:
    """(id, cluster) of every linked id; the cluster is the smallest id in it.

    links holds (u, v). Star contraction: each round is two grouped minima and
    two joins, and the number of rounds grows with the logarithm of the longest
    chain. Each round is written to the shared folder. Labels only get smaller,
    so the rounds come to an end by themselves.
    """
    edges = cut_lineage(
        links.filter("u <> v")
        .select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
        .distinct()
    )
    before = _fingerprint(edges)
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)))
        after = _fingerprint(edges)
        if after == before:
            roots = edges.select(F.col("lo").alias("id")).distinct()
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("cluster")).unionByName(
                roots.select("id", F.col("id").alias("cluster"))
            )
        before = after


def with_clusters(df: DataFrame, key: str, links: DataFrame, column: str = "cluster") -> DataFrame:
    """Rows with their cluster id; a row without links is its own cluster."""
    found = connected_components(links).select(
        F.col("id").alias("_id"), F.col("cluster").alias("_cluster")
    )
    return (
        df.join(found, F.col(key) == F.col("_id"), "left")
        .withColumn(column, F.coalesce("_cluster", F.col(key)))
        .drop("_id", "_cluster")
    )
