"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

The graph starts from neighbours inside small random cells. Each round of
NN-descent joins every node's neighbours, in both directions, with one another
and keeps each node's nearest; a pair meets over a node once, when one of its links
there is new. What a search follows is that graph pruned: of a node's neighbours
those that no nearer one covers, in both directions, a bounded number. A search
keeps a fixed number of the nearest nodes met so far and goes on from those it has
not expanded, until all are, so what it meets does not grow with the table. A
query is a row of the table and starts from its own node. Nearness is the Euclidean
distance in double precision.

Equal vectors are one node of the graph; their rows come back in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.llm.jaccard import _whole_groups
from harrow.llm.textblocks import column_of
from harrow.session import cut_lineage

DEGREE = 24  # neighbours kept while the graph is built
TABLES = 8
CELL = 96
FRESH = 10  # new links of a node, each way, that meet the others in a round; the rest stay new
LINKS = 24  # links of the pruned graph, each way
COVERED = 1.2  # a neighbour goes if a nearer one is this many times nearer to it than the node
BEAM = 256  # nodes a search keeps
SETTLED = 0.005  # NN-descent ends when fewer links than this share are new
ROUNDS = 10


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part.

    Null vectors, zero vectors and those with a null or non-finite component take
    none, nor do those of another length than most (of equal counts, the shorter).
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null and size(embedding) > 0 "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(embedding, x -> x <> 0)"
    )
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("embedding") == (common[0]["n"] if common else 0))


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups in tables, with where each group begins and the last ends."""
    for rows in _whole_groups(batches, keys):
        rows = rows.combine_chunks()
        n = rows.num_rows
        fresh = np.ones(n, bool)
        columns = [rows.column(k).to_numpy() for k in keys]
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        yield rows, np.append(np.flatnonzero(fresh), n)


def _nearest(links: DataFrame, degree: int) -> DataFrame:
    """The nearest `degree` links of each node, once each; of equal distances the smaller id.

    A link is new only where every row of it is.
    """
    order = Window.partitionBy("node").orderBy("d", "to")
    once = links.groupBy("node", "to").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= degree).drop("r")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _first_links(nodes: DataFrame, count: int, degree: int) -> DataFrame:
    """Links inside random cells: signs of random projections, cells of about CELL nodes."""
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / CELL))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(column_of(batch, "v"))
            draw = np.random.default_rng(99)
            for t in range(TABLES):
                planes = draw.normal(size=(points.shape[1], max(bits, 1)))
                code = ((points @ planes > 0) @ (1 << np.arange(max(bits, 1)))) if bits else np.zeros(len(points), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [column_of(batch, "node"), column_of(batch, "v"), pa.array(np.full(len(points), t)), pa.array(code.astype(np.int64))],
                    names=["node", "v", "t", "code"],
                )

    placed = nodes.mapInArrow(place, "node long, v array<double>, t long, code long")
    sizes = placed.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n"))
    cut = F.ceil(F.col("n") / F.lit(4 * CELL))  # a full cell is dealt into several at random
    dealt = placed.join(sizes, ["t", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "t"), cut)).drop("n")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _groups(batches, ["t", "code", "part"]):
            ids, points = rows.column("node").to_numpy(), _matrix(rows.column("v"))
            found = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                d = _distances(points[a:b], points[a:b])
                np.fill_diagonal(d, np.inf)
                k = min(degree // 2, b - a - 1)
                if k > 0:
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    found.append((np.repeat(ids[a:b], k), ids[a:b][near].ravel(), np.take_along_axis(d, near, 1).ravel()))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["node", "to", "d"]
                )

    dealt = dealt.repartition("t", "code", "part").sortWithinPartitions("t", "code", "part")
    links = dealt.mapInArrow(link, "node long, to long, d double").withColumn("new", F.lit(True))
    return _nearest(links, degree)


def _around(graph: DataFrame, degree: int) -> tuple[DataFrame, DataFrame]:
    """(at, node, new): who meets over each node in this round; and the graph with those links old."""
    first = Window.partitionBy("node", "new").orderBy("d", "to")
    chosen = F.col("new") & (F.row_number().over(first) <= FRESH)
    marked = cut_lineage(graph.withColumn("chosen", chosen))
    there = marked.where("chosen or not new")
    back = Window.partitionBy("to", "chosen").orderBy("d", "node")
    limit = F.when(F.col("chosen"), FRESH).otherwise(degree)
    reverse = there.withColumn("r", F.row_number().over(back)).where(F.col("r") <= limit)
    around = (
        there.select(F.col("node").alias("at"), F.col("to").alias("node"), "chosen")
        .unionByName(reverse.select(F.col("to").alias("at"), "node", "chosen"))
        .unionByName(there.select(F.col("node").alias("at"), "node", F.lit(False).alias("chosen")).distinct())
    )
    # a neighbour both ways is new if one of its links is
    around = around.groupBy("at", "node").agg(F.max("chosen").alias("new"))
    return around, marked.select("node", "to", "d", (F.col("new") & ~F.col("chosen")).alias("new"))


def _local_join(nodes: DataFrame, graph: DataFrame, around: DataFrame, degree: int) -> DataFrame:
    """Links that join two neighbours of one node, at least one of them new there, and beat what either has."""
    bound = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= degree, F.max("d")).otherwise(F.lit(float("inf"))).alias("far"))
    told = nodes.join(bound, "node", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    rows = around.join(told, "node").repartition("at").sortWithinPartitions("at")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _groups(batches, ["at"]):
            ids, far = table.column("node").to_numpy(), table.column("far").to_numpy()
            new = table.column("new").to_numpy(zero_copy_only=False)
            points = _matrix(table.column("v"))
            found = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                d = _distances(points[a:b], points[a:b])
                np.fill_diagonal(d, np.inf)
                fresh = new[a:b]
                row, col = np.nonzero((d < far[a:b, None]) & (fresh[:, None] | fresh[None, :]))
                found.append((ids[a:b][row], ids[a:b][col], d[row, col]))
            if found:
                node, to, d = (np.concatenate(c) for c in zip(*found, strict=True))
                # over the nodes of this batch, a pair once and each node's best
                order = np.lexsort((d, to, node))
                once = np.ones(len(order), bool)
                once[1:] = (node[order][1:] != node[order][:-1]) | (to[order][1:] != to[order][:-1])
                order = order[once]
                order = order[np.lexsort((d[order], node[order]))]
                begin = np.flatnonzero(np.append(True, node[order][1:] != node[order][:-1])) if len(order) else order
                rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
                order = order[rank < degree]
                yield pa.RecordBatch.from_arrays([pa.array(c[order]) for c in (node, to, d)], names=["node", "to", "d"])

    return rows.mapInArrow(join, "node long, to long, d double").withColumn("new", F.lit(True))


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(node, to, d): each node's nearest found, by NN-descent; nodes holds (node, v array<double>)."""
    count = nodes.count()
    graph = cut_lineage(_first_links(nodes, count, degree))
    for _ in range(ROUNDS):
        around, met = _around(graph, degree)
        graph = cut_lineage(_nearest(met.unionByName(_local_join(nodes, met, around, degree)), degree))
        if graph.where("new").count() <= SETTLED * degree * count:
            break
    return graph.select("node", "to", "d")


def pruned(nodes: DataFrame, graph: DataFrame, links: int = LINKS) -> DataFrame:
    """(node, to): the links a search follows, at most twice `links` of a node.

    From near to far, a neighbour is kept unless one kept before it is nearer to it than
    the node is, COVERED times. A node that many keep takes the nearest of them back.
    """
    both = graph.select(F.col("node").alias("at"), F.col("to").alias("node"))
    selves = graph.select(F.col("node").alias("at"), "node").distinct()
    rows = both.unionByName(selves).join(nodes, "node").repartition("at").sortWithinPartitions("at")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _groups(batches, ["at"]):
            at, ids = table.column("at").to_numpy(), table.column("node").to_numpy()
            points = _matrix(table.column("v"))
            found = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                d = _distances(points[a:b], points[a:b])
                own = int(np.flatnonzero(ids[a:b] == at[a])[0])
                kept: list[int] = []
                for i in np.lexsort((ids[a:b], d[own])).tolist():
                    if i != own and (COVERED * d[i, kept] > d[own, i]).all():
                        kept.append(i)
                        if len(kept) == links:
                            break
                found.append((np.full(len(kept), at[a]), ids[a:b][kept], d[own, kept]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["node", "to", "d"]
                )

    kept = cut_lineage(rows.mapInArrow(choose, "node long, to long, d double"))
    back = Window.partitionBy("to").orderBy("d", "node")
    reverse = kept.withColumn("r", F.row_number().over(back)).where(F.col("r") <= links)
    return cut_lineage(
        kept.select("node", "to").unionByName(reverse.select(F.col("to").alias("node"), F.col("node").alias("to"))).distinct()
    )


def greedy_search(nodes: DataFrame, links: DataFrame, queries: DataFrame, entries: DataFrame, beam: int = BEAM) -> DataFrame:
    """(query, node): the `beam` nearest nodes met by each query, going along the links from its entries.

    queries holds (query, q array<double>), entries (query, node), links (node, to).
    Ends when every node kept is expanded.
    """
    nearest = Window.partitionBy("query").orderBy("d", "node")
    gap = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes, "node").join(queries, "query").select("query", "node", gap.alias("d"))

    def best(met: DataFrame) -> DataFrame:
        return cut_lineage(met.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= beam).drop("r"))

    # what is left out of the beam never comes back, and is known only so that it is not measured again
    known = cut_lineage(measured(entries.distinct()))
    kept, met = best(known.withColumn("done", F.lit(False))), known.select("query", "node")
    while True:
        fresh = kept.where(~F.col("done"))
        if fresh.isEmpty():
            return kept.select("query", "node")
        steps = fresh.select("query", "node").join(links, "node").select("query", F.col("to").alias("node")).distinct()
        new = cut_lineage(measured(steps.join(met, ["query", "node"], "left_anti")))
        met = met.unionByName(new.select("query", "node"))
        kept = best(kept.withColumn("done", F.lit(True)).unionByName(new.withColumn("done", F.lit(False))))


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`.

    All usable rows are indexed and all but the query's own are candidates; fewer
    than k if there are fewer. Nearest first, of equal distances the smaller
    vec_id. Rows of equal vec_id are one row if their vectors are equal.
    """
    rows = cut_lineage(usable(vectors).distinct())
    # a node is a vector, whatever the ids of its rows
    equal = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"))
    equal = cut_lineage(equal.select("embedding", F.monotonically_increasing_id().alias("node")))
    keyed = cut_lineage(rows.join(equal, "embedding").select("vec_id", "embedding", "node"))
    nodes = equal.select("node", F.col("embedding").alias("v"))
    queries = keyed.where(F.col("vec_id") % every == 0)
    sought = cut_lineage(queries.select(F.col("node").alias("query"), F.col("embedding").alias("q")).dropDuplicates(["query"]))
    links = pruned(nodes, neighbour_graph(nodes))
    found = greedy_search(nodes, links, sought, sought.select("query", F.col("query").alias("node")))
    # of equal vectors only the first k + 1 rows can be among k results
    lowest = Window.partitionBy("node").orderBy("vec_id")
    members = keyed.withColumn("m", F.row_number().over(lowest)).where(F.col("m") <= k + 1).select("node", "vec_id", "embedding")
    asked = queries.select(F.col("vec_id").alias("asked"), F.col("node").alias("query"), F.col("embedding").alias("q"))
    pairs = found.join(members, "node").join(asked, "query").where("vec_id <> asked").drop("query").withColumnRenamed("asked", "query")
    score = F.sqrt(F.aggregate(F.zip_with("q", "embedding", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    ranked = pairs.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
