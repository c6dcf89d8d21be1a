"""Documents that share most of their word n-grams: an exact Jaccard join with rare-first prefixes.

A document's n-grams are ordered from rare to frequent. Two documents as similar
as asked share an n-gram among the first few of both, so only those are joined.
Documents with equal sets are one class and are joined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.bitmaps import bitmap_of, hits
from harrow.llm.jaccard import SKETCH, SKETCH_SCHEMA, fine_sketches, grams_column, similar_components, sketches
from harrow.llm.textblocks import column_of, distinct, mixed, pieces, shingles, utf8, word_hashes
from harrow.session import cut_lineage

# N-grams are counted by hash in a table of this many counters: a fixed size whatever the input.
COUNTERS = 1 << 18
_BLOCK = 1 << 12


def gram_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, sorted by hash, and how many each text has."""
    return distinct(*shingles(*word_hashes(*utf8(column)), width))


def _set_digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    edges = np.concatenate(([0], np.cumsum(counts)))
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values + np.uint64(salt)))))
        out.append((sums[edges[1:]] - sums[edges[:-1]]).astype(np.int64))
    return out[0], out[1]


def _slot(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(COUNTERS - 1)).astype(np.int64)


def gram_counts(docs: DataFrame, width: int) -> np.ndarray:
    """In how many documents n-grams of each counter occur, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for piece in pieces(batches):
            total += np.bincount(_slot(gram_sets(column_of(piece, "text"), width)[0]), minlength=COUNTERS)
        for at in range(0, COUNTERS, _BLOCK):
            part = total[at : at + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": [at], "part": [part.tolist()]})

    parts = docs.select("text").mapInArrow(count, "block long, part array<long>")
    # added up cell by cell, with partial sums in each task
    cells = parts.select("block", F.posexplode("part").alias("i", "n")).groupBy("block", "i").agg(F.sum("n").alias("n"))
    rows = cells.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("cells"))
    out = np.zeros(COUNTERS, np.int64)
    for row in rows.select("block", "cells.n").collect():
        out[row["block"] : row["block"] + len(row["n"])] = row["n"]
    return out


def _described(docs: DataFrame, width: int, counts: np.ndarray, num: int, den: int) -> DataFrame:
    """Per row of docs: set size, digests, sketch, and the n-grams of its prefix, rare first."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            values, sizes = gram_sets(column_of(piece, "text"), width)
            text = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, shared.value[_slot(values)], text))
            rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prefix = np.where(sizes > 0, sizes - -(-num * sizes // den) + 1, 0)
            first = order[rank < prefix[text]]
            d1, d2 = _set_digests(values, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(piece, "doc_id"),
                    *map(pa.array, (sizes, d1, d2, *sketches(values, sizes))),
                    grams_column(values[first], prefix),
                ],
                names=["doc_id", "size", "d1", "d2", *SKETCH, "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id long, size long, d1 long, d2 long, {SKETCH_SCHEMA}, prefix binary"
    )


def _postings(classes: DataFrame, bitmap) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                raw = [v.as_buffer() for v in column_of(some, "prefix")]
                sizes = np.array([len(r) // 8 for r in raw], np.int64)
                keys = np.frombuffer(b"".join(raw), np.int64)
                ids = np.repeat(column_of(some, "id").to_numpy(), sizes)
                pos = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [keys, ids, pos.astype(np.int32), np.repeat(sizes, sizes).astype(np.int32)]
                if bitmap is not None:
                    columns = [c[hits(bitmap.value, keys)] for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns],
                    names=["key", "id", "pos", "keys"],
                )

    return classes.select("id", "prefix").mapInArrow(run, "key long, id long, pos int, keys int")


def ngram_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text).

    Words are lower-cased in A-Z and split at 0x20 and 0x09 to 0x0D. Rows link when
    den * |intersection| >= num * |union| of their distinct n-grams; component_id
    is the smallest doc_id reachable by links. A text of fewer words is one n-gram.
    A null or empty text, or one without words, has no n-gram and no link. Rows of
    equal doc_id are told apart by their texts; a null doc_id names no component
    that has another. Sets are compared by 64-bit hashes of their n-grams.
    """
    docs = docs.select("doc_id", "text")
    described = cut_lineage(_described(docs, width, gram_counts(docs, width), num, den))
    full = described.where("size > 0")
    classes = cut_lineage(
        full.groupBy("d1", "d2", "size")
        .agg(F.min("doc_id").alias("first_doc"), *[F.first(c).alias(c) for c in (*SKETCH, "prefix")])
        .withColumn("id", F.monotonically_increasing_id())
    )

    def sets_of(ids: DataFrame, fine: bool) -> DataFrame:
        wanted = cut_lineage(classes.join(ids, "id", "left_semi").select("id", "d1", "d2", "size", "first_doc"))
        one_of = F.xxhash64("first_doc")
        known = bitmap_of(wanted.select(one_of.alias("h")), "h")
        rows = docs.select(F.xxhash64("doc_id").alias("h"), "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                named = batch.filter(pa.array(hits(known.value, column_of(batch, "h").to_numpy())))
                for piece in pieces([named]):
                    values, sizes = gram_sets(column_of(piece, "text"), width)
                    d1, d2 = _set_digests(values, sizes)
                    raw = fine_sketches(values, sizes) if fine else grams_column(values, sizes)
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, (d1, d2, sizes)), raw], names=["d1", "d2", "size", "raw"]
                    )

        found = rows.mapInArrow(run, "d1 long, d2 long, size long, raw binary")
        return found.dropDuplicates(["d1", "d2", "size"]).join(wanted, ["d1", "d2", "size"]).select("id", "size", "raw")

    def items_of(ids: DataFrame) -> DataFrame:
        return cut_lineage(classes.select("id", "size", *SKETCH).join(ids, "id", "left_semi"))

    labels = cut_lineage(similar_components(lambda bitmap: _postings(classes, bitmap), items_of, sets_of, num, den))
    named = classes.select("id", "first_doc", "d1", "d2", "size").join(labels, "id", "left")
    named = named.withColumn("label", F.coalesce("label", "id"))
    smallest = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = named.join(smallest, "label").select("d1", "d2", "size", "component_id")
    linked = full.select("doc_id", "d1", "d2", "size").join(named, ["d1", "d2", "size"])
    alone = described.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return (
        linked.select("doc_id", "size", "component_id").unionByName(alone).withColumnRenamed("size", "n_shingles")
    )
