"""Components of sets linked by Jaccard similarity, without comparing all pairs.

Sets that share a key may be similar; sets that share none are not (or, for hashed
bands, hardly ever). Linking all members of a key pairwise would be quadratic in
families of copies, and only connectivity is wanted. So:

1. every member of a key is compared with the key's hub, the member that shares
   the largest part of its keys with others;
2. keys whose members are then in several components are taken up again, some of the
   keys at a time: every pair of members of different components, in cells of bounded size.

The second step makes the result exact; the first keeps it small. Before a pair is
compared exactly it must pass bounds from the set sizes, from where the shared key
stands in both sets, and from a coarse and a fine parity sketch of both sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.bitmaps import bitmap_of
from harrow.llm.textblocks import binaries, column_of
from harrow.operators.clusters import connected_components
from harrow.session import cut_lineage

SKETCH_WORDS = 4
CELL_ROWS = 2048
_PAIRS_AT_ONCE = 1 << 21
_BITS_AT_ONCE = 1 << 19  # of fine sketches that are made together

# The second step takes up the keys in parts of about so many rows, at most so many: what a part
# shuffles is dropped before the next, and what it links need not be compared in the next.
PART_ROWS = 1 << 20
PARTS = 8


def sketches(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """A 256-bit parity sketch of each set, as one int64 array per word.

    Every value flips one bit, so two sketches differ in at most as many bits as
    the sets differ in values.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    bit = (values >> np.uint64(40)).astype(np.int64) % (64 * SKETCH_WORDS)
    odd = np.bincount(text * 64 * SKETCH_WORDS + bit, minlength=len(counts) * 64 * SKETCH_WORDS) & 1
    packed = np.packbits(odd.astype(np.uint8).reshape(len(counts), -1), axis=1, bitorder="little")
    words = packed.view("<i8").reshape(len(counts), SKETCH_WORDS)
    return [np.ascontiguousarray(words[:, i]) for i in range(SKETCH_WORDS)]


SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
SKETCH_SCHEMA = ", ".join(f"{s} long" for s in SKETCH)


def _largest_difference(size_a: Column, size_b: Column, num: int, den: int) -> Column:
    """How many values two similar sets may differ in."""
    return F.floor((size_a + size_b) * F.lit(den - num) / F.lit(den + num) + F.lit(1e-9))


def _screen(pairs: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that sizes and sketches allow."""
    for side in "ab":
        pairs = pairs.join(
            items.select(F.col("id").alias(side), F.col("size").alias(f"n{side}"), *[F.col(s).alias(f"{side}{s}") for s in SKETCH]),
            side,
        ).where("na * {0} >= nb * {1} and nb * {0} >= na * {1}".format(den, num) if side == "b" else "true")
    differing = sum((F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in SKETCH), F.lit(0))
    return pairs.where(differing <= _largest_difference(F.col("na"), F.col("nb"), num, den)).select("a", "b")


def fine_sketches(values: np.ndarray, counts: np.ndarray, each: int = 4) -> pa.Array:
    """A parity sketch of each set that grows with it: at least `each` bits a value, a power of two."""
    bits = 1 << np.maximum(9 if each > 2 else 8, np.frexp(each * counts.astype(np.float64) - 1)[1]).astype(np.int64)
    to, end = np.cumsum(counts), np.cumsum(bits)
    cuts = np.flatnonzero(np.diff(end // _BITS_AT_ONCE)) + 1
    out = []
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(counts)], strict=True):
        if low < high:
            first = end[low:high] - bits[low:high]
            own = np.repeat(np.arange(high - low), counts[low:high])
            some = (values[to[low] - counts[low] : to[high - 1]] >> np.uint64(20)).astype(np.int64)
            at = (first - first[0])[own] + (some & (bits[low:high] - 1)[own])
            odd = np.bincount(at, minlength=int(end[high - 1] - first[0])) & 1
            out.append(np.packbits(odd.astype(np.uint8), bitorder="little"))
    return binaries(np.concatenate([np.zeros(0, np.uint8), *out]), bits // 8)


class _Fine:
    """The fine sketches of a column, those of one length as the rows of a matrix."""

    def __init__(self, column: pa.Array):
        self.width = pc.binary_length(column).to_numpy()
        self.place = np.empty(len(column), np.int64)
        self.of = {}
        for width in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == width)
            self.place[at] = np.arange(len(at))
            packed = b"".join(column.take(pa.array(at)).to_pylist())
            self.of[width] = np.frombuffer(packed, np.uint64).reshape(len(at), -1)

    def rows(self, width: int, at: np.ndarray) -> np.ndarray:
        return self.of[width][self.place[at]]

    def coarse(self) -> list[np.ndarray]:
        """All sketches folded to SKETCH_WORDS words, one array per word."""
        out = np.empty((SKETCH_WORDS, len(self.width)), np.uint64)
        for width, x in self.of.items():
            while x.shape[1] > SKETCH_WORDS:
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            out[:, self.width == width] = x.T
        return list(out)


def _may_be_similar(a: _Fine, i: np.ndarray, b: _Fine, j: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Whether rows i of a and j of b differ in no more bits than allowed, about 4 MB of sketches at a time."""
    keep = np.zeros(len(i), bool)
    widths = np.column_stack((a.width[i], b.width[j]))
    for wa, wb in np.unique(widths, axis=0).tolist():
        same = np.flatnonzero((widths[:, 0] == wa) & (widths[:, 1] == wb))
        step = (1 << 22) // max(wa, wb) + 1
        for at in (same[n : n + step] for n in range(0, len(same), step)):
            x, y = a.rows(wa, i[at]), b.rows(wb, j[at])
            while x.shape[1] != y.shape[1]:  # fold the longer sketch onto itself
                x, y = (x, y) if x.shape[1] > y.shape[1] else (y, x)
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            keep[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= allowed[at]
    return keep


def _are_similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int(np.count_nonzero(y[at] == x)) if len(y) else 0
    return den * both >= num * (len(x) + len(y) - both)


def _tested(pairs: DataFrame, data: DataFrame, num: int, den: int, fine: bool) -> DataFrame:
    """Pairs (a, b) whose fine sketches allow it (data: id, size, raw), or whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = column_of(batch, "ra"), column_of(batch, "rb")
            if fine:
                allowed = (column_of(batch, "na").to_numpy() + column_of(batch, "nb").to_numpy()) * (den - num) / (den + num) + 1e-9
                every = np.arange(batch.num_rows)
                kept = np.flatnonzero(_may_be_similar(_Fine(left), every, _Fine(right), every, allowed))
            else:
                sets = zip(*([np.frombuffer(v.as_buffer(), np.uint64) for v in c] for c in (left, right)), strict=True)
                kept = [i for i, (x, y) in enumerate(sets) if _are_similar(x, y, num, den)]
            picked = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([column_of(batch, n).take(picked) for n in "ab"], names=["a", "b"])

    for side in "ab":
        pairs = pairs.join(data.select(*[F.col(c).alias(f"{d}{side}") for c, d in (("id", ""), ("size", "n"), ("raw", "r"))]), side)
    return pairs.mapInArrow(run, "a long, b long")


def _whole_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str], limit: int | None = None
) -> Iterator[pa.Table]:
    """Rows sorted by keys, in tables that no group straddles but one of more rows than the limit, which has tables of its own."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = column_of(batch, k).to_numpy(zero_copy_only=False)
            changes[1:] |= v[1:] != v[:-1]
        last = int(np.flatnonzero(changes)[-1]) if changes.any() else 0
        if last == 0:
            waiting.append(batch)
            if len(waiting) > 1:
                before = tuple(column_of(waiting[-2], k)[-1] for k in keys)
                if before != tuple(column_of(batch, k)[0] for k in keys):
                    yield pa.Table.from_batches(waiting[:-1])
                    waiting = [batch]
            if limit is not None and sum(b.num_rows for b in waiting) > limit:
                yield pa.Table.from_batches(waiting)
                waiting = []
            continue
        yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
        waiting = [batch.slice(last)]
    if waiting:
        yield pa.Table.from_batches(waiting)


def _cells(live: DataFrame, labels: DataFrame, items: DataFrame) -> DataFrame:
    """Members of keys that still hold several components, dealt into cells of bounded size.

    The largest component of a key is its major one. Major members meet the minor
    ones, minor members meet each other; two major members never meet. A cell
    holds one block of each side, so minor members of one block meet where they meet
    the major ones. The coarse sketch does not travel beside the fine one, which folds to one.
    """
    told = live.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    per_label = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_keys = (
        per_label.groupBy("key")
        .agg(
            F.max(F.struct("n", "label")).alias("top"),
            F.sum("n").alias("all"),
            F.count(F.lit(1)).alias("labels"),
        )
        .where("labels > 1")
        .select("key", F.col("top.label").alias("major"), F.col("top.n").alias("n_major"), (F.col("all") - F.col("top.n")).alias("n_minor"))
    )

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / F.lit(CELL_ROWS)).cast("long")

    rows = told.join(open_keys, "key").withColumn("minor", F.col("label") != F.col("major"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("minor"), blocks("n_minor")).otherwise(blocks("n_major")))
    to_major = F.sequence(F.lit(0).cast("long"), blocks("n_major") - 1)
    to_minor = F.sequence(F.lit(0).cast("long"), blocks("n_minor") - 1)
    rows = rows.withColumn("own", own).withColumn(
        "cell",
        F.explode(
            F.when(
                F.col("minor"),
                F.concat(
                    F.transform(to_major, lambda i: F.struct(i.alias("x"), F.col("own").alias("y"))),
                    F.transform(
                        F.filter(to_minor, lambda i: i != F.col("own")),
                        lambda i: F.struct((-1 - F.least(F.col("own"), i)).alias("x"), F.greatest(F.col("own"), i).alias("y")),
                    ),
                ),
            ).otherwise(F.transform(to_minor, lambda i: F.struct(F.col("own").alias("x"), i.alias("y"))))
        ),
    )
    rows = rows.select("key", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "id", "label", "pos")
    if "raw" in items.columns:
        items = items.drop(*SKETCH)
    return rows.join(items, "id").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _candidates(cells: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components in the same cell that the bounds allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, ["key", "x", "y"]):
            column = {n: rows.column(n).to_numpy() for n in ("key", "x", "y", "id", "label", "pos", "size")}
            fine = _Fine(rows.column("raw").combine_chunks()) if "raw" in rows.column_names else None
            coarse = fine.coarse() if fine is not None else [rows.column(s).to_numpy() for s in SKETCH]
            n = rows.num_rows
            fresh = np.ones(n, bool)
            fresh[1:] = np.logical_or.reduce([column[k][1:] != column[k][:-1] for k in ("key", "x", "y")])
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            before = np.arange(n) - first  # each row meets the rows of its cell before it
            to = np.cumsum(before)
            at = 0
            while at < n:
                end = max(at + 1, int(np.searchsorted(to, (to[at - 1] if at else 0) + _PAIRS_AT_ONCE, side="right")))
                some = np.arange(at, end)
                left = np.repeat(some, before[some])
                base = np.repeat(to[some] - before[some], before[some])
                right = np.repeat(first[some], before[some]) + np.arange(to[some[0]] - before[some[0]], to[some[-1]]) - base
                keep = column["label"][left] != column["label"][right]
                left, right = left[keep], right[keep]
                na, nb = column["size"][left], column["size"][right]
                allowed = (na + nb) * (den - num) / (den + num) + 1e-9
                keep = np.abs(na - nb) <= allowed
                pa_, pb = column["pos"][left], column["pos"][right]
                together = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
                keep &= (pa_ < 0) | (together * (den + num) + 1e-6 >= num * (na + nb))
                left, right, allowed = left[keep], right[keep], allowed[keep]
                apart = np.zeros(len(left), np.int64)
                for word in coarse:
                    apart += np.bitwise_count(word[left] ^ word[right])
                keep = apart <= allowed
                left, right = left[keep], right[keep]
                if fine is not None:
                    keep = _may_be_similar(fine, left, fine, right, allowed[keep])
                    left, right = left[keep], right[keep]
                a, b = column["id"][left], column["id"][right]
                found = np.unique(np.column_stack((np.minimum(a, b), np.maximum(a, b))), axis=0)
                if len(found):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"]
                    )
                at = end

    return cells.mapInArrow(run, "a long, b long").distinct()


def _labels_of(links: DataFrame) -> DataFrame:
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return cut_lineage(found.select("id", F.col("cluster").alias("label")))


def _closed(
    live: DataFrame, labels: DataFrame, items: DataFrame, num: int, den: int, linked: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The labels (id, label) after the second step, over the members (key, id, pos) of each key."""
    parts = min(live.count() // PART_ROWS + 1, PARTS)
    for part in range(parts):
        some = live.where(F.pmod(F.col("key"), F.lit(parts)) == part)
        more = linked(_candidates(_cells(some, labels, items), num, den))
        if not more.isEmpty():
            stars = labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
            labels = _labels_of(stars.unionByName(more.select("a", "b")))
    return labels


def similar_components(
    postings: Callable[[object], DataFrame],
    items_of: Callable[[DataFrame], DataFrame],
    sets_of: Callable[[DataFrame, bool], DataFrame],
    num: int,
    den: int,
) -> DataFrame:
    """(id, label) of every item that is linked with another; label is the smallest id linked.

    postings gives (key, id, pos, keys), key a 64-bit hash: pos is where the key
    stands in the ordered set (-1: unknown), keys how many postings the item has.
    It is called with None for all rows, and with a bitmap for those whose key may
    be in it. For a frame of ids, items_of gives (id, size, s0..s3) and sets_of
    (id, size, raw): the fine sketch, or the sorted distinct 64-bit values, by its
    second argument. Two items link when den * |intersection| >= num * |union|.
    Empty tables give no rows.
    """
    shared = cut_lineage(postings(None).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    live = cut_lineage(postings(bitmap_of(shared, "key")).join(shared, "key"))
    items = items_of(live.select("id").distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among candidate pairs; sketches and sets are fetched for their ids alone."""
        for fine in (True, False):
            pairs = cut_lineage(pairs)
            if pairs.isEmpty():
                break
            ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
            pairs = _tested(pairs, cut_lineage(sets_of(ids, fine)), num, den, fine)
        return cut_lineage(pairs)

    alive = live.groupBy("id").agg((F.first("keys") - F.count(F.lit(1))).alias("alone"))
    hubs = live.join(alive, "id").groupBy("key").agg(F.min(F.struct("alone", "id")).alias("hub"))
    starred = (
        live.join(hubs, "key")
        .where("id <> hub.id")
        .select(F.least("id", F.col("hub.id")).alias("a"), F.greatest("id", F.col("hub.id")).alias("b"))
        .distinct()
    )
    labels = _labels_of(linked(_screen(starred, items, num, den)))
    return _closed(live, labels, items, num, den, linked)


def hub_components(
    members: DataFrame, items: DataFrame, num: int, den: int, tested: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The components of similar_components where the members of each key are known with its hub.

    members holds (id, size, hub, hub_size, chain) of each member of a key but its hub, chain a
    64-bit name shared by the members of the key that it may be similar to, null if there are none; items
    (id, size, raw), raw the fine sketch, is asked before pairs are given to tested, which gives
    the similar ones as a table. Every member meets the hub in the first step, so the
    second is over the chains alone.
    """

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs)
        return pairs if pairs.isEmpty() else tested(pairs)

    starred = (
        members.where(f"size * {den} >= hub_size * {num} and hub_size * {den} >= size * {num}")
        .select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        .distinct()
    )
    labels = _labels_of(linked(_tested(starred, items, num, den, True)))
    live = members.where("chain is not null").select(F.col("chain").alias("key"), "id", F.lit(-1).alias("pos"))
    return _closed(live, labels, items, num, den, linked)


def grams_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return binaries(values.astype(np.uint64), counts)
