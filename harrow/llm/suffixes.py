"""Removal of long byte strings that an earlier document holds too, by suffix sorting.

Every string of WINDOW bytes has an anchor, the run of GRAM bytes in it with the
least hash. Equal strings have equal anchors, so strings are brought together by
the hash of their anchor; the strings of one anchor overlap and travel as one
stretch of text. Stretches whose anchor, with the bytes on either side, occurs in
one document only are left out beforehand. Stretches of an anchor that is in very
many are split into their windows, which are brought together one by one; equal
ones are counted together before they travel. For the others, a task sorts the suffixes of its stretches in two stages: suffixes
smaller than their successors are sorted directly, all others are induced from
them by scans over the buckets of first bytes. Neighbours in that order with a
common prefix of WINDOW bytes are equal strings.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.bitmaps import bitmap_of, hits
from harrow.llm.jaccard import _whole_groups
from harrow.llm.textblocks import binaries, column_of, mixed, pieces, utf8
from harrow.session import cut_lineage

WINDOW = 50
GRAM = 14
SIDE = 16  # at most (WINDOW - GRAM) / 2
_SPAN = WINDOW - GRAM + 1  # anchors a window can have
_SIDE_BITS = 16
_KEY_BITS = 32 + _SIDE_BITS
_KEY_BLOCK = 4 << 20  # bytes of text whose keys make a block, about
_KEYS_AT_ONCE = 4 << 20
BITS_MOST = 30  # 128 MB of bitmap
_ALL = -1  # in place of runs: the whole text
_PLACE = np.uint64(30)
_BLOCK_BYTES = 2 << 20
HOT_ROWS = 50_000  # an anchor counted more often, by its shared sides, is dealt out by window


def stretches(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first window, last window, anchor place and anchor hash of every run of windows with one anchor."""
    n = len(data) - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none, none.astype(np.uint64)
    grams = np.zeros(n, np.uint64)
    low = np.concatenate((data, np.zeros(16, np.uint8))).astype(np.uint64)
    two = low[:-1] | low[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    grams = mixed(mixed(eight[:n]) + eight[GRAM - 8 : GRAM - 8 + n])
    ranked = (grams >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)
    least, width = ranked, 1
    while 2 * width <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _SPAN:
        rest = _SPAN - width
        least = np.minimum(least[: len(least) - rest], least[rest:])
    anchor = (least & np.uint64((1 << 30) - 1)).astype(np.int64)  # of the window beginning at each byte
    sizes = np.diff(starts)
    per_text = np.maximum(sizes - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(sizes)), per_text)
    window = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + np.repeat(starts[:-1], per_text)
    if not len(window):
        return none, none, none, none, none.astype(np.uint64)
    own = anchor[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(window)) - 1
    return text[first], window[first], window[last], own[first], grams[own[first]]


def _take(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several spans one after another."""
    return data[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the suffix that begins one later; the last is."""
    out = np.ones(len(text), bool)
    if len(text) > 1:
        change = np.flatnonzero(text[1:] != text[:-1])  # last place of each run of equal bytes
        place = np.searchsorted(change, np.arange(len(text)))
        known = place < len(change)
        at = change[place[known]]
        out[known] = text[at] < text[at + 1]
    return out


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that orders like them."""
    padded = np.concatenate((text, np.zeros(WINDOW + 16, np.uint8))).astype(np.uint64)
    two = padded[:-1] << np.uint64(8) | padded[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    return four[:-4] << np.uint64(32) | four[4:]


def _sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the bytes from there on, as far as depth."""
    order = np.argsort(words[places], kind="stable")
    places = places[order]
    key = words[places]
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    for at in range(8, depth, 8):
        alike = np.zeros(len(places), bool)
        same = group[1:] == group[:-1]
        alike[1:] |= same
        alike[:-1] |= same
        some = np.flatnonzero(alike)
        if not len(some):
            break
        key = words[places[some] + at]
        order = np.lexsort((key, group[some]))
        places[some] = places[some][order]
        key = key[order]
        fresh = np.zeros(len(places), bool)
        fresh[1:] = ~same
        fresh[some[1:]] |= key[1:] != key[:-1]
        group = np.cumsum(fresh)
    return places


def suffix_order(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """All suffixes of a text ordered by their first `depth` bytes at least, in two stages.

    The text ends with a byte smaller than any before it but for separators. Place order decides between suffixes that are alike as far as they were compared.
    """
    small = _smaller_than_next(text)
    direct = _sorted_directly(np.flatnonzero(small), _words(text), depth)
    heads = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        part = waiting[byte]
        fresh = np.concatenate(part) if part else np.zeros(0, np.int64)
        mine = direct[heads[byte] : heads[byte + 1]]
        while len(fresh):
            out.append(fresh)
            fresh = _induce(fresh, text, small, waiting, byte)
        if len(mine):
            out.append(mine)
            _induce(mine, text, small, waiting, byte)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _induce(done: np.ndarray, text: np.ndarray, small: np.ndarray, waiting: list, byte: int) -> np.ndarray:
    """Put the larger predecessors of ordered suffixes behind their buckets; those of this very bucket are returned."""
    before = done[done > 0] - 1
    before = before[~small[before]]
    if not len(before):
        return before
    first = text[before]
    order = np.argsort(first, kind="stable")
    before, first = before[order], first[order]
    cuts = np.flatnonzero(np.diff(first)) + 1
    here = before[:0]
    for chunk, head in zip(np.split(before, cuts), first[np.concatenate(([0], cuts))].tolist(), strict=True):
        if head == byte:
            here = chunk
        else:
            waiting[head].append(chunk)
    return here


def first_holders(texts: np.ndarray, sizes: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every stretch, the least holder of an equal window; and windows per stretch.

    texts holds the bytes of all stretches, of the given sizes (WINDOW at least).
    """
    apart = np.zeros(len(texts) + len(sizes), np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    where = np.arange(len(texts)) + np.repeat(np.arange(len(sizes)), sizes)
    apart[where] = texts + np.uint8(1)  # no byte of a text is 0xFF, and 0 ends a stretch
    order = suffix_order(apart)
    many = sizes - WINDOW + 1
    number = np.full(len(apart), -1, np.int64)
    place = np.repeat(begins - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    number[place] = np.arange(len(place))
    order = order[number[order] >= 0]
    words = _words(apart)
    alike = np.ones(max(len(order) - 1, 0), bool)
    for at in range(0, WINDOW, 8):
        drop = np.uint64(8 * max(0, at + 8 - WINDOW))
        some = np.flatnonzero(alike)
        alike[some] = (words[order[some] + at] >> drop) == (words[order[some + 1] + at] >> drop)
    fresh = np.flatnonzero(np.concatenate(([True], ~alike))) if len(order) else np.zeros(0, np.int64)
    held = np.repeat(holders, many)[number[order]]
    out = np.empty(len(order), np.int64)
    if len(order):
        out[number[order]] = np.repeat(np.minimum.reduceat(held, fresh), np.diff(np.append(fresh, len(order))))
    return out, many


def side_keys(data: np.ndarray, starts: np.ndarray, text: np.ndarray, at: np.ndarray, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two keys of each anchor, with the SIDE bytes before it and with those after it; and where there are such.

    Two equal windows agree on GRAM bytes and on WINDOW - GRAM around them, so on
    SIDE bytes on one side at least. The upper 32 bits of a key are the anchor's, the 16
    below them those of the side.
    """
    words = np.concatenate((np.zeros(2 * 8, np.uint64), _words(data)))  # place p is at p + 16
    # an anchor is the least hash around, so its first bits are mixed once more
    own = mixed(anchors) >> np.uint64(32) << np.uint64(_SIDE_BITS)
    out = []
    for ahead in (False, True):
        here = at + GRAM if ahead else at - SIDE
        inside = (here + SIDE <= starts[1:][text]) if ahead else (here >= starts[:-1][text])
        here = np.where(inside, here, 0)
        mark = mixed(mixed(words[here + 16] + np.uint64(ahead + 1)) ^ words[here + 24])
        out.append((own | mark >> np.uint64(64 - _SIDE_BITS), inside))
    return out


def _bit_of(keys: np.ndarray, bits: int, blocks: int) -> np.ndarray:
    """The bit of each key in a bitmap of 2^bits, in the slice of its block (the first bits of its anchor) by hash."""
    inside = mixed(keys) >> np.uint64(64 - (bits - blocks))
    return (keys >> np.uint64(_KEY_BITS - blocks) << np.uint64(bits - blocks) | inside).astype(np.int64)


class Shared:
    """Which side keys occur in several documents, as a bitmap, and which anchors are hot.

    The bitmap travels as the compressed slices of its blocks and is laid out where it
    is first asked; the driver only hands the slices on.
    """

    def __init__(self, bits: int, blocks: int, slices: dict[int, bytes], hot: list[int]):
        self.bits, self.blocks = bits, blocks  # as powers of two
        self.slices = slices
        self.hot = np.array(sorted(hot), np.uint64)

    @functools.cached_property
    def whole(self) -> np.ndarray:
        out = np.zeros(1 << (self.bits - 3), np.uint8)
        size = 1 << (self.bits - self.blocks - 3)
        for block, packed in self.slices.items():
            out[block * size : (block + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = _bit_of(keys, self.bits, self.blocks)
        return (self.whole[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1

    def is_hot(self, anchors: np.ndarray) -> np.ndarray:
        return np.isin(mixed(anchors) >> np.uint64(32), self.hot)


def _five(keys: np.ndarray) -> np.ndarray:
    """The lower 40 bits of each key as five bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).ravel()


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its counts added up."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _shared_keys(rows: DataFrame, known, n_bytes: int) -> Shared:
    """The side keys that occur in several documents, and the hot anchors.

    Tasks send their keys sorted, five bytes each, in blocks by the anchor's first bits;
    a block is added up in one task and comes back as a slice of the bitmap, compressed. The
    number of blocks and the size of the bitmap follow the bytes of all texts (the
    bitmap up to BITS_MOST, beyond which more stretches travel than need to).
    """
    blocks = min(24, max(8, (n_bytes // _KEY_BLOCK).bit_length()))
    bits = min(BITS_MOST, max(blocks + 12, n_bytes.bit_length()))
    low = _KEY_BITS - blocks  # at most 40
    slice_bytes = 1 << (bits - blocks - 3)

    def send(keys: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        key, n = _summed(np.concatenate(keys), np.concatenate(counts))
        block = (key >> np.uint64(low)).astype(np.int64)
        out: dict[str, list] = {"block": [], "once": [], "more": [], "n": []}
        edge = np.flatnonzero(np.diff(block, prepend=-1))
        for x, y in zip(edge.tolist(), np.append(edge[1:], len(block)).tolist(), strict=True):
            one = n[x:y] == 1
            out["block"].append(int(block[x]))
            out["once"].append(_five(key[x:y][one]).tobytes())
            out["more"].append(_five(key[x:y][~one]).tobytes())
            out["n"].append(n[x:y][~one].astype("<u4").tobytes())
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64() if c == "block" else pa.binary()) for c, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for piece in _wanted(batches, known):
            data, starts = utf8(column_of(piece, "text"))
            text, _, _, at, anchors = stretches(data, starts)
            if not len(anchors):
                continue
            # a document counts once for a key; the rows of this piece are told apart by place
            sides = side_keys(data, starts, text, at, anchors)
            both = np.concatenate([k[inside] for k, inside in sides])
            owner = np.concatenate([text[inside] for _, inside in sides])
            order = np.lexsort((owner, both))
            both, owner = both[order], owner[order]
            own = np.ones(len(both), bool)
            own[1:] = (both[1:] != both[:-1]) | (owner[1:] != owner[:-1])
            found, many = np.unique(both[own], return_counts=True)
            keys.append(found)
            counts.append(many)
            if sum(map(len, keys)) > _KEYS_AT_ONCE:
                yield send(keys, counts)
                keys, counts = [], []
        if keys:
            yield send(keys, counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _whole_groups(batches, ["block"]):
            block = group.column("block").to_numpy()
            edge = np.flatnonzero(np.diff(block, prepend=-1))
            for x, y in zip(edge.tolist(), np.append(edge[1:], len(block)).tolist(), strict=True):
                part = group.slice(x, y - x)
                once = _from_five(b"".join(part.column("once").to_pylist()))
                more = _from_five(b"".join(part.column("more").to_pylist()))
                n = np.frombuffer(b"".join(part.column("n").to_pylist()), "<u4").astype(np.int64)
                top = np.uint64(int(block[x])) << np.uint64(low)
                inside = np.uint64((1 << low) - 1)
                key, n = _summed(np.concatenate((once, more)) & inside | top, np.concatenate((np.ones(len(once), np.int64), n)))
                key, n = key[n > 1], n[n > 1]
                slots = np.zeros(slice_bytes * 8, np.uint8)
                slots[_bit_of(key, bits, blocks) & (slice_bytes * 8 - 1)] = 1
                anchor, total = _summed(key >> np.uint64(_SIDE_BITS), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(block[x])]),
                        pa.array([zlib.compress(np.packbits(slots, bitorder="little").tobytes(), 1)], pa.binary()),
                        pa.array([anchor[total > HOT_ROWS].astype(np.int64)], pa.list_(pa.int64())),
                    ],
                    names=["block", "bits", "hot"],
                )

    sent = rows.select("doc_id", "t", "text").mapInArrow(run, "block long, once binary, more binary, n binary")
    slices = sent.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, bits binary, hot array<long>")
    found = slices.collect()  # the bitmap: 2^BITS_MOST bits at most
    return Shared(bits, blocks, {r["block"]: bytes(r["bits"]) for r in found}, [a for r in found for a in r["hot"]])


def _wanted(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    """Pieces of the rows that may be the first of their text; others are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = column_of(batch, "doc_id").to_numpy().view(np.uint64)
        h = mixed(mixed(ids) ^ column_of(batch, "t").to_numpy().view(np.uint64)).view(np.int64)
        yield from pieces([batch.filter(pa.array(hits(known.value, h)))])


def _shared_stretches(rows: DataFrame, known, shared, hot: bool) -> DataFrame:
    """Stretches whose anchor may be shared: anchor, bytes, and who holds them where.

    Those of hot anchors, or all others. Equal stretches of one piece of input are one
    row, whatever their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _wanted(batches, known):
            data, starts = utf8(column_of(piece, "text"))
            text, first, last, at, keys = stretches(data, starts)
            if not len(keys):
                continue
            keep = shared.value.is_hot(keys) == hot
            may = np.zeros(len(keys), bool)
            for side, inside in side_keys(data, starts, text, at, keys):
                may |= inside & shared.value.has(side)
            keep &= may
            text, first, last, keys = text[keep], first[keep], last[keep], keys[keep]
            if not len(keys):
                continue
            sizes = last - first + WINDOW
            body = _take(data, first, sizes)
            to = np.cumsum(sizes)
            raw = body.tobytes()
            seen: dict[bytes, int] = {}
            which = np.array(
                [seen.setdefault(raw[a:b], len(seen)) for a, b in zip((to - sizes).tolist(), to.tolist(), strict=True)], np.int64
            )
            order = np.argsort(which, kind="stable")
            edge = np.flatnonzero(np.diff(which[order], prepend=-1))
            many = np.diff(np.append(edge, len(order)))
            lead = order[edge]
            held = np.empty((len(order), 3), np.int64)
            held[:, 0] = column_of(piece, "doc_id").to_numpy()[text[order]]
            held[:, 1] = column_of(piece, "t").to_numpy()[text[order]]
            held[:, 2] = first[order] - starts[text[order]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[lead].view(np.int64)),
                    binaries(_take(body, (to - sizes)[lead], sizes[lead]), sizes[lead]),
                    binaries(held.ravel(), 3 * many),
                ],
                names=["key", "body", "held"],
            )

    return rows.select("doc_id", "t", "text").mapInArrow(run, "key long, body binary, held binary")


def _runs(least: np.ndarray, many: np.ndarray, owner: np.ndarray, who: np.ndarray) -> pa.RecordBatch | None:
    """The runs of windows that a document earlier than their holder has.

    least is the first document of each window, many the windows of each stretch;
    who are holders (document, text, place), owner the stretch of each.
    """
    begins = np.cumsum(many) - many
    # occurrences whose document is later than some holder of a window of theirs
    lowest = np.minimum.reduceat(least, begins)
    late = lowest[owner] < who[:, 0]
    who, owner = who[late], owner[late]
    if not len(owner):
        return None
    count = many[owner]
    row = np.repeat(np.arange(len(owner)), count)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    gone = least[begins[owner][row] + offset] < who[row, 0]
    row, offset = row[gone], offset[gone]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(row)))
    row, offset = row[at], offset[at]
    return pa.RecordBatch.from_arrays(
        [pa.array(who[row, 0].copy()), pa.array(who[row, 1].copy()), pa.array((who[row, 2] + offset) * 256 + length)],
        names=["doc_id", "t", "run"],
    )


def _windows(spans: DataFrame, known=None) -> DataFrame:
    """Every window of stretches (sid, body, held): its bytes, a hash of them, where it is, its first and last holder.

    With a bitmap of hashes, only windows that may be in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "body"):
            data, starts = utf8(column_of(piece, "body"))
            many = np.diff(starts) - WINDOW + 1
            sid = np.repeat(np.arange(len(many)), many)
            off = np.arange(len(sid)) - np.repeat(np.cumsum(many) - many, many)
            place = starts[:-1][sid] + off
            words = _words(data)
            h = np.zeros(len(place), np.uint64)
            for at in range(0, WINDOW, 8):
                h = mixed(h ^ words[place + at] >> np.uint64(8 * max(0, at + 8 - WINDOW)))
            if known is not None:
                keep = hits(known.value, h.view(np.int64))
                sid, off, place, h = sid[keep], off[keep], place[keep], h[keep]
            if not len(place):
                continue
            who = [np.frombuffer(x.as_buffer(), np.int64)[::3] for x in column_of(piece, "held")]
            least, most = (np.array([f(w) for w in who], np.int64) for f in (np.min, np.max))
            sizes = np.full(len(place), WINDOW)
            yield pa.RecordBatch.from_arrays(
                [
                    binaries(_take(data, place, sizes), sizes),
                    pa.array(h.view(np.int64)),
                    column_of(piece, "sid").take(pa.array(sid)),
                    pa.array(off),
                    pa.array(least[sid]),
                    pa.array(most[sid]),
                ],
                names=["win", "h", "sid", "off", "least", "most"],
            )

    return spans.select("sid", "body", "held").mapInArrow(run, "win binary, h long, sid long, off long, least long, most long")


def _removed_by_window(rows: DataFrame) -> DataFrame:
    """As _removed, for anchors with any number of stretches: each window is looked up by its bytes.

    Equal windows are one row per task before they are dealt out, so a passage in
    very many documents is counted where it is read; the join back has one row
    per window on its right side.
    """
    spans = cut_lineage(rows.select("body", "held").withColumn("sid", F.monotonically_increasing_id()))
    firsts = _windows(spans).groupBy("win").agg(F.min("h").alias("h"), F.min("least").alias("first"), F.max("most").alias("last"))
    firsts = cut_lineage(firsts.where("first < last").select("win", "h", "first"))
    found = _windows(spans, bitmap_of(firsts, "h")).drop("h").join(firsts.drop("h"), "win").where("first < most")
    told = found.groupBy("sid").agg(F.collect_list(F.struct("off", "first")).alias("firsts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "held"):
            many = column_of(piece, "n").to_numpy() - WINDOW + 1
            begins = np.cumsum(many) - many
            least = np.full(int(many.sum()), np.iinfo(np.int64).max)
            lists = column_of(piece, "firsts")
            row = np.repeat(np.arange(len(many)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            least[begins[row] + flat.field("off").to_numpy()] = flat.field("first").to_numpy()
            who = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3) for x in column_of(piece, "held")]
            owner = np.repeat(np.arange(len(who)), [len(w) for w in who])
            if (gone := _runs(least, many, owner, np.concatenate(who))) is not None:
                yield gone

    joined = spans.join(told, "sid").select(F.octet_length("body").cast("long").alias("n"), "held", "firsts")
    return joined.mapInArrow(run, "doc_id long, t long, run long")


def _removed(rows: DataFrame) -> DataFrame:
    """(doc_id, t, run): runs of windows that an earlier document holds, as first * 256 + how many."""

    def solve(bodies: list[bytes], held: list[bytes]) -> pa.RecordBatch | None:
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(b, len(seen)) for b in bodies], np.int64)
        distinct = list(seen)
        sizes = np.array([len(b) for b in distinct], np.int64)
        who = [np.frombuffer(h, np.int64).reshape(-1, 3) for h in held]
        owner = np.repeat(which, [len(w) for w in who])
        who = np.concatenate(who)
        holders = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(holders, owner, who[:, 0])
        least, many = first_holders(np.frombuffer(b"".join(distinct), np.uint8), sizes, holders)
        return _runs(least, many, owner, who)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: list[bytes] = []
        held: list[bytes] = []
        size, before = 0, None
        for batch in batches:
            keys = column_of(batch, "key").to_pylist()
            for key, body, who in zip(keys, column_of(batch, "body").to_pylist(), column_of(batch, "held").to_pylist(), strict=True):
                if size > _BLOCK_BYTES and key != before:
                    if (found := solve(bodies, held)) is not None:
                        yield found
                    bodies, held, size = [], [], 0
                bodies.append(body)
                held.append(who)
                size += len(body) + len(who)
                before = key
        if bodies and (found := solve(bodies, held)) is not None:
            yield found

    return rows.mapInArrow(run, "doc_id long, t long, run long")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash under which _wanted looks a row up."""
    for batch in batches:
        ids = column_of(batch, "doc_id").to_numpy().view(np.uint64)
        h = mixed(mixed(ids) ^ column_of(batch, "t").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def without_repeats(docs: DataFrame, *kept: str) -> DataFrame:
    """Each row's doc_id, t and text, with kept columns, and what stays once repeated strings are removed.

    A byte goes when a string of WINDOW bytes covers it that also begins in a row
    with a smaller doc_id; strings are judged on the input. New columns: n_bytes,
    n_removed, n_spans (runs removed), remaining (the bytes that stay, in order; a
    cut may fall inside a character). A null text counts as empty. Rows of equal
    doc_id do not remove anything from each other; a row without doc_id loses
    nothing and takes nothing from others.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text"), *kept)
    named = rows.where("doc_id is not null").select("doc_id", "t", "text")
    told = cut_lineage(named.select("doc_id", "t", F.md5(F.col("text").cast("binary")).alias("h"), F.octet_length("text").alias("n")))
    # equal texts: all but those of the smallest doc_id go whole, and nothing else is asked of them
    first = told.groupBy("h").agg(F.min("doc_id").alias("first"))
    told = cut_lineage(told.join(first, "h").select("doc_id", "t", "n", (F.col("doc_id") > F.col("first")).alias("copy")))
    copies = told.where(F.col("copy") & (F.col("n") >= WINDOW)).select("doc_id", "t").distinct()
    firsts = told.where(~F.col("copy")).select("doc_id", "t").mapInArrow(_places, "h long")
    known = bitmap_of(firsts, "h")
    n_bytes = told.agg(F.sum("n")).first()[0] or 0
    shared = _shared_keys(named, known, n_bytes)
    crowded = len(shared.hot) > 0
    shared = spark.sparkContext.broadcast(shared)
    dealt = _shared_stretches(named, known, shared, False).repartition("key").sortWithinPartitions("key")
    found = _removed(dealt)
    if crowded:
        found = found.unionByName(_removed_by_window(_shared_stretches(named, known, shared, True)))
    # written before the texts are joined, so that the stretches' shuffle is gone by then
    found = cut_lineage(found.unionByName(copies.withColumn("run", F.lit(_ALL).cast("long"))))
    runs = found.groupBy("doc_id", "t").agg(F.collect_list("run").alias("runs"))
    joined = rows.join(runs, ["doc_id", "t"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, starts = utf8(column_of(piece, "text"))
            gone = column_of(piece, "runs")
            removed, spans, left = [], [], []
            for i in range(piece.num_rows):
                body = data[starts[i] : starts[i + 1]]
                if not gone[i].is_valid:
                    removed.append(0)
                    spans.append(0)
                    left.append(body.tobytes())
                    continue
                run = gone[i].values.to_numpy()
                if (run == _ALL).any():
                    removed.append(len(body))
                    spans.append(1)
                    left.append(b"")
                    continue
                change = np.zeros(len(body) + 1, np.int64)
                np.add.at(change, run >> 8, 1)
                np.add.at(change, (run >> 8) + (run & 255) + WINDOW - 1, -1)
                covered = np.cumsum(change[:-1]) > 0
                removed.append(int(covered.sum()))
                spans.append(int(np.count_nonzero(covered[1:] & ~covered[:-1]) + covered[:1].sum()))
                left.append(body[~covered].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    *[column_of(piece, c) for c in ("doc_id", *kept)],
                    pa.array(np.diff(starts)),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(left, pa.binary()),
                ],
                names=["doc_id", *kept, "n_bytes", "n_removed", "n_spans", "remaining"],
            )

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in ("doc_id", *kept))
    return joined.select("doc_id", *kept, "text", "runs").mapInArrow(
        cut, schema + "n_bytes long, n_removed long, n_spans long, remaining binary"
    )


