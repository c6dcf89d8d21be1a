"""Benchmark passages inside documents, up to a few edits, by counted q-grams in diagonal bands.

A passage of m characters that occurs with at most k edits shares at least
m + 1 - q - k*q of its q-grams with the place where it occurs, and they all lie
on diagonals (place in the text minus place in the passage) at most k apart.
Shared q-grams are counted in overlapping bands of diagonals; a band that holds
too few is dropped without loss, and the text around any other is aligned with
the passage in a band of k diagonals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.textblocks import column_of, mixed, pieces, utf8

EDIT_SHARE = 0.05  # edits a passage may have, as a share of its length
LEAST_BYTES = 24  # a shorter passage is matched whole, without edits
MOST_BENCHMARK_BYTES = 64 << 20
_TABLE_BITS = 22
_FAR = 1 << 40  # keeps diagonals positive


def budget(length: int) -> tuple[int, int, int]:
    """(edits, q, shared q-grams needed) for a passage of that many bytes."""
    if length < LEAST_BYTES:
        return 0, max(1, min(8, length)), max(1, length + 1 - min(8, length))
    edits = int(length * EDIT_SHARE)
    return edits, 8, length + 1 - 8 - 8 * edits


def folded(raw: bytes) -> np.ndarray:
    """Bytes with A-Z in lower case and any run of space as one blank, without space at the ends."""
    return np.frombuffer(b" ".join(raw.lower().split()), np.uint8)


def alignment(passage: np.ndarray, text: np.ndarray, edits: int, shift: int) -> tuple[int, int] | None:
    """(edits, end) of the best place of a passage in a text near a diagonal, or None beyond the budget.

    The passage may begin anywhere within `edits` of `shift`. Cells further than
    2 * edits from the diagonal are not computed. Of equal edits the first end counts.
    """
    m, width = len(passage), 4 * edits + 1
    low = shift - 2 * edits
    offsets = np.arange(width)
    exact = text[max(0, shift) : max(0, shift) + m]
    if shift >= 0 and len(exact) == m and np.array_equal(exact, passage):
        return 0, shift + m
    best = np.zeros(width + 1, np.int64)  # row 0: the passage may begin at any diagonal of the band
    best[width] = m + 1
    padded = np.full(m + width + 1, -1, np.int64)
    source = np.arange(low - 1, low - 1 + len(padded))
    inside = (source >= 0) & (source < len(text))
    padded[inside] = text[source[inside]]
    for i in range(1, m + 1):
        letters = padded[i : i + width]
        change = best[:width] + (letters != passage[i - 1])
        now = np.minimum(change, best[1:] + 1)
        now = np.minimum.accumulate(now - offsets) + offsets  # letters of the text left out
        best[:width] = now
        if now.min() > edits:
            return None
    best = best[:width]
    ends = low + m + offsets
    best = np.where((ends < 0) | (ends > len(text)), m + 1, best)
    at = int(best.argmin())
    return (int(best[at]), int(ends[at])) if best[at] <= edits else None


class Passages:
    """All benchmark passages, their q-grams sorted by hash, and a small bitmap of those."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.texts, self.limits = [], [], []
        keys, owners, places = [], [], []
        for item_id, text in rows:
            body = folded((text or "").encode())
            if not len(body):
                continue
            edits, q, need = budget(len(body))
            if need < 1:
                raise ValueError(f"passage {item_id} leaves no q-gram bound")
            owner = len(self.ids)
            self.ids.append(item_id)
            self.texts.append(body)
            self.limits.append((edits, q, need))
            grams = self.grams(body, q)
            keys.append(grams)
            owners.append(np.full(len(grams), owner))
            places.append(np.arange(len(grams)))
        self.widths = sorted({q for _, q, _ in self.limits})
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner = np.concatenate([np.zeros(0, np.int64), *owners])[order].astype(np.int64)
        self.place = np.concatenate([np.zeros(0, np.int64), *places])[order].astype(np.int64)
        self.there = np.zeros(1 << _TABLE_BITS, bool)
        self.there[(self.key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    @staticmethod
    def grams(body: np.ndarray, q: int) -> np.ndarray:
        """A hash of each run of q <= 8 bytes."""
        if len(body) < q:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(body) - q + 1, np.uint64)
        for i in range(q):
            out |= body[i : len(body) - q + 1 + i].astype(np.uint64) << np.uint64(8 * i)
        return mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(q))

    def shared(self, body: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, place in it, place in the text) of every q-gram that both have."""
        found = []
        for q in self.widths:
            grams = self.grams(body, q)
            at = np.flatnonzero(self.there[(grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low = np.searchsorted(self.key, grams[at], "left")
            many = np.searchsorted(self.key, grams[at], "right") - low
            which = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found.append((self.owner[which], self.place[which], np.repeat(at, many)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def matches(self, bodies: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item_id, start, end, edits) of every passage found; places are in the folded text."""
        owner, place, at = self.shared(bodies)
        text = np.searchsorted(starts, at, side="right") - 1
        diagonal = at - place
        out = []
        if not len(owner):
            return out
        limits = np.array(self.limits, np.int64)
        # a passage whose q-grams are too few in the whole text is in no band of it
        pair = text * len(limits) + owner
        order = np.argsort(pair)
        fresh = np.flatnonzero(np.diff(pair[order], prepend=-1))
        many = np.diff(np.append(fresh, len(pair)))
        enough = np.repeat(many >= limits[owner[order[fresh]], 2], many)
        kept = order[enough]
        owner, place, text, diagonal = owner[kept], place[kept], text[kept], diagonal[kept]
        if not len(owner):
            return out
        step = np.maximum(2 * limits[owner, 0], 1)  # band b holds diagonals [b*step, b*step + 2*step)
        base = (diagonal - starts[text] + _FAR) // step
        rows = [(text, owner, base), (text, owner, base - 1)]
        text2, owner2, band = (np.concatenate(c) for c in zip(*rows, strict=True))
        keys = np.lexsort((np.tile(place, 2), band, owner2, text2))
        t, o, b = text2[keys], owner2[keys], band[keys]
        p = np.tile(place, 2)[keys]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1]) | (b[1:] != b[:-1])
        new = fresh.copy()
        new[1:] |= p[1:] != p[:-1]  # a q-gram of the passage counts once in a band
        begin = np.flatnonzero(fresh)
        counts = np.add.reduceat(new.astype(np.int64), begin)
        good = counts >= limits[o[begin], 2]
        begin, counts = begin[good], counts[good]
        done = set()
        for k in begin[np.lexsort((b[begin], -counts))].tolist():
            i, j = int(t[k]), int(o[k])
            if (i, j) in done:
                continue
            edits, passage = self.limits[j][0], self.texts[j]
            width = max(2 * edits, 1)
            low = int(b[k]) * width - _FAR
            for shift in [low + width] if edits else [low, low + 1]:
                hit = alignment(passage, bodies[starts[i] : starts[i + 1]], edits, shift)
                if hit:
                    out.append((i, self.ids[j], max(0, hit[1] - len(passage)), hit[1], hit[0]))
                    done.add((i, j))
                    break
        return sorted(out)


def passages_of(benchmark: DataFrame) -> list[tuple[int, str]]:
    """The passages on the driver. Their size is checked: a benchmark beyond the bound is refused."""
    rows = benchmark.where("text is not null").select("item_id", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    if size > MOST_BENCHMARK_BYTES:
        raise ValueError(f"benchmark of {size} bytes; split it into parts of {MOST_BENCHMARK_BYTES}")
    return sorted((r["item_id"], r["text"]) for r in rows.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of each benchmark passage found in each row of docs.

    Both sides are compared with A-Z in lower case and runs of space as one
    blank; start and end count bytes of the text so folded. Of several places of
    a passage in a text the one that shares most q-grams is given, then the first. A
    passage of m bytes may have m * EDIT_SHARE edits, one shorter than
    LEAST_BYTES none. Null or blank texts and passages match nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Passages(passages_of(benchmark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, starts = utf8(column_of(piece, "text"))
            raw = data.tobytes()
            bodies = [folded(raw[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            # texts lie apart by a byte that no text holds
            gap = np.full(1, 0xFF, np.uint8)
            whole = np.concatenate([x for body in bodies for x in (body, gap)])
            edges = np.concatenate(([0], np.cumsum([len(body) + 1 for body in bodies])))
            found = shared.value.matches(whole, edges)
            if found:
                text, item, start, end, edits = (np.array(c, np.int64) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [column_of(piece, "doc_id").take(pa.array(text)), *map(pa.array, (item, start, end, edits))],
                    names=["doc_id", "item_id", "start", "end", "edits"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark passage."""
    found = contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")
