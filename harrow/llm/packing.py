"""Packing documents into windows of fixed length by the sum-of-squares rule.

A document is cut into full windows first; its rest, shorter than a window, is
placed online. level[h] counts the open windows that hold h ids. Placing s ids
into a window at h takes it from level h to h + s, and of all levels with room
the one is taken that leaves the sum of level[h]^2 smallest (opening a window is
placing at 0, a full window counts nowhere; ties: the fullest). So no fill level
piles up, and windows meet rests that complete them.

What is still open at the end of a task's documents, or when more than
`open_windows` are, is settled: the emptiest windows give ids to the fullest until
one is left, and that one is cut by the binary digits of its length. A window
whose length is a power of two is not padded, so no padding is left; documents are
cut only where they are longer than a window or lie in a window that was settled.

Every task packs the rows of its own part of the table, in their order: nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.llm.textblocks import column_of, pieces
from harrow.llm.tokenfile import encoder
from harrow.session import broadcast_if_small, cut_lineage

WINDOW = 2048
# Open windows hold their ids in memory: 8 kB each at most.
OPEN_WINDOWS = 4096

# A piece is (document, its first id, how many ids).
Piece = tuple[int, int, int]


class Packer:
    """Windows of one task; closed windows are lists of pieces."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.limit = window, open_windows
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]
        self.n_open = 0

    def choose(self, size: int) -> int:
        """The level whose windows get the next `size` ids; 0 opens one."""
        room = self.window - size + 1
        # what the sum of squares grows by: leaving h, and arriving at h + size
        grows = 1 - 2 * self.level[:room]
        grows[0] = 0
        grows += 2 * self.level[size : self.window + 1] + 1
        grows[-1] -= 2 * self.level[self.window] + 1  # a full window is no longer counted
        there = np.flatnonzero(self.level[:room])
        there = np.append(0, there) if not len(there) or there[0] else there
        return int(there[::-1][np.argmin(grows[there][::-1])])

    def add(self, document: int, n_ids: int) -> Iterator[list[Piece]]:
        """Place a document; the windows that this completes."""
        at = 0
        while n_ids - at >= self.window:
            yield [(document, at, self.window)]
            at += self.window
        size = n_ids - at
        if not size:
            return
        h = self.choose(size)
        held: list[Piece] = []
        if h:
            held = self.open[h].pop()
            self.level[h] -= 1
            self.n_open -= 1
        held.append((document, at, size))
        if h + size == self.window:
            yield held
            return
        self.open[h + size].append(held)
        self.level[h + size] += 1
        self.n_open += 1
        if self.n_open > self.limit:
            yield from self.settle()

    def settle(self) -> Iterator[list[Piece]]:
        """Close every open window without padding."""
        # fullest first; ids move from the end of the list to its front
        left = [(h, held) for h in range(self.window - 1, 0, -1) for held in self.open[h]]
        self.level[:] = 0
        self.open = [[] for _ in range(self.window)]
        self.n_open = 0
        last = len(left) - 1
        first = 0
        while first < last:
            h, held = left[first]
            given, taken = left[last]
            document, at, size = taken.pop()
            take = min(size, self.window - h)
            held.append((document, at + size - take, take))
            if take < size:
                taken.append((document, at, size - take))
            left[first], left[last] = (h + take, held), (given - take, taken)
            if h + take == self.window:
                yield held
                first += 1
            if given == take:
                last -= 1
        if first == last:
            yield from _powers(*left[first])


def _powers(length: int, held: list[Piece]) -> Iterator[list[Piece]]:
    """One window cut into windows whose lengths are powers of two."""
    held = held[::-1]
    while length:
        room = 1 << (length.bit_length() - 1)
        length -= room
        out = []
        while room:
            document, at, size = held.pop()
            take = min(size, room)
            out.append((document, at, take))
            if take < size:
                held.append((document, at + take, size - take))
            room -= take
        yield out


class _Ids:
    """Ids of documents with pieces still to come; of a cut document only its rest is kept."""

    def __init__(self):
        self.ids: dict[int, tuple[int, np.ndarray]] = {}
        self.left: dict[int, int] = {}

    def put(self, document: int, ids: np.ndarray) -> None:
        self.ids[document], self.left[document] = (0, ids), len(ids)

    def take(self, document: int, at: int, size: int) -> bytes:
        first, ids = self.ids[document]
        out = ids[at - first : at - first + size].astype("<u4").tobytes()
        self.left[document] -= size
        if not self.left[document]:
            del self.ids[document], self.left[document]
        return out

    def keep_rest(self, document: int) -> None:
        if document in self.left:
            first, ids = self.ids[document]
            gone = len(ids) - self.left[document]
            self.ids[document] = (first + gone, ids[gone:].copy())


def packed(
    docs: DataFrame,
    tokenizer_file: str,
    end_id: int | None = None,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pack the ids of all texts: one row per piece, written as a table.

    Columns: doc_id, start (ids of the document before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id (dense from 0), offset
    (place in the sequence, without gaps from 0), sequence_length. A sequence needs
    no padding: it is a full window, or its length is a power of two.

    A null or empty text has the end id alone; without an end id it has no piece.
    Rows of equal doc_id are documents of their own, a null doc_id is kept, an empty
    table gives no rows, a long text is cut into full windows and a rest. Other
    columns are not read. Which documents share a window follows the splits of the
    input; the windows are whole and unpadded for any.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer, ids = encoder(tokenizer_file), Packer(window, open_windows), _Ids()
        part, doc_ids, sizes = TaskContext.get().partitionId(), {}, {}
        sequence = document = 0

        def rows(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            flat = [(i, *p) for i, w in enumerate(windows, sequence) for p in w]
            length = np.array([p[3] for p in flat], np.int64)
            first = np.concatenate(([0], np.cumsum([len(w) for w in windows]))).astype(np.int64)
            before = np.concatenate(([0], np.cumsum(length)))
            per_window = np.diff(first)
            out = {
                "doc_id": pa.array([doc_ids[p[1]] for p in flat], kind),
                "start": np.array([p[2] for p in flat], np.int64),
                "length": length,
                "doc_tokens": np.array([sizes[p[1]] for p in flat], np.int64),
                "part": np.full(len(flat), part, np.int64),
                "sequence": np.array([p[0] for p in flat], np.int64),
                "offset": before[:-1] - np.repeat(before[first[:-1]], per_window),
                "sequence_length": np.repeat(np.diff(before[first]), per_window),
                "ids": pa.array([ids.take(*p[1:]) for p in flat], pa.binary()),
            }
            for p in flat:
                if p[1] not in ids.left:
                    doc_ids.pop(p[1], None), sizes.pop(p[1], None)
            sequence += len(windows)
            return pa.RecordBatch.from_pydict(out)

        kind = None
        for piece in pieces(batches):
            kind = column_of(piece, "doc_id").type
            found, counts = encode(column_of(piece, "text").to_pylist())
            ends = np.cumsum(counts)
            closed = []
            for doc_id, to, n in zip(column_of(piece, "doc_id").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                own = found[to - n : to]
                if end_id is not None:
                    own = np.append(own, np.uint32(end_id))
                if len(own):
                    doc_ids[document], sizes[document] = doc_id, len(own)
                    ids.put(document, own)
                    closed.extend(packer.add(document, len(own)))
                    document += 1
            if closed:
                yield rows(closed)
            for fresh in range(document - piece.num_rows, document):
                ids.keep_rest(fresh)
        closed = list(packer.settle())
        if closed:
            yield rows(closed)

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = cut_lineage(
        docs.select("doc_id", "text").mapInArrow(
            pack,
            f"doc_id {kind}, start long, length long, doc_tokens long, part long, sequence long, "
            "offset long, sequence_length long, ids binary",
        )
    )
    # one row per task: where its sequences begin among all
    many = table.groupBy("part").agg((F.max("sequence") + 1).alias("many"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = many.select("part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    return table.join(broadcast_if_small(base), "part").select(
        "doc_id",
        "start",
        "length",
        "ids",
        "doc_tokens",
        (F.col("base") + F.col("sequence")).alias("sequence_id"),
        "offset",
        "sequence_length",
    )
