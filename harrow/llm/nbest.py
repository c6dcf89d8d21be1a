"""SentencePiece encoding by N-best search over the piece lattice, and decoding.

All pieces that match somewhere in a text are the edges of a lattice. Forward
Viterbi scores tell the best score of every beginning; a backward A* search that
uses them as its estimate, which is exact, meets whole segmentations in falling
order of score. No piece crosses from a letter into a following blank or over a
line break, so the lattice falls apart there; the N best of a text follow from
the N best of its parts, and each distinct part is searched once.

Scores of unigram models are taken as they are. Models of merges store ranks in
place of probabilities; a rank r counts as the log probability -log(2 + r). So a
merge model's pieces, ids and decoding are kept, while the segmentation is the
best one of the lattice and not the one of merging in order.

The forward pass runs for all new parts of a batch at once, over a trie of the
pieces, and keeps the two best scores of every beginning. Their difference at the
end tells which parts of a text can be among its N best; only those are searched
backward.
"""

from __future__ import annotations

import array
import functools
import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.textblocks import binaries, column_of, pieces
from harrow.llm.wordcache import PerWord

BLANK = "▁"
_PART = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")
# Parts of texts that are kept take at most about this many bytes in a worker process.
KEPT_BYTES = 1 << 26
# What a kept part takes besides its characters and ids: an entry, a string, and four numbers.
_ENTRY_BYTES = 240
# Parts whose alternatives are kept; each takes about a kilobyte.
KEPT_ALTERNATIVES = 1 << 14
# Parts up to this many characters go through the forward pass together; a longer one goes alone.
_TOGETHER = 48
# The forward pass takes this many characters at a time; its edges take some hundred bytes a character.
_AT_ONCE = 1 << 16
_CHAR_BITS = 21


def _plain(model) -> list[int]:
    """The numbers of the pieces that stand for text."""
    return [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Pieces:
    """The pieces of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = model.get_piece_size()
        numbers = range(self.size)
        plain = _plain(model)
        self.number = {model.id_to_piece(i): i for i in plain}
        if any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in self.number):
            raise ValueError("pieces cross blanks or line breaks")
        scores = {i: model.get_score(i) for i in plain}
        # ranks of a merge model are whole numbers; log probabilities are not
        ranked = all(float(s).is_integer() for s in scores.values())
        self.score = {p: -math.log(2 - scores[i]) if ranked else scores[i] for p, i in self.number.items()}
        self.begun = {p[:i] for p in self.number for i in range(1, len(p))}
        self.lowest = min(self.score.values(), default=0.0)
        self.longest = max(map(len, self.number), default=1)
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in numbers if model.is_byte(i)}
        self.unknown = model.unk_id()
        self._grow()

    def _grow(self) -> None:
        """The pieces as a trie: sorted (node, character) keys, and the node and piece that each leads to."""
        node = {"": 0}
        for p in sorted(self.number.keys() | self.begun, key=len):
            node[p] = len(node)
        steps = sorted((node[p[:-1]] << _CHAR_BITS | ord(p[-1]), node[p], self.number.get(p, -1)) for p in node if p)
        self.steps, self.nodes, self.ends = np.array(steps, np.int64).reshape(-1, 3).T.copy()
        self.scores = np.zeros(self.size + 1)
        self.scores[list(self.number.values())] = [self.score[p] for p in self.number]

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(begin, length, piece) of each piece in the texts of codes; left: characters to the end of each one's text.

        A character without piece is an edge of piece -1.
        """
        begins, lengths, found = [], [], []
        at, node, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), 1
        while len(at):
            keys = node << _CHAR_BITS | codes[at + length - 1]
            place = np.minimum(np.searchsorted(self.steps, keys), max(len(self.steps) - 1, 0))
            there = self.steps[place] == keys if len(self.steps) else np.zeros(len(at), bool)
            piece = np.where(there, self.ends[place], -1) if len(self.steps) else np.full(len(at), -1)
            real = np.ones(len(at), bool) if length == 1 else piece >= 0
            begins.append(at[real])
            lengths.append(np.full(int(real.sum()), length))
            found.append(piece[real])
            on = there & (left[at] > length)
            at, node, length = at[on], self.nodes[place[on]] if len(self.steps) else node[on], length + 1
        return np.concatenate(begins), np.concatenate(lengths), np.concatenate(found)

    def forward(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over many parts: best ids one after another, ids per part, best score, and how far the second falls short.

        Of equal scores the one with the longer last piece is best.
        """
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(parts)), sizes)
        within = np.arange(len(codes)) - first[own]
        begin, length, piece = self._edges(codes, sizes[own] - within)
        # ids and scores of characters without piece follow those of the pieces
        missing = piece < 0
        chars, which = np.unique(codes[begin[missing]], return_inverse=True)
        instead = [self._missing(chr(c)) for c in chars.tolist()]
        piece[missing] = self.size + which
        scores = np.concatenate((self.scores[: self.size], [s for _, s in instead]))[piece]
        spelled = np.concatenate([np.arange(self.size), *[ids for ids, _ in instead]]).astype(np.uint32)
        spans = np.concatenate((np.ones(self.size, np.int64), [len(ids) for ids, _ in instead])).astype(np.int64)
        # a node per character and one more per part; edges by where they end, long ones first
        low = begin + own[begin]
        high = low + length
        order = np.lexsort((-length, within[begin] + length))
        low, high, length, piece, scores = low[order], high[order], length[order], piece[order], scores[order]
        ends = within[begin][order] + length
        cuts = np.flatnonzero((np.diff(ends) != 0) | (np.diff(length) != 0)) + 1
        best, second = np.full((2, len(codes) + len(parts)), -np.inf)
        back = np.zeros(len(best), np.int64)
        starts, stops = first + np.arange(len(parts)), first + np.arange(len(parts)) + sizes
        best[starts] = 0.0
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(low)], strict=True):
            u, v, s = low[a:b], high[a:b], scores[a:b]
            one, held = best[u] + s, best[v]
            second[v] = np.maximum(np.minimum(held, one), np.maximum(second[v], second[u] + s))
            better = one > held
            best[v[better]] = one[better]
            back[v[better]] = np.arange(a, b)[better]
        paths, at, part = [], stops, np.arange(len(parts))
        while len(at):
            edge = back[at]
            paths.append((part, edge))
            at = low[edge]
            on = at > starts[part]
            at, part = at[on], part[on]
        part = np.concatenate([p for p, _ in reversed(paths)])
        edge = np.concatenate([e for _, e in reversed(paths)])
        edge = edge[np.argsort(part, kind="stable")]
        kinds = piece[edge]
        to = np.cumsum(spans[kinds])
        ids = spelled[np.arange(to[-1]) + np.repeat(np.cumsum(spans)[kinds] - to, spans[kinds])]
        counts = np.bincount(np.sort(part), spans[kinds], minlength=len(parts)).astype(np.int64)
        return ids, counts, best[stops], best[stops] - second[stops]

    def _missing(self, char: str) -> tuple[tuple[int, ...], float]:
        """A character without piece: its bytes, or the unknown piece; each as bad as the worst piece."""
        ids = tuple(self.bytes[b] for b in char.encode("utf-8", "replace")) if self.bytes else (self.unknown,)
        return ids, (self.lowest - 1) * len(ids)

    def nbest(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a part, best first: (score, ids)."""
        size, longest = len(part), self.longest
        score, begun = self.score, self.begun
        into: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]  # edges by where they end
        best = [0.0] + [-math.inf] * size
        for at in range(size):
            reached = best[at]
            for to in range(at + 1, min(size, at + longest) + 1):
                piece = part[at:to]
                s = score.get(piece)
                if s is None:
                    if to == at + 1:
                        s = self._missing(piece)[1]
                    elif piece in begun:
                        continue
                    else:
                        break
                into[to].append((at, s))
                if reached + s > best[to]:
                    best[to] = reached + s
        # backward: a hypothesis is what follows `at`; its estimate is exact
        heap = [(-best[size], size, 0, 0.0, None)]
        made, out = 1, []
        pop, push = heapq.heappop, heapq.heappush
        while heap and len(out) < n:
            _, at, _, after, path = pop(heap)
            if at:
                for before, s in into[at]:
                    s += after
                    push(heap, (-best[before] - s, before, made, s, (before, at, path)))
                    made += 1
                continue
            ids: list[int] = []
            while path:
                piece = part[path[0] : path[1]]
                ids += (self.number[piece],) if piece in score else self._missing(piece)[0]
                path = path[2]
            out.append((after, tuple(ids)))
        return out


def parts_of(text: str) -> list[str]:
    """Where the lattice falls apart. A text begins with a blank of its own."""
    return _PART.findall(BLANK + text.replace(" ", BLANK)) if text else []


def combine(gaps: list[list[float]], n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n cheapest ways to deviate from the best: (cost, (part, alternative) pairs).

    gaps[i] lists by how much part i's alternatives fall short, least first; parts
    are in rising order of their first gap. The first way is no deviation.
    """
    heap: list[tuple[float, int, list]] = [(0.0, 0, [])]
    out: list[tuple[float, list[tuple[int, int]]]] = []
    made = 1
    while heap and len(out) < n:
        cost, _, taken = heapq.heappop(heap)
        out.append((cost, taken))
        options, last = [], -1
        if taken:
            last, k = taken[-1]
            if k < len(gaps[last]):
                options.append((cost - gaps[last][k - 1] + gaps[last][k], [*taken[:-1], (last, k + 1)]))
        options += [(cost + gaps[i][0], [*taken, (i, 1)]) for i in range(last + 1, len(gaps))]
        for price, way in options:
            heapq.heappush(heap, (price, made, way))
            made += 1
    return out


class Segmenter:
    """N-best segmentation of whole texts; parts are searched once and kept, up to a bound."""

    def __init__(self, model_file: str, n: int, kept: int = KEPT_BYTES):
        self.pieces = Pieces(model_file)
        self.n, self.kept = n, kept
        self.forget()

    def forget(self) -> None:
        """Lets go of all parts, as a task does at its end."""
        self._forget()
        self.others = PerWord(self._alternatives, KEPT_ALTERNATIVES)

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.taken = 0
        self.ids, self.ends = array.array("I"), array.array("q", [0])
        self.scores, self.gaps = array.array("d"), array.array("d")

    def _places(self, parts: list[str]) -> np.ndarray:
        if self.taken > self.kept:
            self._forget()
        new = [p for p in dict.fromkeys(parts) if p not in self.place]
        short = [p for p in new if len(p) <= _TOGETHER]
        cuts = np.flatnonzero(np.diff(np.cumsum([len(p) for p in short]) // _AT_ONCE)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(short)], strict=True):
            if low < high:
                self._keep(short[low:high], *self.pieces.forward(short[low:high]))
        for part in new:
            if len(part) > _TOGETHER:
                found = self.pieces.nbest(part, 2)
                gap = found[0][0] - found[1][0] if len(found) > 1 else math.inf
                ids = np.array(found[0][1], np.uint32)
                self._keep([part], ids, np.array([len(ids)]), np.array([found[0][0]]), np.array([gap]))
        return np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))

    def _keep(self, parts: list[str], ids: np.ndarray, sizes: np.ndarray, scores: np.ndarray, gaps: np.ndarray) -> None:
        self.place.update(zip(parts, range(len(self.scores), len(self.scores) + len(parts)), strict=True))
        self.ends.frombytes((self.ends[-1] + np.cumsum(sizes)).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        # a character takes up to four bytes, an id four
        self.taken += sum(_ENTRY_BYTES + 4 * len(p) for p in parts) + 4 * len(ids)
        self.scores.frombytes(scores.astype(np.float64).tobytes())
        self.gaps.frombytes(gaps.astype(np.float64).tobytes())

    def _alternatives(self, part: str) -> list[tuple[float, tuple[int, ...]]]:
        """What else a part may be: (shortfall, ids), least first. Asked for the few parts that matter."""
        place = self.place[part]
        own = tuple(self.ids[self.ends[place] : self.ends[place + 1]])
        found = self.pieces.nbest(part, self.n)
        return [(found[0][0] - s, ids) for s, ids in found if ids != own][: self.n - 1]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list]]:
        """Best ids of all texts one after another, how many each has, and its n best.

        The n best of a text are (score, changes), best first; changes lists what
        differs from the best: (first id replaced, ids replaced, ids instead).
        """
        parted = [parts_of(t or "") for t in texts]
        places = self._places([p for parts in parted for p in parts])
        ends = np.frombuffer(self.ends, np.int64)
        begins, sizes = ends[places], ends[places + 1] - ends[places]
        to = np.cumsum(sizes)
        total = int(to[-1]) if len(to) else 0
        held = np.frombuffer(self.ids, np.uint32) if self.ids else np.zeros(0, np.uint32)
        ids = held[np.arange(total) + np.repeat(begins - (to - sizes), sizes)]
        edges = np.cumsum([0, *map(len, parted)])
        first = np.concatenate(([0], to))[edges]
        scores, gaps = (np.frombuffer(kept)[places] if kept else np.zeros(0) for kept in (self.scores, self.gaps))
        del ends, held  # views of arrays that are to grow
        best = []
        for i in range(len(texts)):
            low, high = int(edges[i]), int(edges[i + 1])
            top = math.fsum(scores[low:high].tolist())
            own = gaps[low:high]
            near = np.argsort(own, kind="stable")[: self.n - 1] if high - low < 64 else self._least(own)
            near = [int(k) for k in near if own[k] < math.inf]
            rest = [self.others[parted[i][k]] for k in near]
            ways = combine([[g for g, _ in r] for r in rest], self.n)
            best.append(
                [
                    (
                        top - cost,
                        [
                            (int(to[low + near[j]] - sizes[low + near[j]] - first[i]), int(sizes[low + near[j]]), rest[j][k - 1][1])
                            for j, k in way
                        ],
                    )
                    for cost, way in ways
                ]
            )
        return ids, np.diff(first), best

    def _least(self, own: np.ndarray) -> np.ndarray:
        """Where the n - 1 least gaps stand, the earlier of equal ones first."""
        bound = np.partition(own, self.n - 2)[self.n - 2] if self.n > 1 else -math.inf
        some = np.flatnonzero(own <= bound)
        return some[np.argsort(own[some], kind="stable")][: self.n - 1]


@functools.cache
def segmenter(model_file: str, n: int) -> Segmenter:
    """One segmenter per worker process, file and n, kept from task to task without the parts it met."""
    return Segmenter(model_file, n)


@functools.cache
def piece_bytes(model_file: str) -> list[bytes]:
    """The bytes that each piece stands for; none for control pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    raw = {i: model.id_to_piece(i).replace(BLANK, " ").encode() for i in _plain(model)}
    raw |= {i: bytes([int(model.id_to_piece(i)[3:5], 16)]) for i in range(model.get_piece_size()) if model.is_byte(i)}
    return [raw.get(i, b"") for i in range(model.get_piece_size())]


def _schema(frame: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in names)


def encode(docs: DataFrame, model_file: str, n: int, *kept: Column) -> DataFrame:
    """The kept columns of each row, with ids, n_pieces, score, and the n best segmentations.

    ids is the best segmentation of text, little-endian unsigned 32-bit. nbest lists
    up to n segmentations, best first: each score, and what is changed against the
    best, as (first id replaced, ids replaced, ids instead). A null text is an empty
    one: no pieces, score 0, one segmentation. Repeated rows give repeated rows.
    """
    wanted = docs.select(*kept, F.col("text").alias("_text"))
    names = [c for c in wanted.columns if c != "_text"]
    change = pa.struct([("at", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = segmenter(model_file, n)
        try:
            for piece in pieces(batches, "_text"):
                ids, sizes, best = segment(column_of(piece, "_text").to_pylist())
                listed = [
                    [{"score": s, "changes": [{"at": a, "n": k, "ids": list(x)} for a, k, x in c]} for s, c in b] for b in best
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[column_of(piece, c) for c in names],
                        binaries(ids, sizes),
                        pa.array(sizes),
                        pa.array([b[0][0] for b in best], pa.float64()),
                        pa.array(listed, kind),
                    ],
                    names=[*names, "ids", "n_pieces", "score", "nbest"],
                )
        finally:
            segment.forget()

    return wanted.mapInArrow(
        run,
        _schema(wanted, names) + "ids binary, n_pieces long, score double, "
        "nbest array<struct<score: double, changes: array<struct<at: long, n: long, ids: array<int>>>>>",
    )


def decode(rows: DataFrame, model_file: str) -> DataFrame:
    """rows with their ids (little-endian unsigned 32-bit) also as text in column decoded.

    The blank that begins every encoded text is dropped; bytes that are no UTF-8
    become replacement characters. Null ids give a null text.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                raw = piece_bytes(model_file)
                texts = []
                for ids in column_of(some, "ids"):
                    if not ids.is_valid:
                        texts.append(None)
                        continue
                    whole = b"".join([raw[i] for i in np.frombuffer(ids.as_buffer(), np.uint32).tolist()])
                    texts.append(whole.decode("utf-8", "replace")[1:] if whole[:1] == b" " else whole.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(run, _schema(rows, names) + "decoded string")
