"""Token ids in files: fixed-width bit packing in blocks, written and read by Spark tasks.

A file holds the ids of consecutive documents. Every id takes the fewest bits
that hold the largest id of the vocabulary. Ids are packed in blocks of
BLOCK_IDS; a block begins at a whole byte, so any range of ids is read by
fetching its blocks alone and unpacking them with numpy.

    magic "HTOK1\\n", payload of all blocks,
    doc_id of each document (int64), where its ids begin (int64, one entry more),
    where each block begins in the file (int64, one entry more),
    footer: bits, ids per block, documents, blocks (4 x int64)

Fixed layout, all numbers little-endian. Documents are in ascending doc_id order
inside a file and across the files of a folder.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from harrow.llm.textblocks import column_of, pieces
from harrow.llm.wordcache import KEPT_WORDS, distinct_words, is_plain
from harrow.session import cut_lineage, new_run_dir

MAGIC = b"HTOK1\n"
BLOCK_IDS = 1 << 16
FILE_BYTES = 32 << 20
_FOOTER = 32


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below the size of the vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, each in that many bits, lowest bit first."""
    ids = np.asarray(ids, np.uint64)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, count: int) -> np.ndarray:
    """The first `count` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", count).astype(np.uint32)
    data = np.zeros(len(raw) + 8, np.uint8)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    at = np.arange(count, dtype=np.int64) * bits
    word = np.zeros(count, np.uint64)
    for i in range((bits + 14) // 8):
        word |= data[(at >> 3) + i].astype(np.uint64) << np.uint64(8 * i)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Writer:
    """One file; memory holds a block of ids and the index of documents."""

    def __init__(self, path: str, vocabulary: int, block: int = BLOCK_IDS):
        self.fs, self.path = _store(path)
        # an attempt writes under its own name and then takes the final one: a repeated
        # or speculative task leaves the same bytes and no half-written file
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.draft)
        self.out.write(MAGIC)
        self.at, self.bits, self.block = len(MAGIC), bits_for(vocabulary), block
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.blocks, self.waiting = [self.at], np.zeros(0, np.uint32)

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(doc_ids, np.int64))
        self.sizes.append(np.asarray(sizes, np.int64))
        self.waiting = np.concatenate((self.waiting, np.asarray(ids, np.uint32)))
        while len(self.waiting) >= self.block:
            self._put(self.waiting[: self.block])
            self.waiting = self.waiting[self.block :]

    def _put(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self.out.write(raw)
        self.at += len(raw)
        self.blocks.append(self.at)

    def close(self) -> tuple[int, int]:
        """Finish the file; how many documents and ids it holds."""
        if len(self.waiting):
            self._put(self.waiting)
        docs = np.concatenate([np.zeros(0, np.int64), *self.docs])
        starts = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.sizes]))))
        for part in (docs, starts, np.array(self.blocks), np.array([self.bits, self.block, len(docs), len(self.blocks) - 1])):
            self.out.write(part.astype("<i8").tobytes())
        self.out.close()
        self.fs.move(self.draft, self.path)
        return len(docs), int(starts[-1])


class Reader:
    """Random access to one file: only the blocks of the wanted ids are fetched."""

    def __init__(self, path: str):
        fs, path = _store(path)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        if size < len(MAGIC) + _FOOTER or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.bits, self.block, n, blocks = (
            int(x) for x in np.frombuffer(self.file.read_at(_FOOTER, size - _FOOTER), "<i8")
        )
        index = np.frombuffer(
            self.file.read_at(8 * (2 * n + blocks + 2), size - _FOOTER - 8 * (2 * n + blocks + 2)), "<i8"
        )
        self.doc_ids, self.starts, self.blocks = np.split(index, [n, 2 * n + 1])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number start to stop of the file."""
        stop = min(stop, int(self.starts[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        base = int(self.blocks[first])
        raw = self.file.read_at(int(self.blocks[last + 1]) - base, base)
        for b in range(first, last + 1):
            count = min(self.block, int(self.starts[-1]) - b * self.block)
            parts.append(unpack(raw[int(self.blocks[b]) - base : int(self.blocks[b + 1]) - base], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, position: int) -> np.ndarray:
        """The ids of the document at that position of the file."""
        return self.ids(int(self.starts[position]), int(self.starts[position + 1]))


class Encoder:
    """Ids of whole texts in batches; each distinct word is encoded by the library once.

    The words that a batch brings anew are given to the library as one text, and
    cut apart at the tokens that end a word. Texts whose words cannot be told by
    character class are given to the library whole. The word table is emptied
    when it holds more than `kept` words.
    """

    def __init__(self, tokenizer_file: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kept = kept
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.begins, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ask(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _places(self, found: list[str]) -> np.ndarray:
        if len(self.place) > self.kept:
            self._forget()
        new = [w for w in found if w not in self.place]
        if new:
            ids = self._ask(" ".join(new))
            ends = np.flatnonzero(self.closes[ids]) + 1
            assert len(ends) == len(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.begins = np.concatenate((self.begins, ends + len(self.ids)))
            self.ids = np.concatenate((self.ids, ids))
        return np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        texts = [t or "" for t in texts]
        plain = np.array([is_plain(t) for t in texts], bool)
        found, which, per_text = distinct_words([t for t, p in zip(texts, plain, strict=True) if p])
        places = self._places(found)
        begins = self.begins[places]
        sizes = self.begins[places + 1] - begins
        take = sizes[which]
        to = np.cumsum(take)
        total = int(to[-1]) if len(to) else 0
        ids = self.ids[np.arange(total) + np.repeat(begins[which] - (to - take), take)]
        edges = np.concatenate(([0], to))[np.concatenate(([0], np.cumsum(per_text)))]
        if plain.all():
            return ids, np.diff(edges)
        parts, at = [np.zeros(0, np.uint32)], 0
        for text, is_simple in zip(texts, plain, strict=True):
            parts.append(ids[edges[at] : edges[at + 1]] if is_simple else self._ask(text))
            at += is_simple
        return np.concatenate(parts), np.array([len(p) for p in parts[1:]], np.int64)


@functools.cache
def encoder(tokenizer_file: str) -> Encoder:
    """One encoder per worker process and file, kept from task to task."""
    return Encoder(tokenizer_file)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_file: str,
    end_id: int | None = None,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode every text and write the ids below `folder`; one row per file written.

    docs holds doc_id and text; other columns are not read. A null or empty text
    gives the end id alone (nothing, without one). Rows of equal doc_id are all
    written, in the order of their texts; a null doc_id is refused. Files hold
    about `file_bytes` of text each: their number follows the input. Returns
    (file, path, n_docs, n_ids), written as a table, files in doc_id order.
    An empty input gives no file.
    """
    docs = docs.select("doc_id", "text")
    seen = docs.agg(
        F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("k")
    ).first()
    if seen["n"] != seen["k"]:
        raise ValueError("doc_id must not be null")
    files = max(1, -(-((seen["b"] or 0) + 16 * seen["n"]) // file_bytes))
    ordered = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = number = None
        for piece in pieces(batches):
            if writer is None:
                encode = encoder(tokenizer_file)
                number = TaskContext.get().partitionId()
                path = f"{folder}/part-{number:07d}.tok"
                writer = Writer(path, max(encode.size, 1 + (end_id or 0)))
            ids, sizes = encode(column_of(piece, "text").to_pylist())
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(end_id))
                sizes = sizes + 1
            writer.add(column_of(piece, "doc_id").to_numpy(zero_copy_only=False), sizes, ids)
        if writer is not None:
            n, total = writer.close()
            yield pa.RecordBatch.from_pydict({"file": [number], "path": [path], "n_docs": [n], "n_ids": [total]})

    return cut_lineage(ordered.mapInArrow(write, "file long, path string, n_docs long, n_ids long"))


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files.

    start counts the ids of all documents before it, over all files. The file
    totals are one row per file, summed in file order.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    located = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    located = located.repartition(max(1, manifest.count()), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(column_of(batch, "path").to_pylist(), column_of(batch, "base").to_pylist(), strict=True):
                reader = Reader(path)
                n = len(reader.doc_ids)
                at = 0
                while at < n:  # some blocks' worth of documents at a time
                    to = max(at + 1, int(np.searchsorted(reader.starts, reader.starts[at] + 16 * reader.block)) - 1)
                    to = min(to, n)
                    starts = reader.starts[at : to + 1]
                    raw = memoryview(reader.ids(int(starts[0]), int(starts[-1])).astype("<u4").tobytes())
                    cuts = ((starts - starts[0]) * 4).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": reader.doc_ids[at:to],
                            "start": starts[:-1] + base,
                            "n_tokens": np.diff(starts),
                            "ids_crc32": np.array(
                                [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.int64
                            ),
                        }
                    )
                    at = to

    return located.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write the token files of all documents and return the digest of each, read back."""
    spark = docs.sparkSession
    folder = folder or new_run_dir(spark, "tokens")
    return read_token_files(spark, write_token_files(docs, folder, tokenizer_file, end_id))
