"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product of
its letters' vectors, the second rotated by one place and the third by two. A
text is the sum of its trigrams, a language the sum of its training texts; the
prediction is the language whose prototype has the largest cosine with the text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.textblocks import column_of, pieces

DIMENSIONS = 1024
_LETTERS = 128  # letter vectors; letters beyond a-z share them by code point
_BITS = 7
_BLOCK = 64
_LEARNT_BYTES = 1 << 18  # of text that are learnt from together; their arrays take some sixty times as much
_AT_ONCE = 1024  # trigrams whose vectors are made together: four megabytes
UNDETERMINED = "und"


@functools.cache
def _letter_codes() -> np.ndarray:
    """Code point -> 0 for anything but a letter, else the number of its letter vector."""
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = 0
    found = regex.findall(r"\p{L}", points.astype("<u4").tobytes().decode("utf-32-le"))
    letters = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    codes = np.zeros(0x110000, np.uint8)
    codes[letters] = 27 + (letters.astype(np.uint64) * 2654435761 >> 7) % (_LETTERS - 27)
    codes[97:123] = np.arange(1, 27)
    return codes


@functools.cache
def _letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    plain = np.random.default_rng(20240).choice(np.array([-1, 1], np.float32), (_LETTERS, DIMENSIONS))
    return plain, np.roll(plain, 1, axis=1), np.roll(plain, 2, axis=1)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vector of each trigram number."""
    first, second, third = _letter_vectors()
    out = first[grams >> (2 * _BITS)]
    out *= second[(grams >> _BITS) & (_LETTERS - 1)]
    out *= third[grams & (_LETTERS - 1)]
    return out


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers of all texts, the text of each, and whether each text has a letter.

    Texts are lower-cased; a run of anything but letters counts as one gap, and a
    text begins and ends with one.
    """
    wrapped = [f"\n{t.lower()}\n" if t else "\n\n" for t in texts]
    whole = "".join(wrapped)
    codes = _letter_codes()[np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)]
    edges = np.cumsum([0, *map(len, wrapped)])
    letter = codes > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[edges[:-1]] = True
    keep[edges[1:] - 1] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    codes = codes[keep].astype(np.int32)
    sizes = np.diff(kept[edges])
    seen = np.concatenate(([0], np.cumsum(letter)))
    has_letter = np.diff(seen[edges]) > 0
    text = np.repeat(np.arange(len(texts)), sizes)
    numbers = codes[:-2] << (2 * _BITS) | codes[1:-1] << _BITS | codes[2:]
    inside = text[:-2] == text[2:]
    return numbers[inside], text[:-2][inside], has_letter


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """language -> unit prototype, bundled from all rows of docs (text, lang) whose lang is known.

    Each task sends one partial prototype per language, in blocks that Spark adds
    up. What reaches the driver is one vector per language. Texts that are null or
    have no letter add nothing; without any row there is no language.
    """
    rows = docs.select("text", "lang").where("lang is not null and text is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[int, int]] = {}
        for piece in pieces(batches, limit=_LEARNT_BYTES):
            numbers, text, has_letter = grams(column_of(piece, "text").to_pylist())
            langs = np.array(column_of(piece, "lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                counts = np.bincount(numbers[((langs == lang) & has_letter)[text]], minlength=1)
                total = totals.setdefault(lang, {})
                there = np.flatnonzero(counts)
                for g, n in zip(there.tolist(), counts[there].tolist(), strict=True):
                    total[g] = total.get(g, 0) + n
        for lang, total in totals.items():
            vector = np.zeros(DIMENSIONS)
            found, counts = np.array(list(total), np.int64), np.array(list(total.values()), np.float64)
            for at in range(0, len(found), _AT_ONCE):
                vector += counts[at : at + _AT_ONCE] @ gram_vectors(found[at : at + _AT_ONCE])
            for block in range(0, DIMENSIONS, _BLOCK):
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang], "block": [block], "part": [vector[block : block + _BLOCK].tolist()]}
                )

    sums = (
        rows.mapInArrow(bundle, "lang string, block long, part array<double>")
        .groupBy("lang", "block")
        .agg(F.array(*[F.sum(F.col("part")[i]) for i in range(_BLOCK)]).alias("part"))
        .collect()
    )
    out: dict[str, np.ndarray] = {}
    for row in sums:
        out.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["block"] : row["block"] + _BLOCK] = row["part"]
    return {lang: v / np.linalg.norm(v) for lang, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], *kept: Column) -> DataFrame:
    """The kept columns of each row with lang_pred and score, the cosine (0 if negative).

    A text that is null or has no letter is `und` with score 0, as is every text
    when nothing was learned. Equal cosines go to the language first in the
    alphabet. One pass, no shuffle; repeated rows give repeated rows.
    """
    langs = np.array([*prototypes, UNDETERMINED], object)
    matrix = np.array([*prototypes.values()], np.float32).reshape(-1, DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text"):
            column = column_of(piece, "_text")
            numbers, text, has_letter = grams(column.to_pylist())
            found, which = np.unique(numbers, return_inverse=True)
            vectors = np.zeros((len(column), DIMENSIONS), np.float32)
            for at in range(0, len(found), _AT_ONCE):
                # texts by distinct trigrams, a thousand trigrams at a time
                own = (which >= at) & (which < at + _AT_ONCE)
                width = min(_AT_ONCE, len(found) - at)
                counts = np.bincount(text[own] * width + which[own] - at, minlength=len(column) * width)
                vectors += counts.reshape(len(column), width).astype(np.float32) @ gram_vectors(found[at : at + width])
            norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
            if len(matrix):
                cosines = (vectors @ matrix.T) / np.maximum(norms, 1e-300)[:, None]
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
            else:
                best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
            unknown = ~has_letter | (norms == 0)
            best = np.where(unknown | (len(matrix) == 0), len(matrix), best)
            score = np.where(unknown, 0.0, score).astype(np.float64)
            columns = [piece.column(i) for i, n in enumerate(piece.schema.names) if n != "_text"]
            names = [n for n in piece.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs[best].tolist(), pa.string()), pa.array(score)], [*names, "lang_pred", "score"]
            )

    wanted = docs.select(*kept, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name != "_text")
    return wanted.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: a fifth, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text, lang).

    Learns from the rows that are not held out and have a lang; lang is never an
    input of a prediction.
    """
    prototypes = learn(docs.where(~held_out()))
    return predict(docs, prototypes, F.col("doc_id"), held_out().alias("held_out"))
