"""Token counts by a compiled finite-state transducer.

The merges of a BPE file become a deterministic transducer over the bytes of a
word. A state stands for all word beginnings after which every continuation is
cut alike; a transition carries by how much the token count of the beginning
changes, and the count of a word is the sum along its path. No merge is replayed
for a text: merges are consulted only while a transition is compiled, once.

Why it is exact: a cut of a word is the one that the merges give if and only if
each two neighbouring tokens are what the merges give for those two alone. Each
beginning of a word then has one last token, found from the last tokens of the
shorter beginnings. A state keeps those that a token still under way can follow.

Transitions are compiled when first needed and dropped together when there are
too many, so memory is bounded whatever the texts hold.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm.textblocks import column_of, pieces, utf8
from harrow.llm.wordcache import SPECIAL, PerWord, distinct_words, is_plain

KEPT_STATES = 250_000
CHUNK_CHARS = 1 << 16


def _byte_letters() -> list[str]:
    """The letter that byte-level files write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    rest = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Transducer:
    """Compiled merges of a tokenizer file whose words end in a suffix."""

    def __init__(self, tokenizer_file: str, kept_states: int = KEPT_STATES):
        with open(tokenizer_file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.kept_states = kept_states
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {
            (vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in reversed(list(enumerate(merges)))
        }
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.single = [vocab[c] for c in byte_of]
        self.last = [vocab[c + suffix] for c in byte_of]
        # a token as its bytes; the closing one of a word is marked
        self.tokens: dict[tuple[bytes, bool], int] = {}
        self.begun: set[bytes] = {b""}
        for text, number in vocab.items():
            closing = text.endswith(suffix)
            body = text[: -len(suffix)] if closing else text
            if not all(c in byte_of for c in body):
                continue
            raw = bytes(byte_of[c] for c in body)
            self.tokens[raw, closing] = number
            self.begun.update(raw[:i] for i in range(1, len(raw)))
        self.bytes_of = {number: key for key, number in self.tokens.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((b"", -1, 0),)
        self.number = {start: 0}
        self.states = [start]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def _merged(self, *tokens: int) -> list[int]:
        """What the merges give for the bytes of these tokens."""
        parts: list[int] = []
        for t in tokens:
            raw, closing = self.bytes_of[t]
            parts += [self.single[b] for b in raw]
            if closing:
                parts[-1] = self.last[raw[-1]]
        while len(parts) > 1:
            found = [(*self.ranks.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
            rank, new, _ = min(found)
            if rank == 1 << 60:
                break
            out, i = [], 0
            pair = next(p for p in zip(parts, parts[1:], strict=False) if self.ranks.get(p, (None,))[0] == rank)
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(new)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges leave these two apart and whole. left -1: the word begins."""
        key = left, right
        if key not in self._fits:
            if len(self._fits) > 4 * self.kept_states:
                self._fits.clear()
            alone = [right] if left < 0 else [left, right]
            self._fits[key] = self._merged(*alone) == alone
        return self._fits[key]

    def _last_token(self, state: tuple, byte: int, closing: bool) -> tuple[int, int]:
        """The last token after one more byte, and the count's change."""
        for under_way, before, tokens_since in state:
            token = self.tokens.get((under_way + bytes([byte]), closing))
            if token is not None and self._fit(before, token):
                return token, 1 - tokens_since
        raise AssertionError("every byte is a token")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: (next state, change of the count)."""
        alive = self.states[state]
        token, change = self._last_token(alive, byte, False)
        extended = [
            (under_way + bytes([byte]), before, since + change)
            for under_way, before, since in alive
            if under_way + bytes([byte]) in self.begun
        ]
        key = (*extended, (b"", token, 0))
        following = self.number.get(key)
        if following is None:
            following = self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][byte] = following, change
        return following, change

    def count(self, word: bytes) -> int:
        """How many tokens a word has."""
        if len(self.states) > self.kept_states:
            self._forget()
        state = total = 0
        steps = self.steps
        for byte in word[:-1]:
            move = steps[state].get(byte) or self.step(state, byte)
            state = move[0]
            total += move[1]
        end = 256 + word[-1]
        move = steps[state].get(end)
        if move is None:
            _, change = self._last_token(self.states[state], word[-1], True)
            move = steps[state][end] = 0, change
        return total + move[1]


def then(a: tuple, b: tuple, count) -> tuple:
    """One state map after another; associative.

    A map of a stretch of text is (head, tokens, tail): the part before its first
    space, which goes on from whatever came before; the tokens between its first
    and last space, the same from every state; and the part after the last space,
    which fixes the state it ends in. A stretch without space is (text, None, "").
    """
    if a[1] is None:
        return (a[0] + b[0], None, "") if b[1] is None else (a[0] + b[0], b[1], b[2])
    if b[1] is None:
        return a[0], a[1], a[2] + b[0]
    return a[0], a[1] + count(a[2] + b[0]) + b[1], b[2]


def scan(maps: list[tuple], count) -> list[tuple]:
    """The maps from the beginning up to and with each stretch, by doubling steps."""
    step = 1
    while step < len(maps):
        maps = maps[:step] + [then(maps[i - step], maps[i], count) for i in range(step, len(maps))]
        step *= 2
    return maps


class Counter:
    """Counts the tokens of whole texts in batches."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.machine = Transducer(tokenizer_file)
        # the library prepares texts beyond plain letters; the transducer counts their words too
        library = Tokenizer.from_file(tokenizer_file)
        self.normalise = library.normalizer.normalize_str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.cache = PerWord(lambda word: self.machine.count(word.encode()))

    def _other(self, text: str) -> int:
        total = 0
        for mark in SPECIAL:
            if mark in text:
                parts = text.split(mark)
                return len(parts) - 1 + sum(map(self._other, parts))
        for word, _ in self.cut(self.normalise(text)):
            total += self.machine.count(bytes(self.byte_of[c] for c in word))
        return total

    def _plain(self, texts: list[str]) -> np.ndarray:
        found, which, per_text = distinct_words(texts)
        per_word = np.array([self.cache[w] for w in found], np.int64)
        sums = np.concatenate(([0], np.cumsum(per_word[which]))) if len(found) else np.zeros(1, np.int64)
        return np.diff(sums[np.concatenate(([0], np.cumsum(per_text)))])

    def _stretch(self, text: str) -> tuple[str, str | None, str]:
        head, space, rest = text.partition(" ")
        if not space:
            return text, None, ""
        middle, _, tail = rest.rpartition(" ")
        return head, middle, tail

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens per text. A longer text is cut into stretches, mapped apart and composed."""
        stretches: list[str] = []
        plans: list[list | int] = []
        out = np.zeros(len(texts), np.int64)
        for i, text in enumerate(t or "" for t in texts):
            if not is_plain(text):
                out[i] = self._other(text)
                plans.append([])
                continue
            if len(text) <= CHUNK_CHARS:
                plans.append(len(stretches))
                stretches.append(text)
                continue
            plan = []
            for at in range(0, len(text), CHUNK_CHARS):
                head, middle, tail = self._stretch(text[at : at + CHUNK_CHARS])
                plan.append((head, None if middle is None else len(stretches), tail))
                if middle is not None:
                    stretches.append(middle)
            plans.append(plan)
        per_stretch = self._plain(stretches)

        def one(text: str) -> int:
            return int(self._plain([text])[0])

        for i, plan in enumerate(plans):
            if isinstance(plan, int):
                out[i] = per_stretch[plan]
            elif plan:
                maps = [(h, None if k is None else int(per_stretch[k]), t) for h, k, t in plan]
                head, middle, tail = scan(maps, one)[-1]
                out[i] = one(head) + (middle or 0) + one(tail)
        return out


@functools.cache
def counter(tokenizer_file: str) -> Counter:
    """One counter per worker process and file, kept from task to task."""
    return Counter(tokenizer_file)


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs, in one pass without a shuffle.

    docs holds doc_id and text; other columns are not read. A null text is an
    empty one: no bytes, no tokens. Repeated rows give repeated rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            text = column_of(piece, "text")
            n = counter(tokenizer_file).counts(text.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [column_of(piece, "doc_id"), pa.array(np.diff(utf8(text)[1])), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
