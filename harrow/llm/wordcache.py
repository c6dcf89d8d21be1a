"""Words of a tokenizer file with word ends, for whole batches of texts at a time.

word_bpe_49k.json splits a text into words before its merges, and no token
crosses two words. What the library gives for a text is therefore what it gives
for its words, one after another, and a batch needs each distinct word once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import regex

from harrow.llm.textblocks import mixed, powers

# The pattern of the file's pre-tokenizer, and the strings it takes as special tokens.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")

KEPT_WORDS = 1 << 19

# Letters below this code point keep their UTF-8 length in lower case and have no combining forms.
_PLAIN = 0x180
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u017f]")  # without the dotted capital I
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)
_KIND = np.array(
    [
        _LETTER if regex.match(r"\p{L}", chr(c))
        else _DIGIT if regex.match(r"\p{N}", chr(c))
        else _SPACE if regex.match(r"\s", chr(c))
        else _OTHER
        for c in range(_PLAIN)
    ],
    np.uint8,
)
_CODES = mixed(np.arange(1, _PLAIN + 1, dtype=np.uint64))


class PerWord(dict):
    """word -> result, asked for once and kept; emptied when it holds too many words."""

    def __init__(self, ask: Callable[[str], object], limit: int = KEPT_WORDS):
        super().__init__()
        self.ask, self.limit = ask, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        self[word] = out = self.ask(word)
        return out


def is_plain(text: str) -> bool:
    """Whether the words of a text can be found by character class alone."""
    if not text.isascii() and _BEYOND.search(text):
        return False
    return "<|" not in text or not any(s in text for s in SPECIAL)


def _starts(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and the kind of each character. first: where each text begins."""
    n = len(codes)
    kind = _KIND[codes]
    before = np.full(n, _SPACE, np.uint8)
    before[1:] = kind[:-1]
    before[first] = _SPACE
    begins = (kind == _DIGIT) | ((kind != _SPACE) & (kind != before))
    quotes = np.flatnonzero((codes == ord("'")) & (before != _OTHER))
    if len(quotes):
        text_end = np.append(first[1:], n)[np.searchsorted(first, quotes, side="right") - 1]
        padded = np.append(codes, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        one = np.where(quotes + 1 < text_end, one, 0)
        two = np.where(quotes + 2 < text_end, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        long = np.logical_or.reduce(pair)
        for found, size in ((short, 2), (long, 3)):
            at = quotes[found]
            for i in range(1, size):
                begins[at + i] = False
            ends = text_end[found]
            after = at + size
            after = after[after < ends]
            begins[after[kind[after] == _LETTER]] = True
    return begins, kind


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of plain texts, which of them each text's words are, and words per text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    whole = "".join(texts).lower()
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    first = edges[:-1][sizes > 0]
    if not len(codes):
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    begins, kind = _starts(codes, first)
    n = len(codes)
    stops = np.ones(n, bool)
    stops[:-1] = begins[1:] | (kind[1:] == _SPACE)
    stops &= kind != _SPACE
    stops[edges[1:][sizes > 0] - 1] |= kind[edges[1:][sizes > 0] - 1] != _SPACE
    at, to = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[codes] * up[:n], out=sums[1:])
    keys = mixed((sums[to] - sums[at]) * down[at] + _CODES[np.minimum(to - at, _PLAIN - 1)])
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    which = order[fresh]
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    begin, end = at[which].tolist(), to[which].tolist()
    found = [whole[a:b] for a, b in zip(begin, end, strict=True)]
    return found, back, np.diff(np.searchsorted(at, edges))
