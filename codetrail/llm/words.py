"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a longest run of ASCII letters or digits and of characters beyond ASCII, in lower case; everything else
separates words.  No word crosses a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from codetrail.llm.common import mix

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_IS_LETTER = _IS_WORD.copy()
_IS_LETTER[48:58] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            table = np.full(size, _BASE, dtype=np.uint64)
            table[0] = 1
            _POWERS = np.multiply.accumulate(table)
    return _POWERS


@dataclass
class Words:
    data: np.ndarray      #: bytes of all texts in lower case, one zero byte after each
    text_start: np.ndarray  #: first byte of each text, and the end of the data
    start: np.ndarray     #: first byte of each word
    end: np.ndarray       #: past its last byte
    hash: np.ndarray      #: 64-bit hash of each word
    first: np.ndarray     #: for each text its first word, and the number of words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[str], letters_only: bool = False, longest: int | None = None) -> Words:
    """Words of ``texts``.  ``letters_only``: digits separate too.  ``longest``: cut words into parts of about so many bytes,
    at character limits (a part has at most three bytes more)."""
    encoded = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter((len(e) + 1 for e in encoded), dtype=np.int64, count=len(encoded))
    text_start = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"\0".join(encoded) + b"\0", dtype=np.uint8) if encoded else np.zeros(0, np.uint8)
    inside = (_IS_LETTER if letters_only else _IS_WORD)[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if longest is not None and len(start) and int((end - start).max()) > longest:
        pieces = -(-(end - start) // longest)
        within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        new = np.repeat(start, pieces) + within * longest
        for _ in range(3):
            new -= (within > 0) & ((data[new] & 0xC0) == 0x80)
        last = np.cumsum(pieces) - 1
        stop = np.append(new[1:], 0)
        stop[last] = end
        end, start = stop, new
    return Words(data, text_start, start, end, hash_spans(data, start, end),
                 np.searchsorted(start, text_start).astype(np.int64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A hash of the bytes of each non-empty span, worked out for about ``block`` bytes at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    ends = np.cumsum(end - start)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
        length = end[at:stop] - start[at:stop]
        first = np.cumsum(length) - length
        within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
        value = data[np.repeat(start[at:stop], length) + within].astype(np.uint64)
        with np.errstate(over="ignore"):
            total = np.add.reduceat((value + np.uint64(1)) * _powers(int(length.max()))[within], first)
            out[at:stop] = mix(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    return out


def keyed_hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """As ``hash_spans``, but every byte is mixed with its place before the sum, so that no pattern of bytes cancels out:
    words with a hash in common are as rare as among random numbers, whatever the texts."""
    out = np.empty(len(start), dtype=np.uint64)
    ends = np.cumsum(end - start)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
        length = end[at:stop] - start[at:stop]
        first = np.cumsum(length) - length
        within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
        value = data[np.repeat(start[at:stop], length) + within].astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = mix(np.arange(int(length.max()), dtype=np.uint64) * np.uint64(_BASE) + np.uint64(_BASE))
            total = np.add.reduceat(mix(keys[within] + (value + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)), first)
            out[at:stop] = mix(total + length.astype(np.uint64) * np.uint64(_BASE))
        at = stop
    return out


def shingles_of(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``n`` successive words: hashes sorted in each text, and for each text its first one (and the
    end).  A text of fewer words has one shingle of all its words; a text without words has none."""
    h, count = words.hash, words.counts()
    with np.errstate(over="ignore"):
        if len(h) >= n:
            sums = sum(h[k:len(h) - n + 1 + k] * np.uint64(2 * k + 1) * np.uint64(_BASE) for k in range(n))
        else:
            sums = np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
        within = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(count - n + 1, 0)) - np.maximum(count - n + 1, 0),
                                                  np.maximum(count - n + 1, 0))
        value = mix(sums[words.first[text] + within]) if len(text) else np.zeros(0, np.uint64)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            whole = np.array([np.bitwise_xor.reduce(mix(h[words.first[t]:words.first[t + 1]]
                                                        + np.arange(count[t], dtype=np.uint64)))
                              for t in short], dtype=np.uint64)
            text, value = np.concatenate([text, short]), np.concatenate([value, whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[fresh], value[fresh]
    return value, np.searchsorted(text, np.arange(len(count) + 1))
