"""Two-stage suffix sorting in numpy, to a bounded depth.

A suffix is of type B if it is smaller than the one after it, else of type A.  Only type B suffixes are sorted directly,
by up to ``DEPTH`` symbols; type A suffixes are induced: buckets are scanned by their first symbol, and the suffix before
each one scanned goes, in that order, to the end of the A part of its own bucket.  Suffixes that agree in DEPTH symbols
stand side by side in any order, which is all that common prefixes of up to DEPTH symbols need.
"""

from __future__ import annotations

import numpy as np

#: Symbols 0..256 take nine bits; seven of them make a key.
BITS, PER_KEY = 9, 7
DEPTH = 56


def keys(text: np.ndarray) -> np.ndarray:
    """For each position the next seven symbols as one number; past the end stand zeros."""
    out = np.zeros(len(text), dtype=np.uint64)
    padded = np.append(text, np.zeros(PER_KEY, text.dtype)).astype(np.uint64)
    for k in range(PER_KEY):
        out = (out << np.uint64(BITS)) | padded[k:k + len(text)]
    return np.append(out, np.zeros(DEPTH, np.uint64))


def is_type_a(text: np.ndarray) -> np.ndarray:
    """Where the suffix is larger than the one after it; the empty suffix is the smallest."""
    following = np.append(text[1:], -1).astype(np.int32)
    differs = np.flatnonzero(text != following)
    return (text > following)[differs[np.searchsorted(differs, np.arange(len(text)))]]


def sort_directly(positions: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The positions in the order of the DEPTH symbols there: by seven of them, then again where those tie."""
    order = positions[np.argsort(key[positions], kind="stable")]
    first = key[order]
    tied = np.zeros(len(order), bool)
    same = first[1:] == first[:-1]
    tied[1:] |= same
    tied[:-1] |= same
    group = np.cumsum(np.append(0, ~same)) if len(order) else np.zeros(0, np.int64)
    for depth in range(PER_KEY, DEPTH, PER_KEY):
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own, value = order[at], key[order[at] + depth]
        by = np.lexsort((value, group[at]))
        order[at] = own[by]
        value, g = value[by], group[at]
        same = (value[1:] == value[:-1]) & (g[1:] == g[:-1])
        more = np.zeros(len(at), bool)
        more[1:] |= same
        more[:-1] |= same
        tied[at] = more
        group[at] = np.cumsum(np.append(0, ~same))
    return order


def suffix_order(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """All positions of ``text`` (symbols 0..256) in the order of their suffixes, up to DEPTH symbols."""
    a = is_type_a(text)
    direct = sort_directly(np.flatnonzero(~a), key)
    starts = np.searchsorted(text[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[a[before]]
        symbol = text[before]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        edge = np.flatnonzero(np.diff(symbol)) + 1
        if len(before):
            for s, own in zip(symbol[np.append(0, edge)].tolist(), np.split(before, edge), strict=True):
                waiting[s].append(own)

    induce(np.array([len(text)]))
    out = []
    for c in range(257):
        while waiting[c]:
            own = np.concatenate(waiting[c])
            waiting[c] = []
            out.append(own)
            induce(own)
        own = direct[starts[c]:starts[c + 1]]
        out.append(own)
        induce(own)
    return np.concatenate(out)


def common_prefixes(order: np.ndarray, key: np.ndarray, most: int) -> np.ndarray:
    """For each suffix of the order the length of its common prefix with the one before it, up to ``most`` (0 first)."""
    out = np.zeros(len(order), dtype=np.int64)
    at = np.arange(1, len(order))
    depth = 0
    while len(at) and depth < most:
        x, y = key[order[at] + depth], key[order[at - 1] + depth]
        for k in range(1, PER_KEY + 1):
            shift = np.uint64(BITS * (PER_KEY - k))
            same = (x >> shift) == (y >> shift)
            if not same.all():
                at, x, y = at[same], x[same], y[same]
            out[at] = depth + k
        depth += PER_KEY
    return np.minimum(out, most)
