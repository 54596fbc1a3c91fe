"""Operator 10: removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``LENGTH`` (50) bytes that covers it also starts in a document with a smaller doc_id.  What
has to be known is, for each 50-byte window, the smallest document that holds it.

Windows meet by content.  Each window has an anchor: of its 24-byte strings the one with the smallest hash, the first of
equals.  Equal windows have equal anchors, and neighbouring windows mostly share one: such a run, with the bytes it
covers, is a segment.  All steps are one plan over documents dealt into blocks of about ``BLOCK_BYTES``:

1. each block lists its distinct anchor hashes, dealt into ranges of the hash; a range finds the anchors that are in
   several documents and tells the blocks that have them;
2. the blocks send the distinct segments of those anchors, with their smallest and largest document, to the same ranges;
3. a range sorts the suffixes of its distinct segments in two stages (``suffix_sort``), groups windows by adjacent common
   prefixes of 50 bytes, takes each group's smallest document, and returns the runs that matter to the blocks;
4. the blocks mark the covered bytes of their documents.

A block sends an anchor or a segment once, however many of its documents share it, so a passage that a third of all
documents hold costs one entry per block.  A common string of 24 to 49 bytes in varied surroundings makes a segment per
occurrence instead.  The blocks count the segments of an anchor (as a power of two); an anchor that has more than
``MOST_SEGMENTS`` isn't sorted: its windows, distinct within a block, go to ranges by the hash of all their 50 bytes.  Anchors that occur in one distinct segment need no sorting: its documents
share all its windows.  The text is shuffled once; later steps use the same exchange again.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrail.llm.common import mix
from codetrail.llm.suffix_sort import common_prefixes, keys, suffix_order
from codetrail.llm.words import hash_spans

LENGTH = 50
GRAM = 24
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
#: Distinct segments of an anchor, added up over the blocks, above which its windows are compared one by one.
MOST_SEGMENTS = 1 << 14
_LAST = np.iinfo(np.int64).max
_GEAR = np.random.default_rng(20240310).integers(0, 1 << 32, 256, dtype=np.uint32)


class Block:
    """The documents of a block as one byte array, and the segments of their windows."""

    def __init__(self, table: pa.Table):
        texts = [(t or "").encode() for t in table["text"].to_pylist()]
        self.ids = np.array([_LAST if i is None else i for i in table["doc_id"].to_pylist()], dtype=np.int64)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.append(0, np.cumsum(self.size))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self._segments()

    def _segments(self) -> None:
        """first, last: first and last window of each segment; anchor: its anchor's position; doc: its document."""
        n = len(self.data) - LENGTH + 1
        none = np.zeros(0, np.int64)
        self.first, self.last, self.anchor, self.doc = none, none, none, none
        if n <= 0:
            return
        # hash of 24 bytes from hashes of 1, 2, 4, 8 and 16 bytes
        h, parts = _GEAR[self.data], {}
        for width in (1, 2, 4, 8):
            h = h[:-width] * np.uint32(0x9E3779B1 + 2 * width) + h[width:]
            parts[2 * width] = h
        m = len(self.data) - GRAM + 1
        gram = (parts[16][:m] * np.uint32(0x85EBCA6B) + parts[8][16:16 + m]) * np.uint32(0xC2B2AE35)
        gram ^= gram >> np.uint32(15)
        low = (gram.astype(np.uint64) << np.uint64(32)) | np.arange(m, dtype=np.uint64)
        width, most = 1, LENGTH - GRAM + 1
        while 2 * width <= most:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < most:
            low = np.minimum(low[:len(low) - (most - width)], low[most - width:])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
        inside = np.zeros(n + 1, dtype=np.int8)
        whole = self.size >= LENGTH
        np.add.at(inside, self.start[:-1][whole], 1)
        np.add.at(inside, self.start[:-1][whole] + self.size[whole] - LENGTH + 1, -1)
        valid = np.cumsum(inside[:n], dtype=np.int8) > 0
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        begins = self.start[:-1][whole]
        new[begins] = True
        self.first = np.flatnonzero(new & valid)
        ends = np.flatnonzero(~valid)
        stop = np.append(self.first[1:], n)
        cut = np.append(ends, n)
        self.last = np.minimum(stop, cut[np.searchsorted(cut, self.first)]) - 1
        self.anchor = at[self.first]
        self.doc = np.searchsorted(self.start, self.first, side="right") - 1

    def anchor_hashes(self) -> np.ndarray:
        return gram_hashes(self.data, self.anchor)

    def text_hashes(self, chosen: np.ndarray) -> np.ndarray:
        return hash_spans(self.data, self.first[chosen], self.last[chosen] + LENGTH)

    def texts_by_anchor(self, hashes: np.ndarray, by: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """How many distinct segments each anchor has.  ``by``: segments in the order of their anchors' ``hashes``;
        ``edge``: where in that order an anchor begins."""
        size = np.diff(np.append(edge, len(by)))
        several = np.repeat(size > 1, size)
        text, group = self.text_hashes(by[several]), np.repeat(np.arange(len(edge)), size)[several]
        order = np.lexsort((text, group))
        text, group = text[order], group[order]
        new = np.append(True, (text[1:] != text[:-1]) | (group[1:] != group[:-1]))[:len(text)]
        return np.maximum(np.bincount(group[new], minlength=len(edge)), 1)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of segments: where in ``chosen`` their segment is, and their position."""
        n = self.last[chosen] + 1 - self.first[chosen]
        segment = np.repeat(np.arange(len(chosen)), n)
        return segment, np.arange(len(segment)) - (np.cumsum(n) - n)[segment] + self.first[chosen][segment]

    def chosen(self, anchors: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Segments whose anchor hash is in the sorted ``wanted``."""
        if not len(wanted) or not len(anchors):
            return np.zeros(0, np.int64)
        return np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, anchors), len(wanted) - 1)] == anchors)


def gram_hashes(data: np.ndarray, at: np.ndarray, length: int = GRAM) -> np.ndarray:
    """64-bit hash of the 24 bytes (or ``length``, at least 8) at each position."""
    if not len(at):
        return np.zeros(0, np.uint64)
    wide = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    h = np.full(len(at), 0x243F6A8885A308D3, dtype=np.uint64)
    for k in range(0, length, 8):
        h = mix(h ^ wide[at + min(k, length - 8)])
    return h


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    first = np.cumsum(length) - length
    return data[np.arange(int(length.sum())) - np.repeat(first, length) + np.repeat(start, length)]


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each with its length in bytes in front, compressed."""
    raw = b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unsqueeze(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at:at + 8], "little")
        out.append(np.frombuffer(raw[at + 8:at + 8 + n], kind))
        at += 8 + n
    return out


def _columns(blobs: pa.ChunkedArray, **kinds: str) -> dict[str, np.ndarray]:
    """The arrays of all blobs that aren't null, by name."""
    parts = [_unsqueeze(b, *kinds.values()) for b in blobs.to_pylist() if b]
    return {name: np.concatenate([np.zeros(0, kind), *(p[k] for p in parts)]) for k, (name, kind) in enumerate(kinds.items())}


def _table(**columns) -> pa.Table:
    return pa.table({k: pa.array(v, pa.binary() if k in ("blob", "windows") else pa.int64()) for k, v in columns.items()})


def removed_mask(block: Block, found: dict[str, np.ndarray], windows: dict[str, np.ndarray]) -> np.ndarray:
    """A flag per byte of the block.  ``found``: anchor and text hash of segments, with the number of their runs; runs of
    windows (first one, how many) and the smallest document that holds them.  ``windows``: anchor and text hash of single
    windows, and that document."""
    cover = np.zeros(len(block.data) + 1, dtype=np.int32)
    anchors = block.anchor_hashes()
    own = block.chosen(anchors, np.unique(windows["anchor"]))
    if len(own):
        key, first = np.unique(_pair_key(windows["anchor"], windows["text"]), return_index=True)
        segment, start = block.windows(own)
        mine = _pair_key(anchors[own][segment], gram_hashes(block.data, start, LENGTH))
        at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        start = start[(key[at] == mine) & (block.ids[block.doc[own[segment]]] > windows["least"][first[at]])]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + LENGTH, -1)
    own = block.chosen(anchors, np.unique(found["anchor"]))
    if len(own):
        by = np.lexsort((found["text"], found["anchor"]))
        runs_at = np.append(0, np.cumsum(found["runs"]))
        key = _pair_key(found["anchor"][by], found["text"][by])
        key, first = np.unique(key, return_index=True)
        mine = _pair_key(anchors[own], block.text_hashes(own))
        at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        ok = key[at] == mine
        own, entry = own[ok], by[first[at[ok]]]
        n = found["runs"][entry]
        run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs_at[entry], n)
        seg = np.repeat(own, n)
        later = block.ids[block.doc[seg]] > found["least"][run]
        start = block.first[seg[later]] + found["from"][run[later]]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + found["count"][run[later]] - 1 + LENGTH, -1)
    return np.cumsum(cover[:-1]) > 0


def _pair_key(anchor: np.ndarray, text: np.ndarray) -> np.ndarray:
    out = np.empty(len(anchor), dtype=[("a", "<u8"), ("t", "<u8")])
    out["a"], out["t"] = anchor, text
    return out


def smallest_documents(data: np.ndarray, length: np.ndarray, least: np.ndarray,
                       sort_us: np.ndarray) -> list[np.ndarray]:
    """Runs of windows of each segment text with the smallest document that holds them: how many runs each segment has,
    their first window, window count and document.  Only the texts flagged in ``sort_us`` can share windows."""
    start = np.cumsum(length) - length
    windows = length - LENGTH + 1
    least_of = np.repeat(least, windows)
    window_at = np.cumsum(windows) - windows
    chosen = np.flatnonzero(sort_us)
    if len(chosen):
        size = length[chosen] + 1
        place = np.cumsum(size) - size
        text = np.zeros(int(size.sum()), dtype=np.int16)
        body = np.ones(len(text), bool)
        body[place + length[chosen]] = False
        text[body] = _gather(data, start[chosen], length[chosen]).astype(np.int16) + 1
        key = keys(text)
        order = suffix_order(text, key)
        prefix = common_prefixes(order, key, LENGTH)
        owner = np.repeat(np.arange(len(chosen)), size)
        inside = np.arange(len(text)) - place[owner]
        full = inside < windows[chosen][owner]
        # a group: suffixes side by side that share LENGTH bytes; suffixes without a whole window stand alone
        group = np.cumsum(prefix < LENGTH) - 1
        ok = full[order]
        who, group = order[ok], group[ok]
        edge = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(who) else np.zeros(0, np.int64)
        doc = least[chosen[owner[who]]]
        if len(edge):
            low = np.minimum.reduceat(doc, edge)
            each = np.repeat(low, np.diff(np.append(edge, len(who))))
            least_of[window_at[chosen[owner[who]]] + inside[who]] = each
    segment = np.repeat(np.arange(len(length)), windows)
    new = np.append(True, (segment[1:] != segment[:-1]) | (least_of[1:] != least_of[:-1])) if len(segment) else \
        np.zeros(0, bool)
    at = np.flatnonzero(new)
    return [np.bincount(segment[at], minlength=len(length)), at - window_at[segment[at]],
            np.diff(np.append(at, len(segment))), least_of[at]]


def repeated_strings(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id integer, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts count as UTF-8, null as empty; texts under 50 bytes lose nothing.  Strings that start twice in one document, or
    in documents of the same doc_id (a repeated row), don't count; a null doc_id counts as larger than all others.
    Repeated rows give repeated rows, an empty table none; other columns aren't read.
    """
    total = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, ranges = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / range_bytes))
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long").alias("block"))

    def list_anchors(table: pa.Table) -> pa.Table:
        block = Block(table)
        hashes = block.anchor_hashes()
        by = np.argsort(hashes, kind="stable")
        hashes, doc = hashes[by], block.ids[block.doc[by]]
        edge = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        if not len(edge):
            return _table(range=[], block=[], blob=[])
        # in a byte: whether several documents have the anchor, and the power of two of its segments
        several = (np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge)).astype(np.uint8)
        several |= ((np.frexp(block.texts_by_anchor(hashes, by, edge))[1] - 1) << 1).astype(np.uint8)
        hashes = hashes[edge]
        own = _range_of(hashes, ranges)
        cut = np.flatnonzero(np.diff(own)) + 1
        return _table(range=own[np.append(0, cut)], block=[table["block"][0].as_py()] * (len(cut) + 1),
                      blob=[h.tobytes() + s.tobytes() for h, s in zip(np.split(hashes, cut), np.split(several, cut),
                                                                      strict=True)])

    def share_anchors(table: pa.Table) -> pa.Table:
        blobs = table["blob"].to_pylist()
        n = np.array([len(b) // 9 for b in blobs])
        hashes = np.frombuffer(b"".join(b[:8 * k] for b, k in zip(blobs, n, strict=True)), "<u8")
        flags = np.frombuffer(b"".join(b[8 * k:] for b, k in zip(blobs, n, strict=True)), np.uint8)
        distinct, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[which[(flags & 1) > 0]] = True
        hot = np.bincount(which, weights=np.exp2(flags >> 1), minlength=len(distinct)) > MOST_SEGMENTS
        cut = np.cumsum(n)[:-1]
        parts, hot_parts = ([h[k].tobytes() for h, k in zip(np.split(hashes, cut), np.split(keep[which], cut), strict=True)]
                            for keep in (shared & ~hot, shared & hot))
        full = [i for i in range(len(parts)) if parts[i] or hot_parts[i]]
        block = table["block"].to_pylist()
        return _table(block=[block[i] for i in full], blob=[parts[i] for i in full], windows=[hot_parts[i] for i in full])

    def send_segments(docs_: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs_.num_rows or not shared.num_rows:
            return _table(range=[], block=[], blob=[], windows=[])
        block = Block(docs_)
        anchors = block.anchor_hashes()

        def wanted(column: str) -> np.ndarray:
            return block.chosen(anchors, np.sort(np.frombuffer(b"".join(shared[column].to_pylist()), "<u8")))

        def distinct(anchor: np.ndarray, text: np.ndarray, doc: np.ndarray, by_text: bool) -> list[tuple]:
            """Range, first of equals, smallest and largest document, for each range."""
            by = np.lexsort((doc, anchor, text) if by_text else (doc, text, anchor))
            anchor, text, doc = anchor[by], text[by], doc[by]
            edge = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))[:len(by)])
            if not len(edge):
                return []
            most = np.maximum.reduceat(doc, edge)
            where = _range_of((text if by_text else anchor)[edge], ranges)
            cut = np.append(np.flatnonzero(np.append(True, where[1:] != where[:-1])), len(edge))
            return [(int(where[x]), by[edge[x:y]], doc[edge[x:y]], most[x:y]) for x, y in zip(cut, cut[1:], strict=False)]

        blobs, windows = {}, {}
        own = wanted("blob")
        for k, one, doc, most in distinct(anchors[own], block.text_hashes(own), block.ids[block.doc[own]], False):
            mine = own[one]
            length = block.last[mine] + LENGTH - block.first[mine]
            blobs[k] = _squeeze(_gather(block.data, block.first[mine], length), length.astype("u1"),
                                (block.anchor[mine] - block.first[mine]).astype("u1"), doc, most)
        own = wanted("windows")
        segment, start = block.windows(own)
        anchor, text = anchors[own][segment], gram_hashes(block.data, start, LENGTH)
        for k, one, doc, most in distinct(anchor, text, block.ids[block.doc[own[segment]]], True):
            windows[k] = _squeeze(anchor[one], text[one], doc, most)
        at = sorted(blobs.keys() | windows.keys())
        return _table(range=at, block=[docs_["block"][0].as_py()] * len(at), blob=[blobs.get(k) for k in at],
                      windows=[windows.get(k) for k in at])

    def compare_segments(table: pa.Table) -> pa.Table:
        sent_ = [(k, b) for k, b in zip(table["block"].to_pylist(), table["blob"].to_pylist(), strict=True) if b]
        if not sent_:
            return _table(block=[], blob=[], windows=[])
        parts = [_unsqueeze(b, "u1", "u1", "u1", "<i8", "<i8") for _, b in sent_]
        data, length, offset, least, most = (np.concatenate([p[k] for p in parts]) for k in range(5))
        length = length.astype(np.int64)
        start = np.cumsum(length) - length
        sender = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        anchor, text = gram_hashes(np.append(data, np.zeros(8, np.uint8)), start + offset), \
            hash_spans(data, start, start + length)
        by = np.lexsort((text, anchor))
        new = np.append(True, (anchor[by][1:] != anchor[by][:-1]) | (text[by][1:] != text[by][:-1]))
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        edge = np.flatnonzero(new)
        one = by[edge]
        low = np.minimum.reduceat(least[by], edge)
        alone = anchor[one]
        twin = np.zeros(len(one), bool)
        same = alone[1:] == alone[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        runs, begin, count, doc = smallest_documents(_gather(data, start[one], length[one]), length[one], low, twin)
        at = np.cumsum(runs) - runs
        lowest = np.minimum.reduceat(doc, at)
        matters = most > lowest[which]
        out = {"block": [], "blob": []}
        order = np.flatnonzero(matters)
        cut = np.searchsorted(sender[order], np.arange(len(parts) + 1))
        for k in range(len(parts)):
            mine = which[order[cut[k]:cut[k + 1]]]
            if len(mine):
                n = runs[mine]
                run = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[mine], n)
                out["block"].append(sent_[k][0])
                out["blob"].append(_squeeze(anchor[one[mine]], text[one[mine]], n.astype("u1"), begin[run].astype("u1"),
                                            count[run].astype("u1"), doc[run]))
        return _table(**out, windows=[None] * len(out["block"]))

    def compare_windows(table: pa.Table) -> pa.Table:
        sent_ = [(k, b) for k, b in zip(table["block"].to_pylist(), table["windows"].to_pylist(), strict=True) if b]
        if not sent_:
            return _table(block=[], blob=[], windows=[])
        parts = [_unsqueeze(b, "<u8", "<u8", "<i8", "<i8") for _, b in sent_]
        anchor, text, least, most = (np.concatenate([p[k] for p in parts]) for k in range(4))
        by = np.lexsort((anchor, text))
        new = np.append(True, (text[by][1:] != text[by][:-1]) | (anchor[by][1:] != anchor[by][:-1]))
        lowest = np.empty(len(by), np.int64)
        lowest[by] = np.minimum.reduceat(least[by], np.flatnonzero(new))[np.cumsum(new) - 1]
        matters, out, stop = most > lowest, {"block": [], "windows": []}, 0
        for (block, _), p in zip(sent_, parts, strict=True):
            start, stop = stop, stop + len(p[0])
            mine = start + np.flatnonzero(matters[start:stop])
            if len(mine):
                out["block"].append(block)
                out["windows"].append(_squeeze(anchor[mine], text[mine], lowest[mine]))
        return _table(**out, blob=[None] * len(out["block"])).select(["block", "blob", "windows"])

    def compare(table: pa.Table) -> pa.Table:
        return pa.concat_tables([compare_segments(table), compare_windows(table)])

    def remove(docs_: pa.Table, found: pa.Table) -> pa.Table:
        block = Block(docs_)
        mask = np.zeros(len(block.data), bool)
        if found.num_rows:
            columns = _columns(found["blob"], anchor="<u8", text="<u8", runs="u1", **{"from": "u1"}, count="u1", least="<i8")
            mask = removed_mask(block, {k: v.astype(np.int64) if v.dtype == np.uint8 else v for k, v in columns.items()},
                                _columns(found["windows"], anchor="<u8", text="<u8", least="<i8"))
        gone = np.append(0, np.cumsum(mask))
        starts = np.append(0, np.cumsum(mask & ~np.append(False, mask[:-1])))
        a, b = block.start[:-1], block.start[1:]
        # a run that goes on from the text before begins anew at a text's first byte
        carried = np.array([bool(y > x and x > 0 and mask[x] and mask[x - 1]) for x, y in zip(a.tolist(), b.tolist(),
                                                                                               strict=True)], dtype=np.int64)
        kept = [hashlib.sha256(block.data[x:y][~mask[x:y]].tobytes()).hexdigest() for x, y in zip(a, b, strict=True)]
        return pa.table({"doc_id": docs_["doc_id"], "n_bytes": pa.array(block.size),
                         "n_removed": pa.array((gone[b] - gone[a]).astype(np.int64)),
                         "n_spans": pa.array((starts[b] - starts[a] + carried).astype(np.int64)),
                         "kept_sha256": pa.array(kept, pa.string())})

    listed = own.groupBy("block").applyInArrow(list_anchors, "range long, block long, blob binary")
    shared = listed.groupBy("range").applyInArrow(share_anchors, "block long, blob binary, windows binary")
    sent = own.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        send_segments, "range long, block long, blob binary, windows binary")
    found = sent.groupBy("range").applyInArrow(compare, "block long, blob binary, windows binary")
    return own.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
