"""Operator 1: byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into words as the tokenizer file's ByteLevel pattern cuts them (numpy over code point classes).  The
distinct words of a block of a partition are encoded together: an index maps each pair of neighbouring tokens that
has a rank to all its positions, active ranks are taken in ascending order from a heap, all occurrences of the pair are
merged at once (from the left where they overlap), and the lists of the pairs to the left and right are
updated.  Later blocks encode the words that no earlier block of the task had.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codetrail.llm.common import map_arrow, slices, strings
from codetrail.llm.words import keyed_hash_spans

#: Text that is encoded together, and the words that a task remembers.
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 16_384
#: Characters that are cut into words at a time.
PART_CHARS = 1 << 19
REMEMBER = 200_000

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
#: Letters and numbers that Unicode 16.0 added (first and last code point of each range).
LETTERS_16 = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
              (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
              (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
              (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
              (0x1E5F0, 0x1E5F0)]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
              (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    kind = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    for ranges, value in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for a, b in ranges:
            out[a:b + 1] = value
    return out


def word_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where words start: a flag per code point.  ``breaks``: positions of separators, which belong to no word.

    A run of letters, numbers or other signs takes one blank before it; of a longer run of white space the last
    character stands apart if something follows; an apostrophe that starts a word takes s, t, m, d, re, ve or ll.
    """
    kind = classes()[points]
    kind[breaks] = BREAK
    n = len(kind)
    new = np.ones(n + 1, dtype=bool)
    new[1:n] = kind[1:] != kind[:-1]
    after_blank = np.zeros(n, dtype=bool)
    after_blank[1:] = (points[:-1] == 32) & (kind[:-1] == SPACE)
    start = new[:n] & ~(after_blank & (kind < SPACE))
    ends = np.append(kind[1:], BREAK)
    start |= (kind == SPACE) & (ends < SPACE)
    mark = np.flatnonzero((points == 39) & (kind == OTHER) & start)
    padded = np.append(points, [0, 0, 0])
    one, two = padded[mark + 1], padded[mark + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    size = np.where(short, 2, np.where(long, 3, 0))
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    past = (mark + size)[mark + size < n]
    start[past] |= kind[past] == LETTER
    start[breaks] = True
    return start


class Tokenizer:
    """Vocabulary, merges and added tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type") != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("only plain byte-level BPE files can be used")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in shown}
        sign.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for c, b in sign.items():
            self.byte_ids[b] = vocab[c]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        content = [b""] * size
        for token, i in vocab.items():
            content[i] = bytes(sign[c] for c in token)
        for token, i in self.added.items():
            content[i] = token.encode()
        self.content_length = np.array([len(c) for c in content], dtype=np.int64)
        self.content_start = np.cumsum(self.content_length) - self.content_length
        self.content = np.frombuffer(b"".join(content), np.uint8)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        born = {int(i): -1 for i in self.byte_ids}
        for rank, (a, b, c) in enumerate(zip(self.left.tolist(), self.right.tolist(), self.merged.tolist(), strict=True)):
            if a not in born or b not in born or c in born:
                raise ValueError("a merge uses a token that no earlier merge makes, or makes a token again")
            born[c] = rank
        key = self.left << 32 | self.right
        self.by_key = np.argsort(key)
        self.keys = key[self.by_key]
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") \
            if self.added else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def merge(self, data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words that lie one after another in ``data``; how many ids each word has."""
        n = len(data)
        token = np.append(self.byte_ids[data], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        last = np.cumsum(length) - 1
        after[last] = -1
        before[(last + 1)[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self.ranks(token[at], token[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edge = np.flatnonzero(np.diff(rank)) + 1
            for r, own in zip(rank[np.append(0, edge)].tolist(), np.split(at, edge), strict=True):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(active, r)

        note(np.flatnonzero(after[:n] >= 0))
        while active:
            rank = heapq.heappop(active)
            at = np.unique(np.concatenate(index.pop(rank)))
            a, b = self.left[rank], self.right[rank]
            right = after[at]
            ok = (token[at] == a) & (right >= 0) & (token[right] == b)
            at, right = at[ok], right[ok]
            if a == b and len(at) > 1:
                joined = np.append(False, at[1:] == right[:-1])
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(joined, 0, place))
                even = (place - run) % 2 == 0
                at, right = at[even], right[even]
            if not len(at):
                continue
            token[at] = self.merged[rank]
            token[right] = -1
            beyond = after[right]
            after[at] = beyond
            more = beyond >= 0
            before[beyond[more]] = at[more]
            left = before[at]
            note(np.concatenate([left[left >= 0], at[more]]))
        alive = token[:n] >= 0
        return token[:n][alive], np.add.reduceat(alive.astype(np.int64), np.append(0, last[:-1] + 1)) if n else length


class Codec:
    """Encodes and decodes blocks of texts; remembers the words it has encoded."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def _words(self, texts: list[str]):
        """Word hashes of a list of texts, the bytes, and where the added tokens stand."""
        special = self.tokenizer.special
        parts, owner, inserted = [], [], []
        for i, text in enumerate(texts):
            if special is not None and special.search(text):
                for k, part in enumerate(special.split(text)):
                    if k % 2:
                        inserted.append((i, len(parts), self.tokenizer.added[part]))
                    else:
                        parts.append(part)
                        owner.append(i)
            else:
                parts.append(text)
                owner.append(i)
        joined = "\0".join(parts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        data = np.frombuffer(joined.encode(), np.uint8)
        breaks = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))) - 1
        starts = np.flatnonzero(word_starts(points, breaks))
        offset = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)) if len(data) > len(points) \
            else np.arange(1, len(points) + 1)
        offset = np.append(0, offset)
        is_break = np.zeros(len(points) + 1, bool)
        is_break[breaks] = True
        own = ~is_break[starts]
        begin, end = offset[starts[own]], offset[np.append(starts[1:], len(points))[own]]
        part = np.searchsorted(breaks, starts[own])
        return data, begin, end, keyed_hash_spans(data, begin, end), part, np.array(owner), inserted

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (and the end)."""
        done, new_words, new_hash = [], [], []
        at, size = 0, 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= PART_CHARS):
                size += len(texts[stop])
                stop += 1
            data, begin, end, hashes, part, owner, inserted = self._words(texts[at:stop])
            own, first = np.unique(hashes, return_index=True)
            fresh = first[~_inside(own, self.known)]
            new_hash.append(hashes[fresh])
            length = end[fresh] - begin[fresh]
            body = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin[fresh], length)
            new_words.append((data[body], length))
            done.append((hashes, part, owner, inserted, stop - at))
            at = stop
        if new_hash:
            self._learn(np.concatenate(new_hash), new_words)
        ids, counts = [], []
        for hashes, part, owner, inserted, n in done:
            word = np.searchsorted(self.known, hashes)
            length = self.length[word]
            place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length - self.start[word], length)
            out = self.ids[place]
            per_part = np.bincount(part, length, minlength=len(owner)).astype(np.int64)
            if inserted:
                before = np.append(0, np.cumsum(per_part))
                out = np.insert(out, [before[k] for _, k, _ in inserted], [i for _, _, i in inserted])
            count = np.bincount(owner, per_part, minlength=n).astype(np.int64)
            for i, _, _ in inserted:
                count[i] += 1
            ids.append(out)
            counts.append(count)
        if len(self.known) > REMEMBER:
            self.forget()
        return (np.concatenate(ids) if ids else np.zeros(0, np.int64),
                np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, np.int64))

    def _learn(self, hashes: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> None:
        data, length = np.concatenate([d for d, _ in words]), np.concatenate([n for _, n in words])
        own, first = np.unique(hashes, return_index=True)
        if len(own) < len(hashes):
            keep = np.zeros(len(hashes), bool)
            keep[first] = True
            data, length, hashes = data[np.repeat(keep, length)], length[keep], hashes[keep]
        if not len(hashes):
            return
        ids, counts = self.tokenizer.merge(data, length)
        start = np.cumsum(counts) - counts + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known = known[order]
        self.start = np.concatenate([self.start, start])[order]
        self.length = np.concatenate([self.length, counts])[order]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        t = self.tokenizer
        ids = ids[(ids >= 0) & (ids < len(t.content_length))]
        length = t.content_length[ids]
        place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length - t.content_start[ids], length)
        return t.content[place].tobytes().decode("utf-8", "replace")


def _inside(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of every row of ``docs`` (doc_id, text); null and empty texts have no ids."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        codec = Codec(path)
        for batch in slices(batches, limit=BLOCK_BYTES, rows=BLOCK_ROWS):
            ids, first = codec.encode(strings(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(first.astype(np.int32), ids.astype(np.int32))],
                names=["doc_id", "ids"])

    return docs.select("doc_id", "text").transform(map_arrow, run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids give the empty text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = [codec.decode(np.array([i for i in ids or [] if i is not None], dtype=np.int64))
                         for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").transform(map_arrow, run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text).

    Whole texts are encoded (null: empty) and decoded again; the digests are of the ids as little-endian unsigned 32-bit
    integers and of the decoded text in UTF-8.  Repeated rows give repeated rows, an empty table none; other columns
    aren't read.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        codec = Codec(path)
        for batch in slices(batches, limit=BLOCK_BYTES, rows=BLOCK_ROWS):
            ids, first = codec.encode(strings(batch))
            own = [ids[a:b] for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array(np.diff(first).astype(np.int64)),
                "ids_sha256": pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in own], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(codec.decode(i).encode()).hexdigest() for i in own],
                                           pa.string())})

    return docs.select("doc_id", "text").transform(map_arrow, 
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
