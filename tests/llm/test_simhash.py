import re

import numpy as np
import xxhash

from codetrail.llm import simhash as m

from .helpers import SF, docs, odd_docs


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """(doc_id, fingerprint, component_id) from all pairs."""
    f = np.array([plain_fingerprint(t) for _, t in rows], dtype=np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 3):
            root[find(i)] = find(int(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{int(f[i]):016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df, **k):
    return sorted((tuple(r) for r in m.near_duplicates(df, **k).collect()), key=str)


def test_equals_all_pairs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert got(df) == brute(rows)


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_long_text_in_windows():
    words = [f"w{i * i % 977}" for i in range(m.WINDOW + 5)]
    for n in (m.WINDOW - 1, m.WINDOW, m.WINDOW + 2, m.WINDOW + 3, m.WINDOW + 5):
        text = "\n ".join(words[:n]) + "\t"
        hashes = np.concatenate(list(m._hashes(text.encode(), 3)))
        want = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(n - 2)]
        assert hashes.tolist() == want


def test_crowded_buckets_lose_no_link(spark):
    """A dense cluster: thousands of fingerprints that differ in a few of 18 bits only, and chains that cross blocks."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**62))
    places = rng.choice(64, 18, replace=False).tolist()
    fps = {base}
    for _ in range(1500):
        fps.add(base ^ sum(1 << int(p) for p in rng.choice(places, 7, replace=False)))
    fps |= {int(x) for x in rng.integers(0, 2**63, 300)}
    fps |= {x ^ 0x8000000000000101 for x in list(fps)[:40]}
    f = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    parts = m.buckets(df, crowd=20)
    sizes = parts.groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert sizes <= 20
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in m.links(parts).collect()]
    at = {int(x): i for i, x in enumerate(f)}
    left, right = np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links])
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    a, b = np.nonzero(np.triu(near, 1))
    assert len(a) > 1000 and len(links) <= parts.count()
    assert (m.forest(left, right, len(f)) == m.forest(a, b, len(f))).all()


def test_cut_masks_cover_the_varying_bits():
    for bits in (0, 1, 0xFFFFFFFFFFFFFFFF, 0x8000000000000001, 0x0F0F00F0):
        masks = [x % 2**64 for x in m._parted(bits)]
        assert sum(masks) == bits and len(masks) == 4
