"""Operator 6: URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into one bit string of 64-bit words: per rule a start bit and a bit per literal byte.  One Shift-And
step per byte of a URL moves all rules at once: D = ((D << 1) & B[c]) | (D & S[c]), where B has the bits that byte c may
enter and S the bits that it may stay in (a wildcard after them); the shift carries from word to word.  numpy does the
step for all URLs of a batch, the longest first, so that finished ones drop out.

Globs match the whole canonical URL, which is ``.host/path`` (host with A-Z in lower case, no scheme, query or fragment;
the leading dot makes a host look like its own subdomain).  ``*`` is any run without a slash, ``**`` any run, a
backslash takes the next character literally.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrail.llm.common import map_arrow

#: Verdict and rule (host and the beginning of the path).
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: URLs without a fitting rule are blocked if one of these globs matches.
BLOCK_GLOBS = ("*.spam-farm.**", "*.cheap-pills.**", "*.free-bets.**", "*.adult-x.**", "*casino*/**", "*.xxx/**")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    # the first :// is kept once found: a URL in the query or fragment has no say
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^(?>.*?://)[^/?#]*(/[^?#]*)", 1)


def rule_glob(rule: str) -> str:
    """The glob of a host rule: its host and all subdomains, paths that start with the rule's."""
    quoted = "".join("\\" + c if c in "*\\" else c for c in rule)
    return f"*.{quoted}**"


class Automaton:
    """All globs at once.  ``matches`` gives for each text which globs match it."""

    def __init__(self, globs: list[str]):
        parsed = [_parse(g) for g in globs]
        bits = sum(1 + sum(k == "byte" for k, _ in p) for p in parsed)
        self.words = max(1, -(-bits // 64))
        enter, stay = np.zeros((256, self.words * 64), bool), np.zeros((256, self.words * 64), bool)
        start, self.final = np.zeros(self.words * 64, bool), []
        at = 0
        for items in parsed:
            start[at] = True
            for kind, value in items:
                if kind == "byte":
                    at += 1
                    enter[value, at] = True
                else:
                    stay[:, at] = True
                    if value == "segment":
                        stay[ord("/"), at] = False
            self.final.append(at)
            at += 1
        # a `**` after a `*` at the same bit wins, whatever their order
        at = 0
        for items in parsed:
            for kind, value in items:
                at += kind == "byte"
                if kind == "star" and value == "any":
                    stay[:, at] = True
            at += 1
        self.enter, self.stay, self.start = _pack(enter), _pack(stay), _pack(start[None])[0]

    def matches(self, texts: list[bytes]) -> np.ndarray:
        length = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        begin = (np.cumsum(length) - length)[order]
        state = np.tile(self.start, (len(texts), 1))
        falling = -length[order]
        for step in range(int(length.max(initial=0))):
            n = int(np.searchsorted(falling, -step, side="left"))  # texts longer than step
            c, d = data[begin[:n] + step], state[:n]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.enter[c]) | (d & self.stay[c])
        final = np.array(self.final, dtype=np.int64)
        hit = (state[:, final // 64] >> (final % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def _parse(glob: str) -> list[tuple[str, int | str]]:
    raw, out, i = glob.encode(), [], 0
    while i < len(raw):
        if raw[i:i + 2] == b"**":
            out.append(("star", "any"))
            i += 2
        elif raw[i:i + 1] == b"*":
            out.append(("star", "segment"))
            i += 1
        else:
            i += raw[i:i + 1] == b"\\" and i + 1 < len(raw)
            out.append(("byte", raw[i]))
            i += 1
    return out


def _pack(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words, the first flag in the lowest bit."""
    return np.packbits(flags, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = HOST_RULES,
          block_globs: tuple[str, ...] = BLOCK_GLOBS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    The longest fitting rule decides (of equally long ones the first), without one the globs do.  A null url, or one
    without ``://``, has an empty host and path; no rule fits it and it is allowed unless a glob matches ``.``.  Repeated
    rows give repeated rows, an empty table none; other columns aren't read.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    globs = [rule_glob(r) for _, r in ranked] + list(block_globs)
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def run(batches):
        automaton = Automaton(globs)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                texts = [f".{h}{p}".encode() for h, p in zip(batch.column("host").to_pylist(),
                                                              batch.column("path").to_pylist(), strict=True)]
                hit = automaton.matches(texts)
                fits, blocked = hit[:, :len(ranked)], hit[:, len(ranked):].any(axis=1)
                first = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(ranked) else 0, -1)
                rule = [ranked[k][1] if k >= 0 else None for k in first.tolist()]
                verdict = [ranked[k][0] if k >= 0 else ("block" if b else "allow")
                           for k, b in zip(first.tolist(), blocked.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                    names=["page_id", "host", "path", "rule", "verdict"])

    return own.transform(map_arrow, run, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, "
                               "verdict string")


ORACLE_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN regexp_matches('.' || host || path,
                 '^(?s:[^/]*\\.(spam-farm|cheap-pills|free-bets|adult-x)\\..*|[^/]*casino[^/]*/.*|[^/]*\\.xxx/.*)$')
            THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
