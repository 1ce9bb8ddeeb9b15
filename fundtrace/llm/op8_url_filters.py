"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed side by side into the bits of several 64-bit words. Reading one character of a
URL moves every rule at once: ``state = ((state << 1) & starts_cleared | state & loops) & letter mask``, the
Shift-And step, where a wildcard keeps its bit while it matches. numpy runs all URLs of a block in step.

In a glob ``**`` matches any characters, ``*`` any but a slash and ``?`` one but a slash. The text read is
``.host/path`` after the host is lower-cased, so ``*.net/**`` is a host rule with all its subdomains.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundtrace.llm.store import prepare

# (verdict, host, path): of those that fit, the longest decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Where no rule fits: block what one of these fits, allow the rest.
GLOBS = ("*.adult-*/**", "*.cheap-pills.*/**", "*.free-casino*/**", "*-casino.*/**", "*.spam-*/**", "**/ads/**", "**/tracker/**")


class Automaton:
    """All globs as one bit set. Bit i of a glob means: its first i elements have been matched."""

    def __init__(self, globs: Sequence[str]):
        elements: list[tuple[str, int]] = []  # (character, "?" or "" for a start), its loop: 0 none, 1 not slash, 2 any
        self.accepts: list[int] = []
        self.start: list[int] = []
        for glob in globs:
            self.start.append(len(elements))
            elements.append(("", 0))
            i = 0
            while i < len(glob):
                if glob.startswith("**", i):
                    elements[-1] = (elements[-1][0], 2)
                    i += 2
                elif glob[i] == "*":
                    elements[-1] = (elements[-1][0], max(1, elements[-1][1]))
                    i += 1
                else:
                    elements.append((glob[i], 0))
                    i += 1
            self.accepts.append(len(elements) - 1)
        self.words = (len(elements) + 63) // 64 or 1
        letters = sorted({c for c, _ in elements if len(c) == 1} | {"/"})
        self.codes = {ord(c): k + 1 for k, c in enumerate(letters)}
        masks = np.zeros((len(letters) + 1, self.words), np.uint64)
        loops = np.zeros((len(letters) + 1, self.words), np.uint64)
        slash = self.codes[ord("/")]
        for bit, (char, loop) in enumerate(elements):
            word, one = bit >> 6, np.uint64(1) << np.uint64(bit & 63)
            for code in range(len(letters) + 1):
                if (char == "?" and code != slash) or (char and char != "?" and self.codes[ord(char)] == code):
                    masks[code, word] |= one
                if loop == 2 or (loop == 1 and code != slash):
                    loops[code, word] |= one
        self.masks, self.loops = masks, loops
        self.first = np.zeros(self.words, np.uint64)
        for bit in self.start:
            self.first[bit >> 6] |= np.uint64(1) << np.uint64(bit & 63)

    def run(self, texts: list[str]) -> np.ndarray:
        """Boolean matrix: which glob matches which whole text."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(128, np.uint8)
        for point, code in self.codes.items():
            if point < 128:
                table[point] = code
        codes = table[np.minimum(points, 127)]
        codes[points >= 128] = 0
        for point, code in self.codes.items():
            if point >= 128:
                codes[points == point] = code
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        state = np.repeat(self.first[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -at))  # texts longer than ``at`` stand first
            code = codes[begins[:live] + at]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.masks[code]) | (now & self.loops[code])
        accepts = np.array(self.accepts, np.int64)
        hit = (state[:, accepts >> 6] >> (accepts & 63).astype(np.uint64)) & one
        out = np.zeros((len(texts), len(accepts)), bool)
        out[order] = hit.astype(bool)
        return out


def _canonical(url: str | None) -> tuple[str, str]:
    """Host and path; both empty without ``://``."""
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judge(pages: DataFrame, rules=RULES, globs: Sequence[str] = GLOBS, key: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``rule`` is the longest fitting rule's host and path, null where none fits; then a fitting glob blocks, and
    what no glob fits is allowed. A url that is null, empty or without ``://`` has an empty host and path and
    fits nothing. Repeated rows are judged each; other columns are ignored; an empty table gives no rows.
    Rules are read by the automaton along with the globs, in one pass over the url.
    """
    prepare(pages.sparkSession)
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    if any(c in host + path for _, host, path in ranked for c in "*?"):
        raise ValueError("rules name a host and the beginning of a path; wildcards belong into globs")
    automaton = Automaton([f"**.{host}{path}**" if "/" not in host and not path else f"*.{host}{path}**" for _, host, path in ranked] + list(globs))
    names = [host + path for _, host, path in ranked]
    verdicts = [v for v, _, _ in ranked]

    def scan(batches):
        for batch in batches:
            parts = [_canonical(u) for u in batch.column(1).to_pylist()]
            fits = automaton.run([f".{h}{p}" if h or p else "" for h, p in parts])
            chosen = np.where(fits[:, : len(names)].any(axis=1), fits[:, : len(names)].argmax(axis=1), -1) if names else np.full(len(parts), -1)
            blocked = fits[:, len(names) :].any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([names[c] if c >= 0 else None for c in chosen], pa.string()),
                    pa.array([verdicts[c] if c >= 0 else "block" if b else "allow" for c, b in zip(chosen, blocked)], pa.string()),
                ],
                names=[key, "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string")).mapInArrow(scan, f"{key} long, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#][\s\S]*', '') ELSE '' END AS rest FROM pages
), c AS (
  SELECT page_id, translate(regexp_replace(rest, '/[\s\S]*', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u
), r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM c
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN path LIKE '/%' AND (('.' || host) LIKE '%.adult-%' OR ('.' || host) LIKE '%.cheap-pills.%' OR ('.' || host) LIKE '%.free-casino%'
            OR host LIKE '%-casino.%' OR ('.' || host) LIKE '%.spam-%' OR path LIKE '%/ads/%' OR path LIKE '%/tracker/%') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""
