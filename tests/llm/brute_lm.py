"""The language-model scores from plain dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = b" \t\n\x0b\x0c\r"


def symbols(raw: bytes):
    """(context, symbol) of every coding step of a text; 256 ends a unit, 257 the text."""
    runs = re.findall(rb"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", raw)
    if not runs or runs[0][0] in SPACE:
        runs.insert(0, b"")
    for i, run in enumerate(runs):
        space = i % 2 == 1
        yield from unit(run, space, 257 if space and i == len(runs) - 1 else 256)
    if len(runs) % 2 == 1:
        yield from unit(b"", True, 257)


def unit(run: bytes, space: bool, end: int, order: int = 5):
    marked = (b"\x01" if space else b" ") + run
    for i in range(len(run) + 1):
        yield marked[max(0, i + 1 - order) : i + 1], run[i] if i < len(run) else end


def scores(rows: list[tuple[int, str]]) -> dict[int, tuple]:
    texts = {i: (t or "").encode().lower() for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count, trie = Counter(), defaultdict(Counter)
    for i, raw in texts.items():
        if not held[i]:
            count.update(raw.split())
            count["end"] += 1
            for context, symbol in symbols(raw):
                for k in range(len(context) + 1):
                    trie[context[len(context) - k :]][symbol] += 1
    total, kinds = sum(count.values()), len(count)

    def logp(context: bytes, symbol: int) -> float:
        out, gone = 0.0, set()
        for k in range(len(context), -1, -1):
            node = trie.get(context[len(context) - k :])
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in gone}
            if symbol in left:
                return out + math.log10((2 * left[symbol] - 1) / (2 * sum(left.values())))
            if left:
                out += math.log10(len(left) / (2 * sum(left.values())))
            gone = set(node)
        return out - math.log10(max(1, 258 - len(gone)))

    result = {}
    for i, raw in texts.items():
        tokens = [*raw.split(), "end"]
        base = sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in tokens)
        result[i] = (held[i], len(tokens), sum(count[t] > 0 for t in tokens), total, base, sum(logp(c, s) for c, s in symbols(raw)))
    return result
