"""Name similarities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def indel_ratio(a: str, b: str) -> float:
    """1 less insertions and deletions over the summed lengths."""
    return 2 * _common(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set(a: str, b: str) -> float:
    """The best ratio between the shared words and the shared words with either rest; 1 if one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, [both, *sorted(s)])) for s in (x - y, y - x))
    best = indel_ratio(left, right)
    return max(best, indel_ratio(both, left), indel_ratio(both, right)) if both else best
