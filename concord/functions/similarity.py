"""Jaro similarity of names."""

from __future__ import annotations


def jaro(a: str, b: str) -> float:
    """Jaro similarity from 0 to 1; of two empty names 0."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    matched = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                matched.append(c)
                break
    if not matched:
        return 0.0
    others = [c for c, unused in zip(b, free, strict=True) if not unused]
    moved = sum(x != y for x, y in zip(matched, others, strict=True)) // 2
    m = len(matched)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3
