"""Banded alignment of two word sequences by bit vectors."""

from __future__ import annotations

from collections import Counter

import numpy as np


def banded_distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences, None if it is over ``limit``.

    Only cells within ``limit`` of the main diagonal are computed. A column's
    band is one integer: bit i stands for row column - limit + i, so the vector
    slides down the diagonal by one bit per column (Hyyrö's bit-parallel band).
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return None
    a, b = _untrimmed(a, b)
    n, gap = len(b), len(a) - len(b)
    if not n:
        return gap if gap <= limit else None
    rows, columns = a.tolist(), b.tolist()
    common = sum((Counter(rows) & Counter(columns)).values())
    if len(a) - common > limit:
        return None
    width = 2 * limit + 1
    mask = (1 << width) - 1
    wanted = set(columns)
    places: dict[int, int] = {}
    for r, w in enumerate(rows):
        if w in wanted:
            places[w] = places.get(w, 0) | 1 << (r + limit)
    up, down = mask >> limit << limit, 0  # vertical steps of +1 and -1
    middle, distance = 1 << limit, 0
    for column, w in enumerate(columns):
        same = (places.get(w, 0) >> column) & mask
        flat = ((((same & up) + up) ^ up) | same | down) & mask  # diagonal steps of 0
        right = down | (~(flat | up) & mask)
        left = flat & up
        if not flat & middle:
            distance += 1
            if distance - gap > limit:
                return None
        below = flat >> 1
        up = left | (~(below | right) & mask)
        down = below & right
    rest = ((1 << gap) - 1) << limit
    distance += (up & rest).bit_count() - (down & rest).bit_count()
    return distance if distance <= limit else None


def _untrimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common start and end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b, n = a[start:], b[start:], n - start
    if n:
        differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        end = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - end], b[: len(b) - end]
    return a, b


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Is 1 - distance / longer length at least ``threshold``? Two empty sequences are."""
    longer = max(len(a), len(b))
    limit = int((1 - threshold) * longer + 1e-9)
    return banded_distance(a, b, limit) is not None
