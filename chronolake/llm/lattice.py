"""The E8 lattice: nearest points, and the next nearest of the neighbouring cells."""

from __future__ import annotations

import numpy as np

#: Which two of a point's worst rounded coordinates its neighbours move.
_MOVED = ((0, 1), (0, 2), (1, 2), (0, 3))


def _even(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest points of D8 (integer vectors of even sum); the rounded-off parts and the order of coordinates, worst rounded first."""
    near = np.rint(x)
    off = x - near
    order = np.argsort(-np.abs(off), axis=1, kind="stable")
    odd = (near.sum(1) % 2) != 0
    rows, worst = np.flatnonzero(odd), order[odd, 0]
    way = np.where(off[rows, worst] >= 0, 1.0, -1.0)
    near[rows, worst] += way
    return near, x - near, order


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """The nearest E8 points of the rows of x (n, 8), doubled to integers, of shape (n, 1 + probes, 8).

    E8 is D8 and D8 moved by one half in every coordinate. First comes the nearest point; the probes are the nearest of its neighbours
    among each coset's own nearest point and those that move two of its four worst rounded coordinates by one (a root of the lattice).
    """
    nearest, ways, orders, far = [], [], [], []
    for shift in (0.0, 0.5):
        near, off, _ = _even(x - shift)
        order = np.argsort(-np.abs(off), axis=1, kind="stable")[:, :4]
        more = 1 - 2 * np.abs(np.take_along_axis(off, order, axis=1))  # what moving a coordinate adds to the squared distance
        own = (off * off).sum(1)
        far += [own, *[own + more[:, i] + more[:, j] for i, j in _MOVED]]
        nearest.append(near + shift)
        ways.append(np.where(off >= 0, 1.0, -1.0))
        orders.append(order)
    best = np.argsort(np.stack(far, axis=1), axis=1, kind="stable")[:, : 1 + probes]
    coset, move = np.divmod(best, 1 + len(_MOVED))
    rows = np.arange(len(x))
    points = np.stack(nearest)[coset, rows[:, None]]
    ways, orders, pair = np.stack(ways), np.stack(orders), np.array([(0, 0), *_MOVED])
    row, at = np.nonzero(move)
    for k in (0, 1):
        c = orders[coset[row, at], row, pair[move[row, at], k]]
        points[row, at, c] += ways[coset[row, at], row, c]
    return np.rint(2 * points).astype(np.int64)
