"""Geometry kernels on numpy arrays: hull, buffer, clip, area."""

from __future__ import annotations

import math

import numpy as np


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, without collinear points (monotone chain). Fewer than three if degenerate."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    rows = p.tolist()
    return np.array(half(rows) + half(rows[::-1]))


def area(ring: np.ndarray) -> float:
    """Of an open or closed ring."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def diameter(ring: np.ndarray) -> float:
    """Largest distance of two vertices, row by row."""
    return max((float(np.hypot(*(ring[i:] - ring[i]).T).max()) for i in range(len(ring))), default=0.0)


def elongation(ring: np.ndarray) -> float:
    """Root of the ratio of the covariance's eigenvalues over the vertices; 1 if it has none."""
    if len(ring) < 3:
        return 1.0
    (a, b), (_, d) = np.cov(ring.T)
    mean, spread = (a + d) / 2, math.sqrt(((a - d) / 2) ** 2 + b * b)
    return math.sqrt((mean + spread) / (mean - spread)) if mean - spread > 1e-12 * max(mean, 1e-300) else 1.0


def buffer(points: np.ndarray, radius: float, sides: int = 64) -> np.ndarray:
    """Hull of the points widened by a regular polygon: the sum of two convex shapes."""
    angle = np.arange(sides) * 2 * math.pi / sides
    disc = np.stack([np.cos(angle), np.sin(angle)], 1) * radius
    return hull((hull(points)[:, None, :] + disc[None, :, :]).reshape(-1, 2))


def clip(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """Part of any simple ring inside a convex counter-clockwise ring (Sutherland-Hodgman)."""
    out = np.asarray(ring, float)
    if len(out) > 1 and (out[0] == out[-1]).all():
        out = out[:-1]
    for i in range(len(convex)):
        if not len(out):
            break
        a, b = convex[i], convex[(i + 1) % len(convex)]
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        after = np.roll(side, -1)
        step = np.where(side == after, 1.0, side - after)
        crossing = out + (np.roll(out, -1, axis=0) - out) * (side / step)[:, None]
        both = np.stack([out, crossing], 1).reshape(-1, 2)
        out = both[np.stack([side >= 0, ((side > 0) & (after < 0)) | ((side < 0) & (after > 0))], 1).ravel()]
    return out


def _convex(ring: np.ndarray) -> np.ndarray | None:
    """The ring open and counter-clockwise if it is convex and winds once, else None."""
    r = ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring
    step = np.roll(r, -1, axis=0) - r
    after = np.roll(step, -1, axis=0)
    turn = step[:, 0] * after[:, 1] - step[:, 1] * after[:, 0]
    if not ((turn >= 0).all() or (turn <= 0).all()):
        return None
    angle = np.arctan2(turn, (step * after).sum(1)).sum()
    if abs(abs(angle) - 2 * math.pi) > 1e-6:
        return None
    return r if angle > 0 else r[::-1]


def clipped_area(polygons: list, convex: np.ndarray, project=None) -> float:
    """Area of a multipolygon (polygon -> ring -> points; the first ring is the outer one) inside a convex ring."""
    if area(convex) == 0:
        return 0.0
    x, y = convex[:, 0], convex[:, 1]
    if np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)) < 0:
        convex = convex[::-1]
    total = 0.0
    for rings in polygons:
        for k, ring in enumerate(rings):
            open_ = _convex(np.asarray(ring, float))
            part = clip(np.asarray(ring, float), convex) if open_ is None or len(open_) >= len(convex) else clip(convex, open_)
            if len(part) > 2:
                total += (1 if k == 0 else -1) * area(project(part) if project else part)
    return max(0.0, total)


def valid_ring(ring: np.ndarray) -> bool:
    """Closed, four points or more, some area, and no two edges that cross."""
    r = np.asarray(ring, float)
    if len(r) < 4 or not (r[0] == r[-1]).all() or area(r) == 0:
        return False
    a, b = r[:-1], r[1:]
    cross = lambda o, p, q: (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])
    for i in range(len(a) - 2):
        c, d = a[i + 2 :], b[i + 2 :]
        hit = (cross(a[i], b[i], c) * cross(a[i], b[i], d) < 0) & (cross(c, d, a[i]) * cross(c, d, b[i]) < 0)
        if hit.any():
            return False
    return True
