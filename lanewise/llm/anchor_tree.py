"""Metric trees by the anchors hierarchy, and the assignment of their points to the nearest of a few entries.

Middle out: about sqrt(n) anchors take their points from one another by the triangle inequality, their balls are merged upwards in
pairs of the smallest common ball, and a ball of many points is cut downwards in the same way. A ball knows its centre, radius, count
and sum. Assignment walks down with the entries that may still own a point of the ball; when one is left, the ball is its own with
count and sum, and no point is looked at. Coordinates are integers; distances that decide are exact.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, fields

import numpy as np

LEAF = 96  # points of a ball that is not cut


@dataclass
class Tree:
    """Balls in depth-first order; a ball's points are a run of ``order``. ``children`` is -1 at leaves."""
    order: np.ndarray     # int32 (n,)
    centre: np.ndarray    # float64 (balls, d)
    radius: np.ndarray    # float64 (balls,), with a margin for rounding
    sums: np.ndarray      # int64 (balls, d)
    span: np.ndarray      # int32 (balls, 2): first place, count
    children: np.ndarray  # int32 (balls, 2)

    def packed(self) -> dict[str, bytes]:
        return {f.name: getattr(self, f.name).tobytes() for f in fields(self)}

    @classmethod
    def unpacked(cls, parts: dict[str, bytes], dim: int) -> Tree:
        def read(name: str, kind: type, *shape: int) -> np.ndarray:
            return np.frombuffer(parts[name], kind).reshape(*shape)
        balls = len(parts["radius"]) // 8
        return cls(read("order", np.int32, -1), read("centre", np.float64, balls, dim), read("radius", np.float64, -1),
                   read("sums", np.int64, balls, dim), read("span", np.int32, -1, 2), read("children", np.int32, -1, 2))


@dataclass
class Ball:
    idx: np.ndarray
    centre: np.ndarray
    radius: float
    parts: tuple["Ball", "Ball"] | None = None


def _ball(points: np.ndarray, idx: np.ndarray, parts: tuple[Ball, Ball] | None = None) -> Ball:
    own = points[idx]
    centre = own.mean(0)
    gaps = own - centre
    return Ball(idx, centre, math.sqrt(float(np.einsum("ij,ij->i", gaps, gaps).max(initial=0.0))), parts)


def anchors(points: np.ndarray, idx: np.ndarray, most: int) -> list[np.ndarray]:
    """``idx`` dealt to at most ``most`` anchors, each point to a nearest one. Equal points never part."""
    def far(pivot: int, own: np.ndarray) -> np.ndarray:
        gaps = points[own] - points[pivot]
        return np.sqrt(np.einsum("ij,ij->i", gaps, gaps))

    d = far(idx[0], idx)
    by = np.argsort(-d, kind="stable")
    pivots, owned, dist = [idx[0]], [idx[by]], [d[by]]
    radius = [dist[0][0]]
    while len(pivots) < most:
        widest = int(np.argmax(radius))
        if radius[widest] <= 0:
            break
        pivot = owned[widest][0]
        between = far(pivot, np.array(pivots))
        taken, at = [], []
        for a in np.nonzero(np.array(radius) * 2 > between)[0]:  # nearer points than half the way stay
            reach = int(np.searchsorted(-dist[a], -between[a] / 2, side="left"))
            if not reach:
                continue
            new = far(pivot, owned[a][:reach])
            moves = new < dist[a][:reach]
            if moves.any():
                taken.append(owned[a][:reach][moves])
                at.append(new[moves])
                stay = np.concatenate([~moves, np.ones(len(owned[a]) - reach, bool)])
                owned[a], dist[a] = owned[a][stay], dist[a][stay]
                radius[a] = dist[a][0] if len(dist[a]) else 0.0
        own, d = np.concatenate(taken), np.concatenate(at)
        by = np.argsort(-d, kind="stable")
        pivots.append(pivot)
        owned.append(own[by])
        dist.append(d[by])
        radius.append(dist[-1][0])
    return [o for o in owned if len(o)]


def _merged(points: np.ndarray, balls: list[Ball]) -> Ball:
    """One ball over all, by merging the two of the smallest common ball again and again."""
    centres, radii = np.array([b.centre for b in balls]), np.array([b.radius for b in balls])

    def common(i: int) -> np.ndarray:
        apart = np.sqrt(((centres - centres[i]) ** 2).sum(1))
        return np.maximum(np.maximum(radii, radii[i]), (apart + radii + radii[i]) / 2)

    cost = np.array([common(i) for i in range(len(balls))])
    np.fill_diagonal(cost, np.inf)
    for _ in range(len(balls) - 1):
        a, b = np.unravel_index(int(np.argmin(cost)), cost.shape)
        both = _ball(points, np.concatenate([balls[a].idx, balls[b].idx]), (balls[a], balls[b]))
        balls[a], centres[a], radii[a] = both, both.centre, both.radius
        cost[b, :] = cost[:, b] = np.inf
        gone = np.isinf(cost[a])
        row = common(a)
        row[gone] = np.inf
        row[a] = row[b] = np.inf
        cost[a, :] = cost[:, a] = row
        last = both
    return last if len(balls) > 1 else balls[0]


def _grown(points: np.ndarray, idx: np.ndarray) -> Ball:
    whole = _ball(points, idx)
    if len(idx) <= LEAF or whole.radius == 0:
        return whole
    groups = anchors(points, idx, max(2, math.isqrt(len(idx))))
    return _merged(points, [_grown(points, g) for g in groups]) if len(groups) > 1 else whole


def build(points: np.ndarray) -> Tree:
    """The tree over integer ``points`` (n, d), n > 0."""
    exact = points.astype(np.float64)
    root = _grown(exact, np.arange(len(points)))
    order, centre, radius, sums, span, children = [], [], [], [], [], []
    stack, start = [(root, -1, 0)], 0
    while stack:
        ball, parent, side = stack.pop()
        me = len(centre)
        if parent >= 0:
            children[parent][side] = me
        centre.append(ball.centre)
        radius.append(ball.radius * (1 + 1e-9) + 1e-9)
        sums.append(points[ball.idx].sum(0))
        span.append((start, len(ball.idx)))
        children.append([-1, -1])
        if ball.parts:
            stack += [(ball.parts[1], me, 1), (ball.parts[0], me, 0)]
        else:
            order.append(ball.idx)
            start += len(ball.idx)
    return Tree(np.concatenate(order).astype(np.int32), np.array(centre), np.array(radius), np.array(sums, np.int64).reshape(len(centre), -1),
                np.array(span, np.int32), np.array(children, np.int32))


class Entries:
    """A codebook as the candidates of a ball. Of equal entries only the first can own points."""

    def __init__(self, book: np.ndarray) -> None:
        self.book, self.exact = book, book.astype(np.float64)
        self.square = np.einsum("ij,ij->i", self.exact, self.exact)
        gaps = self.square[:, None] - 2 * self.exact @ self.exact.T + self.square
        self.apart = np.sqrt(np.maximum(gaps, 0)) * (1 + 1e-7) + 1e-3
        self.first = np.sort(np.unique(book, axis=0, return_index=True)[1])
        self.most = int(np.abs(book).max(initial=0))

    def left(self, centre: np.ndarray, radius: float, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` that may be nearest to a point of the ball.

        From the entry nearest to the centre another one differs in squared distance by a linear function of the point; if that is
        positive in the whole ball, the other owns nothing. Equality keeps both, so ties are decided point by point.
        """
        gaps = self.exact[among] - centre
        square = np.einsum("ij,ij->i", gaps, gaps)
        best = int(np.argmin(square))
        margin = 1e-9 * (square + square[best] + radius * radius) + 1e-6
        return among[square - square[best] <= 2 * radius * self.apart[among, among[best]] + margin]

    def distances(self, points: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Exact squared distances (points, among)."""
        size = 4 * points.shape[1] * max(self.most, int(np.abs(points).max(initial=0))) ** 2
        if size < 2 ** 53:
            p = points.astype(np.float64)
            return np.einsum("ij,ij->i", p, p)[:, None] - 2 * p @ self.exact[among].T + self.square[among]
        if size >= 2 ** 63:
            raise ValueError("components are too large for exact squared distances in 64 bits")
        return np.stack([((points - self.book[e]) ** 2).sum(1) for e in among], 1)


def assign(tree: Tree, points: np.ndarray, entries: Entries, owners: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(counts, sums) of each entry's points, the nearest entry with ties to the smaller index, and how many points were looked at.

    ``points`` in the tree's original order; ``owners`` gets every point's entry.
    """
    counts, sums, looked = np.zeros(len(entries.book), np.int64), np.zeros_like(entries.book), 0
    stack = [(0, entries.first)]
    while stack:
        ball, among = stack.pop()
        start, n = tree.span[ball]
        among = entries.left(tree.centre[ball], tree.radius[ball], among)
        if len(among) == 1:
            counts[among[0]] += n
            sums[among[0]] += tree.sums[ball]
            if owners is not None:
                owners[tree.order[start:start + n]] = among[0]
        elif tree.children[ball, 0] >= 0:
            stack += [(tree.children[ball, 1], among), (tree.children[ball, 0], among)]
        else:
            idx = tree.order[start:start + n]
            nearest = among[np.argmin(entries.distances(points[idx], among), 1)]
            np.add.at(counts, nearest, 1)
            np.add.at(sums, nearest, points[idx])
            looked += int(n)
            if owners is not None:
                owners[idx] = nearest
    return counts, sums, looked
