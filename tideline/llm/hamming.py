"""Links between fingerprints within a Hamming distance, by vantage-point trees in numpy.

Fingerprints are rows of unsigned 64-bit words. `Forest` keeps which points hang together; pairs are found and joined on the way and never listed.
"""

from __future__ import annotations

import numpy as np

#: Points that are compared directly.
BLOCK = 192
#: Pairs compared at once.
PAIRS = 1 << 20


def distances(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(points ^ one).sum(1, dtype=np.int32)


class Forest:
    """Union-find over 0 to n - 1; the smallest member stands for its set."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i], all at once: the smaller label wins until nothing changes."""
        while len(a):
            x, y = self.of[a], self.of[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low < high
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.of, high[open_], low[open_])
            self.flatten()

    def flatten(self) -> None:
        while True:
            up = self.of[self.of]
            if (up == self.of).all():
                return
            self.of = up


def link(points: np.ndarray, home: np.ndarray, visitors: np.ndarray, radius: int, forest: Forest) -> None:
    """Joins all pairs within radius of which one at least is among home; both are row numbers.

    A vantage point splits the home points at their median distance. By the triangle inequality a point can only have
    neighbours on the other side if its distance is within radius of the split, and only such points visit it. If
    most points are within radius of the vantage point they hang together through it, and
    the others need one neighbour among them only.
    """
    todo = [(home, visitors)]
    while todo:
        home, visitors = todo.pop()
        if not len(home) or len(home) == 1 and not len(visitors):
            continue
        if len(home) <= BLOCK:
            _compare(points, home, visitors, radius, forest)
            continue
        vantage = points[home[len(home) // 2]]
        near, far = distances(points[home], vantage), distances(points[visitors], vantage)
        ball = near <= radius
        if 4 * ball.sum() >= len(home):
            inside = home[ball]
            forest.join(inside, np.repeat(inside[:1], len(inside)))
            out = home[~ball]
            _any(points, inside, np.concatenate([out[near[~ball] <= 2 * radius], visitors[far <= 2 * radius]]), radius, forest)
            todo.append((out, visitors))
            continue
        split = int(np.median(near))
        lower = near <= split
        if lower.all():
            split -= 1
            lower = near <= split
        if not lower.any() or lower.all():
            _compare(points, home, visitors, radius, forest)
            continue
        todo.append((home[lower], np.concatenate([visitors[far <= split + radius], home[~lower & (near <= split + radius)]])))
        todo.append((home[~lower], visitors[far > split - radius]))


def _compare(points, home, visitors, radius, forest) -> None:
    step = max(1, PAIRS // max(1, len(home)))
    for k, others in enumerate((home, visitors)):
        for i in range(0, len(others), step):
            part = others[i : i + step]
            d = np.zeros((len(part), len(home)), np.int32)
            for w in range(points.shape[1]):
                d += np.bitwise_count(points[part, w][:, None] ^ points[home, w][None, :])
            a, b = np.nonzero(d <= radius)
            a, b = part[a], home[b]
            if k == 0:
                keep = a < b
                a, b = a[keep], b[keep]
            forest.join(a, b)


def _any(points, inside, others, radius, forest) -> None:
    """Joins each of others with one neighbour inside, if it has any: what is inside hangs together already."""
    width = max(1, PAIRS // max(1, len(others)))
    for i in range(0, len(inside), width):
        if not len(others):
            return
        part = inside[i : i + width]
        found = np.zeros(len(others), bool)
        for j in range(0, len(others), PAIRS):
            some = others[j : j + PAIRS]
            d = np.zeros((len(some), len(part)), np.int32)
            for w in range(points.shape[1]):
                d += np.bitwise_count(points[some, w][:, None] ^ points[part, w][None, :])
            found[j : j + PAIRS] = (d <= radius).any(1)
        hit = others[found]
        forest.join(hit, np.repeat(inside[:1], len(hit)))
        others = others[~found]


class TopTree:
    """A vantage-point tree over a bounded sample that deals all fingerprints to leaves."""

    def __init__(self, sample: np.ndarray, leaves: int, radius: int):
        self.radius, self.nodes, self.leaves = radius, [], 0
        rng = np.random.default_rng(17)

        def grow(part: np.ndarray, want: int) -> int:
            """The node's number, or minus one less the leaf's."""
            if want > 1 and len(part) >= 8:
                # of a few candidates, the one that tells its points apart best
                tried = part[rng.choice(len(part), min(16, len(part)), replace=False)]
                spread = [distances(part, v).std() for v in tried]
                vantage = tried[int(np.argmax(spread))]
                d = distances(part, vantage)
                split = int(np.median(d))
                if (d <= split).all():
                    split -= 1
                if (d <= split).any():
                    at = len(self.nodes)
                    self.nodes.append(None)
                    low = grow(part[d <= split], want // 2)
                    high = grow(part[d > split], want - want // 2)
                    self.nodes[at] = (vantage, split, low, high)
                    return at
            self.leaves += 1
            return -self.leaves

        self.root = grow(sample, leaves)

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether at home) for each leaf that a point lives in or visits. Of two leaves that a pair could meet in, the one with the smaller number is visited."""
        rows, leaves, homes = [], [], []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        home = np.zeros(len(points), np.int64)
        while todo:
            node, some, own = todo.pop()
            if not len(some):
                continue
            if node < 0:
                rows.append(some)
                leaves.append(np.full(len(some), -node - 1))
                homes.append(own)
                home[some[own]] = -node - 1
                continue
            vantage, split, low, high = self.nodes[node]
            d = distances(points[some], vantage)
            inner, outer = d <= split + self.radius, d > split - self.radius
            todo.append((low, some[inner], own[inner] & (d <= split)[inner]))
            todo.append((high, some[outer], own[outer] & (d > split)[outer]))
        row, leaf, own = np.concatenate(rows), np.concatenate(leaves), np.concatenate(homes)
        keep = leaf <= home[row]
        return row[keep], leaf[keep], own[keep]
