"""Scores of many rows by many trees, without walking every row through every tree.

A tree is a set of boxes, one per leaf, of which each row lies in one. A block of rows is cut at
medians into parts of rows that lie close together: there, most trees have few leaves. Trees of
a forest that still differ inside a part are added up on a common grid of their splits, while the
grid has no more cells than the part has rows, and each row reads its cell.

Paths are whole multiples of 2^-44, so sums are exact: a score depends neither on the block nor
on the part or the grid that its row came in.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Rows of a block at most, and of a part that need not be cut.
BLOCK, PART = 1 << 20, 1 << 13
#: Cells per row of the grid of several trees at most, and of one tree's own.
SHARED_CELLS, OWN_CELLS = 1, 8
#: Rows times grids that are read at once.
BATCH = 1 << 17
#: A path of 1; sums stay below 2^19.
UNIT = float(1 << 44)


class LeafBoxes:
    """The leaves of several forests of the same features, as boxes of places.

    A value's place in a feature is the number of splits below it, so that ``value <= split``
    means a place up to the split's own. ``low`` and ``high`` are the first and last place of a
    leaf in each feature, ``tree`` counts over all forests. ``walk`` gives the mean paths of rows by a
    forest's arrays; a tree that splits a part into too many cells is left to it.
    """

    def __init__(self, forests: Sequence[tuple], width: int, walk: Callable[..., np.ndarray]) -> None:
        self.forests, self.width, self.walk = forests, width, walk
        self.splits = [
            np.unique(np.concatenate([v[np.isfinite(v) & (f == at)] for _, f, v, _ in forests]))
            for at in range(width)
        ]
        low, high, path, tree, start = [], [], [], [], 0
        for _, feature, value, leaf_path in forests:
            a, b = self._boxes(feature, value)
            held = (a <= b).all(axis=2)
            low.append(a[held])
            high.append(b[held])
            path.append(np.rint(leaf_path[held] * UNIT).astype(np.int64))
            tree.append(start + np.nonzero(held)[0])
            start += len(feature)
        self.low = np.ascontiguousarray(np.concatenate(low).T)
        self.high = np.ascontiguousarray(np.concatenate(high).T)
        self.path, self.tree = np.concatenate(path), np.concatenate(tree)
        self.sizes = np.array([len(f) for _, f, _, _ in forests])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.forest = np.repeat(np.arange(len(forests)), self.sizes)

    def _boxes(self, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places (tree, leaf, feature) of the last level of complete heaps."""
        low = np.zeros((len(feature), 1, self.width), np.int32)
        high = np.zeros_like(low) + np.array([len(s) for s in self.splits], np.int32)
        first = 0
        while first < feature.shape[1]:
            nodes = low.shape[1]
            f, v = feature[:, first : first + nodes], value[:, first : first + nodes]
            low, high = np.repeat(low, 2, axis=1), np.repeat(high, 2, axis=1)
            for at, splits in enumerate(self.splits):
                t, n = np.nonzero(f == at)
                place = np.searchsorted(splits, v[t, n])
                # Nothing goes right at a node without a split: its place is behind all.
                high[t, 2 * n, at] = np.minimum(high[t, 2 * n, at], place)
                low[t, 2 * n + 1, at] = np.maximum(low[t, 2 * n + 1, at], place + 1)
            first += nodes
        return low, high

    def mean_paths(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, mean path per forest and row) of every part of a block; no value is NaN."""
        places = [np.searchsorted(s, np.ascontiguousarray(x[:, f])) for f, s in enumerate(self.splits)]
        todo = [(np.arange(len(x)), np.arange(len(self.tree)))] if len(x) else []
        while todo:
            rows, leaves = todo.pop()
            here = [p[rows] for p in places]
            for f, p in enumerate(here):
                leaves = leaves[(self.low[f][leaves] <= p.max()) & (self.high[f][leaves] >= p.min())]
            right = self._cut(here, leaves) if len(rows) > PART else None
            if right is None:
                yield rows, self._sums(x[rows], here, leaves) / UNIT / self.sizes[:, None]
            else:
                todo += [(rows[right], leaves), (rows[~right], leaves)]

    def _cut(self, here: list[np.ndarray], leaves: np.ndarray) -> np.ndarray | None:
        """Marks the rows above the median of the feature that bounds most leaves; None if none is bounded."""
        best, feature = 0, None
        for f, p in enumerate(here):
            bounds = np.count_nonzero(self.low[f][leaves] > p.min())
            if bounds > best:
                best, feature = bounds, f
        if feature is None:
            return None
        p = here[feature]
        middle = np.partition(p, len(p) // 2)[len(p) // 2]
        return p >= middle if middle > p.min() else p > middle

    def _sums(self, x: np.ndarray, here: list[np.ndarray], leaves: np.ndarray) -> np.ndarray:
        """Sums of paths per forest and row of a part. A tree whose own grid is too large for it is walked."""
        rows = len(x)
        totals = np.zeros((len(self.sizes), rows), np.int64)
        # Bounds in ranks of the values that occur; leaves between two of them hold no row.
        ranks, low, high = [], [], []
        for f, p in enumerate(here):
            values, rank = np.unique(p, return_inverse=True)
            ranks.append((rank, len(values)))
            low.append(np.searchsorted(values, self.low[f][leaves]))
            high.append(np.searchsorted(values, self.high[f][leaves], side="right"))
        low, high = np.stack(low), np.stack(high)
        held = (low < high).all(axis=0)
        low, high, tree, path = low[:, held], high[:, held], self.tree[leaves[held]], self.path[leaves[held]]
        # Leaves are in the order of their trees; a tree's splits per feature, counted once each.
        begins = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        many = np.diff(np.r_[begins, len(tree)])
        forest = self.forest[tree[begins]]
        alone = np.zeros(len(self.sizes), np.int64)
        np.add.at(alone, forest[many == 1], path[begins[many == 1]])
        totals += alone[:, None]
        at = np.repeat(np.arange(len(begins)), many)
        counts = np.zeros((len(begins), self.width), np.int64)
        for f, (_, n) in enumerate(ranks):
            inner = low[f] > 0
            seen = np.sort(at[inner] * n + low[f][inner])
            counts[:, f] = np.bincount(seen[np.flatnonzero(np.diff(seen, prepend=-1))] // n, minlength=len(begins))
        large = (many > 1) & (np.prod(counts + 1.0, axis=1) > OWN_CELLS * max(rows, 64))
        for t in np.flatnonzero(large):
            _, *arrays = self.forests[forest[t]]
            own = tree[begins[t]] - self.first[forest[t]]
            totals[forest[t]] += np.rint(self.walk(x, *[a[own : own + 1] for a in arrays]) * UNIT).astype(np.int64)
        order = np.lexsort((counts.sum(axis=1), (counts > 0) @ (1 << np.arange(self.width)), forest))
        order = order[(many[order] > 1) & ~large[order]]
        groups = self._groups(counts[order].tolist(), forest[order].tolist(), SHARED_CELLS * rows)
        group_of = np.full(len(begins), -1)
        group_of[order] = groups
        mine = group_of[at]
        by_group = np.argsort(mine, kind="stable")
        by_group = by_group[np.count_nonzero(mine < 0):]
        mine, low, high, path = mine[by_group], low[:, by_group], high[:, by_group], path[by_group]
        total_groups = groups[-1] + 1 if groups else 0
        of = np.zeros(total_groups, np.int64)
        of[groups] = forest[order]
        step = max(1, BATCH // rows)
        for first in range(0, total_groups, step):
            a, b = np.searchsorted(mine, [first, first + step])
            read = self._read(mine[a:b] - first, low[:, a:b], high[:, a:b], path[a:b], ranks)
            here_of = of[first : first + step]
            starts = np.flatnonzero(np.r_[True, here_of[1:] != here_of[:-1]])
            totals[here_of[starts]] += np.add.reduceat(read, starts, axis=0)
        return totals

    @staticmethod
    def _groups(counts: list[list[int]], forest: list[int], limit: float) -> list[int]:
        """The group of each tree: trees of a forest, in order, while their grid stays small."""
        found, group, size, last = [], -1, [], None
        for own, key in zip(counts, forest):
            grown = [a + b for a, b in zip(size, own)] if key == last else own
            if key != last or math.prod([n + 1 for n in grown]) > limit:
                group, grown = group + 1, own
            size, last = grown, key
            found.append(group)
        return found

    def _read(self, group, low, high, path, ranks) -> np.ndarray:
        """The sum of paths per group of trees and row, from a grid for each group."""
        groups = int(group[-1]) + 1
        strides = np.ones(groups, np.int64)
        corner, sign, leaf = np.zeros(len(group), np.int64), path, np.arange(len(group))
        cell, shapes = None, []
        for f, (rank, n) in enumerate(ranks):
            a, b = low[f], high[f]
            if not a.any():
                continue
            place = np.zeros((groups, n), np.int64)
            place[group, a] = strides[group]
            place[:, 0] = 0
            np.cumsum(place, axis=1, out=place)
            sizes = place[:, -1] // strides + 1
            near = place[group, a]
            inside = np.flatnonzero(b[leaf] < n)
            far = leaf[inside]
            corner = np.concatenate([corner + near[leaf], corner[inside] + place[group[far], b[far]]])
            sign = np.concatenate([sign, -sign[inside]])
            leaf = np.concatenate([leaf, far])
            got = np.take(place, rank, axis=1, mode="clip")
            cell = got if cell is None else np.add(cell, got, out=cell)
            shapes.append(sizes)
            strides = strides * sizes
        offsets = np.cumsum(strides) - strides
        grid = np.zeros(int(strides.sum()), np.int64)
        np.add.at(grid, corner + offsets[group[leaf]], sign)
        for start, cells, *shape in zip(offsets.tolist(), strides.tolist(), *[s.tolist() for s in shapes[::-1]]):
            cube = grid[start : start + cells].reshape(shape)
            for axis, size in enumerate(shape):
                if size > 1:
                    np.add.accumulate(cube, axis=axis, out=cube)
        cell += offsets[:, None]
        return np.take(grid, cell, mode="clip")
