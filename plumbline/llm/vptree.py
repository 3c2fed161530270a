"""Vantage-point trees over 64-bit fingerprints under the Hamming distance.

A node has a vantage point and a distance m. By the triangle inequality the distances of two linked
fingerprints (at most r bits apart) to the vantage point differ by at most r. So with the near branch
taking distances up to m + r and the far branch those over m, any linked pair shares a branch: only
fingerprints in the band m+1 to m+r go to both.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np

#: Fingerprints up to which all pairs of a branch are compared, and the most that are compared so where no
#: vantage point divides a branch; beyond, each fingerprint's neighbours are looked up one by one.
BRUTE, DENSE = 384, 60_000
#: The largest radius for which neighbours are looked up.
LOOK_UP = 3
#: A branch must leave out at least this share of its parent.
LEAVES_OUT = 0.08
TRIES = 4


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and distance that leave the fewest points in both branches together, if any do divide."""
    best, found = 2 * len(points) + 1, None
    for vantage in points[rng.integers(0, len(points), TRIES)]:
        counts = np.bincount(distances(points, vantage), minlength=65)
        upto = np.cumsum(counts)
        m = np.arange(65 - radius)
        near, far = upto[m + radius], len(points) - upto[m]
        cost = np.where(np.maximum(near, far) <= (1 - LEAVES_OUT) * len(points), near + far + np.abs(near - far) / 2, np.inf)
        k = int(np.argmin(cost))
        if cost[k] < best:
            best, found = cost[k], (np.uint64(vantage), int(m[k]))
    return found


@dataclass
class TopTree:
    """The upper part of a tree, fitted on a sample; its leaves are shards."""

    vantage: np.ndarray
    bound: np.ndarray
    near: np.ndarray
    far: np.ndarray
    radius: int
    n_leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, radius: int, leaf: int, seed: int = 7) -> TopTree:
        """Divide until a leaf has at most `leaf` points of the sample. Children below 0 are leaves -1, -2, ..."""
        rng, nodes, leaves = np.random.default_rng(seed), [], 0
        todo = [(sample, None, 0)]
        while todo:
            points, parent, side = todo.pop()
            cut = split(points, radius, rng) if len(points) > leaf else None
            if cut is None:
                leaves, me = leaves + 1, -leaves - 1
            else:
                me = len(nodes)
                nodes.append([*cut, 0, 0])
                d = distances(points, cut[0])
                todo += [(points[d <= cut[1] + radius], me, 2), (points[d > cut[1]], me, 3)]
            if parent is not None:
                nodes[parent][side] = me
        columns = list(zip(*nodes)) if nodes else [[], [], [], []]
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        return cls(*(np.array(x, t) for x, t in zip(columns, kinds)), radius, leaves)

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of points and the shards each belongs to: its own and those whose boundary it is near."""
        index = np.arange(len(points))
        if not len(self.vantage):
            return index, np.zeros(len(points), np.int64)
        at, out = np.zeros(len(points), np.int64), []
        while len(index):
            d = distances(points[index], self.vantage[at]).astype(np.int64)
            near, far = d <= self.bound[at] + self.radius, d > self.bound[at]
            index, at = np.r_[index[near], index[far]], np.r_[self.near[at[near]], self.far[at[far]]]
            leaf = at < 0
            out.append((index[leaf], -at[leaf] - 1))
            index, at = index[~leaf], at[~leaf]
        return tuple(np.concatenate(x) for x in zip(*out))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each of n points' component, for edges between a and b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (up := label[label]) is not label and not np.array_equal(up, label):
            label = up


def least_neighbours(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between n points, for each point that has a lesser neighbour the edge to its least one."""
    least = np.arange(n)
    np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
    i = np.flatnonzero(least != np.arange(n))
    return i, least[i]


def _thin(members: np.ndarray, i: np.ndarray, j: np.ndarray, stars: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a branch; where they are many, a star for each component instead, which joins the same points, or
    without stars each point's edge to its least neighbour."""
    if len(i) > 4 * len(members) and not stars:
        i, j = least_neighbours(len(members), i, j)
    elif len(i) > 4 * len(members):
        label = forest(len(members), i, j)
        i = np.flatnonzero(label != np.arange(len(members)))
        j = label[i]
    return members[i], members[j]


def near_pairs(points: np.ndarray, radius: int, seed: int = 11, stars: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges (indexes into points, which are distinct) that join all points within radius, transitively.

    Every edge joins points of one component, and no link's two ends are left in different components.
    Without stars edges are links themselves, each point's to its least neighbour, and needn't join whole
    components: candidates for those who look closer.
    """
    rng = np.random.default_rng(seed)
    todo, found = [np.arange(len(points))], []
    while todo:
        members = todo.pop()
        own = points[members]
        cut = split(own, radius, rng) if len(members) > BRUTE else None
        if cut is not None:
            d = distances(own, cut[0])
            todo += [members[d <= cut[1] + radius], members[d > cut[1]]]
        elif len(members) <= DENSE or radius > LOOK_UP:
            step = max(1, 2_000_000 // max(1, len(members)))
            for k in range(0, len(members), step):
                i, j = np.nonzero(distances(own[k : k + step, None], own[None, :]) <= radius)
                later = j > i + k
                found.append(_thin(members, i[later] + k, j[later], stars))
        else:
            order = np.argsort(own)
            ranked = own[order]
            for bits in (c for k in range(1, radius + 1) for c in combinations(range(64), k)):
                flip = np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(ranked, own ^ flip), len(ranked) - 1)
                hit = np.flatnonzero(ranked[at] == own ^ flip)
                found.append((members[hit], members[order[at[hit]]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    if not stars:
        return least_neighbours(len(points), a, b)
    label = forest(len(points), a, b)
    i = np.flatnonzero(label != np.arange(len(points)))
    return i, label[i]
