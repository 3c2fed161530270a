import random

import numpy as np
import pytest
import xxhash

from plumbline.llm.components import star_components
from plumbline.llm.simhash import majorities, near_duplicates
from plumbline.llm.vptree import TopTree, distances, forest, near_pairs

from .helpers import awkward, frame


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                label = [label[j] if x == label[i] else x for x in label]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_groups_match_brute_force(spark):
    pick = random.Random(2)
    rows = awkward()
    for k in range(30):
        words = [f"w{pick.randint(0, 500)}" for _ in range(pick.randint(3, 700))]
        for copy in range(pick.randint(1, 4)):
            rows.append((100 + 10 * k + copy, " ".join(words), "en", "a", 0))
            words[pick.randrange(len(words))] = "changed"
    got = near_duplicates(frame(spark, rows, clash=True), "doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute_groups(rows)
    assert near_duplicates(frame(spark, []), "doc_id", "text").count() == 0


def points(n, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    dense = flip(flip(flip(np.full(n // 4, base[0]))))
    return np.unique(np.concatenate([base, flip(base[: n // 4]), flip(flip(base[: n // 5])), dense]))


def test_trees_lose_no_link():
    p = points(3000)
    i, j = np.nonzero(distances(p[:, None], p[None, :]) <= 2)
    want = forest(len(p), i, j)
    assert np.array_equal(forest(len(p), *near_pairs(p, 2)), want)
    tree = TopTree.fit(p[::7], 2, 20)
    index, shard = tree.shards(p)
    assert tree.n_leaves > 8 and set(index.tolist()) == set(range(len(p)))
    found = [(m[a], m[b]) for k in range(tree.n_leaves) for m in [index[shard == k]] for a, b in [near_pairs(p[m], 2)]]
    assert np.array_equal(forest(len(p), *(np.concatenate(x) for x in zip(*found))), want)


def test_neighbour_lookup_of_dense_branches(monkeypatch):
    import plumbline.llm.vptree as v

    p = points(800)
    i, j = np.nonzero(distances(p[:, None], p[None, :]) <= 2)
    monkeypatch.setattr(v, "DENSE", 10)
    monkeypatch.setattr(v, "BRUTE", 100_000)
    assert np.array_equal(forest(len(p), *near_pairs(p, 2)), forest(len(p), i, j))


def test_majorities_of_long_runs():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 254, 255, 256, 0, 1000, 3])
    h = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    at = np.cumsum(sizes) - sizes
    want = [sum(1 << b for b in range(64) if 2 * int(((h[a : a + n] >> np.uint64(b)) & np.uint64(1)).sum()) > n) for a, n in zip(at, sizes)]
    assert majorities(h, sizes).tolist() == want


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = star_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == [(k, 1) for k in range(2, 61)] + [(k, 100) for k in range(101, 160)]


def test_links_without_stars_are_links():
    p = points(1500)
    a, b = near_pairs(p, 2, stars=False)
    assert len(a) > 400 and (distances(p[a], p[b]) <= 2).all() and (b < a).all()
    i, j = np.nonzero(distances(p[:, None], p[None, :]) <= 2)
    least = {}
    for x, y in zip(i.tolist(), j.tolist()):
        if y < x:
            least[x] = min(least.get(x, x), y)
    assert set(a.tolist()) == set(least)
