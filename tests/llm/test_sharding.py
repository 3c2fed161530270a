import zlib
from collections import Counter

import numpy as np

from plumbline.llm.sharding import assign_shards, jump_buckets, shard_layout

from .helpers import awkward, frame


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_buckets_are_the_published_ones():
    keys = np.array([0, 1, 2, 10, 256, -1, -(2**63), 2**63 - 1, *range(1000, 1300)])
    for n in (1, 2, 16, 17, 1000):
        assert jump_buckets(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20_000)
    before, after = jump_buckets(keys, 16), jump_buckets(keys, 17)
    moved = before != after
    assert (after[moved] == 16).all() and abs(moved.mean() - 1 / 17) < 0.01


def test_layout(spark):
    got = shard_layout(frame(spark, clash=True), "doc_id", "text", 16).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in awkward())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        assert (r.law, r.shard, r.grown_shard) == ("key", jump(key, 16), jump(key, 17))
    for shard in {r.shard for r in got}:
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in got if r.shard == shard)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert shard_layout(frame(spark, []), "doc_id", "text", 16).count() == 0


def test_other_key_types(spark):
    rows = assign_shards(frame(spark), "source", 8).select("source", "shard").distinct().collect()
    assert len(rows) == len({r.source for r in rows}) and all(0 <= r.shard < 8 for r in rows)
