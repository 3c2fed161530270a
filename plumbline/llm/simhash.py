"""SimHash fingerprints of word shingles, and groups of texts whose fingerprints are near, by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import settle
from .components import star_components
from .vptree import TopTree, forest, near_pairs

SEED = 42
#: Fingerprints that the upper tree is fitted on (8 bytes each, on the driver), and those aimed at in a shard.
SAMPLE, SHARD = 65_536, 4096
#: Bytes of text whose shingles are hashed together.
AT_ONCE = 1 << 20

# eight counters in a 64-bit word: a byte's bits spread out, lowest first
_spread = np.array([sum((b >> k & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of each run of `words` words, space-joined; fewer words: of them all; none: no hash.

    Words are runs of bytes other than space and \\x09-\\x0D, A-Z lower-cased; shingles repeat as they occur.
    """
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1).tolist()
    return [xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]


def majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` hashes the fingerprint whose bits are set in over half of them; no hashes: zero."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    begins = (np.cumsum(sizes) - sizes)[full]
    # parts of at most 255 hashes, so that counters of a byte don't overflow
    parts = -(-sizes[full] // 255)
    owner = np.repeat(np.arange(len(full)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = begins[owner] + 255 * nth
    raw = hashes.view(np.uint8).reshape(-1, 8)
    first = np.cumsum(parts) - parts
    bits = np.zeros((len(full), 64), bool)
    for k in range(8):
        counts = np.add.reduceat(_spread[raw[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(counts.astype(np.int64), first) > sizes[full, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, text: str, keep: list[str], words: int = 3) -> DataFrame:
    """Columns `keep` and _fp, the text's fingerprint as a signed 64-bit number; a null text or one without words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, done = batch.column(len(keep)), []
            step = max(1, AT_ONCE * batch.num_rows // max(1, texts.nbytes))
            for at in range(0, batch.num_rows, step):
                lists = [shingle_hashes(t or b"", words) for t in texts.slice(at, step).to_pylist()]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(sizes.sum()))
                done.append(majorities(hashes, sizes))
            fp = np.concatenate(done) if done else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp.view(np.int64))], names=[*keep, "_fp"])

    narrow = df.select(*keep, F.col(text).cast("binary").alias("_text"))
    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(run, f"{kinds}, _fp long")


def linked(prints: DataFrame, radius: int, stars: bool = True) -> DataFrame:
    """Edges u, v between distinct fingerprints (column _fp) that join all pairs within `radius` bits.

    The upper tree is fitted on about SAMPLE fingerprints, or all of fewer, chosen by a hash of their bits; every
    fingerprint is then dealt to its shard and to those whose boundary it is near, and each shard's
    pairs are found exactly. A shard returns fewer edges than it has fingerprints; without stars they are
    links themselves (see near_pairs).
    """
    n = prints.count()
    # a share of all hashes, so that no more than the sample itself goes to the driver, whatever number of tasks there is
    bound = min(2**63 - 1, int(min(1.0, SAMPLE / max(1, n)) * 2.0**64) - 2**63)
    chosen = prints.select("_fp").where(F.xxhash64("_fp") <= bound)
    points = np.sort(chosen.toPandas()["_fp"].to_numpy(np.int64).view(np.uint64))
    tree = TopTree.fit(points, radius, max(8, round(SHARD * len(points) / max(1, n))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            index, shard = tree.shards(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(own[index])], names=["shard", "_fp"])

    def search(group: pa.Table) -> pa.Table:
        own = group.column("_fp").to_numpy()
        a, b = near_pairs(own.view(np.uint64), radius, stars=stars)
        return pa.table({"u": pa.array(own[a]), "v": pa.array(own[b])})

    dealt = prints.select("_fp").mapInArrow(deal, "shard int, _fp long")
    return dealt.groupBy("shard").applyInArrow(search, "u long, v long")


def group_by_fingerprint(prints: DataFrame, doc_id: str, radius: int = 2) -> DataFrame:
    """doc_id, _fp, component_id and _root for each row of a settled table of doc_id and _fp.

    Rows whose fingerprints are within `radius` bits are linked; component_id is the smallest doc_id
    reachable over links (null only where no linked row has an id), _root names the group. Equal
    fingerprints are one node, however many rows have them. Every row stays, repeated ones too.
    """
    classes = settle(prints.groupBy("_fp").agg(F.min(doc_id).alias("_least")), "classes")
    stars = star_components(linked(classes, radius)).select(F.col("u").alias("_fp"), F.col("v").alias("_root"))
    rooted = classes.select("_fp", "_least").join(stars, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = rooted.select("_fp", "_root").join(least, "_root").select("_fp", "_root", "component_id")
    return prints.join(named, "_fp").select(doc_id, "_fp", "component_id", "_root")


def near_duplicates(df: DataFrame, doc_id: str, text: str, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    Null and wordless texts have fingerprint zero and are linked like any other. Other columns are not
    read. An empty table gives an empty result.
    """
    prints = settle(fingerprints(df, text, [doc_id], words), "fingerprints")
    grouped = group_by_fingerprint(prints, doc_id, radius)
    return grouped.select(doc_id, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
