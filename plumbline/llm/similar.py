"""Near copies by a Jaccard index of word shingles: a fingerprint tree first, then an exact search for the rest.

Texts with the same words (by a 128-bit digest) are one class. Classes whose SimHash fingerprints are
within a few bits are found by the vantage-point tree of simhash.linked, and each link is verified by
whole sets of shingles: that joins most copies. What it can't see is found by prefix and position
filters, which miss no pair: texts as similar share one of their leading shingles. Everything that a
pair needs besides (whole sets) is read again from the texts, for those in question only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import forget, settle, tidy
from .components import star_components
from .simhash import majorities, linked, shingle_hashes

#: Rare shingles are told from usual ones by one of so many texts; usual shingles held (16 bytes each).
SAMPLED, USUAL = 16, 1 << 20
#: While more candidate pairs than this for each row are left, texts are compared with one of each shingle's
#: texts at a time, ROUNDS times at most and no more once a round has left over STILL of them. Only the order of
#: work depends on these.
FEW, ROUNDS, STILL = 16, 6, 7 / 8
#: Pairs a set is given out for at a time.
SHARE = 512
#: Edges up to which the driver joins them (16 bytes each); beyond, tasks do.
TOGETHER = 1 << 17
#: Shingles before each leading one that are kept with it; more of them leave fewer repeats of a pair, none changes a result.
EARLIER = 4
BEFORE = [f"_p{k}" for k in range(EARLIER)]
#: Words of 64 bits in a set's sketch.
SKETCH = 4
BITS = [f"_b{k}" for k in range(SKETCH)]
#: Bits of a filter for each thing it holds, and the most it has whatever it holds (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27


class Filter:
    """Tells which 64-bit keys may be among those it was made of, and surely isn't wrong about one that is.

    Its size is bounded: with more keys than it has room for it lets more others pass, which only costs work.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        return mixed >> np.uint64(64 - (bits.bit_length() - 1)), (mixed ^ (keys >> np.uint64(29))) & np.uint64(bits - 1)

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Filter:
        """Made by the executors, in four parts that the driver lays over each other."""
        count = df.count()
        bits = min(MOST_BITS, max(1 << 16, 1 << (BITS_EACH * count).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                keys = batch.column(0).to_numpy().view(np.uint64)
                for at in cls.places(keys, bits):
                    np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["bits"])

        table = np.zeros(bits // 8, np.uint8)
        for row in df.select(column).coalesce(4).mapInArrow(tidy(run), "bits binary").collect():
            table |= np.frombuffer(row["bits"], np.uint8)
        return cls(table)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        hit = [self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 for at in self.places(keys, 8 * len(self.table))]
        return (hit[0] & hit[1]).astype(bool)


def signed(x: np.ndarray | list) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def digest_of(text: bytes) -> bytes:
    """A 128-bit digest of a text's words in order."""
    return xxh3_128_digest(b" ".join(text.lower().split()))


def prefix_length(size: int, similarity: float) -> int:
    """Leading shingles of which texts with a Jaccard index of `similarity` share one, whatever order all texts use."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def usual_shingles(df: DataFrame, text: str, words: int) -> np.ndarray:
    """The shingles found most in a sample of texts, sorted, and their counts: [2, n], USUAL at most.

    They only set the order in which shingles are taken, rare ones first: no result depends on them. The
    sample is a share of all texts, so that a shingle that counts as rare has few of them at any size.
    """
    key = F.xxhash64(text)
    own = df.select(key.alias("_key"), F.col(text).cast("binary").alias("_text")).where(F.pmod(key, F.lit(SAMPLED)) == 0).dropDuplicates(["_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                found = np.unique(np.array(shingle_hashes(t.as_py() or b"", words), np.uint64))
                yield pa.RecordBatch.from_arrays([signed(found)], names=["_shingle"])

    counts = settle(own.select("_text").mapInArrow(tidy(run), "_shingle long").groupBy("_shingle").count().where("count > 2"), "usual")
    least, held = 3, 0
    for row in counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("count")).collect():  # a row for each count that occurs
        held += row["n"]
        least = row["count"]
        if held > USUAL:
            least += 1
            break
    top = counts.where(F.col("count") >= least).toPandas()
    forget(counts)
    names = top["_shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    return np.stack([names[order], top["count"].to_numpy(np.int64).astype(np.uint64)[order]])


def leading(found: np.ndarray, usual: np.ndarray, similarity: float) -> np.ndarray:
    """The leading ones of a text's distinct shingles: least often in the sample first, then by hash."""
    n = prefix_length(len(found), similarity)
    if not len(usual[0]) or not len(found):
        return found[:n]
    at = np.minimum(np.searchsorted(usual[0], found), len(usual[0]) - 1)
    return found[np.lexsort((found, np.where(usual[0][at] == found, usual[1][at], 0)))[:n]]


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """SKETCH words for each run of `sizes` distinct hashes: which of 64 * SKETCH slots hold an odd number of them.

    A hash that only one of two sets has turns one bit, so sketches differ in no more bits than sets in hashes.
    """
    mixed = hashes * np.uint64(0xD6E8FEB86659FD93)
    slot = (mixed >> np.uint64(58 - (SKETCH - 1).bit_length())).astype(np.int64) % (64 * SKETCH)
    odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * (64 * SKETCH) + slot, minlength=len(sizes) * 64 * SKETCH) & 1
    return list(np.packbits(odd.astype(bool).reshape(-1, 64 * SKETCH), axis=1, bitorder="little").view("<u8").T.copy())


def _rows(df: DataFrame, doc_id: str, text: str) -> list[Column]:
    """_rep, a hash of a row's id and text, and _text."""
    return [F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("_rep"), F.col(text).cast("binary").alias("_text")]


def shingle_prints(df: DataFrame, doc_id: str, text: str, words: int, similarity: float) -> DataFrame:
    """_doc, _rep, _words (digest), _size (distinct shingles), _fp (their SimHash), _leading and BITS (their sketch) of each row."""
    usual = df.sparkSession.sparkContext.broadcast(usual_shingles(df, text, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [t.as_py() or b"" for t in part.column(2)]
                sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)) for t in raw]
                sizes = np.fromiter(map(len, sets), np.int64, len(sets))
                first = [leading(s, usual.value, similarity) for s in sets]
                offsets = pa.array(np.cumsum([0, *map(len, first)]).astype(np.int32))
                none = np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(offsets, signed(np.concatenate([none, *first])))
                every = np.concatenate([none, *sets])
                prints, bits = majorities(every, sizes), map(signed, sketches(every, sizes))
                names = pa.array([digest_of(t) for t in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], names, pa.array(sizes.astype(np.int32)), signed(prints), lists, *bits], names=out)

    out = ["_doc", "_rep", "_words", "_size", "_fp", "_leading", *BITS]
    narrow = df.select(F.col(doc_id).alias("_doc"), *_rows(df, doc_id, text))
    kinds = f"_doc {narrow.schema['_doc'].dataType.simpleString()}, _rep long, _words binary, _size int, _fp long, _leading array<long>"
    return narrow.mapInArrow(tidy(run), ", ".join([kinds, *(f"{b} long" for b in BITS)]))


def word_prints(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` and _words, a digest of each text's words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.array([digest_of(t.as_py() or b"") for t in batch.column(len(keep))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], names], names=[*keep, "_words"])

    narrow = df.select(*keep, F.col(text).cast("binary").alias("_text"))
    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(tidy(run), f"{kinds}, _words binary")


def met_rows(classes: DataFrame) -> DataFrame:
    """_node, _size, BITS, _at, BEFORE, _shingle for each leading shingle that more than one class has, settled.

    BEFORE are the shingles that come before it among the class's leading ones, the nearest first, null where there are fewer.
    """
    wide = classes.select("_leading", "_node", "_size", *BITS)

    def exploded(sieve: Filter):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(0)
                lengths = lists.value_lengths().to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), lengths)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                shingle = lists.flatten().to_numpy()
                own = np.flatnonzero(sieve.may_hold(shingle.view(np.uint64)))
                take = pa.array(owner[own])
                kept = [c.take(take) for c in batch.columns[1:]]
                earlier = [pa.array(shingle[np.maximum(own - k, 0)], mask=at[own] < k) for k in range(1, EARLIER + 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(at[own].astype(np.int32)), *earlier, pa.array(shingle[own])], names=["_node", "_size", *BITS, "_at", *BEFORE, "_shingle"])

        return wide.mapInArrow(tidy(run), ", ".join(["_node long, _size int", *(f"{b} long" for b in BITS), "_at int", *(f"{p} long" for p in BEFORE), "_shingle long"]))

    each = classes.select(F.explode("_leading").alias("_shingle")).groupBy("_shingle").agg(F.count(F.lit(1)).alias("_n"))
    met = settle(each.where("_n > 1").select("_shingle"), "met")
    rows = settle(exploded(Filter.of(met, "_shingle")).join(met, "_shingle"), "leading")
    forget(met)
    return rows


def shingle_sets(df: DataFrame, doc_id: str, text: str, chosen: DataFrame, words: int) -> DataFrame:
    """_node and _set (sorted distinct hashes, 8 bytes each) for each _node, _words and _rep of chosen, settled.

    Texts aren't shuffled: a filter of bounded size tells which rows may be those chosen, and their sets are.
    """
    sieve = Filter.of(chosen, "_rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.flatnonzero(sieve.may_hold(batch.column(0).to_numpy().view(np.uint64)))
            for at in range(0, len(own), 256):
                raw = [t or b"" for t in batch.column(1).take(pa.array(own[at : at + 256])).to_pylist()]
                sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)).tobytes() for t in raw]
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(t) for t in raw], pa.binary()), pa.array(sets, pa.binary())], names=["_words", "_set"])

    sets = df.select(*_rows(df, doc_id, text)).mapInArrow(tidy(run), "_words binary, _set binary")
    return settle(sets.join(chosen.select("_words", "_node").hint("merge"), "_words").dropDuplicates(["_words"]).select("_node", "_set"), "sets")


def as_similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs u, v of nodes whose sets have a Jaccard index of at least `similarity`, exactly."""
    return sharing(pairs, sets, lambda common, a, b, least: common / (a + b - common) >= similarity)


def sharing(pairs: DataFrame, sets: DataFrame, enough: Callable[[int, int, int, int], bool]) -> DataFrame:
    """Those of the distinct pairs u, v of nodes for which enough(entries in common, entries of either, the pair's _least or 0).

    sets has _node and _set, distinct numbers of 64 bits as bytes or a list. A set that is v in many pairs is given
    out SHARE pairs at a time, so that no task gets all of them.
    """
    least = F.col("_least") if "_least" in pairs.columns else F.lit(0)
    pairs = pairs.select("u", "v", least.cast("int").alias("_least"))
    shares = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("_n"))
    given = shares.join(sets.select(F.col("_node").alias("v"), F.col("_set").alias("_b")), "v")
    given = given.select("v", "_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_share"))
    dealt = pairs.join(shares, "v").select("u", "v", "_least", F.pmod(F.xxhash64("u"), F.col("_n")).cast("int").alias("_share"))
    own = dealt.join(sets.select(F.col("_node").alias("u"), F.col("_set").alias("_a")).hint("merge"), "u")
    both = own.join(given.hint("merge"), ["v", "_share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, b, least) in enumerate(zip(*map(numbers, batch.columns[2:4]), batch.column(4).to_pylist())):
                both = np.sort(np.concatenate([a, b]), kind="stable")
                keep[k] = enough(int((both[1:] == both[:-1]).sum()), len(a), len(b), least)
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "_a", "_b", "_least").mapInArrow(tidy(run), "u long, v long")


def numbers(sets: pa.Array) -> Iterator[np.ndarray]:
    """Each set's numbers of 64 bits, given as bytes or as a list."""
    for s in sets:
        yield s.values.to_numpy().view(np.uint64) if pa.types.is_list(sets.type) else np.frombuffer(s.as_buffer(), np.uint64)


def by_fingerprint(classes: DataFrame, radius: int) -> DataFrame:
    """Pairs u, v of nodes by fingerprints: of equal ones with the least of them, of linked ones with the other's least."""
    own = classes.select("_node", "_fp")
    prints = settle(own.groupBy("_fp").agg(F.min("_node").alias("_first")), "prints")
    near = linked(prints, radius, stars=False).select(F.col("u").alias("_fp"), F.col("v").alias("_to"))
    least = lambda name: prints.select(F.col("_fp").alias(name), F.col("_first").alias(f"{name}_first"))
    apart = near.join(least("_fp"), "_fp").join(least("_to"), "_to").select(F.col("_fp_first").alias("u"), F.col("_to_first").alias("v"))
    same = own.join(prints, "_fp").where("_node <> _first").select(F.col("_node").alias("u"), F.col("_first").alias("v"))
    return same.union(apart)


def may_share(a: str, b: str, similarity: float) -> Column:
    """False only where sizes or sketches of the rows a and b show that their sets aren't as similar.

    Sets that share need(sizes) differ in the rest of both sizes, and their sketches in no more bits.
    """
    x, y = F.col(f"{a}._size"), F.col(f"{b}._size")
    apart = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in BITS), F.lit(0))
    return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9) & (apart <= x + y - 2 * F.ceil(similarity / (1 + similarity) * (x + y) - 1e-9))


def enough_behind(u: str, v: str, similarity: float) -> Column:
    """Whether a shingle at {u}at and {v}at of two texts may be the first that they share, if they are similar (position filter).

    Two sets as similar share need(sizes) shingles: the first one shared must leave as many behind it in both.
    """
    x, y = F.col(f"{u}_size"), F.col(f"{v}_size")
    return F.least(x - F.col(f"{u}_at"), y - F.col(f"{v}_at")) >= F.ceil(similarity / (1 + similarity) * (x + y) - 1e-9)


def least_leading(u: str, v: str, similarity: float) -> Column:
    """Leading shingles that two texts as similar share, at least.

    Beyond the leading shingles of the text whose last one comes first in the order, of which none is missing in a
    count of all that are shared, there are no more than the rest of it.
    """
    x, y = F.col(f"{u}_size"), F.col(f"{v}_size")
    return F.ceil(similarity / (1 + similarity) * (x + y) - 1e-9) - F.ceil(similarity * F.greatest(x, y) - 1e-9) + 1


def likely(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs u, v of met (a row for each leading shingle that two texts share: u, v and both texts' _size and _at) that may be similar."""
    room, least = enough_behind("_u", "_v", similarity), least_leading("_u", "_v", similarity)
    sums = met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("_n"), F.max(room).alias("_room"), F.first(least).alias("_least"))
    return sums.where("_room AND _n >= _least").select("u", "v", "_n")


def similar(df: DataFrame, doc_id: str, text: str, classes: DataFrame, words: int, similarity: float, radius: int = 2) -> DataFrame:
    """Edges u, v between nodes of classes whose texts have a Jaccard index of at least `similarity`, that join all such pairs.

    classes has _node, _words, _rep, _size, _fp, _leading and BITS, and is forgotten. Each edge is verified by whole
    sets. First come pairs by fingerprint. Then, while many candidates are left and rounds make them fewer, each text is
    compared with the one text of its leading shingles with which it shares most, a text for each shingle, in the
    first round the one that meets others most: in a large group of near copies most are like one of the least edited;
    last, all pairs that may be similar and are in no common group yet: each is made where the two first meet (see
    first_met), and the leading shingles that it shares are counted from both texts' lists.
    """
    rows = met_rows(classes)
    names = classes.select("_node", "_words", "_rep")
    near = settle(by_fingerprint(classes, radius), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        chosen = pairs.select(F.explode(F.array("u", "v")).alias("_node")).distinct()
        chosen = settle(names.join(chosen, "_node", "left_semi"), "chosen")
        sets = shingle_sets(df, doc_id, text, chosen, words)
        found = settle(as_similar(pairs, sets, similarity), "edges")
        forget(pairs, chosen, sets)
        return found

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        same = F.col("a._shingle") == F.col("b._shingle")
        both = a.join(b, same & (F.col("a._root") != F.col("b._root")) & may_share("a", "b", similarity))
        side = lambda x, to: (F.col(f"{x}._node").alias(to), F.col(f"{x}._size").alias(f"_{to}_size"), F.col(f"{x}._at").alias(f"_{to}_at"))
        return both.select(*side("a", "u"), *side("b", "v"))

    edges = verified(near)
    total, left, worth, open_before = rows.count(), None, True, math.inf
    for k in range(ROUNDS + 1):
        stars = star_components(edges, TOGETHER)
        roots = stars.select(F.col("u").alias("_node"), F.col("v").alias("_root"))
        labelled = rows.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
        groups = labelled.groupBy("_shingle", "_root").agg(F.count(F.lit(1)).alias("_n"))
        several = groups.groupBy("_shingle").agg(F.max_by("_root", F.struct("_n", "_root")).alias("_main"), F.count(F.lit(1)).alias("_groups"), F.sum("_n").alias("_texts"), F.max("_n").alias("_most"))
        several = settle(several.where("_groups > 1").withColumn("_pairs", (F.col("_texts") - F.col("_most")) * F.col("_texts").cast("double")), "several")
        before, left = left, settle(labelled.join(several.select("_shingle", "_main", "_texts"), "_shingle"), "open")
        open_pairs = several.agg(F.sum("_pairs")).first()[0] or 0
        forget(stars, several, *([before] if before is not None else []))
        if k == ROUNDS or not worth or open_pairs <= FEW * total or open_pairs > STILL * open_before:
            break
        open_before = open_pairs
        meets = left.groupBy("_node").agg((-F.sum("_texts")).alias("_order")) if k == 0 else left.select("_node", F.xxhash64("_node", F.lit(k)).alias("_order")).distinct()
        pivot = F.min(F.struct("_order", "_node", "_size", *BITS, "_at", "_root")).alias("b")
        pivots = left.join(meets, "_node").groupBy("_shingle").agg(pivot).select("_shingle", "b.*")
        best = likely(met(left, pivots), similarity).groupBy("u").agg(F.max_by("v", F.struct("_n", "v")).alias("v"))
        best = settle(best, "pairs")
        tried = best.count()
        found = verified(best)
        worth = 8 * found.count() >= tried > 0  # else what is left is mostly texts that aren't alike
        before_edges, edges = edges, settle(edges.unionByName(found), "edges")
        forget(before_edges, found)
    met_first = settle(first_met(left, similarity).distinct(), "pairs")
    forget(rows, left)
    pairs = sharing(met_first, classes.select("_node", F.col("_leading").alias("_set")), lambda common, a, b, least: common >= least)
    last = verified(settle(pairs, "pairs"))
    forget(met_first, classes)
    return edges.unionByName(last)


def first_met(left: DataFrame, similarity: float) -> DataFrame:
    """Pairs u, v, u < v, of left (rows of met_rows with _root, and _main for each shingle) across groups that may be similar, and their _least.

    The first leading shingle that two similar texts share passes the position filter, and none before it is shared:
    rows with a common shingle in BEFORE say that the pair has met before, and aren't made. So a pair is
    made once or a few times, not for each shingle it shares. A pair across groups has a text outside its shingle's
    largest group; of two such texts, the lesser is a.
    """
    # Sizes of sets as similar are in one class or two that follow each other, so other classes needn't meet.
    # Classes are a little wider than that, so that rounding can't part a pair.
    scale = F.floor(F.log("_size") / -math.log(0.99 * similarity)).cast("int")
    minor, every = left.where("_root <> _main").withColumn("_class", scale), left.withColumn("_class", scale)
    minor = minor.withColumn("_class", F.explode(F.array(F.col("_class") - 1, F.col("_class"), F.col("_class") + 1)))
    same = (F.col("a._shingle") == F.col("b._shingle")) & (F.col("a._class") == F.col("b._class")) & (F.col("a._root") != F.col("b._root"))
    once = (F.col("b._root") == F.col("b._main")) | (F.col("a._node") < F.col("b._node"))
    before = reduce(or_, (F.col(f"a.{p}") == F.col(f"b.{q}") for p in BEFORE for q in BEFORE))  # null where there are fewer
    new = once & enough_behind("a.", "b.", similarity) & ~F.coalesce(before, F.lit(False))
    both = minor.alias("a").join(every.alias("b"), same & new & may_share("a", "b", similarity))
    ends = F.least("a._node", "b._node").alias("u"), F.greatest("a._node", "b._node").alias("v")
    return both.select(*ends, least_leading("a.", "b.", similarity).alias("_least"))


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def similar_groups(df: DataFrame, doc_id: str, text: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """_doc (the id), _words (digest of the words), _root (the group) and component_id (its least id) of each row of df.

    Texts with the same words are copies. Different ones are linked if their sets of distinct runs of
    `words` words (by 64-bit hashes) have a Jaccard index of at least `similarity`; all such pairs are
    linked, and no others. Groups are closed under links. Null and wordless texts are copies of each other.
    component_id is null only where no row of the group has an id. Repeated rows each have a result; other
    columns are not read; an empty table gives an empty result.
    """
    with shuffles_freed(df.sparkSession):
        prints = settle(shingle_prints(df, doc_id, text, words, similarity), "shingles")
        first = F.min(F.struct("_rep", "_size", "_fp", "_leading", *BITS)).alias("_one")
        one = prints.groupBy("_words").agg(F.min("_doc").alias("_least"), first)
        classes = settle(one.select(F.monotonically_increasing_id().alias("_node"), "_words", "_least", "_one.*"), "classes")
        narrow = settle(prints.select("_doc", "_words"), "rows")
        nodes = settle(classes.select("_node", "_words", "_least"), "nodes")
        forget(prints)
        edges = similar(df, doc_id, text, classes, words, similarity)
        stars = star_components(edges, TOGETHER)
        roots = stars.select(F.col("u").alias("_node"), F.col("v").alias("_root"))
        rooted = nodes.join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
        least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
        named = rooted.join(least, "_root").select("_words", "_root", "component_id")
        grouped = settle(narrow.join(named.hint("merge"), "_words"), "grouped")
        forget(edges, stars, narrow, nodes)
        return grouped


def keep_one_of_similar(df: DataFrame, doc_id: str, text: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """df with one row of each group of near copies (see similar_groups): that with the smallest id. All columns stay.

    A row without an id stays only if no row of its group has one; of rows that share an id and their
    words one stays. Names of other columns may be any; an empty table stays empty.
    """
    grouped = similar_groups(df, doc_id, text, words, similarity)
    with shuffles_freed(df.sparkSession):
        repeated = grouped.groupBy("_doc").count().where(F.col("_doc").isNull() | (F.col("count") > 1))
        if not repeated.limit(1).count():
            kept = settle(grouped.where(F.col("_doc") == F.col("component_id")).select("_doc"), "kept")
            # sorted and merged at every size: the ids to keep are as many as the documents, never a table to broadcast
            return df.join(kept.hint("merge"), df[doc_id] == kept["_doc"], "left_semi")
        first = F.min(F.struct(F.col("_doc").isNull(), "_doc", "_words"))
        kept = settle(grouped.groupBy("_root").agg(first.alias("_row")).select("_row._doc", "_row._words"), "kept")
        held = df.select(F.struct(*(df[c] for c in df.columns)).alias("_whole"), df[doc_id].alias("_id"), df[text].alias("_body"))
        tagged = word_prints(held, "_body", ["_whole", "_id"])
        same = tagged["_id"].eqNullSafe(kept["_doc"]) & (tagged["_words"] == kept["_words"])
        return tagged.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["_id", "_words"]).select("_whole.*")
