"""Benchmark items inside documents: size-partitioned MinHash search for containment, verified by exact shingles.

Items are partitioned into classes by their number n of distinct shingles, from 2^(k-1) to 2^k - 1. The
class sets the length of its items' MinHash sketches: of a class's largest items a text with at least
the share t may lack floor((1-t) (2^k - 1)) shingles, and a sketch has one more of the least hashes. So a
containing text holds at least one hash of the sketch, and of a smaller item of the class more: the
sketch's length less floor((1-t) n). Documents are looked up with those of their shingles whose hash
is no larger than the largest in a class's sketches, and an item of whose sketch enough is met is
verified by its exact shingles. No containing pair is missed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import kept, settle, tidy
from .files import locate

#: Bytes of item texts in a block, and blocks whose index a worker holds at once (some 3 bytes for each byte of text).
BLOCK_BYTES, HELD = 32 << 20, 2
#: Bytes of document text that are hashed together, and that are gathered before blocks are gone through, if there are many.
AT_ONCE, GATHERED = 2 << 20, 32 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
# a word: a run of letters, digits and all that isn't ASCII
_word = re.compile(rb"[0-9a-z\x80-\xff]+")
_is_word = np.zeros(256, bool)
_is_word[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_of(text: str) -> list[bytes]:
    return _word.findall(text.lower().encode("utf-8", "surrogatepass"))


def shingles_of(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    """Runs of `size` words; of fewer words all of them; of none nothing."""
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The start and a hash of each word in a buffer of lower-cased UTF-8, by sums of powers over all its bytes."""
    flags = _is_word[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    # sum of byte x base^(place in word), with the powers of the longest word only
    powers = np.cumprod(np.r_[np.uint64(1), np.full(max(0, int((ends - starts).max(initial=1)) - 1), BASE)])
    place = np.arange(len(data))
    word_start = np.zeros(len(data), np.int64)
    word_start[starts] = starts
    place -= np.maximum.accumulate(word_start)
    terms = np.where(flags, (data.astype(np.uint64) + np.uint64(1)) * powers[np.where(flags, place, 0)], np.uint64(0))
    return starts, mixed(np.add.reduceat(terms, starts) if len(starts) else np.zeros(0, np.uint64))


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` word hashes."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total = total * BASE + words[k : k + len(total)]
    return mixed(total)


def missing(n: int, share: float) -> int:
    """Shingles of n that a text with at least `share` of them may lack."""
    return n - math.ceil(share * n - 1e-9)


def sketch_length(n: int, share: float) -> int:
    """Length of the sketches of items with n distinct shingles: the same for a whole class of sizes."""
    largest = (1 << n.bit_length()) - 1
    return missing(largest, share) + 1


@dataclass
class Sketches:
    """The sketches of items with shingles of `length` words in a class of sizes: hashes, sorted, and their items."""

    length: int
    hashes: np.ndarray
    items: np.ndarray


class Items:
    """A block of items: their texts, and sketches by length of a shingle and class of sizes."""

    def __init__(self, texts: list[str | None], size: int, share: float):
        self.size, self.share = size, share
        self.words = [words_of(t or "") for t in texts]
        self.n = np.zeros(len(texts), np.int64)
        self.need = np.zeros(len(texts), np.int64)
        found: dict[tuple[int, int], tuple[list, list]] = {}
        for k, words in enumerate(self.words):
            if not words:
                continue
            length = min(size, len(words))
            _, h = word_hashes(np.frombuffer(b" ".join(words), np.uint8))
            # by hash, a sketch is the least of them; equal hashes of different shingles only make it longer
            own = np.unique(run_hashes(h, length))
            self.n[k] = n = len(shingles_of(words, size))
            sketch = own[: sketch_length(n, share)]
            self.need[k] = max(1, len(sketch) - missing(n, share))
            hashes, items = found.setdefault((length, n.bit_length()), ([], []))
            hashes.append(sketch)
            items.append(np.full(len(sketch), k))
        self.sketches = []
        for (length, _), (hashes, items) in sorted(found.items()):
            hashes, items = np.concatenate(hashes), np.concatenate(items)
            order = np.argsort(hashes, kind="stable")
            self.sketches.append(Sketches(length, hashes[order], items[order]))

    def met(self, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """doc and item, [2, n], of the pairs with enough of the item's sketch in the document, for the hash and document of each word."""
        pairs, length, hashes = [], None, h
        for s in self.sketches:
            if s.length != length:
                length, hashes = s.length, run_hashes(h, s.length)
            low = np.flatnonzero(hashes <= s.hashes[-1])
            low = low[doc[low] == doc[low + length - 1]]
            low = low[s.hashes[np.searchsorted(s.hashes, hashes[low])] == hashes[low]]
            # a shingle counts once for a document
            order = np.lexsort((hashes[low], doc[low]))
            low = low[order]
            low = low[np.r_[True, (np.diff(doc[low]) != 0) | (np.diff(hashes[low]) != 0)]] if len(low) else low
            first, last = (np.searchsorted(s.hashes, hashes[low], side) for side in ("left", "right"))
            times = last - first
            at = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            key, hits = np.unique(np.repeat(doc[low], times) * len(self.n) + s.items[at], return_counts=True)
            item = key % len(self.n)
            enough = hits >= self.need[item]
            pairs.append(np.stack([key[enough] // len(self.n), item[enough]]))
        return np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """text's index, item's index, shingles in common, the item's shingles, for all containing pairs."""
        lowered = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(lowered), np.uint8)
        if not len(data) or not self.sketches:
            return []
        starts, h = word_hashes(data)
        ends = np.cumsum([len(b) + 1 for b in lowered])
        doc = np.searchsorted(ends, starts, side="right")
        out, held = [], (-1, {})
        for d, i in sorted(map(tuple, self.met(h, doc).T.tolist())):
            item = shingles_of(self.words[i], self.size)
            length = min(self.size, len(self.words[i]))
            if held[0] != d:
                held = (d, {})
            if length not in held[1]:
                held[1][length] = shingles_of(_word.findall(lowered[d]), length)
            common = len(item & held[1][length])
            if common >= self.share * len(item) - 1e-9:
                out.append((d, i, common, len(item)))
        return out


@kept
@lru_cache(maxsize=HELD)
def block_of(uris: tuple[str, ...], size: int, share: float) -> tuple[pa.Array, Items]:
    """Ids and index of a block of items, read from the shared folder; a worker keeps HELD of them from task to task."""
    parts = []
    for system, path in map(locate, uris):
        with system.open_input_file(path) as file:
            parts.append(pq.read_table(file))
    table = pa.concat_tables(parts)
    return table.column(0).combine_chunks(), Items(table.column(1).to_pylist(), size, share)


def blocks(items: DataFrame, item_id: str, text: str) -> list[tuple[str, ...]]:
    """Files of items, by blocks with some BLOCK_BYTES of text each, written by the executors below the shared folder.

    Blocks go by bytes alone: of however many files Spark makes, small ones are a block together.
    """
    own = items.select(F.col(item_id).alias("_item"), F.col(text).alias("_text")).where(F.col(text).isNotNull()).distinct()
    total = own.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    table = settle(own.repartition(1 + total // BLOCK_BYTES, F.xxhash64("_text")), "items")
    name = F.substring_index(F.input_file_name(), "/", -1).alias("name")
    sizes = dict(table.select(name, F.octet_length("_text").alias("size")).groupBy("name").agg(F.sum("size")).collect())
    found, room = [], 0
    for uri in table.inputFiles():
        size = sizes.get(uri.rpartition("/")[2])
        if size is None:  # without rows
            continue
        if not found or size > room:
            found.append([])
            room = BLOCK_BYTES
        found[-1].append(uri)
        room -= size
    return [tuple(x) for x in found]


def gathered(batches: Iterator[pa.RecordBatch], column: int, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Batches as they are, or larger ones where there are more blocks than a worker holds, as each has to read them again."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if n_blocks <= HELD or size >= GATHERED:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def hits(texts: pa.Array, index: Items) -> Iterator[tuple[int, int, int, int]]:
    """What Items.search() finds in a column of texts, AT_ONCE bytes at a time; a null text is empty."""
    step = max(1, AT_ONCE * len(texts) // max(1, texts.nbytes))
    for at in range(0, len(texts), step):
        for d, *rest in index.search([t or "" for t in texts.slice(at, step).to_pylist()]):
            yield at + d, *rest


def contained_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, size: int = 5, share: float = 0.8
) -> DataFrame:
    """doc_id, item_id, n_common, n_shingles, containment: each document with each item it contains.

    Contained: at least `share` of the item's distinct runs of `size` words (an item of fewer words: the
    run of all of them) occur in the document. Words are lower-cased runs of letters, digits and
    anything beyond ASCII. All items are queries against all rows: documents are read once and never
    shuffled, and looked up in blocks of items that workers read from the shared folder. Null or wordless
    texts contain nothing and nothing contains them; an item in several rows is searched for each
    different text; repeated documents repeat their rows. Ids may be of any type; other columns are not
    read. An empty table of documents or items gives an empty result.
    """
    narrow = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where(F.col(text).isNotNull())
    parts, kind = blocks(items, item_id, item_text), items.schema[item_id].dataType
    as_given = to_arrow_type(kind)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", kind), T.StructField("n_common", T.LongType()), T.StructField("n_shingles", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1, len(parts)):
            for part in parts:
                ids, index = block_of(part, size, share)
                found = list(hits(batch.column(1), index))
                if found:
                    where, item, common, n = (pa.array(x, pa.int64()) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), ids.take(item).cast(as_given), common, n], names=schema.names)

    out = narrow.mapInArrow(run, schema)
    return out.withColumn("containment", F.col("n_common") / F.col("n_shingles"))


def without_contained(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, size: int = 5, share: float = 0.8) -> DataFrame:
    """docs without the rows whose text contains an item; all columns stay, whatever their names, and so do null texts.

    Rows are judged one by one, repeated ones alike. An empty table stays empty; without items all rows stay.
    """
    parts, at = blocks(items, item_id, item_text), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, at, len(parts)):
            keep = np.ones(batch.num_rows, bool)
            for part in parts:
                keep[[d for d, *_ in hits(batch.column(at), block_of(part, size, share)[1])]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run, "block_of"), docs.schema)


_WORDS = r"regexp_extract_all(lower(text), '[^\x00-/:-`{-\x7f]+')"
_RUNS = "list_transform(range(1, greatest(len(w) - n + 1, 1) + 1), lambda i: array_to_string(w[i : i + n - 1], ' '))"
ORACLE = f"""
WITH b AS (SELECT DISTINCT item_id, text FROM benchmark),
i AS (SELECT item_id, text, w, least(5, len(w)) AS n FROM (SELECT *, {_WORDS} AS w FROM b) WHERE len(w) > 0),
s AS (SELECT item_id, text, n, unnest(list_distinct({_RUNS})) AS g FROM i),
z AS (SELECT item_id, text, count(*) AS n_shingles FROM s GROUP BY 1, 2),
d AS (SELECT doc_id, n, {_RUNS} AS gs FROM (SELECT doc_id, {_WORDS} AS w FROM documents) CROSS JOIN (SELECT DISTINCT n FROM i) WHERE len(w) > 0),
e AS (SELECT doc_id, n, unnest(list_distinct(gs)) AS g FROM d),
m AS (SELECT e.doc_id, s.item_id, s.text, count(*) AS n_common FROM e JOIN s ON e.n = s.n AND e.g = s.g GROUP BY 1, 2, 3)
SELECT m.doc_id, m.item_id, m.n_common, z.n_shingles, m.n_common / z.n_shingles AS containment
FROM m JOIN z ON m.item_id = z.item_id AND m.text = z.text WHERE m.n_common >= 0.8 * z.n_shingles - 1e-9
"""
