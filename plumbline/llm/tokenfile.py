"""Token ids as Arrow files of equal-length sequences.

A file NAME.arrow is an Arrow IPC file whose record batches hold two fixed-size lists of `length`
entries: `ids` (uint16 or uint32, whichever the vocabulary fits in) and `mask` (bits: false for padding
and for each document's last id, so true where the next id belongs to the same document). Its ids run
on from one document to the next; the last sequence is padded. Batches have ROWS sequences each
(the last may have fewer), so sequence k lies in batch k // ROWS at row k % ROWS and is read as a
view on the mapped file, without copying. NAME.docs.arrow lists the file's documents in order with
their first id's place and their number of ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, new_path, settle, tasks_for, tidy
from .files import Draft, open_file
from .wordbpe import WordBPE, load

#: Ids of a sequence, sequences of a record batch.
LENGTH, ROWS = 1024, 256
#: Pre-tokens in one call of the library, whose working memory is a hundred times their text.
TOGETHER = 3000
#: Characters that are encoded at once, and chunks and pre-tokens whose ids a worker remembers; neither changes a result.
AT_ONCE, REMEMBERED = 4_000_000, 900_000


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    starts, sizes = starts[sizes > 0], sizes[sizes > 0]
    steps = np.ones(int(sizes.sum()), np.int32)
    if len(starts):
        steps[0] = starts[0]
        steps[np.cumsum(sizes)[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(steps, dtype=np.int32)


class Encoder:
    """The library's ids of whole texts. Distinct pre-tokens are encoded once and remembered."""

    def __init__(self, path: str, end_id: int, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.bpe: WordBPE = load(path)
        names = self.bpe.library.get_vocab()
        top = max(*names.values(), end_id)
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.ends = np.zeros(top + 1, bool)
        self.ends[[i for w, i in names.items() if w.endswith(self.bpe.end)]] = True
        self.end_id = end_id
        self.elder: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # of chunks and of pre-tokens, which may be whole chunks

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (type self.kind) of all texts in a row, each one's end id last, and each one's number of ids.

        Chunks are found, numbered and put together by whole arrays; Python sees each distinct one once.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.bpe.hinders) if self.bpe.hinders else pa.array([True] * len(texts), pa.bool_())
        lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(odd))))
        numbered = lists.flatten().dictionary_encode()
        distinct = numbered.dictionary.to_pylist()
        self._learn(distinct)
        values = list(map(self.known.__getitem__, distinct))
        lengths = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
        whole = np.frombuffer(b"".join(values), self.kind)
        index = numbered.indices.to_numpy()
        n = lengths[index]
        flat = whole[runs((np.cumsum(lengths) - lengths)[index], n)]
        cuts = np.r_[0, np.cumsum(n)][lists.offsets.to_numpy() - lists.offsets[0].as_py()] if len(lists) else np.zeros(1, np.int64)
        ids, sizes = np.insert(flat, cuts[1:], np.array(self.end_id, self.kind)), np.diff(cuts) + 1
        other = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(other):
            return ids, sizes
        encoded = self.bpe.library.encode_batch_fast(texts.take(pa.array(other)).to_pylist(), add_special_tokens=False)
        parts: list = [None] * len(texts)
        for k, e in zip(other, encoded):
            parts[k] = np.array([*e.ids, self.end_id], self.kind)
        plain = iter(np.split(ids, np.cumsum(sizes)[:-1]))
        parts = [next(plain) if p is None else p for p in parts]
        return np.concatenate(parts), np.array(list(map(len, parts)), np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Put all chunks into self.known, encoding pre-tokens that aren't."""
        if len(self.known) > self.remembered // 2:
            self.known, self.elder = {}, self.known  # what is still in use comes back from the elder half
        known, elder = self.known, self.elder
        known[""] = b""
        new = [c for c in chunks if c not in known]
        known.update([(c, elder[c]) for c in new if c in elder])
        new = [c for c in new if c not in known]
        mixed = [c for c in new if not c.isalpha()]
        parts = [self.bpe.words(c) for c in mixed]
        every = {c for c in new if c.isalpha()}
        every.update(w for w in set(chain.from_iterable(parts)) if w not in known)
        every = list(every)
        for at in range(0, len(every), TOGETHER):
            # one text of new pre-tokens, blanks between; each one's ids end at a symbol with the word end
            words = every[at : at + TOGETHER]
            encoded = self.bpe.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
            ids = np.array(encoded.ids, self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            if len(stops) != len(words):
                raise ValueError("the vocabulary has no word ends to tell pre-tokens apart")
            raw, stops = ids.tobytes(), stops.tolist()
            known.update(zip(words, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        known.update(zip(mixed, [b"".join(map(known.__getitem__, p)) for p in parts]))


@kept
@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int, remembered: int) -> Encoder:
    """A Python worker keeps its encoder, with what it has learned, from task to task."""
    return Encoder(path, end_id, remembered)


class SequenceWriter:
    """Appends documents' ids to one pair of files, a record batch at a time."""

    def __init__(self, uri: str, id_type: pa.DataType, kind: np.dtype, length: int, rows: int):
        self.kind, self.length, self.rows = kind, length, rows
        self.main, self.side = Draft(uri), Draft(uri.removesuffix(".arrow") + ".docs.arrow")
        lists = [("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))]
        self.schema = pa.schema(lists, metadata={"length": str(length), "rows": str(rows)})
        self.docs = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = pa.ipc.new_file(self.main.sink, self.schema)
        self.list = pa.ipc.new_file(self.side.sink, self.docs)
        self.ids, self.mask, self.held, self.total = [], [], 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.total + np.cumsum(sizes) - sizes
        self.list.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(sizes)], schema=self.docs))
        mask = np.ones(len(ids), bool)
        mask[np.cumsum(sizes) - 1] = False
        self.ids.append(ids)
        self.mask.append(mask)
        self.held += len(mask)
        self.total += len(mask)
        if self.held >= self.length * self.rows:
            self._write(self.held // (self.length * self.rows) * self.length * self.rows)

    def _write(self, n: int) -> None:
        ids, mask = np.concatenate(self.ids), np.concatenate(self.mask)
        for at in range(0, n, self.length * self.rows):
            part = [x[at : min(n, at + self.length * self.rows)] for x in (ids, mask)]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in part]
            self.out.write_batch(pa.record_batch(lists, schema=self.schema))
        self.ids, self.mask, self.held = [ids[n:]], [mask[n:]], len(ids) - n

    def close(self) -> None:
        if self.held:
            padding = -self.held % self.length
            self.ids.append(np.zeros(padding, self.kind))
            self.mask.append(np.zeros(padding, bool))
            self._write(self.held + padding)
        self.out.close()
        self.list.close()
        self.side.publish()
        self.main.publish()


class SequenceFile:
    """Random access to a file: sequences and masks as views, documents by their place in the list."""

    def __init__(self, uri: str):
        self.file = pa.ipc.open_file(open_file(uri))
        self.docs = pa.ipc.open_file(open_file(uri.removesuffix(".arrow") + ".docs.arrow"))
        self.length = int(self.file.schema.metadata[b"length"])
        self.rows = int(self.file.schema.metadata[b"rows"])

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """The ids and the mask of sequence k, as views on the file."""
        batch, row = self.file.get_batch(k // self.rows), k % self.rows
        part = slice(row * self.length, (row + 1) * self.length)
        return self._ids(batch)[part], batch.column("mask").flatten()[part]

    @staticmethod
    def _ids(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("ids").flatten().to_numpy(zero_copy_only=True)

    def pieces(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, n of them, as views on the record batches that hold them."""
        span = self.length * self.rows
        while n > 0:
            flat = self._ids(self.file.get_batch(start // span))
            view = flat[start % span : start % span + n]
            yield view
            start, n = start + len(view), n - len(view)


def write_sequences(
    df: DataFrame, doc_id: str, text: str, path: str, tokenizer: str, end_id: int = 1, length: int = LENGTH, remembered: int = REMEMBERED
) -> DataFrame:
    """Encode whole texts in ascending doc_id order and write them below path; return the settled manifest.

    The manifest has a row for each file: uri, place (files in order), n_docs, n_tokens, start (ids in
    all earlier files). Nulls come first in the order, texts that share a doc_id by XXH64 (seed 42, signed), then
    by text; null texts count as empty and have the end id alone. Each range is one task's file, so files
    follow the input in number, not in size. Other columns aren't read. An empty table gives an empty manifest.
    """
    id_type = df.select(doc_id).schema[0].dataType
    frugal = remembered < REMEMBERED  # memory is dear: shorter parts too, and what is freed goes back after each task
    at_once = AT_ONCE // 4 if frugal else AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, writer, n = TaskContext.get().partitionId(), None, 0
        uri, encoder = f"{path}/part-{place:08d}.arrow", encoder_of(tokenizer, end_id, remembered)
        for batch in batches:
            texts = batch.column(1)
            if writer is None and batch.num_rows:
                writer = SequenceWriter(uri, batch.schema.field(0).type, encoder.kind, length, ROWS)
            size = texts.nbytes // max(1, batch.num_rows) + 1
            step = max(1, at_once // size)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                writer.add(part.column(0), *encoder.encode(part.column(1)))
                n += part.num_rows
        if writer:
            writer.close()
            rows = {"uri": [uri], "place": [place], "n_docs": [n], "n_tokens": [writer.total]}
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("uri", pa.string()), *((k, pa.int64()) for k in list(rows)[1:])]))

    # by a hash of the text too: rows without an id, or with one id, go to as many ranges as they need
    order = ["doc_id", "_hash", "text"]
    named = df.select(F.col(doc_id).cast(id_type).alias("doc_id"), F.col(text).alias("text")).withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    ordered = named.repartitionByRange(tasks_for(df), *order[:2]).sortWithinPartitions(*order).select("doc_id", "text")
    files = settle(ordered.mapInArrow(tidy(run, "load", "encoder_of") if frugal else run, "uri string, place long, n_docs long, n_tokens long"), "manifest")
    # the manifest has a row for each file, and stays small
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, id_type: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    ids_crc32 is the unsigned CRC-32 of the document's ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = SequenceFile(row["uri"])
                for k in range(file.docs.num_record_batches):
                    docs = file.docs.get_batch(k)
                    sums = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                        crc = 0
                        for view in file.pieces(start, n):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        sums.append(crc)
                    start = pa.array(docs.column("start").to_numpy() + row["start"])
                    arrays = [docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(sums, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, manifest.count())
    spread = manifest.select("uri", "start").repartition(tasks)
    return spread.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, doc_id: str, text: str, tokenizer: str, path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """Write all documents' ids (see write_sequences) and read them back (see read_documents): a row for each row of df.

    Null texts have the end id alone; repeated rows repeat; columns other than doc_id and text are not read, and may
    have any names; an empty table gives an empty result.
    """
    spark = df.sparkSession
    manifest = write_sequences(df, doc_id, text, path or new_path(spark, "tokens"), tokenizer, remembered=remembered)
    return read_documents(manifest, df.schema[doc_id].dataType.simpleString())
