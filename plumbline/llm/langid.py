"""Language identification by a byte convolutional network, trained in numpy.

Texts are cut into windows of WINDOW UTF-8 bytes. In each window filters of several widths slide over
the bytes; each filter's largest response (not below zero) goes into a softmax over languages. A
filter of width w is w tables of a weight for each byte, so a response is a sum of look-ups. Windows
are laid out in columns, so that a whole batch is pooled by one running maximum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

UNDETERMINED = "und"
WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16
#: Bound of the training sample: at most SLOTS documents of each language, PIECES windows from each.
SLOTS, PIECES = 256, 4
EPOCHS, BATCH, RATE = 12, 128, 0.01
#: Weight of the padding after a text's end; no filter prefers it to a response of zero.
PADDING = -1e4
#: Windows that are pooled together, and texts that are taken from a batch at a time.
AT_ONCE, ROWS = 256, 500
_letter = regex.compile(r"\p{L}")


def as_windows(data: bytes, spans: list[tuple[int, int]], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as columns (0 is padding), each one's span and number of bytes. An empty span has no window."""
    begin = np.array([a for a, _ in spans], np.int64)
    size = np.array([b - a for a, b in spans], np.int64)
    n = -(-size // width)
    owner = np.repeat(np.arange(len(spans)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[owner] + nth * width
    used = np.minimum(width, size[owner] - nth * width)
    raw = np.frombuffer(data, np.uint8)
    place = np.arange(width)[:, None]
    cells = raw[np.minimum(start[None, :] + place, max(0, len(raw) - 1))] if len(raw) else np.zeros((width, 0), np.uint8)
    return np.where(place < used[None, :], np.where(cells == 0, 32, cells), 0).astype(np.uint8), owner, used


@dataclass
class ByteNet:
    """Filters by width as arrays [place, byte, filter], and the dense layer over pooled responses."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> ByteNet:
        filters = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        for table in filters.values():
            table[:, 0] = PADDING
        dense = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        return cls(languages, filters, dense, np.zeros(len(languages), np.float32))

    def train(self, windows: np.ndarray, label: np.ndarray, rng: np.random.Generator) -> ByteNet:
        """Adam on the cross entropy; the gradient of a pooled response goes to the place of its maximum only."""
        weights = [*self.filters.values(), self.dense, self.bias]
        first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
        step, lanes = 0, np.arange(FILTERS)[None, :]
        for _ in range(EPOCHS):
            order = rng.permutation(windows.shape[1])
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                cells = windows[:, pick]
                pooled, places = [], []
                for w, table in self.filters.items():
                    length = WINDOW - w + 1
                    response = sum(table[i][cells[i : i + length]] for i in range(w))
                    places.append(at := response.argmax(axis=0))
                    pooled.append(np.maximum(np.take_along_axis(response, at[None], 0)[0], 0))
                hidden = np.concatenate(pooled, axis=1)
                p = softmax(hidden @ self.dense + self.bias)
                p[np.arange(len(pick)), label[pick]] -= 1
                p /= len(pick)
                back = (p @ self.dense.T) * (hidden > 0)
                slopes = []
                for j, (w, table) in enumerate(self.filters.items()):
                    slope, own = np.zeros_like(table), back[:, j * FILTERS : (j + 1) * FILTERS]
                    for i in range(w):
                        byte = cells[places[j] + i, np.arange(len(pick))[:, None]]
                        np.add.at(slope[i], (byte, lanes), own)
                    slope[:, 0] = 0
                    slopes.append(slope)
                slopes += [hidden.T @ p, p.sum(axis=0)]
                step += 1
                for x, g, a, b in zip(weights, slopes, first, second):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    x -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def ready(self) -> ReadyNet:
        return ReadyNet(self)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class ReadyNet:
    """A net for use: weights of neighbouring bytes added up in advance, for all pairs of bytes."""

    def __init__(self, net: ByteNet):
        self.net = net
        self.parts = []
        for w, t in net.filters.items():
            # (table, offset, whether it is looked up by pairs of bytes) of each part of a filter
            pairs = [((t[i][:, None] + t[i + 1][None, :]).reshape(65536, -1), i, True) for i in range(0, w - 1, 2)]
            self.parts.append((w, pairs + ([(t[w - 1], w - 1, False)] if w % 2 else [])))

    def window_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, windows.shape[1], AT_ONCE):
            cells = np.ascontiguousarray(windows[:, k : k + AT_ONCE])
            double = cells[:-1].astype(np.int32) * 256 + cells[1:]
            pooled = []
            for w, parts in self.parts:
                length, response = len(cells) - w + 1, None
                for table, offset, by_pairs in parts:
                    seen = np.take(table, (double if by_pairs else cells)[offset : offset + length], axis=0)
                    response = seen if response is None else np.add(response, seen, out=response)
                pooled.append(np.maximum(response.max(axis=0), 0))
            out.append(softmax(np.concatenate(pooled, axis=1) @ self.net.dense + self.net.bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)), np.float32)

    def predict_all(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """predict() of an Arrow array, ROWS texts at a time, so that few are held twice."""
        names, scores = [], []
        for at in range(0, len(texts), ROWS):
            some, sure = self.predict(texts.slice(at, ROWS).to_pylist())
            names, scores = names + some, scores + sure
        return names, scores

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of whole texts: the windows' probabilities, averaged by their bytes."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [k for k, t in enumerate(texts) if t and _letter.search(t)] if self.net.languages else []
        raw = [texts[k].encode("utf-8", "surrogatepass") for k in known]
        ends = np.cumsum([len(b) for b in raw], dtype=np.int64).tolist()
        for begin, end in groups(ends, AT_ONCE * WINDOW * 4):
            base = ends[begin - 1] if begin else 0
            spans = list(zip([0, *(e - base for e in ends[begin : end - 1])], (e - base for e in ends[begin:end])))
            windows, owner, used = as_windows(b"".join(raw[begin:end]), spans)
            p = self.window_probabilities(windows) * used[:, None]
            first = np.searchsorted(owner, np.arange(end - begin))
            mean = np.add.reduceat(p, first, axis=0) / np.add.reduceat(used, first)[:, None]
            for k, row in zip(known[begin:end], mean):
                best = int(row.argmax())
                names[k], scores[k] = self.net.languages[best], float(min(1.0, max(0.0, row[best])))
        return names, scores


def groups(ends: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `size` bytes together, a single longer text on its own."""
    begin, base = 0, 0
    for k, end in enumerate(ends, 1):
        if end - base >= size or k == len(ends):
            yield begin, k
            begin, base = k, end


def held_out(doc_id: str):
    """Whether a document is kept from training: CRC-32 of its id as text (null: empty) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(df: DataFrame, doc_id: str, text: str, lang: str) -> list[tuple[str, str]]:
    """Language and pieces of text of at most SLOTS labelled documents a language that aren't held out.

    In each of SLOTS slots of a hash of the id, the document with the least second hash is taken, by a
    grouped minimum of ids alone; then those documents' pieces are read.
    """
    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    rows = rows.where(~held_out("_id") & F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}"))
    slot = F.pmod(F.xxhash64("_id"), F.lit(SLOTS)).alias("_slot")
    picked = rows.groupBy("_lang", slot).agg(F.min_by("_id", F.xxhash64("_id", F.lit(1))).alias("_id")).select("_lang", "_id")
    ids = [r[0] for r in picked.select("_id").distinct().collect()]
    if not ids:
        return []
    spread = F.greatest(F.length("_text") - WINDOW, F.lit(1))
    cut = lambda k: F.substring("_text", (F.pmod(F.xxhash64("_id", F.lit(k)), spread) + 1).cast("int"), F.lit(WINDOW))
    pieces = F.array(*(cut(k) for k in range(2, 2 + PIECES)))
    read = rows.where(F.col("_id").isin(ids)).groupBy("_lang", "_id").agg(F.min(pieces).alias("p"))
    return [(r["_lang"], piece) for r in read.orderBy("_lang", "_id").collect() for piece in r["p"]]


def fit(pieces: list[tuple[str, str]], seed: int = 5) -> ByteNet:
    """Train on pieces and on a short run from within each, so that short texts are known too."""
    rng = np.random.default_rng(seed)
    names = sorted({lang for lang, _ in pieces})
    texts, labels = [], []
    for lang, piece in pieces:
        begin = int(rng.integers(0, max(1, len(piece) - 12)))
        for part in (piece, piece[begin : begin + int(rng.integers(12, 80))]):
            if _letter.search(part):
                texts.append(part.encode("utf-8", "surrogatepass")[:WINDOW])
                labels.append(names.index(lang))
    net = ByteNet.fresh(names, rng)
    if not texts:
        return net
    ends = np.cumsum([len(t) for t in texts]).tolist()
    windows, owner, _ = as_windows(b"".join(texts), list(zip([0, *ends], ends)))
    return net.train(windows, np.array(labels)[owner], rng)


def identify(df: DataFrame, net: ByteNet, text: str, keep: list[str], lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns `keep` of each row with the predicted language and its score from 0 to 1. One pass, no shuffle.

    A null text, or one without a letter, is `und` with score 0, as is any text if nothing was learned.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)  # 9 tables of 256 x 16 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value.ready()
        for batch in batches:
            names, scores = ready.predict_all(batch.column(len(keep)))
            arrays = [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, lang_pred, score])

    narrow = df.select(*keep, F.col(text).alias("_text_"))
    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(run, f"{kinds}, {lang_pred} string, {score} double")


def languages(df: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row, learned from labelled rows that aren't held out."""
    net = fit(sample(df, doc_id, text, lang))
    out = identify(df, net, text, [doc_id])
    return out.select(doc_id, held_out(doc_id).alias("held_out"), "lang_pred", "score")


def accept(df: DataFrame, doc_id: str, text: str, lang: str, least: float = 0.35) -> DataFrame:
    """The rows of df whose language can be told: not `und`, and predicted with a score of at least `least`.

    All columns stay as they are. Where nothing could be learned, rows with a letter stay.
    """
    net = fit(sample(df, doc_id, text, lang))
    if not net.languages:
        return df.where(F.col(text).rlike(r"\p{L}"))
    shared, names = df.sparkSession.sparkContext.broadcast(net), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.value.ready()
        for batch in batches:
            found, scores = ready.predict_all(batch.column(names.index(text)))
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(found, scores)], pa.bool_()))

    return df.mapInArrow(tidy(run), df.schema)
