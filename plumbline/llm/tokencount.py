"""Token counts by rank-synchronous merging: many pre-tokens as one ragged array, merged together round by round."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, tidy
from .wordbpe import WordBPE, byte_characters, load

#: Chunks of text whose counts a worker remembers; beyond it the memory is emptied, which changes no result.
REMEMBERED = 700_000
#: Characters of text whose pre-tokens are held at once.
AT_ONCE = 4_000_000
NO_RANK = np.iinfo(np.int32).max


class RankMerger:
    """Applies a merge table to ragged arrays of symbols."""

    def __init__(self, bpe: WordBPE):
        n = self.size = len(bpe.vocab) + 1
        left = np.array([bpe.vocab[a] for a, _ in bpe.merges], np.int64)
        right = np.array([bpe.vocab[b] for _, b in bpe.merges], np.int64)
        made = np.array([bpe.vocab[a + b] for a, b in bpe.merges], np.int32)
        ranks = np.arange(len(made), dtype=np.int32)
        keys = left * n + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], ranks[order]
        self.made = made
        # A symbol's first use in a pair. Where a merge makes a symbol that an earlier pair uses, doing all
        # of its places at once could overtake that pair; such merges are done one place a round.
        first_use = np.full(n, NO_RANK, np.int64)
        np.minimum.at(first_use, left, ranks)
        np.minimum.at(first_use, right, ranks)
        self.one_by_one = first_use[made] < ranks
        chars = byte_characters()
        self.inner = np.array([bpe.vocab[c] for c in chars], np.int32)
        self.last = np.array([bpe.vocab[c + bpe.end] for c in chars], np.int32)

    def ranks(self, symbols: np.ndarray) -> np.ndarray:
        """The rank of each neighbouring pair, NO_RANK where there is no such merge."""
        keys = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], NO_RANK).astype(np.int32)

    def count(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that each word (at least a byte) keeps when no merge is left."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        result, ids = sizes.copy(), np.arange(len(words))
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(ids)), sizes)
            rank = np.full(len(symbols), NO_RANK, np.int32)
            if len(symbols) > 1:
                rank[:-1] = np.where(owner[1:] == owner[:-1], self.ranks(symbols), NO_RANK)
            lowest = np.minimum.reduceat(rank, starts)
            todo = lowest != NO_RANK
            result[ids[~todo]] = sizes[~todo]
            hit = (rank == lowest[owner]) & (rank != NO_RANK)
            at = np.flatnonzero(hit)
            if len(at):
                # runs of touching places (a a a): every second one; and the first only, where order matters
                place = np.arange(len(at))
                fresh = np.r_[True, (np.diff(at) > 1) | (np.diff(owner[at]) != 0)]
                begin = np.maximum.accumulate(np.where(fresh, place, 0))
                keep = (place - begin) % 2 == 0
                first = np.r_[True, np.diff(owner[at]) != 0]
                at = at[keep & (first | ~self.one_by_one[rank[at]])]
                symbols[at] = self.made[rank[at]]
                gone = np.zeros(len(symbols), bool)
                gone[at + 1] = True
                sizes = sizes - np.bincount(owner[at], minlength=len(ids))
                stay = ~gone & todo[owner]
                symbols = symbols[stay]
            else:
                symbols = symbols[:0]
            ids, sizes = ids[todo], sizes[todo]
        return result


@kept
@lru_cache(maxsize=2)
def _merger(path: str) -> RankMerger:
    return RankMerger(load(path))


class TokenCounter:
    """Counts tokens of texts exactly as the library would, remembering the counts of pre-tokens."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.bpe, self.merger = load(path), _merger(path)
        self.known: dict[str, int] = {}
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}

    def counts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        begin = chars = 0
        for end, text in enumerate(texts, 1):
            chars += len(text or "")
            if chars > AT_ONCE or end == len(texts):
                out += self._group(texts[begin:end])
                begin, chars = end, 0
        return out

    def _group(self, texts: list[str | None]) -> list[int]:
        extra, lists = [0] * len(texts), []
        for k, text in enumerate(texts):
            if not text:
                lists.append([])
            elif self.bpe.is_plain(text):
                lists.append(self.bpe.chunks(text))
            else:
                words, extra[k] = self.bpe.library_words(text)
                lists.append([])
                if words:
                    raw = [bytes(self.byte_of[c] for c in w) for w in words]
                    extra[k] += int(self.merger.count(raw).sum())
        if len(self.known) > self.remembered:
            self.known.clear()
        known, new = self.known, set()
        for chunks in lists:
            new.update(chunks)
        if new := [c for c in new if c not in known]:
            parts = [self.bpe.words(c) for c in new]
            words = list({w for p in parts for w in p})
            count_of = dict(zip(words, self.merger.count([w.encode() for w in words]).tolist()))
            known.update((c, sum(map(count_of.__getitem__, p))) for c, p in zip(new, parts))
        return [sum(map(known.__getitem__, chunks)) + n for chunks, n in zip(lists, extra)]


@kept
@lru_cache(maxsize=1)
def counter_of(path: str, remembered: int = REMEMBERED) -> TokenCounter:
    """A Python worker keeps its counter, with what it has counted, from task to task."""
    return TokenCounter(path, remembered)


def count_tokens(df: DataFrame, text: str, path: str, keep: list[str], limit: int = 2048, remembered: int = REMEMBERED) -> DataFrame:
    """Columns `keep` of each row, then n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    path names a word-end BPE file that every executor can open. No special tokens are added; special
    strings inside a text count as the library counts them. A null text counts as empty: 0 bytes, 0
    tokens. A worker remembers the counts of up to `remembered` chunks, from task to task unless these are
    fewer than REMEMBERED. Rows are counted on their own, so repeated rows repeat; columns that are not in `keep` are
    not read. One pass, no shuffle.
    """
    frugal = remembered < REMEMBERED  # memory is dear

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, remembered)
        for batch in batches:
            texts, counts = batch.column(len(keep) + 1), []
            step = max(1, AT_ONCE * batch.num_rows // max(1, texts.nbytes))
            for at in range(0, batch.num_rows, step):
                counts += counter.counts(texts.slice(at, step).to_pylist())
            n = pa.array(counts, pa.int64())
            over = pa.array([c > limit for c in counts], pa.bool_())
            arrays = [*batch.columns[: len(keep) + 1], n, over]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_bytes", "n_tokens", "over_limit"])
        if frugal:  # nothing counted stays for the next task
            counter.known.clear()

    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(*keep, F.octet_length(body).cast("long").alias("n_bytes"), body.alias("_text"))
    kinds = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(tidy(run, "load", "_merger", "counter_of") if frugal else run, f"{kinds}, n_bytes long, n_tokens long, over_limit boolean")
