import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from plumbline.llm.common import new_path
from plumbline.llm.tokencount import TokenCounter, count_tokens
from plumbline.llm.tokenfile import Encoder, SequenceFile, read_documents, token_files, write_sequences

from .helpers import awkward, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    pick = random.Random(5)
    texts = ["", "<|endoftext|>x", "aaaa aaa", "\x1c\x85 ΑΣ İI ﬁ Å", "''s 's it's we'll", "Ǆ ß ẞ ſ K", "a" * 3000, "!" * 999]
    texts += ["".join(pick.choice("ab'.s1 é日ΣσA<|endoftext|>") for _ in range(40)) for _ in range(400)]
    return texts + ["".join(chr(pick.randint(1, 0x2FFF)) for _ in range(20)) for _ in range(400)]


def test_counts_and_ids_are_the_librarys(library):
    texts = odd_texts()
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TokenCounter(PATH).counts(texts) == [len(e) for e in expected]
    encoder = Encoder(PATH, 1)
    ids, sizes = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [[*e, 1] for e in expected]
    for some in ([None], ["  a b  "], ["日本", None, "x"], []):
        ids, sizes = encoder.encode(pa.array(some, pa.string()))
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in some]
        assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


@pytest.mark.parametrize("clash", [False, True])
def test_count_tokens(spark, library, clash):
    got = count_tokens(frame(spark, clash=clash), "text", PATH, ["doc_id"], 9).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in awkward()]
    assert sorted(map(tuple, got), key=str) == sorted([(*w, w[2] > 9) for w in want], key=str)
    assert count_tokens(frame(spark, []), "text", PATH, ["doc_id"]).count() == 0


def in_order():
    hashed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), seed=42) + 2**63) % 2**64
    return sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]), r[1] is not None, r[1] or ""))


def test_token_files_round_trip(spark, library):
    got = sorted(map(tuple, token_files(frame(spark, clash=True), "doc_id", "text", PATH).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, t, *_ in in_order():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_files(frame(spark, []), "doc_id", "text", PATH).count() == 0


def test_sequences_have_equal_length_and_masks(spark, library):
    manifest = write_sequences(frame(spark), "doc_id", "text", new_path(spark, "t"), PATH, length=16)
    breaks = total = 0
    for row in manifest.orderBy("place").collect():
        file = SequenceFile(row["uri"])
        n = -(-row["n_tokens"] // 16)
        for k in range(n):
            ids, mask = file.sequence(k)
            assert len(ids) == len(mask) == 16 and not ids.flags.owndata
            breaks += 16 - mask.true_count
        breaks -= 16 * n - row["n_tokens"]
        total += sum(len(p) for p in file.pieces(0, row["n_tokens"]))
    want = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in awkward())
    assert (breaks, total) == (len(awkward()), want)
    assert read_documents(manifest, "bigint").count() == len(awkward())


def test_workers_let_go_of_what_other_tasks_kept():
    from plumbline.llm import tokencount, tokenfile, wordbpe
    from plumbline.llm.common import tidy

    tokenfile.encoder_of(PATH, 1, 1000)
    tokencount.counter_of(PATH, 1000)
    assert list(tidy(lambda batches: batches, "load", "encoder_of")(iter([7]))) == [7]
    sizes = [c.cache_info().currsize for c in (wordbpe.load, tokenfile.encoder_of, tokencount.counter_of, tokencount._merger)]
    assert sizes == [1, 1, 0, 0]
    assert list(tidy(lambda batches: batches)(iter([8]))) == [8]
    assert wordbpe.load.cache_info().currsize == tokenfile.encoder_of.cache_info().currsize == 0
