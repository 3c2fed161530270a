"""The pipeline's stages against brute force, each on its own input."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm.langid import fit, sample
from plumbline.llm.mixing import order_key, production_mix

from .helpers import DOCS
from .test_decontam import shingles
from .test_langid import labelled
from .test_mixing import brute as brute_mix
from .test_similar import brute_similar


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = [(i, t, lang, f"src{i % 20}", len(t)) for i, t, lang, _, _ in labelled(120)]
    rows += [(i + 5000, t, lang, s, n) for i, t, lang, s, n in rows[:25]]  # exact copies
    rows += [(1, None, "en", "src0", None), (2, "", "en", "src1", 0), (3, "12 34", "fr", "src2", 5), (4, rows[7][1], None, "other", 1)]
    items = [(1, " ".join(rows[30][1].split()[:9])), (2, "words that no document holds at all")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages_match_brute_force(spark, corpus, tmp_path):
    folder, rows, items = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        own = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if name != "tokenize":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        got = sorted(map(tuple, out.collect()), key=str)
        if name == "language":
            ready = fit(sample(docs, "doc_id", "text", "lang")).ready()
            lang, score = ready.predict([r[1] for r in own])
            want = [r for r, l, s in zip(own, lang, score) if l != "und" and s >= 0.35]
            assert {r[0] for r in own} - {r[0] for r in want} == {1, 2, 3}
        elif name == "near_duplicates":
            least = brute_similar({r[0]: r[1] for r in own}, 0.8)
            want = [r for r in own if least[r[0]] == r[0]]
            assert len(want) < len(own) - 20
        elif name == "decontaminate":
            leaks = [shingles(t) for _, t in items]
            want = [r for r in own if not any(len(x & shingles(r[1])) >= 0.8 * len(x) for x in leaks)]
            assert len(want) == len(own) - 1
        elif name == "mix":
            mix = production_mix()
            each = docs.select("doc_id", *(order_key(e, "doc_id", mix.seed).alias(str(e)) for e in range(5))).collect()
            taken = brute_mix(own, {(r.doc_id, e): r[str(e)] for r in each for e in range(5)}, mix)
            by_id = {r[0]: r for r in own}
            want = [by_id[t[0]] for t in taken]
            assert want and sorted(want) != sorted(own)
        else:
            library, want, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
            for r in sorted(own, key=lambda r: (r[0], r[1])):
                ids = [*library.encode(r[1], add_special_tokens=False).ids, 1]
                want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
        assert got == sorted(want, key=str), name
        kept.append(len(got))
        docs = out
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str)
    assert whole == got and corpus_pipeline.ORACLE_SQL is None
