import random
import zlib

import numpy as np

from plumbline.llm.langid import ByteNet, accept, as_windows, fit, languages

from .helpers import DOCS, awkward, frame

SYLLABLES = {"en": ["the", "and", "ing", "th", "er"], "fr": ["eau", "é", "que", "le", "oi"], "de": ["ü", "sch", "ein", "ch", "und"]}


def labelled(n=240):
    pick, rows = random.Random(1), []
    for k in range(n):
        lang = pick.choice(list(SYLLABLES))
        words = ["".join(pick.choice(SYLLABLES[lang]) for _ in range(pick.randint(1, 3))) for _ in range(pick.randint(8, 90))]
        rows.append((1000 + k, " ".join(words), lang, "s", 0))
    return rows


def test_held_out_accuracy_and_awkward_rows(spark):
    rows = labelled()
    got = languages(frame(spark, rows + awkward()[:7], clash=True), "doc_id", "text", "lang").collect()
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % 5 == 0) and 0 <= r.score <= 1
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(tested) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.95
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 7)} == {"und"}
    assert len(got) == len(rows) + 7


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = labelled(60)
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s, n) for i, t, lang, s, n in rows]
    once, twice = (sorted(languages(frame(spark, x), "doc_id", "text", "lang").collect()) for x in (rows, swapped))
    assert once == twice


def test_nothing_to_learn_from(spark):
    rows = [(1, "abc", None, "s", 1), (2, None, None, "s", 1)]
    got = languages(spark.createDataFrame(rows, DOCS), "doc_id", "text", "lang").collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert languages(frame(spark, []), "doc_id", "text", "lang").count() == 0


def test_rows_without_a_language_are_rejected(spark):
    df = frame(spark, labelled(80) + [(1, None, "en", "a", 0), (2, "123 456", "en", "a", 0)], clash=True)
    kept = accept(df, "doc_id", "text", "lang")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in labelled(80)]


def test_pair_tables_give_the_plain_convolution():
    rng = np.random.default_rng(0)
    net = ByteNet.fresh(["a", "b"], rng)
    texts = [b"some bytes to look at" * 20, b"x", "é\0è".encode()]
    ends = np.cumsum([len(t) for t in texts]).tolist()
    windows, owner, used = as_windows(b"".join(texts), list(zip([0, *ends], ends)))
    assert used.sum() == ends[-1] and np.bincount(owner).tolist() == [-(-420 // 192), 1, 1]
    pooled = []
    for w, table in net.filters.items():
        response = np.array([[sum(table[i, windows[p + i, n]] for i in range(w)) for p in range(len(windows) - w + 1)] for n in range(windows.shape[1])])
        pooled.append(np.maximum(response.max(axis=1), 0))
    z = np.concatenate(pooled, axis=1) @ net.dense + net.bias
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(net.ready().window_probabilities(windows), want, atol=1e-5)


def test_fit_of_no_pieces_has_no_languages():
    assert fit([]).ready().predict(["text", None]) == (["und", "und"], [0.0, 0.0])


def naive(net, text):
    """Language and score by the definition: all windows, each filter at each place, probabilities weighted by bytes."""
    raw, total, n = text.encode(), 0, 0
    for at in range(0, len(raw), 192):
        window = [b or 32 for b in raw[at : at + 192]]
        cells = window + [0] * (192 - len(window))
        pooled = []
        for w, table in net.filters.items():
            pooled.append(np.maximum(np.max([sum(table[i, cells[p + i]] for i in range(w)) for p in range(192 - w + 1)], axis=0), 0))
        z = np.concatenate(pooled) @ net.dense + net.bias
        p = np.exp(z - z.max())
        total, n = total + p / p.sum() * len(window), n + len(window)
    p = total / n
    return net.languages[int(p.argmax())], float(p.max())


def test_whole_texts_are_judged_by_all_their_windows(spark):
    rows = labelled(40)
    net = fit([(r[2], r[1][:192]) for r in rows if r[2]])
    texts = [r[1] for r in rows[::9]] + ["é" * 300 + " mixed ünd the of " * 40, "x", "a\x00b", rows[0][1] * 30]
    names, scores = net.ready().predict([*texts, None, "", "12 34"])
    for text, name, score in zip(texts, names, scores):
        want, sure = naive(net, text)
        assert name == want and abs(score - sure) < 1e-4
    assert names[-3:] == ["und"] * 3 and scores[-3:] == [0.0] * 3
