import random

import numpy as np
import pytest

from plumbline.llm.components import star_components
from plumbline.llm.similar import Filter, keep_one_of_similar, leading, prefix_length
from plumbline.llm.simhash import shingle_hashes

from .helpers import frame


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_similar(texts, similarity):
    """The least id of each id's group, for links between texts at least so similar."""
    sets, least = {d: five(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and jaccard(sets[a], sets[b]) >= similarity:
                low, high = sorted((least[a], least[b]))
                least = {d: low if x == high else x for d, x in least.items()}
    return least


def near_copies(pick, n=25):
    texts, key = {}, 0
    for k in range(n):
        words = [f"w{pick.randint(0, 4000)}" for _ in range(pick.randint(60, 400))]
        for copy in range(pick.randint(1, 5)):
            texts[key] = " ".join(words)
            key += 1
            words = list(words)
            for _ in range(copy % 2 + 1):
                words[pick.randrange(len(words))] = f"changed{pick.random()}"
    return texts


def test_similar_with_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e f g", "en", "a", 0), (1, "a b c d e f g", "en", "a", 0), (None, "a b c d e f g", "en", "a", 0), (None, "lone words here", "en", "a", 0), (1, "other text of one", "en", "a", 0)]
    got = keep_one_of_similar(frame(spark, rows, clash=True), "doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == [(1, "a b c d e f g"), (1, "other text of one"), (None, "lone words here")]
    assert keep_one_of_similar(frame(spark, []), "doc_id", "text").count() == 0


def kept_ids(spark, texts):
    rows = [(d, t, "en", "a", 0) for d, t in texts.items()]
    return {r.doc_id for r in keep_one_of_similar(frame(spark, rows, clash=True), "doc_id", "text").collect()}


@pytest.mark.parametrize("few", [0, 2, 10**9])
def test_groups_of_any_size_are_exact(spark, monkeypatch, few):
    import plumbline.llm.similar as module

    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "SHARE", 7)
    pick = random.Random(5)
    texts, base = near_copies(pick, 12), [f"w{pick.randint(0, 4000)}" for _ in range(300)]
    for k in range(150):  # a large group, some of whose pairs are below the bound
        words = list(base)
        for at in pick.sample(range(300), 3 + k % 4):
            words[at] = f"other{pick.random()}"
        texts[1000 + k] = " ".join(words)
    least = brute_similar(texts, 0.8)
    assert len({least[d] for d in texts if d >= 1000}) > 1
    assert kept_ids(spark, texts) == {d for d in texts if least[d] == d}


def test_a_repeated_line_makes_no_copies(spark):
    pick, texts = random.Random(6), {}
    for k in range(10):
        line = " ".join(f"line{pick.random()}" for _ in range(10))
        for side in range(2):
            texts[2 * k + side] = " ".join([line] * 20 + [f"own{pick.random()}" for _ in range(100)])
    for k in range(20):  # repeated so often that it makes up the whole fingerprint
        texts[100 + k] = " ".join(["one line of seven words in all"] * 300 + [f"own{pick.random()}" for _ in range(20)])
    assert brute_similar(texts, 0.8) == {d: d for d in texts}
    assert kept_ids(spark, texts) == set(texts)


def test_lone_pairs_of_short_and_long_texts(spark):
    pick, texts = random.Random(7), {}
    for k in range(120):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range((15, 25, 40)[k % 3])]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join([*words[:-1], "changed"])
    for k in range(120, 160):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range((300, 1000)[k % 2])]
        texts[2 * k] = " ".join(words)
        for at in pick.sample(range(len(words)), len(words) // 50 + k % 4):
            words[at] = "changed"
        texts[2 * k + 1] = " ".join(words)
    least = brute_similar(texts, 0.8)
    assert 120 < sum(least[d] != d for d in texts) < 160
    assert kept_ids(spark, texts) == {d for d in texts if least[d] == d}


def test_copies_of_a_line_and_empty_texts(spark):
    texts = {900: "One  TWO", 901: "one two", 902: None, 903: " ", 904: "other words"}
    assert kept_ids(spark, texts) == {900, 902, 904}


def test_filters_hold_all_they_were_made_of(spark, monkeypatch):
    import plumbline.llm.similar as module

    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 5000)
    others = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    sieve = Filter.of(df, "k")
    assert sieve.may_hold(keys.view(np.uint64)).all() and sieve.may_hold(others).mean() < 0.1
    monkeypatch.setattr(module, "MOST_BITS", 1 << 10)
    assert Filter.of(df, "k").may_hold(keys.view(np.uint64)).all()


def test_leading_shingles_of_similar_sets_meet():
    pick, usual = np.random.default_rng(2), np.array([[], []], np.uint64)
    for n in (1, 2, 5, 40, 300):
        a = np.unique(pick.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: prefix_length(n, 0.8) * -1 + n + 1] if n > 5 else a, pick.integers(0, 2**64, 0, dtype=np.uint64)])
        if len(b) and len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8:
            assert np.intersect1d(leading(a, usual, 0.8), leading(b, usual, 0.8)).size


def test_sketches_differ_in_no_more_bits_than_sets():
    from plumbline.llm.similar import sketches

    pick = np.random.default_rng(3)
    for n in (0, 1, 9, 200, 5000):
        a = np.unique(pick.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[n // 8 :], pick.integers(0, 2**64, n // 9, dtype=np.uint64)])
        one, other = np.stack(sketches(np.r_[a, b], np.array([len(a), len(b)]))).T
        assert int(np.bitwise_count(one ^ other).sum()) <= len(np.setxor1d(a, b))
        assert (one == np.stack(sketches(a, np.array([len(a)]))).T[0]).all()


def test_texts_below_the_bound_are_not_all_verified(spark, monkeypatch):
    import plumbline.llm.similar as module

    compared, plain = [], module.as_similar
    monkeypatch.setattr(module, "as_similar", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    pick, texts = random.Random(8), {}
    base = [f"w{pick.randint(0, 4000)}" for _ in range(150)]
    for k in range(80):  # most pairs of them are below 0.8
        words = list(base)
        for at in pick.sample(range(150), 3):
            words[at] = f"other{pick.random()}"
        texts[k] = " ".join(words)
    least = brute_similar(texts, 0.8)
    assert kept_ids(spark, texts) == {d for d in texts if least[d] == d}
    assert sum(compared) < 80 * 79 / 2 / 4


def test_few_edges_are_joined_by_the_driver_with_the_same_result(spark):
    pick = random.Random(9)
    rows = [(pick.randint(-300, 300), pick.randint(-300, 300)) for _ in range(200)]
    edges = spark.createDataFrame(rows, "u long, v long")
    both = [sorted(map(tuple, star_components(edges, few).collect())) for few in (0, 1000)]
    assert both[0] == both[1] and both[0]
    assert star_components(edges.where("u > 1000"), 1000).count() == 0


def test_rounds_end_when_they_leave_as_much(spark, monkeypatch):
    import plumbline.llm.similar as module

    verified, plain = [], module.as_similar
    monkeypatch.setattr(module, "as_similar", lambda *args: verified.append(1) or plain(*args))
    monkeypatch.setattr(module, "usual_shingles", lambda *args: np.zeros((2, 0), np.uint64))  # so that the common passage leads
    monkeypatch.setattr(module, "FEW", 0)
    pick, texts = random.Random(12), {}
    for k in range(100):  # all share a passage; eight in a hundred begin a chain whose neighbours only are alike
        words = [f"common{i}" for i in range(60)] + [f"own{k}x{i}" for i in range(90)]
        for copy in range(12 if k < 8 else 1):
            texts[12 * k + copy] = " ".join(words)
            for at in pick.sample(range(60, 150), 3):
                words[at] = f"other{pick.random()}"
    least = brute_similar(texts, 0.8)
    assert kept_ids(spark, texts) == {d for d in texts if least[d] == d}
    assert len(verified) == 3  # by fingerprint, a round that leaves most pairs open, the rest


def test_links_count_however_groups_divide_their_shingles(spark, monkeypatch):
    import plumbline.llm.similar as module

    # a and b, c and d are groups, joined by a and c alone; a's group is the largest of some of their shingles, c's of others
    texts, (a, b, c, d) = split_counts(), range(4)
    least = brute_similar(texts, 0.8)
    assert set(least.values()) == {0} and jaccard(five(texts[a]), five(texts[c])) >= 0.8
    assert all(jaccard(five(texts[x]), five(texts[y])) < 0.8 for x, y in ((a, d), (b, c), (b, d)))

    def known(classes, radius):
        node = {bytes(r._words): r._node for r in classes.collect()}
        own = [node[module.digest_of(texts[k].encode())] for k in range(4)]
        return spark.createDataFrame([(own[a], own[b]), (own[c], own[d])], "u long, v long")

    monkeypatch.setattr(module, "by_fingerprint", known)
    monkeypatch.setattr(module, "FEW", 10**9)
    for order in ((a, b, c, d), (c, d, a, b)):  # whichever is the larger node
        assert kept_ids(spark, {k: texts[k] for k in order}) == {0}


def leads(words):
    found = np.unique(np.array(shingle_hashes(" ".join(words).encode(), 5), np.uint64))
    return set(leading(found, np.zeros((2, 0), np.uint64), 0.8).tolist())


def split_counts():
    """Texts a, b, c, d, each an edit of another, such that what a and c share leads in b or d, hardly in both."""
    pick = random.Random(21)

    def edited(words, cost):
        every = [[*words[:at], f"other{pick.random()}", *words[at + 1 :]] for at in range(4, 46)]
        return min(every, key=cost)

    def pair():
        base = [f"w{pick.randint(0, 10**6)}" for _ in range(50)]
        return base, edited(base, lambda x: len(leads(base) & leads(x)))

    a, c = min((pair() for _ in range(40)), key=lambda p: len(leads(p[0]) & leads(p[1])))
    both = leads(a) & leads(c)
    b = edited(a, lambda x: abs(len(both & leads(x)) - len(both) // 2))
    d = edited(c, lambda x: len(both & leads(x) & leads(b)) + len(both - leads(x) - leads(b)))
    return dict(enumerate(" ".join(w) for w in (a, b, c, d)))


def test_a_pair_is_made_a_few_times_at_most(spark):
    from pyspark.sql import functions as F

    import plumbline.llm.similar as module

    pick = random.Random(13)
    base, texts = [f"w{pick.randint(0, 4000)}" for _ in range(300)], {}
    for k in range(40):
        words = list(base)
        for at in pick.sample(range(300), 1 + k % 5):
            words[at] = f"other{pick.random()}"
        texts[k] = " ".join(words)
    prints = module.shingle_prints(frame(spark, [(d, t, "en", "a", 0) for d, t in texts.items()]), "doc_id", "text", 5, 0.8)
    classes = prints.withColumn("_node", F.col("_doc"))
    left = module.met_rows(classes).withColumn("_root", F.col("_node")).withColumn("_main", F.lit(39))
    made = [(r.u, r.v) for r in module.first_met(left, 0.8).collect()]
    sets = {d: five(t) for d, t in texts.items()}
    alike = {(a, b) for a in texts for b in texts if a < b and jaccard(sets[a], sets[b]) >= 0.8}
    assert len(alike) > 300 and alike <= set(made)
    assert len(made) < 2 * 40 * 39 / 2  # of a pair's 60 leading shingles dozens are shared


def test_a_group_around_one_text_is_joined_in_the_first_round(spark, monkeypatch):
    import plumbline.llm.similar as module

    compared, plain = [], module.as_similar
    monkeypatch.setattr(module, "as_similar", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    monkeypatch.setattr(module, "FEW", 0)
    pick, texts = random.Random(14), {}
    base = [f"w{pick.randint(0, 4000)}" for _ in range(150)]
    for k in range(120):  # most are like the base and like few others
        words = list(base)
        for at in pick.sample(range(150), k % 4):
            words[at] = f"other{pick.random()}"
        texts[k] = " ".join(words)
    least = brute_similar(texts, 0.8)
    assert kept_ids(spark, texts) == {d for d in texts if least[d] == d}
    assert sum(compared) < 3 * 120
