import random
from collections import Counter
from functools import cache

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm.mixing import Mix, budget_table, budgets, mix_sources, mix_table, order_key, production_mix, spread

from .helpers import awkward, frame


def test_spread_gives_surplus_to_siblings():
    assert spread(100, [(1, 1000), (1, 1000)]) == [50, 50]
    assert spread(100, [(1, 10), (1, 1000), (2, 1000)]) == [10, 30, 60]
    assert spread(100, [(1, 10), (1, 20)]) == [10, 20]
    assert spread(10, [(1, 100), (1, 100), (1, 100)]) == [4, 3, 3]
    assert spread(50, [(0, 100), (1, 20)]) == [30, 20] and spread(0, [(1, 5)]) == [0] and spread(5, []) == []


def test_spread_is_whole_and_within_bounds():
    pick = random.Random(1)
    for _ in range(500):
        children = [(pick.choice([0, 0.1, 1, 2.5]), pick.choice([0, 1, 7, 1000, 10**12])) for _ in range(pick.randint(1, 9))]
        budget = pick.choice([0, 1, 13, 999, 10**11])
        got = spread(budget, children)
        assert sum(got) == min(budget, sum(m for _, m in children)) and all(0 <= g <= m for g, (_, m) in zip(got, children))


def test_shortage_goes_to_siblings_before_ancestors():
    supply = {("a", "en", "x"): 10, ("a", "en", "y"): 1000, ("a", "fr", "x"): 1000, ("b", "en", "x"): 1000}
    mix = Mix(weights={("a",): 0.5, ("b",): 0.5, ("a", "en"): 0.5, ("a", "fr"): 0.5, ("a", "en", "x"): 0.5, ("a", "en", "y"): 0.5}, share=0.1, epochs=1)
    got = budgets(supply, mix)  # 301 tokens
    assert got[("a", "en", "x")] == 10 and got[("a", "en", "y")] in (65, 66) and got[("a", "fr", "x")] == 75
    assert sum(got.values()) == 301
    dry = budgets({**supply, ("a", "en", "y"): 0}, Mix(weights=mix.weights, share=0.15, epochs=1))
    assert dry[("a", "fr", "x")] in (140, 141) and dry[("b", "en", "x")] in (150, 151) and sum(dry.values()) == 301


PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@cache
def tokens(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def size(r):
    return tokens(r[1])


def brute(rows, keys, mix):
    leaf = lambda r: (mix.domains.get(r[3] or "(none)", mix.rest), r[2] or "(none)", r[3] or "(none)")
    supply = Counter()
    for r in rows:
        supply[leaf(r)] += size(r)
    out = []
    for at, budget in budgets(dict(supply), mix).items():
        own = [r for r in rows if leaf(r) == at]
        whole, left = divmod(budget, supply[at]) if supply[at] else (0, 0)
        out += [(r[0], *at, e) for r in own for e in range(whole)]
        place = lambda r: (keys[r[0], whole], r[0] is not None, r[0] or 0)  # noqa: E731, B023
        for p in sorted({place(r) for r in own}):
            if sum(size(r) for r in own if place(r) <= p) <= left and left:
                out += [(r[0], *at, whole) for r in own if place(r) == p]
    return sorted(out, key=str)


@pytest.mark.parametrize(("share", "epochs"), [(0.4, 1), (1.7, 2), (0.0, 1)])
def test_prefixes_match_brute_force(spark, share, epochs):
    pick = random.Random(3)
    rows = awkward()
    rows += [(100 + k, "w " * pick.randint(0, 60), pick.choice(["en", "en", "fr", None]), pick.choice(["a", "a", "a", "b", "c", None]), 0) for k in range(500)]
    mix = Mix(domains={"a": "hot", "b": "cold"}, weights={("hot",): 0.2, ("cold",): 0.7}, share=share, epochs=epochs)
    df = frame(spark, rows, clash=True)
    each = df.select("doc_id", *(order_key(e, "doc_id", mix.seed).alias(str(e)) for e in range(5))).distinct().collect()
    keys = {(r.doc_id, e): r[str(e)] for r in each for e in range(5)}
    taken = mix_sources(df, "doc_id", "text", "lang", "source", mix, PATH)
    assert taken.columns == [*df.columns, "mix_domain", "mix_lang", "mix_source", "mix_epoch"]
    got = taken.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_epoch").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, keys, mix)
    table = mix_table(df, "doc_id", "text", "lang", "source", mix, PATH).collect()
    assert sorted(((r.doc_id, r.domain, r.lang or "(none)", r.source or "(none)", r.epoch) for r in table), key=str) == brute(rows, keys, mix)
    sizes = Counter((r[0], size(r)) for r in rows)
    assert all((r.doc_id, r.n_tokens) in sizes for r in table)


def test_columns_of_any_name(spark):
    names = ["_domain", "_lang", "_source", "_epochs", "_last", "_end", "_epoch", "_id", "_n", "_whole", "mix_epoch", "_body"]
    df = spark.createDataFrame([(k, f"text number {k}", "en", "a", *range(len(names))) for k in range(20)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    got = mix_sources(df, "doc_id", "text", "lang", "source", Mix(share=0.5, epochs=1), PATH)
    assert got.columns == [*df.columns, "mix_domain", "mix_lang", "mix_source", "mix_epoch_"] and 5 < got.count() < 15
    assert {tuple(r)[4:-4] for r in got.collect()} == {tuple(range(len(names)))}


def test_budgets_are_the_same_by_tasks(spark, monkeypatch):
    pick, mix = random.Random(4), production_mix()
    supply = {(mix.domains.get(f"src{k}", "other"), lang, f"src{k}"): pick.choice([0, 5, 1000, 10**9]) for k in range(30) for lang in ("en", "fr", "de", "es")}
    stats = spark.createDataFrame([(*k, v) for k, v in supply.items()], "_domain string, _lang string, _source string, _supply long")
    import plumbline.llm.mixing as module

    got = lambda: {tuple(r)[:3]: r._budget for r in budget_table(stats, mix).select("_domain", "_lang", "_source", "_budget").collect()}
    assert got() == budgets(supply, mix)
    monkeypatch.setattr(module, "BROADCAST", 0)
    assert got() == budgets(supply, mix)
    rows = [(k, "w " * (k % 9), "en", f"s{k % 5}", 0) for k in range(100)]
    one = lambda: sorted(map(tuple, mix_sources(frame(spark, rows), "doc_id", "text", "lang", "source", Mix(share=0.5), PATH).collect()))
    joined = one()
    monkeypatch.undo()
    assert joined == one() and joined


def test_empty(spark):
    assert mix_sources(frame(spark, []), "doc_id", "text", "lang", "source", Mix(), PATH).count() == 0
    assert mix_table(frame(spark, [(1, None, "en", "a", 0), (1, "", None, None, 0)]), "doc_id", "text", "lang", "source", Mix(), PATH).count() == 0
