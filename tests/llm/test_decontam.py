import random
import re

from plumbline.llm import decontam
from plumbline.llm.decontam import contained_items, missing, sketch_length, without_contained

from .helpers import awkward, frame


def shingles(text, size=5):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def cases():
    pick = random.Random(4)
    vocabulary = [f"v{k}é" for k in range(300)]
    items = [(k, " ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, 60)))) for k in range(40)]
    items += [(900, None), (901, ""), (902, "..."), (903, items[0][1]), (0, items[0][1]), (904, "quick brown")]
    rows = awkward()
    for k in range(300):
        words = [pick.choice(vocabulary) for _ in range(pick.randint(0, 3000))]
        part = items[pick.randrange(40)][1].split()
        for _ in range(pick.randint(0, 4)):
            part[pick.randrange(len(part))] = pick.choice(vocabulary)
        at = pick.randint(0, len(words))
        rows.append((50 + k, ("! " if k % 2 else " ").join(words[:at] + [w.upper() for w in part] + words[at:]), "en", "a", 0))
    return rows, items


def brute(rows, items):
    out = []
    for d, t, *_ in rows:
        have = {n: shingles(t, n) for n in range(1, 6)}
        for i, s in set(items):
            want = shingles(s)
            if want and len(want & have[len(min(want))]) >= 0.8 * len(want) - 1e-9:
                out.append((d, i, len(want & have[len(min(want))]), len(want)))
    return sorted(out, key=str)


def test_containment_matches_brute_force(spark, monkeypatch):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert len(want) > 60
    args = (frame(spark, rows, clash=True), "doc_id", "text", bench, "item_id", "text")
    assert sorted([tuple(r)[:4] for r in contained_items(*args).collect()], key=str) == want
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3000)
    assert sorted([tuple(r)[:4] for r in contained_items(*args).collect()], key=str) == want


def test_documents_with_items_go(spark):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {d for d, *_ in brute(rows, items)}
    kept = without_contained(frame(spark, rows, clash=True), "text", bench, "item_id", "text")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in hit), key=str)
    assert kept.columns[-1] == "_text"
    assert without_contained(frame(spark, []), "text", bench, "item_id", "text").count() == 0
    assert contained_items(frame(spark), "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0


def test_items_of_any_id_and_edge_tables(spark):
    rows, items = cases()
    want = {(d, i) for d, i, *_ in brute(rows, items)}
    for kind in ("int", "string", "decimal(20,0)", "binary"):
        bench = spark.createDataFrame(items, "item_id long, text string").selectExpr(f"cast({'cast(item_id AS string)' if kind == 'binary' else 'item_id'} AS {kind}) item_id", "text", "1 AS _text", "2 AS _item")
        found = contained_items(frame(spark, rows), "doc_id", "text", bench, "item_id", "text")
        assert found.schema["item_id"].dataType == bench.schema["item_id"].dataType
        as_int = lambda x: int(x.decode() if isinstance(x, (bytes, bytearray)) else x)
        assert {(r.doc_id, as_int(r.item_id)) for r in found.collect()} == want
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert contained_items(frame(spark), "doc_id", "text", none, "item_id", "text").count() == 0
    assert without_contained(frame(spark), "text", none.limit(0), "item_id", "text").count() == len(awkward())


def test_class_sets_length_and_threshold():
    for share in (0.5, 0.8, 1.0):
        for n in range(1, 300):
            length = sketch_length(n, share)
            assert length == sketch_length((1 << n.bit_length()) - 1, share) and min(length, n) - missing(n, share) >= 1


def test_many_blocks_of_items(spark, monkeypatch):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
    files = decontam.blocks(bench, "item_id", "text")
    assert len(files) > 5
    got = {(r.doc_id, r.item_id) for r in contained_items(frame(spark, rows), "doc_id", "text", bench, "item_id", "text").collect()}
    assert got == {(d, i) for d, i, *_ in brute(rows, items)}


def test_blocks_go_by_bytes_not_by_files(spark, monkeypatch):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = decontam.settle
    monkeypatch.setattr(decontam, "settle", lambda df, name: plain(df.repartition(20, "_item"), name))
    parts = decontam.blocks(bench, "item_id", "text")
    assert len(parts) == 1 and len(parts[0]) > 5
    got = {(r.doc_id, r.item_id) for r in contained_items(frame(spark, rows), "doc_id", "text", bench, "item_id", "text").collect()}
    assert got == {(d, i) for d, i, *_ in brute(rows, items)}
