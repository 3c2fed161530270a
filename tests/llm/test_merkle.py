import hashlib
import random
import re

from pyspark.sql import functions as F

from plumbline.llm.merkle import PIECE, edited_branches, fingerprint_edits, merkle_trees

from .helpers import awkward, frame


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(text):
    """Root, branches and paragraph digests by section."""
    found = [[[sha(x)[:32] for x in re.findall(PIECE, p)] for p in s.split("\n")] for s in text.split("\n\n")]
    own = [[sha("".join(p)) for p in s] for s in found]
    parts = [sha("".join(s)) for s in own]
    every = [*parts, *(p for s in own for p in s), *(x for s in found for p in s for x in p)]
    return sha("".join(parts)), {int(x[:10], 16) for x in every}, own


def like(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def places(a, b):
    get = lambda x, k: x[k] if k < len(x) else []
    return [(k, i) for k in range(max(len(a), len(b))) for x, y in [(get(a, k), get(b, k))] for i in range(max(len(x), len(y))) if x[i : i + 1] != y[i : i + 1]]


def brute(rows):
    by_id = {}
    for d, t, *_ in rows:
        by_id.setdefault(d, []).append(t or "")
    order = sorted(by_id, key=lambda d: (d is not None, d or 0))
    out = []
    for d, t, *_ in rows:
        text, follow = t or "", min(by_id[order[(order.index(d) + 1) % len(order)]], key=lambda x: tree(x)[0])
        k = len(text) // 4
        edit = text[: len(text) - k] + follow[:k]
        (fp, own, at), (efp, changed, to), (_, after, _) = tree(text), tree(edit), tree(follow)
        out.append((d, len(text), sha(edit), fp, efp, like(own, changed), like(own, after), ",".join(f"{k}.{i}" for k, i in places(at, to))))
    return sorted(out, key=str)


def test_edits_match_brute_force(spark):
    pick = random.Random(6)
    rows = awkward() + [(3, "another text\nwith the same id", "en", "a", 0)]
    rows += [(20 + 3 * k, "".join(pick.choice("aé日.\n\n ,🤷") for _ in range(pick.randint(0, 400))), "en", "a", 0) for k in range(80)]
    got = fingerprint_edits(frame(spark, rows, clash=True), "doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    distinct = [r for r in rows if r[0] not in (2, 3)]
    got = fingerprint_edits(frame(spark, distinct), "doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute(distinct)


def test_sql_gives_the_same(spark, tmp_path):
    import duckdb

    from plumbline.llm.merkle import ORACLE

    pick = random.Random(7)
    rows = [(3 * k, "".join(pick.choice("abc.\n\n ,") for _ in range(pick.randint(0, 300))), "en", "a", 0) for k in range(60)]
    df = frame(spark, rows)
    df.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = fingerprint_edits(df, "doc_id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE).fetchall())


def test_one_row_follows_itself_and_no_row_gives_none(spark):
    one = [(4, "abcdefgh", "en", "a", 0)]
    assert [tuple(r) for r in fingerprint_edits(frame(spark, one), "doc_id", "text").collect()] == brute(one)
    assert fingerprint_edits(frame(spark, []), "doc_id", "text").count() == 0


def test_differing_branches_locate_edits(spark):
    a = "s0 p0\ns0 p1\n\ns1 p0\n\ns2 p0\ns2 p1"
    b = "s0 p0\ns0 changed\n\ns1 p0\n\ns2 p0\ns2 p1\ns2 new"
    df = merkle_trees(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string"), "text")
    x, y, z = (df.where(f"doc_id = {k}").select(F.col("paragraph_digests").alias(f"d{k}"), F.col("fingerprint").alias(f"r{k}")) for k in (1, 2, 3))
    row = x.crossJoin(y).crossJoin(z).select(edited_branches(F.col("d1"), F.col("d2")).alias("e"), edited_branches(F.col("d1"), F.col("d3")).alias("n"), "r1", "r2", "r3").first()
    assert [tuple(e) for e in row.e] == [(0, 1), (2, 2)] and row.n == []
    assert row.r1 == row.r3 != row.r2
