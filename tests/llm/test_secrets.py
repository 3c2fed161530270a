import hashlib
import random
import re

from plumbline.llm.secrets import BASE, BLANK, HOST, IDENTIFIER, KINDS, NEEDS, REACH, SECRET, redact, scan

from .helpers import awkward, frame


def brute(text):
    text = text or ""
    every = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text, re.A):
            hit = m.group()
            mixed = kind != "bare" or all(re.search(c, hit) for c in ("[0-9]", "[a-z]", "[A-Z]"))
            if len(m.group(group)) >= least and mixed:
                every.append((m.start(), rank, m.end(), kind))
    base = [x for x in every if x[3] in BASE]
    scope = lambda x: sum(1 for m in re.finditer(BLANK, text) if m.end() <= x[0])
    shown = lambda x: f"{x[3]}:{x[0]}:{x[2]}"

    def near(x, kinds):
        own = [(max(0, x[0] - y[2], y[0] - x[2]), y[0] > x[0], y) for y in every if y[3] in kinds and scope(y) == scope(x)]
        own = [o for o in own if o[0] <= REACH]
        if not own:
            return None
        back = [o for o in own if not o[1]]
        least = min(o[0] for o in own)
        if back and min(o[0] for o in back) == least:  # the one that ends last
            return max((o[2] for o in back), key=lambda y: (y[2], y[0], y[1]))
        return min((o[2] for o in own if o[1]), key=lambda y: (y[0], y[2], y[1]))

    out, links = list(base), {}
    for x in every:
        parts = [near(x, kinds) for kinds in NEEDS.get(x[3], ())]
        if parts and all(parts) and not any(b[0] <= x[0] < b[2] for b in base):
            out.append(x)
            links[x] = "+".join(map(shown, [x, *parts]))
    line = lambda xs: ",".join(map(shown, sorted(xs)))
    count = [sum(x[3] == k for x in base) for k in BASE]
    return (*count, len(out) - len(base), hashlib.sha256(line(base).encode()).hexdigest(), line(out), ",".join(links[x] for x in sorted(links)))


PARTS = ["AKIA" + "Q7" * 9, "AKIA123", "token: token: abcdefgh", 'Pass"word', "api_key='s3cr3t/+x'", "secret=abc", "password :  hunter22", "0123456789abcdef" * 3,
         "https://vault.example.com:8443/v1?x=1", "user=admin", "Username: bob", "é🤷🏽", "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY0", "text " * 30, "\n\n", "apikey=\"AKIA" + "X" * 20 + '"']


def test_spans_match_brute_force(spark):
    pick = random.Random(8)
    texts = ["".join(pick.choice(PARTS) + pick.choice([" ", "", "\n"]) for _ in range(pick.randint(1, 14))) for _ in range(250)]
    rows = awkward() + [(100 + k, t, "en", "a", 0) for k, t in enumerate(texts)]
    got = scan(frame(spark, rows, clash=True), "doc_id", "text").collect()
    want = [(r[0], *brute(r[1])) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[4] for w in want) > 50 and sum(w[1] for w in want) > 100


def test_distance_runs_between_intervals_within_a_scope(spark):
    key, link = "AKIA" + "B" * 240, "https://vault.example.com"
    texts = [f"{key} {link} password=abcdefgh", f"{key}{' ' * 199}{link} password=abcdefgh", f"{key}{' ' * 201}{link} password=abcdefgh", f"{key}\n\n{link} password=abcdefgh", f"{key}\n{link} password=abcdefgh"]
    got = scan(frame(spark, [(k, t, "en", "a", 0) for k, t in enumerate(texts)]), "doc_id", "text").orderBy("doc_id").collect()
    assert [r.n_linked for r in got] == [1, 1, 0, 0, 1]
    assert got[0].links == "endpoint:245:270+access:0:244+assign:271:288" and got[2].links == ""
    assert set(IDENTIFIER) & set(SECRET) == set() and HOST == ("endpoint",)


def test_sql_gives_the_same(spark, tmp_path):
    import duckdb

    from plumbline.llm.secrets import ORACLE

    pick = random.Random(9)
    rows = [(k, "".join(pick.choice(PARTS) + pick.choice([" ", "", "\n"]) for _ in range(pick.randint(0, 14))), "en", "a", 0) for k in range(200)]
    df = frame(spark, rows)
    df.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = scan(df, "doc_id", "text")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE).fetchall())


def test_many_matches_in_one_text(spark):
    text = "token=abcdef " * 3000
    got = scan(frame(spark, [(1, text, "en", "a", 0)]), "doc_id", "text").first()
    assert tuple(got)[1:] == brute(text)
    assert scan(frame(spark, []), "doc_id", "text").count() == 0


def test_redaction(spark):
    rows = redact(frame(spark, [(1, "x token = abc123xyz y AKIA" + "B" * 18, "en", "a", 0), (2, None, "en", "a", 0)]), "text").collect()
    assert [r.text for r in rows] == ["x token=[secret] y [secret]", None]
