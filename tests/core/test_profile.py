import json
import sqlite3
import zipfile

import pytest

from plumbline.errors import BadInput, NotFound
from plumbline.operators.profile import Options, text_profile, to_cells, typed_profile
from plumbline.plans.sqlguard import check_options, check_select, run_select
from plumbline.plans.tools import summarize_data, summarize_folder
from plumbline.sources import tabular


def digest(spark, path, **options):
    return json.loads(summarize_data(spark, str(path), format="json", **options))


@pytest.fixture
def tiny_csv(tmp_path):
    lines = ["order_id,customer_email,amount_usd,order_date,region"]
    amounts = [12.5, 1024, 88.1, 45, 67, 23.4, "", 99, 15, 200]
    regions = ["EU", "NA", "EU", "APAC", "NA", "EU", "", "EU", "NA", "EU"]
    lines += [f"{k},u{k}@x.io,{a},2025-01-{k:02d},{r}" for k, (a, r) in enumerate(zip(amounts, regions), 1)]
    path = tmp_path / "tiny.csv"
    path.write_text("\n".join(lines) + "\n")
    return path


def test_csv_profile(spark, tiny_csv):
    t = digest(spark, tiny_csv)["tables"][0]
    by = {c["column"]: c for c in t["columns"]}
    assert t["row_count"] == 10 and [c["dtype"] for c in t["columns"]] == ["int", "string", "float", "datetime", "string"]
    assert by["amount_usd"]["null_count"] == by["region"]["null_count"] == 1
    assert (by["amount_usd"]["min"], by["amount_usd"]["max"]) == (12.5, 1024.0)
    assert (by["order_date"]["min_date"], by["order_date"]["max_date"]) == ("2025-01-01", "2025-01-10")
    assert t["top_values"]["region"][0] == ["EU", 5] and by["region"]["distinct_count"] == 3
    assert [r["order_id"] for r in t["head"]] == ["1", "2", "3", "4", "5"] and t["tail"] == []


def test_caps(spark, tiny_csv):
    t = digest(spark, tiny_csv, max_rows=4, sample=1, columns=["region", "order_id", "none"])["tables"][0]
    assert t["truncated"] and [c["column"] for c in t["columns"]] == ["order_id", "region"]
    assert [c["row_count"] for c in t["columns"]] == [4, 4] and t["tail"][0]["order_id"] == "4"


def test_messy_csv(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text('id,note,mixed\n1,"a, ""quoted"" one",42\n2,plain,13\n3,x,\n4,"two\nlines",\n5,short,fish\n')
    by = {c["column"]: c for c in digest(spark, path)["tables"][0]["columns"]}
    assert by["mixed"]["dtype"] == "mixed" and by["mixed"]["null_count"] == 2 and by["note"]["row_count"] == 5
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(BadInput):
        summarize_data(spark, str(empty))
    with pytest.raises(NotFound):
        summarize_data(spark, str(tmp_path / "no.csv"))


def test_jsonl_with_late_keys_and_bad_lines(spark, tmp_path):
    rows = [{"id": 1, "name": "a", "score": 1.5}, {"id": 2, "name": "b", "score": None}, {"id": 3, "name": "c", "score": 2, "region": "x"}, {"id": 4, "name": "d", "score": 1, "region": "x"}]
    path = tmp_path / "tiny.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n[1]\n")
    t = digest(spark, path)["tables"][0]
    by = {c["column"]: c for c in t["columns"]}
    assert [c["column"] for c in t["columns"]] == ["id", "name", "score", "region"]
    assert by["region"]["null_count"] == 2 and by["score"]["dtype"] == "float" and t["row_count"] == 4
    assert t["notes"] == ["2 malformed lines skipped"] and t["head"][2]["region"] == "x"


def test_json_table_and_structure(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"id": k, "name": "n"} for k in range(3)]))
    (tmp_path / "nested.json").write_text(json.dumps({"version": "1", "users": [1, 2], "config": {"a": 1}, "active": True, "owner": None}))
    assert digest(spark, tmp_path / "array.json")["tables"][0]["row_count"] == 3
    d = digest(spark, tmp_path / "nested.json")
    assert d["tables"] == [] and [(s["type"], s["size"]) for s in d["structures"]] == [("string", 1), ("array", 2), ("object", 1), ("boolean", None), ("null", None)]
    with pytest.raises(BadInput):
        tabular.read_json(spark, tmp_path / "nested.json", max_bytes=10)


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "multi.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, active BOOLEAN)")
        db.executemany("INSERT INTO users VALUES (?, ?, ?)", [(1, "a", 1), (2, "b", 0), (3, None, 1)])
        db.execute("CREATE TABLE orders (id INTEGER, user_id INTEGER, amount REAL)")
        db.executemany("INSERT INTO orders VALUES (?, ?, ?)", [(k, k % 3 + 1, k * 1.5) for k in range(10)])
        db.execute("CREATE TABLE events (id INTEGER, kind TEXT)")
        db.executemany("INSERT INTO events VALUES (?, ?)", [(k, "k") for k in range(30)])
    return path


def test_sqlite(spark, database):
    d = digest(spark, database)
    assert {t["name"]: t["row_count"] for t in d["tables"]} == {"events": 30, "orders": 10, "users": 3}
    users = next(t for t in d["tables"] if t["name"] == "users")
    assert [c["dtype"] for c in users["columns"]] == ["int", "string", "int"] and users["columns"][1]["null_count"] == 1
    split, _ = tabular.read_sqlite(spark, database, ["events"], parts=4)
    assert split[0].rows.rdd.getNumPartitions() == 4
    assert sorted(r.row_id for r in split[0].rows.collect()) == list(range(1, 31))


def test_sqlite_query(spark, database):
    q = "WITH a AS (SELECT id FROM users) SELECT o.amount, o.id, a.id FROM orders o JOIN a ON a.id = o.user_id;"
    t = digest(spark, database, query=q)["tables"][0]
    assert t["name"] == "query result" and t["row_count"] == 10 and [c["column"] for c in t["columns"]] == ["amount", "id", "id_2"]
    for bad in ("SELECT * FROM nothing", "DELETE FROM users"):
        with pytest.raises(BadInput):
            summarize_data(spark, str(database), query=bad)
    with pytest.raises(BadInput, match="combined"):
        summarize_data(spark, str(database), query="SELECT 1", table="users")


GOOD = [
    "SELECT 1", " select id from users ; ", "WITH a AS (SELECT 1) SELECT * FROM a", "with recursive c(n) as (select 1 union all select n + 1 from c where n < 5) select n from c",
    "-- note\nSELECT 1", "/* note */ SELECT 1", "WITH a AS (SELECT ')' AS x), b AS (SELECT 2) SELECT * FROM a, b", 'SELECT "a""b" FROM t',
]
BAD = [
    "", "  ", "UPDATE users SET name = 1", "INSERT INTO users VALUES (1)", "SELECT 1; DELETE FROM users", "PRAGMA table_info(users)", "DROP TABLE users", "VALUES (1)",
    "WITH x AS (SELECT id FROM users) INSERT INTO users SELECT * FROM x", "WITH x AS (SELECT 1", "WITH SELECT 1", "/* SELECT 1", "SELECT ';'", "SHOW TABLES", "WITH x SELECT 1",
]


@pytest.mark.parametrize("sql", GOOD)
def test_selects_pass(sql):
    check_select(sql)


@pytest.mark.parametrize("sql", BAD)
def test_other_statements_dont(sql):
    with pytest.raises(BadInput):
        check_select(sql)


def test_run_select_gives_names_back(spark):
    spark.range(1).createOrReplaceTempView("users")
    got = run_select(spark, "SELECT id, id FROM users WHERE id > 1", {"users": spark.range(5)})
    assert got.columns == ["id", "id_2"] and got.count() == 3 and spark.table("users").count() == 1
    with pytest.raises(BadInput):
        run_select(spark, "SELECT nothing FROM users", {"users": spark.range(5)})
    check_options(None, table="t")


def excel(path, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        for k, (_, rows) in enumerate(sheets, 1):
            body = ""
            for r, row in enumerate(rows, 1):
                cells = "".join(v if v.startswith("<c") else f'<c r="{"ABC"[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row) if v is not None)
                body += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_excel(spark, tmp_path):
    path = tmp_path / "t.xlsx"
    excel(path, [("One", [["a", None, "c"], ['<c r="A2"><v>1</v></c>', None, '<c r="C2" t="s"><v>0</v></c>'], ['<c r="A3"><v>2.5</v></c>']]), ("Empty", [])])
    one, empty = digest(spark, path)["tables"]
    assert [(c["column"], c["dtype"], c["null_count"]) for c in one["columns"]] == [("a", "float", 0), ("col_1", "null", 2), ("c", "string", 1)]
    assert empty["notes"] == ["empty sheet"]


def test_parquet_and_typed_edge_cases(spark, tmp_path):
    rows = [(1, 1.5, " ", True, [1]), (None, float("nan"), "x", None, None), (3, None, "x", False, [])]
    df = spark.createDataFrame(rows, "a int, b double, c string, d boolean, e array<int>")
    by = {r["column"]: r for r in typed_profile(df, Options(median=True)).collect()}
    assert by["b"]["null_count"] == 2 and by["b"]["std"] is None and by["a"]["median"] == 2.0
    assert by["c"]["distinct_count"] == 1 and by["d"]["dtype"] == "bool" and by["e"]["non_null_count"] == 2
    path = tmp_path / "t.parquet"
    df.write.parquet(str(path))
    t = digest(spark, path)["tables"][0]
    assert t["row_count"] == 3 and [c["column"] for c in t["columns"]] == list("abcde")
    none = typed_profile(df.limit(0)).collect()
    assert all(r["row_count"] == 0 and r["null_pct"] == 0 and r["distinct_count"] == 0 for r in none)
    assert text_profile(to_cells(spark.createDataFrame([], "row_id long, x string"), "row_id")).count() == 0


def test_format_detection(tmp_path):
    cases = {"a.csv": "csv", "a.TSV": "tsv", "a.ndjson": "jsonl", "a.pq": "parquet"}
    assert {n: tabular.detect(tmp_path / n) for n in cases} == cases
    for text, kind in ((b" [1]", "json"), (b"a,b\n", "csv"), (b"SQLite format 3\x00", "sqlite")):
        (tmp_path / "x").write_bytes(text)
        assert tabular.detect(tmp_path / "x") == kind
    (tmp_path / "x").write_bytes(b"words only")
    with pytest.raises(BadInput):
        tabular.detect(tmp_path / "x")


def test_folder_scan_skips_ignored(tmp_path):
    for name in ("a.csv", "b.jsonl", "node_modules/bad.csv", "sub/c.csv"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("a,b\n1,2\n")
    names = lambda **k: [p.relative_to(tmp_path).as_posix() for p in tabular.data_files(tmp_path, "*.csv,*.jsonl", **k)]
    assert names() == ["a.csv", "b.jsonl"] and names(recursive=True) == ["a.csv", "b.jsonl", "sub/c.csv"]


def test_folder_digest(spark, tmp_path, tiny_csv):
    (tmp_path / "bad.xlsx").write_text("no workbook")
    (tmp_path / "words").write_text("no table")
    done, warnings = summarize_folder(spark, str(tmp_path), sample=1)
    assert len(done) == 1 and "tiny.csv" in done[0] and len(warnings) == 2
