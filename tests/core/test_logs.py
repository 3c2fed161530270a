import json
import random
import re
from collections import Counter, deque

from plumbline.functions.text import log_key
from plumbline.operators import logs
from plumbline.plans import registry
from plumbline.plans.tools import log_digest, summarize_log, summarize_logs
from plumbline.sources.lines import lines_of, read_lines, window_of
from plumbline.streaming.logs import session_counts, suppress_repeats, tail_lines, window_counts
from pyspark.sql import functions as F


def digest(spark, text, **options):
    return log_digest(spark, lines_of(spark, text), "log", **options)


def test_repetitive_log(spark):
    text = "\n".join(["2025-05-12 10:30:00,123 - app - INFO - heartbeat ok"] * 2000 + ["2025-05-12 10:30:00,123 - app - ERROR - broke"] * 5)
    d = digest(spark, text)
    assert d["format"] == "python_logging" and d["suppressed_lines"] == 1997 and len(d["errors"]) == 5
    assert d["groups"][0]["count"] == 1997 and d["groups"][0]["first_line"] == 4


def test_error_overflow(spark):
    d = digest(spark, "\n".join(f"[ERROR] number {'x' * k}" for k in range(30)), max_errors=10)
    assert len(d["errors"]) == 10 and d["overflow_errors"] == 20


def model(keys, threshold=3, window=100):
    recent, out = deque(maxlen=window), []
    for k in keys:
        if k is None:
            out.append(False)
            continue
        recent.append(k)
        out.append(recent.count(k) > threshold)
    return out


def test_sliding_repeats_match_a_model(spark):
    pick = random.Random(1)
    words = [pick.choice(["a", "b", "c", "d" * pick.randint(1, 60), "error here"]) for _ in range(900)]
    lines = lines_of(spark, "\n".join(words))
    marked = logs.suppressed_lines(logs.parse_lines(lines, "generic")).orderBy("line_number").collect()
    assert [r.suppressed for r in marked] == model([None if "error" in w else w for w in words])
    got = {(r.key, r["count"], r.first_line, r.last_line) for r in logs.repeat_groups(logs.suppressed_lines(logs.parse_lines(lines, "generic"))).collect()}
    want, hit = {}, model([None if "error" in w else w for w in words])
    for k, (w, s) in enumerate(zip(words, hit), 1):
        if "error" not in w and (w in want or s):
            n, first, _ = want.get(w, (0, k, k))
            want[w] = (n + 1, first, k)
    assert got == {(w, *v) for w, v in want.items() if v[0] > 3}


def test_keys(spark):
    rows = [("At 2025-01-02 03:04:05,6 id 0xDEADBEEF took 1.5 s n 7 x9", "at {TS} id {ID} took {N} s n {N} x9"), ("X 123e4567-e89b-12d3-a456-426614174000 ", "x {ID}")]
    got = spark.createDataFrame(rows, "a string, b string").select(log_key(F.col("a")).alias("k"), "b").collect()
    assert all(r.k == r.b for r in got)


TRACE = """start
Traceback (most recent call last):
  File "a.py", line 1, in f
    g()
  File "b.py", line 2, in g
    raise ValueError("bad input")
ValueError: bad input
between
Traceback (most recent call last):
  File "c.py", line 3, in h
custom.module.Oops: dotted

Traceback (most recent call last):
  File "d.py", line 3, in h
KeyError: 'x'"""


def test_tracebacks(spark):
    got = logs.tracebacks(lines_of(spark, TRACE), max_frames=1).orderBy("start_line").collect()
    assert [(t.start_line, t.end_line, t.exception_type, t.exception_message) for t in got] == [(2, 7, "ValueError", "bad input"), (9, 11, None, None), (13, 15, "KeyError", "'x'")]
    assert got[0].frames == ['  File "b.py", line 2, in g'] and got[0].full_text.startswith("Traceback")


def blocks(lines):
    """A model of the segmentation, line by line."""
    out, now = [], None
    for k, line in enumerate(lines, 1):
        s = line.strip()
        if s.startswith("Traceback (most recent call last):"):
            out += [now] if now else []
            now = [k, k]
        elif now and not s:
            out.append(now)
            now = None
        elif now:
            now[1] = k
            if re.match(logs.EXCEPTION, s) and not re.match(r'^\s+File ".+", line', line):
                out.append(now)
                now = None
    return [tuple(b) for b in out + ([now] if now else [])]


def test_random_tracebacks_match_a_model(spark):
    pick = random.Random(4)
    kinds = ["Traceback (most recent call last):", '  File "a.py", line 3, in f', "ValueError: x", "", "   ", "words", "    code()"]
    for _ in range(4):
        lines = [pick.choice(kinds) for _ in range(300)]
        got = logs.tracebacks(lines_of(spark, "\n".join(lines) + "\nend")).orderBy("start_line").collect()
        assert [(t.start_line, t.end_line) for t in got] == blocks([*lines, "end"])


def test_training_log(spark):
    rows = [f"Epoch {k}/20 - loss={v} accuracy=0.{k}" for k, v in enumerate([0.9, 0.5, 0.6, 0.7, 0.8, "nan"], 1)]
    d = digest(spark, "\n".join(rows))
    # metric lines repeat like any others: the first three are kept, and the one whose key differs
    assert d["format"] == "training" and len(d["metrics"]) == 8 and d["metrics"][0]["step"] == 1
    assert [e["level"] for e in d["errors"]] == ["ERROR"] and "nan" in d["errors"][0]["message"]
    found = logs.metrics(lines_of(spark, "\n".join(rows)))
    odd = logs.metric_anomalies(found).orderBy("line_number").collect()
    assert [(r.line_number, r.level) for r in odd] == [(5, "WARNING"), (6, "ERROR")]


def test_other_formats(spark):
    py = "\n".join(["=== test session starts ===", "collected 3 items", "PASSED t/test_a.py::test_x", "FAILED t/test_a.py::test_y - boom", "ERROR t/test_b.py::test_z", "FAILED t/test_c.py::test_q"])
    d = digest(spark, py)
    assert d["format"] == "pytest" and len(d["errors"]) == 3 and len(d["key_events"]) == 3
    web = "\n".join(f'1.2.3.{k} - - [01/Jan/2025:00:00:00 +0000] "GET /p{k} HTTP/1.1" {s} 12 "-" "a"' for k, s in enumerate([200, 404, 500, 302]))
    d = digest(spark, web)
    assert d["format"] == "webserver" and len(d["errors"]) == len(d["warnings"]) == 1 and d["errors"][0]["message"] == "GET /p2 500"
    js = "\n".join(json.dumps(x) for x in [{"level": "error", "msg": "a", "ts": 1}, {"Severity": "WARN", "Text": "b"}, {"lvl": "info", "message": "c", "error": "boom"}, {"x": 1}])
    got = logs.parse_lines(lines_of(spark, js), "json_lines").orderBy("line_number").collect()
    assert [(r.level, r.message, r.category) for r in got[:3]] == [("ERROR", "a", "error"), ("WARN", "b", "warning"), ("INFO", "boom", "error")]
    assert digest(spark, "plain words\nmore")["format"] == "generic" and digest(spark, "")["total_lines"] == 0
    assert digest(spark, "a failed job", format_hint="generic")["errors"][0]["line_number"] == 1


def test_files_and_windows(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("".join(f"line {k}\r\n" for k in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        got = read_lines(spark, str(path))
        assert [(r.line_number, r.raw) for r in got.orderBy("line_number").collect()] == [(k, f"line {k}") for k in range(1, 5001)]
        assert [r.raw for r in window_of(got, tail=2).orderBy("line_number").collect()] == ["line 4999", "line 5000"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "## Summary" in summarize_log(spark, str(path), tail=10) and len(summarize_logs(spark, str(tmp_path))) == 1


def test_run_suppression(spark):
    words = list("aaaaabbbbaac") + ["a"]
    got = logs.run_suppression(lines_of(spark, "\n".join(words)), F.col("raw"), 3).orderBy("line_number").collect()
    assert [r.suppressed for r in got] == [False] * 3 + [True] * 2 + [False] * 3 + [True] + [False] * 4


def test_stream_suppresses_as_the_batch(spark, tmp_path):
    words = [random.Random(7).choice("abc") if k % 3 else "x" for k in range(120)]
    rows = [("s", k, w, w) for k, w in enumerate(words, 1)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(rows, "source string, line_number long, raw string, key string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, line_number long, raw string, key string").json(str(tmp_path / "in"))
    q = suppress_repeats(stream).writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.line_number: r.suppressed for r in spark.table("quiet").collect()}
    assert [got[k] for k in range(1, 121)] == model(words) and Counter(got.values())[True] > 50


def finished(stream, name, folder, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_streams_of_files_windows_and_sessions(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\r\ntwo\n")
    assert sorted(r.raw for r in finished(tail_lines(spark, str(tmp_path / "logs")), "tailed", tmp_path)) == ["one", "two"]
    rows = [("2025-01-01 00:01:00", "a"), ("2025-01-01 00:20:00", "a"), ("2025-01-01 03:00:00", "a"), ("2025-01-01 03:00:00", "b")]
    df = spark.createDataFrame(rows, "at string, k string").select(F.to_timestamp("at").alias("at"), "k")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    got = finished(window_counts(stream(), "at", "k", "1 hour"), "windows", tmp_path, "complete")
    assert sorted((r.start.hour, r.k, r.n) for r in got) == [(0, "a", 2), (3, "a", 1), (3, "b", 1)]
    got = finished(session_counts(stream(), "at", "k", "30 minutes"), "sessions", tmp_path, "complete")
    assert sorted((r.k, r.n) for r in got) == [("a", 1), ("a", 2), ("b", 1)]


def test_every_line_of_whole_texts_has_its_key(spark, tmp_path):
    moment = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}([,.][0-9]+)?"
    hexes = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"

    def key(line):
        out = line.lower().strip()
        for pattern, put in ((moment, "{TS}"), (hexes, "{ID}"), (r"\b0x[0-9a-f]{4,}\b", "{ID}"), (r"\b[0-9]+(\.[0-9]+)?\b", "{N}")):
            out = re.sub(pattern, put, out)
        return out

    texts = [(1, "É took 12 ms é3 3é ß 4\n\n  Ünder 0xBEEF  \n2025-05-12 10:30:00,5 日本 7日 8 " + "x" * 90 + " 9"), (2, None), (3, ""), (4, "plain 1.5"), (5, " 10\n")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        want = [(r.doc_id, k, key(x)) for r in rows if r.text is not None for k, x in enumerate(r.text.split("\n"), 1)]
        assert sorted(map(tuple, registry.queries()["log_normalize_key"](spark, folder).collect())) == sorted(want)
