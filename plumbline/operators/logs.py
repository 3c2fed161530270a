"""Log digests over a relation of lines: source, line_number (from 1), raw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import log_key
from ..functions.values import stripped

# Line formats, key words, field names and metric names.
LEVELS = "DEBUG|INFO|WARNING|ERROR|CRITICAL"
PYTHON = (
    rf"^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}[,.][0-9]+)\s*-\s*([\w.]+)\s*-\s*({LEVELS})\s*-\s*(.+)$",
    rf"^({LEVELS}):([\w.]+):(.+)$",
    rf"^\[({LEVELS})\]\s+(.+)$",
)
ERROR_WORDS = r"(?i)\b(error|exception|fatal|critical|fail(ed|ure)?|crash(ed)?|abort(ed)?|panic|segfault|killed|oom)\b"
WARNING_WORDS = r"(?i)\b(warn(ing)?|deprecated|caution|notice)\b"
COMBINED = r"""^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+([0-9]{3})\s+(\S+)(\s+"([^"]*)"\s+"([^"]*)")?"""
NGINX = r"^([0-9]{4}/[0-9]{2}/[0-9]{2}\s+[0-9]{2}:[0-9]{2}:[0-9]{2})\s+\[(\w+)\]\s+[0-9]+#[0-9]+:\s+(.+)$"
RESULT = r"^(PASSED|FAILED|ERROR|SKIPPED)\s+(.+?)(\s+-\s+(.+))?$"
SECTION = r"^=+ (.+?) =+$"
COLLECTED = r"^collected ([0-9]+) items?"
TEST_ID = r"test_\w+\.py::test_\w+"
METRIC = r"([a-zA-Z_][a-zA-Z0-9_]*)\s*[=:]\s*(-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?|nan|inf|-inf)"
EPOCH = r"(?i)(Epoch\s+)?([0-9]+)\s*/\s*([0-9]+)"
PROGRESS = r"\[=+>?\s*\]|^[0-9]+%\|"
METRICS = (
    "loss", "val_loss", "train_loss", "acc", "accuracy", "val_acc", "val_accuracy", "f1", "f1_score", "val_f1", "auc", "roc_auc",
    "pr_auc", "precision", "recall", "lr", "learning_rate", "epoch", "step", "iter", "mse", "mae", "rmse", "perplexity", "ppl",
)
LEVEL_FIELDS = ("level", "severity", "log_level", "lvl")
MESSAGE_FIELDS = ("message", "msg", "text", "body")
TIME_FIELDS = ("timestamp", "time", "ts", "@timestamp", "datetime")
ERROR_FIELDS = ("error", "exception", "stack_trace", "traceback", "err")
JSON_LEVELS = {
    "error": ("error", "err", "fatal", "critical"),
    "warning": ("warning", "warn"),
}
START = r"^Traceback \(most recent call last\):|^(Exception|Error) in thread"
FRAME = r"""^\s+File ".+", line [0-9]+, in .+|^\s+at [\w.$]+\([\w.]+:[0-9]+\)"""
EXCEPTION = r"^([A-Z][a-zA-Z]+(Error|Exception|Warning|Interrupt|Exit|KeyboardInterrupt|SystemExit)[^\n]*)"
#: Formats in the order in which equal scores are decided.
FORMATS = ("pytest", "python_logging", "training", "json_lines", "webserver", "generic")
PROTECTED = ("error", "traceback")
#: Lines of a source that are sorted together where its lines are counted.
BLOCK = 1 << 17


def _line(level: Column, timestamp: Column, message: Column, category: Column, source: Column) -> Column:
    return F.struct(
        level.alias("level"), timestamp.alias("timestamp"), message.alias("message"), category.alias("category"), source.alias("log_source")
    )


_none = lambda: F.lit(None).cast("string")


def parse_python(raw: Column) -> Column:
    s = stripped(raw)
    get = lambda pattern, k: F.regexp_extract(s, pattern, k)
    by_level = lambda level: F.when(level.isin("ERROR", "CRITICAL"), "error").when(level == "WARNING", "warning").otherwise("info")
    a, b, c = PYTHON
    return (
        F.when(s.rlike(a), _line(get(a, 3), get(a, 1), stripped(get(a, 4)), by_level(get(a, 3)), get(a, 2)))
        .when(s.rlike(b), _line(get(b, 1), _none(), stripped(get(b, 3)), by_level(get(b, 1)), get(b, 2)))
        .when(s.rlike(c), _line(get(c, 1), _none(), stripped(get(c, 2)), by_level(get(c, 1)), _none()))
        .otherwise(_line(_none(), _none(), s, F.when(s.startswith("Traceback"), "traceback").otherwise("info"), _none()))
    )


def parse_generic(raw: Column) -> Column:
    error, warning = raw.rlike(ERROR_WORDS), raw.rlike(WARNING_WORDS)
    level = F.when(error, "ERROR").when(warning, "WARNING")
    category = F.when(error, "error").when(warning, "warning").otherwise("info")
    return _line(level, _none(), stripped(raw), category, _none())


def parse_webserver(raw: Column) -> Column:
    s = stripped(raw)
    get = lambda pattern, k: F.regexp_extract(s, pattern, k)
    status = get(COMBINED, 5).try_cast("int")
    level = F.when(status >= 500, "ERROR").when(status >= 400, "WARNING")
    category = F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")
    message = F.concat_ws(" ", get(COMBINED, 3), get(COMBINED, 4), status.cast("string"))
    named = F.upper(get(NGINX, 2))
    by_name = F.when(named.isin("ERROR", "CRIT", "EMERG"), "error").when(named == "WARN", "warning").otherwise("info")
    return (
        F.when(s.rlike(COMBINED), _line(level, get(COMBINED, 2), message, category, get(COMBINED, 1)))
        .when(s.rlike(NGINX), _line(named, get(NGINX, 1), get(NGINX, 3), by_name, _none()))
        .otherwise(_line(_none(), _none(), s, F.lit("info"), _none()))
    )


def parse_pytest(raw: Column) -> Column:
    s = stripped(raw)
    failed = F.regexp_extract(s, RESULT, 1).isin("FAILED", "ERROR")
    return (
        F.when(s.rlike(RESULT), _line(F.when(failed, "ERROR"), _none(), s, F.when(failed, "error").otherwise("info"), stripped(F.regexp_extract(s, RESULT, 2))))
        .when(s.rlike(SECTION), _line(_none(), _none(), s, F.lit("info"), _none()))
        .when(s.startswith("WARNINGS"), _line(F.lit("WARNING"), _none(), s, F.lit("warning"), _none()))
        .otherwise(_line(_none(), _none(), s, F.lit("info"), _none()))
    )


def parse_json(raw: Column) -> Column:
    """Fields by their names in order, then the same regardless of case; what is left over is the source."""
    s = stripped(raw)
    record = F.from_json(F.when(s.startswith("{"), s), "map<string,string>")
    keys, entries = F.map_keys(record), F.map_entries(record)
    loosely = lambda n: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(0))["value"]

    def found(names: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("string")
        for n in reversed(names):
            out = F.when(F.array_contains(keys, n), record[n]).otherwise(out)
        has = F.arrays_overlap(keys, F.array(*map(F.lit, names)))
        return F.when(has, out).otherwise(F.coalesce(*map(loosely, names)))

    level, text, moment, error = found(LEVEL_FIELDS), found(MESSAGE_FIELDS), found(TIME_FIELDS), found(ERROR_FIELDS)
    known = F.array(*map(F.lit, LEVEL_FIELDS + MESSAGE_FIELDS + TIME_FIELDS + ERROR_FIELDS))
    extra = F.map_filter(record, lambda k, _: ~F.array_contains(known, k))
    by_level = F.lower(F.coalesce(level, F.lit("")))
    category = F.when(by_level.isin(*JSON_LEVELS["error"]), "error").when(by_level.isin(*JSON_LEVELS["warning"]), "warning").otherwise("info")
    bad = F.coalesce(~error.isin("", "false", "0", "[]", "{}"), F.lit(False))
    textual = ~F.coalesce(error, F.lit("")).rlike(r"^[\[{]")
    message = F.when(bad & textual, error).otherwise(F.coalesce(F.when(text != "", text), s))
    parsed = _line(
        F.when(level != "", F.upper(level)), moment, message, F.when(bad, "error").otherwise(category), F.when(F.size(extra) > 0, F.to_json(extra))
    )
    plain = _line(_none(), _none(), s, F.lit("info"), _none())
    return F.when(record.isNotNull() & is_json_object(s), parsed).otherwise(plain)


def is_json_object(s: Column) -> Column:
    return s.startswith("{") & F.try_parse_json(s).isNotNull()


def metric_pairs(raw: Column) -> Column:
    """Name and value of each known metric in a line, in order."""
    found = F.arrays_zip(F.regexp_extract_all(raw, F.lit(METRIC), F.lit(1)).alias("name"), F.regexp_extract_all(raw, F.lit(METRIC), F.lit(2)).alias("value"))
    lowered = F.transform(found, lambda x: F.struct(F.lower(x["name"]).alias("name"), F.lower(x["value"]).alias("value")))
    return F.filter(lowered, lambda x: x["name"].isin(*METRICS))


def parse_training(raw: Column) -> Column:
    lower = F.lower(raw)
    metric = (F.size(metric_pairs(raw)) > 0) | lower.contains("epoch") | lower.contains("step") | lower.contains("iter")
    return _line(_none(), _none(), stripped(raw), F.when(metric, "metric").otherwise("info"), _none())


PARSERS = dict(zip(FORMATS, (parse_pytest, parse_python, parse_training, parse_json, parse_webserver, parse_generic)))


def format_scores(raw: Column) -> list[tuple[str, Column]]:
    """For each format, an aggregate over sample lines from 0 to 1."""
    s, lower, n = stripped(raw), F.lower(raw), F.greatest(F.count(F.lit(1)), F.lit(1))
    signals = (
        F.when(s.rlike(RESULT), 2).when(s.rlike(SECTION), 1).when(s.rlike(TEST_ID), 1).when(s.rlike(COLLECTED), 2)
        .when(s.contains("short test summary info") | s.contains("warnings summary"), 2).otherwise(0)
    )
    words = lower.rlike("epoch|loss|accuracy|val_|train_")
    hit = F.when(words, 1).when(raw.rlike(METRIC), (F.size(metric_pairs(raw)) > 0).cast("int")).when(raw.rlike(PROGRESS), 1).otherwise(0)
    python = F.greatest(*(s.rlike(p).cast("int") for p in PYTHON))
    web = (s.rlike(COMBINED) | s.rlike(NGINX)).cast("int")
    return [
        ("pytest", F.least(F.lit(1.0), F.sum(signals) / n * 3)),
        ("python_logging", F.sum(python) / n),
        ("training", F.least(F.lit(1.0), F.sum(hit) / n * 1.5)),
        ("json_lines", F.sum(is_json_object(s).cast("int")) / n),
        ("webserver", F.sum(web) / n),
        ("generic", F.max(F.lit(0.1))),
    ]


def detect_formats(lines: DataFrame, sample: int = 50) -> DataFrame:
    """source, log_format, score: the best format of each source's first lines; below 0.3 it is generic.

    line_number tells the first lines, so nothing is sorted; equal scores go to the format listed first.
    """
    scored = lines.where(F.col("line_number") <= sample).groupBy("source").agg(*(c.alias(f) for f, c in format_scores(F.col("raw"))))
    places = [F.struct(F.col(f).alias("score"), F.lit(-k).alias("_at"), F.lit(f).alias("log_format")) for k, f in enumerate(FORMATS)]
    best = scored.select("source", F.greatest(*places).alias("b"), F.col("generic"))
    weak = F.col("b.score") < 0.3
    return best.select(
        "source", F.when(weak, "generic").otherwise(F.col("b.log_format")).alias("log_format"), F.when(weak, F.col("generic")).otherwise(F.col("b.score")).alias("score")
    )


def parse_lines(lines: DataFrame, log_format: str) -> DataFrame:
    """lines with level, timestamp, message, category and log_source by one format's rules."""
    return lines.withColumn("_p", PARSERS[log_format](F.col("raw"))).select(*lines.columns, "_p.*")


def by_blocks(
    lines: DataFrame, order: tuple[str, ...] = ("line_number",), sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, previous: dict[str, Column] | None = None
) -> DataFrame:
    """lines with running sums of flags and running maxima of numbers over each source, up to and with each line, and
    values of the line before.

    Blocks of lines are summed up first, then lines within a block, so that no task sorts more than a
    block of a long log.
    """
    sums, maxes, previous = sums or {}, maxes or {}, previous or {}
    values = {f"_v_{n}": F.coalesce(f, F.lit(False)).cast("long") for n, f in sums.items()} | {f"_v_{n}": v for n, v in maxes.items()}
    values |= {f"_v_{n}": F.struct(v.alias("v")) for n, v in previous.items()}
    own = lines.withColumns(values | {"_part": F.floor(F.col("line_number") / BLOCK)})
    place = F.struct(*order)
    ends = [F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums] + [F.max(f"_v_{n}").alias(f"_b_{n}") for n in maxes] + [F.max_by(f"_v_{n}", place).alias(f"_b_{n}") for n in previous]
    blocks = Window.partitionBy("source").orderBy("_part")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("source", "_part").agg(*ends).select(
        "source", "_part", *(F.coalesce(F.sum(f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums),
        *(F.max(f"_b_{n}").over(before).alias(f"_b_{n}") for n in maxes), *(F.lag(f"_b_{n}").over(blocks).alias(f"_b_{n}") for n in previous),
    )
    within = Window.partitionBy("source", "_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(upto) for n in sums} | {n: F.greatest(f"_b_{n}", F.max(f"_v_{n}").over(upto)) for n in maxes}
    out |= {n: F.coalesce(F.lag(f"_v_{n}").over(within), F.col(f"_b_{n}")) for n in previous}
    done = own.join(base, ["source", "_part"]).select(*lines.columns, *(c.alias(n) for n, c in out.items()))
    return done.withColumns({n: F.col(n)["v"] for n in previous} | {f"{n}_known": F.col(n).isNotNull() for n in previous}) if previous else done


def running_count(lines: DataFrame, flag: Column, into: str) -> DataFrame:
    """lines with the number of lines of the source up to and with each for which flag holds (see by_blocks)."""
    return by_blocks(lines, sums={into: flag})


def suppressed_lines(parsed: DataFrame, threshold: int = 3, window: int = 100) -> DataFrame:
    """parsed lines with key and suppressed: a line whose key has come more than `threshold` times in the last
    `window` lines that aren't errors or tracebacks (it included). Those two are never suppressed.

    A source's lines are numbered without sorting it as a whole (see by_blocks); then a key's lines of a
    block look back over a range of places. The last lines of a block are seen by the next one too, so
    that neither a long log nor a line that makes up most of it is one task's.
    """
    plain = ~F.col("category").isin(*PROTECTED)
    own = running_count(parsed.withColumn("key", F.when(plain, log_key(F.col("message")))), F.col("key").isNotNull(), "_seq")
    at = F.floor(F.col("_seq") / BLOCK)
    ahead = F.col("key").isNotNull() & (F.pmod("_seq", F.lit(BLOCK)) >= BLOCK - (window - 1))
    seen = F.when(ahead, F.array(at, at + 1)).otherwise(F.array(at))
    dealt = own.withColumn("_block", F.explode(seen))
    back = Window.partitionBy("source", "key", "_block").orderBy("_seq").rangeBetween(-(window - 1), 0)
    marked = dealt.withColumn("suppressed", F.col("key").isNotNull() & (F.count("key").over(back) > threshold))
    return marked.where(F.col("_block") == at).drop("_seq", "_block")


def repeat_groups(marked: DataFrame, threshold: int = 3) -> DataFrame:
    """source, key, message, count, first_line, last_line of suppressed repeats: from a key's first suppressed line
    on every occurrence counts; groups of more than `threshold`, most frequent first by `count`."""
    first = marked.where("suppressed").groupBy("source", "key").agg(F.min("line_number").alias("first_line"))
    later = marked.where("key IS NOT NULL").select("source", "key", "line_number", "message").join(first, ["source", "key"])
    later = later.where(F.col("line_number") >= F.col("first_line"))
    groups = later.groupBy("source", "key").agg(
        F.min_by("message", "line_number").alias("message"), F.count(F.lit(1)).alias("count"),
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"),
    )
    return groups.where(F.col("count") > threshold)


def capped(marked: DataFrame, category: str, cap: int) -> DataFrame:
    """The first `cap` lines of a category that aren't suppressed, with their rank in each source."""
    rows = marked.where((F.col("category") == category) & ~F.col("suppressed"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("line_number"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= cap)


def overflow(marked: DataFrame, max_errors: int = 50, max_warnings: int = 20) -> DataFrame:
    """source, total_lines, suppressed, errors, warnings and how many of each are beyond their caps."""
    seen = lambda c: F.count_if((F.col("category") == c) & ~F.col("suppressed"))
    out = marked.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if("suppressed").alias("suppressed_lines"), seen("error").alias("errors"), seen("warning").alias("warnings")
    )
    beyond = lambda c, cap: F.greatest(F.col(c) - cap, F.lit(0)).cast("long")
    return out.withColumns({"overflow_errors": beyond("errors", max_errors), "overflow_warnings": beyond("warnings", max_warnings)})


def tracebacks(lines: DataFrame, max_frames: int = 5) -> DataFrame:
    """source, start_line, end_line, exception_type, exception_message, frames, full_text of each traceback.

    A start line opens a block; its first exception line ends it inclusively, a blank line or the next
    start exclusively, the source's end else. Blocks are islands: a running count of starts numbers
    them, and the least closing line of each bounds it.
    """
    s = stripped(F.col("raw"))
    start = s.rlike(START)
    own = lines.select("source", "line_number", "raw", s.alias("_s"), start.alias("_start"))
    own = running_count(own, F.col("_start"), "_block").where(F.col("_block") > 0)
    frame = F.col("raw").rlike(FRAME)
    ends = F.when(~F.col("_start") & F.col("_s").rlike(EXCEPTION) & ~frame, F.col("line_number"))
    blank = F.when(F.col("_s") == "", F.col("line_number"))
    whole = Window.partitionBy("source", "_block")
    own = own.withColumns({"_end": F.min(ends).over(whole), "_blank": F.min(blank).over(whole)})
    inside = F.when(
        F.col("_end").isNotNull() & (F.col("_blank").isNull() | (F.col("_end") < F.col("_blank"))), F.col("line_number") <= F.col("_end")
    ).otherwise(F.col("_blank").isNull() | (F.col("line_number") < F.col("_blank")))
    row = F.struct("line_number", "raw", "_s", frame.alias("frame"))
    blocks = own.where(inside).groupBy("source", "_block").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    last = F.try_element_at(F.filter("rows", lambda x: (x["_s"] != "") & ~x["frame"] & ~x["raw"].startswith("Traceback")), F.lit(-1))["_s"]
    named = F.regexp_extract(last, EXCEPTION, 1)
    frames = F.transform(F.filter("rows", lambda x: x["frame"]), lambda x: x["raw"])
    after = stripped(F.expr("substring(named, instr(named, ':') + 1)"))
    blocks = blocks.select("source", "_block", "rows", named.alias("named"), frames.alias("_frames"))
    colon = F.col("named").contains(":")
    return blocks.select(
        "source",
        F.col("rows")[0]["line_number"].alias("start_line"),
        F.element_at("rows", -1)["line_number"].alias("end_line"),
        F.when(F.col("named") != "", stripped(F.substring_index("named", ":", 1))).alias("exception_type"),
        F.when(colon, after).alias("exception_message"),
        F.when(F.size("_frames") > max_frames, F.slice("_frames", -max_frames, max_frames)).otherwise(F.col("_frames")).alias("frames"),
        F.array_join(F.transform("rows", lambda x: x["raw"]), "\n").alias("full_text"),
    )


def metrics(lines: DataFrame) -> DataFrame:
    """source, line_number, place, name, value, number, step of each metric in training lines."""
    step = F.when(F.col("raw").rlike(EPOCH), F.regexp_extract("raw", EPOCH, 2).try_cast("long"))
    rows = lines.select("source", "line_number", step.alias("step"), F.posexplode(metric_pairs(F.col("raw"))).alias("place", "m"))
    return rows.select("source", "line_number", "place", F.col("m.name").alias("name"), F.col("m.value").alias("value"), F.col("m.value").try_cast("double").alias("number"), "step")


def metric_anomalies(found: DataFrame, max_metrics: int | None = 30) -> DataFrame:
    """source, line_number, level, message: metrics that aren't finite, and the first place where a source's loss
    has risen three times in a row. Looks at each source's first max_metrics metrics (None: at all)."""
    order = ["line_number", "place"]
    held = found
    if max_metrics is not None:
        held = found.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("_n") <= max_metrics).drop("_n")
    bad = held.where(F.col("value").isin("nan", "inf", "-inf"))
    bad = bad.select("source", "line_number", F.lit("ERROR").alias("level"), F.format_string("Anomaly: %s=%s at line %d", "name", "value", "line_number").alias("message"))
    loss = held.where((F.col("name") == "loss") & ~F.col("value").isin("nan", "inf", "-inf"))
    up = F.coalesce(F.col("number") > F.col("_prior"), F.lit(False))
    runs = by_blocks(loss, tuple(order), sums={"_seq": F.lit(True)}, previous={"_prior": F.col("number")}).withColumn("_up", up)
    runs = by_blocks(runs, tuple(order), maxes={"_low": F.when(~F.col("_up"), F.col("_seq"))})
    risen = runs.where(F.col("_seq") - F.col("_low") == 3).groupBy("source").agg(F.min("line_number").alias("line_number"))
    rising = risen.select("source", "line_number", F.lit("WARNING").alias("level"), F.lit("Training loss has been increasing for 3+ consecutive steps").alias("message"))
    return bad.unionByName(rising)


def key_events(marked: DataFrame, log_format: str) -> DataFrame:
    """Lines worth listing on their own: failed results of pytest, errors of a web server, of others none."""
    if log_format not in ("pytest", "webserver"):
        return marked.where(F.lit(False))
    event = (F.col("category") == "error") & ~F.col("suppressed")
    return marked.where(event & F.col("message").rlike(RESULT) if log_format == "pytest" else event)


def run_suppression(lines: DataFrame, key: Column, threshold: int = 3) -> DataFrame:
    """lines with suppressed: those beyond the first `threshold` of consecutive lines with one key."""
    own = by_blocks(lines.withColumn("_key", key), sums={"_seq": F.lit(True)}, previous={"_prior": F.col("_key")})
    fresh = ~F.col("_prior_known") | ~F.col("_key").eqNullSafe(F.col("_prior"))
    own = by_blocks(own, maxes={"_first": F.when(fresh, F.col("_seq"))})
    return own.withColumn("suppressed", F.col("_seq") - F.col("_first") >= threshold).select(*lines.columns, "suppressed")
