"""History, blame, diff and tree digests over relations of commits, lines and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import age, human_size

DAY = 86_400
LARGE, RECENT = 1 << 20, 7 * DAY


def related_files(touched: DataFrame, path: Column | str, k: int = 5) -> DataFrame:
    """path, n: the files most often changed in one commit with `path`. touched has commit, path.

    Commits of the one file are few next to all; the other side is filtered by a semi join before it
    is counted.
    """
    own = touched.where(F.col("path") == path).select("commit").distinct()
    other = touched.join(own, "commit", "left_semi").where(F.col("path") != path).distinct()
    return other.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "path").limit(k)


def co_changes(touched: DataFrame, k: int = 5) -> DataFrame:
    """path, other, n, rank: for each file, the k files most often changed with it.

    touched has commit and path, each pair once. Pairs arise within a commit only, each once.
    """
    a, b = touched.select("commit", "path"), touched.select("commit", F.col("path").alias("other"))
    once = a.join(b, "commit").where(F.col("path") < F.col("other")).groupBy("path", "other").agg(F.count(F.lit(1)).alias("n"))
    both = once.unionByName(once.select(F.col("other").alias("path"), F.col("path").alias("other"), "n"))
    by = Window.partitionBy("path").orderBy(F.desc("n"), "other")
    return both.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def active_files(touched: DataFrame, k: int = 10) -> DataFrame:
    return touched.groupBy("path").agg(F.count_distinct("commit").alias("commits")).orderBy(F.desc("commits"), "path").limit(k)


def author_shares(blame: DataFrame) -> DataFrame:
    """author, lines, pct (one decimal), last_ts, last_commit of a table of lines with author, ts, hash."""
    by = blame.groupBy("author").agg(F.count(F.lit(1)).alias("lines"), F.max("ts").alias("last_ts"), F.max_by("hash", F.struct("ts", "hash")).alias("last_commit"))
    total = blame.agg(F.count(F.lit(1)).alias("_all"))
    return by.join(F.broadcast(total)).select("author", "lines", F.round(100.0 * F.col("lines") / F.col("_all"), 1).alias("pct"), "last_ts", "last_commit")  # total is one row


def age_histogram(blame: DataFrame, now: int) -> DataFrame:
    """One row: lines changed in the last 7, 30, 91 and 365 days and before; a missing time is the oldest."""
    days = (F.lit(now) - F.col("ts")) / DAY
    edges = [("days_7", None, 7), ("days_30", 7, 30), ("days_91", 30, 91), ("days_365", 91, 365)]
    inside = lambda lo, hi: (days < hi) if lo is None else (days >= lo) & (days < hi)
    older = F.count_if(days.isNull() | (days >= 365)).alias("older")
    return blame.agg(*(F.count_if(inside(lo, hi)).alias(name) for name, lo, hi in edges), older)


def recent_lines(blame: DataFrame, since: int, k: int = 20) -> DataFrame:
    """The newest k lines changed since a moment."""
    return blame.where(F.col("ts") >= since).orderBy(F.desc("ts"), "line_number").limit(k)


def diff_totals(lines: DataFrame) -> DataFrame:
    """path, added, removed of a table of diff lines with path and type (+, - or blank)."""
    return lines.groupBy("path").agg(F.count_if(F.col("type") == "+").alias("added"), F.count_if(F.col("type") == "-").alias("removed"))


def number_diff_lines(lines: DataFrame) -> DataFrame:
    """Diff lines with old_no and new_no. lines has path, hunk, place, type, old_start, new_start."""
    by = Window.partitionBy("path", "hunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda other: F.coalesce(F.sum((F.col("type") != other).cast("long")).over(by), F.lit(0))
    old, new = F.col("old_start") + before("+"), F.col("new_start") + before("-")
    return lines.withColumns({"old_no": F.when(F.col("type") != "+", old), "new_no": F.when(F.col("type") != "-", new)})


def within_budget(lines: DataFrame, group: str, order: list[str], budget: int = 200) -> DataFrame:
    """The first `budget` lines of each group in order, with cut set on the last if more follow."""
    by = Window.partitionBy(group).orderBy(*order)
    own = lines.withColumns({"_n": F.row_number().over(by), "_more": F.lead(F.lit(1)).over(by)})
    return own.where(F.col("_n") <= budget).withColumn("cut", (F.col("_n") == budget) & F.col("_more").isNotNull()).drop("_n", "_more")


def uncommitted(staged: DataFrame, against_head: DataFrame, path: list[str] | str = "path") -> DataFrame:
    """What isn't committed, with part: what is staged, and of the difference to the last commit the paths that aren't."""
    keys = [path] if isinstance(path, str) else path
    rest = against_head.join(staged.select(*keys).distinct(), keys, "left_anti")
    return staged.withColumn("part", F.lit("staged")).unionByName(rest.withColumn("part", F.lit("unstaged")))


def roll_up(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """path, n_files (at any depth), bytes (of direct files), n_children of each folder.

    nodes has path (parts joined by /), parent, is_dir, size. A file counts once for each folder above
    it: its path's prefixes are made in place, so no recursion and no repeated join is needed.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))
    files = nodes.where(~F.col("is_dir"))
    inside = files.where(F.size(parts) > 1).select(F.explode(F.slice(above, 1, depth)).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n_files"))
    direct = nodes.groupBy(F.col("parent").alias("path")).agg(F.sum(F.when(~F.col("is_dir"), F.col("size")).otherwise(0)).alias("bytes"), F.count(F.lit(1)).alias("n_children"))
    folders = nodes.where("is_dir").select("path")
    out = folders.join(inside, "path", "left").join(direct, "path", "left")
    return out.select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_files", "bytes", "n_children")))


def tree_totals(nodes: DataFrame, now: int) -> DataFrame:
    """One row: files, folders, bytes, recent (changed within 7 days) and large (over 1 MiB) files."""
    file = ~F.col("is_dir")
    return nodes.agg(
        F.count_if(file).alias("files"), F.count_if("is_dir").alias("folders"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(file & (F.col("mtime") >= now - RECENT)).alias("recent"), F.count_if(file & (F.col("size") > LARGE)).alias("large"),
    )


def annotate(nodes: DataFrame, now: int) -> DataFrame:
    """nodes with flags, age and human size."""
    file = ~F.col("is_dir")
    flags = F.array_compact(
        F.array(
            F.when(file & F.col("is_binary"), "binary") if "is_binary" in nodes.columns else F.lit(None).cast("string"), F.when(file & (F.col("size") == 0), "empty"), F.when(file & (F.col("size") > LARGE), "large"), F.when(file & (F.col("mtime") >= now - RECENT), "recent"),
        )
    )
    return nodes.withColumns({"flags": flags, "age": age(F.lit(now) - F.col("mtime")), "size_text": human_size(F.col("size"), 1)})


def filter_nodes(
    nodes: DataFrame, since: int | None = None, until: int | None = None, min_size: int | None = None, max_size: int | None = None,
    extensions: list[str] | None = None, kind: str | None = None, dotfiles: bool = True, focus: str | None = None,
) -> DataFrame:
    """Nodes within bounds; folders pass bounds on files. focus is a glob on the path."""
    keep, folder = F.lit(True), F.col("is_dir")
    for bound, ok in ((since, F.col("mtime") >= since), (until, F.col("mtime") <= until), (min_size, F.col("size") >= min_size), (max_size, F.col("size") <= max_size)):
        if bound is not None:
            keep = keep & (folder | ok)
    if extensions:
        keep = keep & (folder | F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(["." + e.lower().lstrip(".") for e in extensions]))
    if kind:
        keep = keep & (folder if kind == "dirs" else ~folder)
    if not dotfiles:
        keep = keep & ~F.col("path").rlike(r"(^|/)\.")
    if focus:
        keep = keep & F.col("path").rlike(glob_regex(focus))
    return nodes.where(keep)


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over whole paths: ** crosses folders; *, ? and [sets] don't."""
    import re

    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "[" and (end := glob.find("]", k + 3 if glob[k + 1 : k + 2] in ("!", "^") else k + 2)) > 0:
            within = glob[k + 1 : end]
            within = ("^" + within[1:] if within[0] in "!^" else within).replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out, k = out + f"(?!/)[{within}]", end + 1
        elif glob[k] == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k]))
            k += 1
    return f"^{out}$"


def limit_children(nodes: DataFrame, cap: int = 50) -> DataFrame:
    """nodes with last (the last of its parent) where a folder's files beyond cap become one row `… n more`."""
    by = Window.partitionBy("parent").orderBy(F.desc("is_dir"), F.lower("name"), "name")
    files = Window.partitionBy("parent", "is_dir").orderBy(F.lower("name"), "name")
    own = nodes.withColumns({"_file": F.row_number().over(files), "_all": F.count(F.lit(1)).over(Window.partitionBy("parent", "is_dir"))})
    own = own.where(F.col("is_dir") | (F.col("_file") <= cap + 1))
    more = ~F.col("is_dir") & (F.col("_file") == cap + 1)
    name = F.when(more, F.concat(F.lit("… "), (F.col("_all") - cap).cast("string"), F.lit(" more"))).otherwise(F.col("name"))
    own = own.withColumns({"place": F.row_number().over(by), "last": F.lead("name").over(by).isNull(), "shown": name})
    return own.drop("_file", "_all")
