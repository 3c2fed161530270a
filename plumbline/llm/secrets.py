"""Secret scans with DataFrame functions only: spans of three strong kinds, and linked parts of credentials.

Weak candidates (endpoints, logins, bare runs that may be secrets) are common in harmless text, so
they are reported only with their complements: an identifier, a secret and an endpoint that belong
together stand close to each other. Spans of all kinds become rows. A scope is a stretch of text
without a blank line. An interval join within scopes, done as a merge over spans by position, finds
the nearest part of each complement on either side of a candidate: no pairs are listed, and texts of
many spans take time by their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds in order with their patterns, and the least length of the group that has one.
KINDS = {
    "assign": (
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so shorter ones need not be found to be dropped
    "endpoint": (r"[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.-]+(:[0-9]+)?(/[A-Za-z0-9._~/?#&=%+-]*)?", 0, 12),
    "login": (
        r"([Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]+)""",
        2,
        3,
    ),
    "bare": (r"[A-Za-z0-9+/]{32,}", 0, 32),
}
BASE = ["assign", "access", "hex"]
BLANK = r"\n[\x20\t\r]*\n"
#: What a weak candidate must have near it: a span of one kind of each part.
IDENTIFIER, SECRET, HOST = ("access", "login"), ("assign", "hex", "bare"), ("endpoint",)
NEEDS = {"endpoint": (IDENTIFIER, SECRET), "login": (SECRET, HOST), "bare": (IDENTIFIER,)}
#: Code points that may stand between the end of one part and the beginning of another.
REACH = 200
RANK = {k: n for n, k in enumerate(KINDS)}
BREAK, MARK = len(KINDS), -1


MATCHES = "array<struct<rank:int,gap:int,size:int,ok:boolean>>"


def found(text: Column, kind: str | None) -> Column:
    """All matches of a kind (None: blank lines) in a text: arrays of (kind's rank, code points before it since the
    last match, its code points, whether it counts). A text without a match has none and is gone through only once."""
    pattern, group, least = KINDS[kind] if kind else (BLANK, 0, 0)
    rank = RANK[kind] if kind else BREAK
    # text between matches, whole matches and the measured group, in step
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    counts = lambda hit, value: F.length(value) >= least
    if kind == "bare":
        mixed = lambda hit: hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
        counts = lambda hit, value: (F.length(hit) >= least) & mixed(hit)
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("w"), part.alias("p")),
        lambda x: F.struct(
            F.lit(rank).alias("rank"), F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("size"), counts(x["w"], x["p"]).alias("ok")
        ),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(MATCHES))


def nearest(kinds: tuple[str, ...]) -> Column:
    """The span of one of the kinds that is nearest to a row's own, in its scope and within REACH; the earlier of two as near."""
    scope = Window.partitionBy("_doc", "_sha", "_scope").orderBy("_start")
    is_one = F.col("rank").isin([RANK[k] for k in kinds]) & F.col("ok")
    before = F.max(F.when(is_one, F.struct("_end", "_start", "rank"))).over(scope.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_one, F.struct("_start", "_end", "rank"))).over(scope.rangeBetween(0, Window.unboundedFollowing))
    far = F.lit(REACH + 1)
    back = F.when(before.isNull(), far).otherwise(F.greatest(F.lit(0), F.col("_start") - before["_end"]))
    ahead = F.when(after.isNull(), far).otherwise(F.greatest(F.lit(0), after["_start"] - F.col("_end")))
    span = lambda x: F.struct(x["rank"].alias("rank"), x["_start"].alias("s"), x["_end"].alias("e"))
    return F.when((back <= ahead) & (back <= REACH), span(before)).when(ahead <= REACH, span(after))


def spans(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_doc (the id), _sha (a digest of the text), _copies (rows of that id and text), _kind, _start, _end, _parts for each span to report.

    Each different pair of id and text also has one row without a kind. _start counts code points from 0,
    _end is exclusive. Base spans all stay; a weak candidate stays if it doesn't begin inside a base span and has
    its complements (NEEDS) in its scope, with at most REACH code points between: these are its _parts,
    the nearest of each, as structs of rank, s and e. Rows are told apart by id and text, not by
    numbers given to them, so a task that runs again finds the same.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("_doc"), body.alias("_body"))
    rows = rows.select("_doc", F.md5("_body").alias("_sha"), "_body", *(found(F.col("_body"), k).alias(k) for k in KINDS))
    weak = sum((F.size(k) for k in NEEDS), F.lit(0))
    # scopes matter to texts with weak candidates only
    rows = rows.withColumn("_breaks", F.when(weak > 0, found(F.col("_body"), None)).otherwise(F.array().cast(MATCHES)))
    # with its place in its kind's array, each match's position is a running sum; only numbers are shuffled
    mark = F.array(F.struct(F.lit(0).alias("i"), F.struct(F.lit(MARK).alias("rank"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(False).alias("ok")).alias("x")))
    each = F.concat(mark, *(F.transform(k, lambda x, i: F.struct(i.alias("i"), x.alias("x"))) for k in [*KINDS, "_breaks"]))
    rows = rows.select("_doc", "_sha", F.explode(each).alias("m")).select("_doc", "_sha", F.col("m.i").alias("_i"), "m.x.*")
    rows = rows.groupBy("_doc", "_sha", "rank", "_i").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("ok").alias("ok"), F.count(F.lit(1)).alias("_n"))
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("_doc", "_sha", "rank").orderBy("_i"))
    rows = rows.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("size"))
    upto = Window.partitionBy("_doc", "_sha").orderBy("_start").rangeBetween(Window.unboundedPreceding, 0)
    is_base = F.col("rank").isin([RANK[k] for k in BASE]) & F.col("ok")
    covered = F.coalesce(F.max(F.when(is_base, F.col("_end"))).over(upto) > F.col("_start"), F.lit(False))
    rows = rows.withColumns({"_in": covered, "_scope": F.count_if(F.col("rank") == BREAK).over(upto)})
    rows = rows.withColumns({"_identifier": nearest(IDENTIFIER), "_secret": nearest(SECRET), "_host": nearest(HOST)})
    name = {IDENTIFIER: "_identifier", SECRET: "_secret", HOST: "_host"}
    is_ = lambda k: (F.col("rank") == RANK[k]) & F.col("ok")
    parts, linked = F.array().cast("array<struct<rank:int,s:bigint,e:bigint>>"), F.lit(False)
    for k, needed in NEEDS.items():
        has = F.lit(True)
        for part in needed:
            has &= F.col(name[part]).isNotNull()
        linked |= is_(k) & has & ~F.col("_in")
        parts = F.when(is_(k), F.array(*(F.col(name[part]) for part in needed))).otherwise(parts)
    rows = rows.select("_doc", "_sha", "rank", "_n", "_start", "_end", (is_base | linked).alias("_told"), F.when(linked, parts).alias("_parts"))
    rows = rows.where("_told OR rank = " + str(MARK))
    kind = F.when(F.col("_told"), F.element_at(F.array(*(F.lit(k) for k in KINDS)), F.col("rank") + 1))
    return rows.select("_doc", "_sha", F.col("_n").alias("_copies"), "rank", kind.alias("_kind"), "_start", "_end", "_parts")


def scan(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans and links of each row (see spans).

    spans lists kind:start:end by start, then by kind as listed in KINDS, joined by commas; base_sha256
    is the SHA-256 of the same list of base kinds only. links lists, for each weak span in that order, it and
    the identifier, secret and endpoint that belong to it, joined by `+`. A null text is an empty one and has no span.
    Repeated rows each have a result; other columns are not read; an empty table gives an empty result.
    """
    kinds = F.array(*(F.lit(k) for k in KINDS))
    shown = lambda rank, s, e: F.concat_ws(":", F.element_at(kinds, rank + 1), s, e)
    parts = F.transform("_parts", lambda p: shown(p["rank"], p["s"], p["e"]))
    item = F.struct("_start", "rank", F.concat_ws(":", "_kind", "_start", "_end").alias("s"), F.concat_ws("+", parts).alias("with"))
    base = F.col("rank").between(0, len(BASE) - 1)
    lists = spans(df, doc_id, text).groupBy("_doc", "_sha").agg(
        F.max(F.when(F.col("rank") == MARK, F.col("_copies"))).alias("_copies"),
        *(F.count_if(F.col("_kind") == k).alias(f"n_{k}") for k in BASE),
        F.count_if(F.col("_kind").isNotNull() & ~base).alias("n_linked"),
        F.array_sort(F.collect_list(F.when(F.col("_kind").isNotNull(), item))).alias("_all"),
    )
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda x: x["s"]))
    only_base = F.filter("_all", lambda x: x["rank"] < len(BASE))
    links = F.transform(F.filter("_all", lambda x: x["rank"] >= len(BASE)), lambda x: F.concat_ws("+", x["s"], x["with"]))
    out = lists.select(
        F.col("_doc").alias(doc_id), "n_assign", "n_access", "n_hex", "n_linked", F.sha2(joined(only_base), 256).alias("base_sha256"),
        joined(F.col("_all")).alias("spans"), F.concat_ws(",", links).alias("links"), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"),
    )
    return out.select(doc_id, "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans", "links")


def redact(df: DataFrame, text: str, mark: str = "[secret]") -> DataFrame:
    """df with the matches of strong kinds in `text` replaced by a mark; nulls stay null."""
    out = F.col(text)
    for kind, least in (("access", "AKIA[A-Z0-9]{16,}"), ("hex", KINDS["hex"][0])):
        out = F.regexp_replace(out, least, mark)
    pattern = KINDS["assign"][0].removesuffix("+)") + "{6,})"
    return df.withColumn(text, F.regexp_replace(out, pattern, f"$1={mark}"))


def _sql_kind(kind: str) -> str:
    pattern, group, least = KINDS[kind]
    p = pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', {group})"
    extra = " AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]')" if kind == "bare" else ""
    return f"""
  SELECT doc_id, {RANK[kind]} AS rank, '{kind}' AS kind, e - length(w) AS s, e FROM (
    SELECT doc_id, w, v, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
      SELECT doc_id, unnest(regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]) AS g,
             unnest(regexp_extract_all(t, '{p}')) AS w, unnest({value}) AS v,
             unnest(range(len(regexp_extract_all(t, '{p}')))) AS i
      FROM d WHERE regexp_matches(t, '{p}')))
  WHERE length(v) >= {least}{extra}"""


def _sql_nearest(kinds: tuple[str, ...]) -> str:
    """DuckDB: the nearest span of one of the kinds, as kind:start:end; null if there is none within REACH."""
    own = "rank IN (" + ", ".join(str(RANK[k]) for k in kinds) + ")"
    before = f"max(CASE WHEN {own} THEN {{'a': e, 'b': s, 'k': rank, 'kind': kind}} END) OVER upto"
    after = f"min(CASE WHEN {own} THEN {{'a': s, 'b': e, 'k': rank, 'kind': kind}} END) OVER onward"
    return f"{{'b': {before}, 'a': {after}}}"


def _sql_pick(x: str) -> str:
    back, ahead = (f"CASE WHEN {x}.{p} IS NULL THEN {REACH + 1} ELSE greatest(0, {gap}) END" for p, gap in (("b", f"s - {x}.b.a"), ("a", f"{x}.a.a - e")))
    b, a = (f"{x}.{p}.kind || ':' || {x}.{p}.{q}::BIGINT || ':' || {x}.{p}.{r}::BIGINT" for p, q, r in (("b", "b", "a"), ("a", "a", "b")))
    return f"CASE WHEN {back} <= {ahead} AND {back} <= {REACH} THEN {b} WHEN {ahead} <= {REACH} THEN {a} END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(map(_sql_kind, KINDS))}
), gap AS (
  SELECT doc_id, unnest(string_split_regex(t, '{BLANK}')) AS part, generate_subscripts(string_split_regex(t, '{BLANK}'), 1) AS i,
         unnest(list_append(regexp_extract_all(t, '{BLANK}'), '')) AS sep
  FROM d WHERE regexp_matches(t, '{BLANK}')
), brk AS (
  SELECT doc_id, {BREAK} AS rank, 'break' AS kind, e - length(sep) AS s, e
  FROM (SELECT doc_id, sep, sum(length(part) + length(sep)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM gap) WHERE sep <> ''
), o AS (
  SELECT *, count(*) FILTER (rank = {BREAK}) OVER upto AS scope, coalesce(max(CASE WHEN rank < {len(BASE)} THEN e END) OVER upto > s, false) AS covered
  FROM (SELECT * FROM m UNION ALL SELECT * FROM brk)
  WINDOW upto AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), n AS (
  SELECT *, {_sql_nearest(IDENTIFIER)} AS i, {_sql_nearest(SECRET)} AS c, {_sql_nearest(HOST)} AS h
  FROM o
  WINDOW upto AS (PARTITION BY doc_id, scope ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         onward AS (PARTITION BY doc_id, scope ORDER BY s RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), p AS (
  SELECT doc_id, rank, kind, s, covered, kind || ':' || s::BIGINT || ':' || e::BIGINT AS item,
         {_sql_pick("i")} AS ident, {_sql_pick("c")} AS secret, {_sql_pick("h")} AS host
  FROM n WHERE rank < {BREAK}
), r AS (
  SELECT doc_id, rank, s, item, item || '+' || CASE kind WHEN 'endpoint' THEN ident || '+' || secret WHEN 'login' THEN secret || '+' || host ELSE ident END AS link
  FROM p
  WHERE rank < {len(BASE)} OR NOT covered AND CASE kind WHEN 'endpoint' THEN ident || secret WHEN 'login' THEN secret || host ELSE ident END IS NOT NULL
)
SELECT d.doc_id, count(*) FILTER (item LIKE 'assign:%') AS n_assign, count(*) FILTER (item LIKE 'access:%') AS n_access,
       count(*) FILTER (item LIKE 'hex:%') AS n_hex, count(*) FILTER (rank >= {len(BASE)}) AS n_linked,
       sha256(coalesce(string_agg(item, ',' ORDER BY s, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(item, ',' ORDER BY s, rank), '') AS spans,
       coalesce(string_agg(link, ',' ORDER BY s, rank) FILTER (rank >= {len(BASE)}), '') AS links
FROM d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""
