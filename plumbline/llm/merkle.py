"""Document fingerprints as Merkle trees, with DataFrame functions only.

A text divides at blank lines into sections, a section at line ends into paragraphs and a paragraph
into pieces that end with punctuation or after 64 characters. Nothing is left out, so equal roots
mean equal texts. A piece's digest is the first half of its SHA-256; a paragraph's, a section's and
the root are the SHA-256 of their children's digests. Where two trees differ, only the branches with
different digests need to be looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_ranges, settle, tasks_for

# A piece of a paragraph; the digits of a piece's digest, and of the part of digests that likeness compares.
PIECE = r"[^.!?,;|]{0,64}[.!?,;|]+|[^.!?,;|]{1,64}"
PIECE_DIGITS, SHORT_DIGITS = 32, 10


def pieces(text: Column) -> Column:
    """Digests of a text's pieces: sections of paragraphs of pieces."""
    digest = lambda x: F.substring(F.sha2(x, 256), 1, PIECE_DIGITS)
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), digest)
    section = lambda s: F.transform(F.split(s, "\n"), paragraph)
    return F.transform(F.split(text, "\n\n"), section)


def paragraphs(tree: Column) -> Column:
    """Digests of the paragraphs of pieces(), by section."""
    return F.transform(tree, lambda s: F.transform(s, lambda p: F.sha2(F.concat_ws("", p), 256)))


def sections(paragraphs_: Column) -> Column:
    """Digests of the sections of paragraphs()."""
    return F.transform(paragraphs_, lambda s: F.sha2(F.concat_ws("", s), 256))


def root(sections_: Column) -> Column:
    return F.sha2(F.concat_ws("", sections_), 256)


def branches(tree: Column, paragraphs_: Column, sections_: Column) -> Column:
    """The distinct digests below a tree's root, of sections, paragraphs and pieces: the first 40 bits of each as a number."""
    every = F.concat(sections_, F.flatten(paragraphs_), F.flatten(F.flatten(tree)))
    return F.array_distinct(F.transform(every, lambda x: F.conv(F.substring(x, 1, SHORT_DIGITS), 16, 10).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Share of the branches of two trees that are in both, from 0 to 1.

    Equal sections make equal paragraphs and pieces, so what an edit leaves alone counts in full.
    """
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def edited_branches(a: Column, b: Column) -> Column:
    """Places (section, paragraph; from 0) whose digests differ, for two results of paragraphs().

    Sections with equal digests are not looked into; a place that only one text has counts as differing.
    """
    width = lambda x, y: F.greatest(F.size(x), F.size(y))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def inside(k: Column) -> Column:
        x, y = F.get(a, k), F.get(b, k)
        none = F.array().cast("array<string>")
        x, y = F.coalesce(x, none), F.coalesce(y, none)
        differ = F.filter(upto(width(x, y)), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
        return F.transform(differ, lambda i: F.struct(k.alias("section"), i.alias("paragraph")))

    apart = F.filter(upto(width(a, b)), lambda k: ~F.get(a, k).eqNullSafe(F.get(b, k)))
    return F.flatten(F.transform(apart, inside))


def merkle_trees(df: DataFrame, text: str) -> DataFrame:
    """Add fingerprint (the root), section_digests and paragraph_digests of each text (null: empty)."""
    out = df.withColumn("_tree", pieces(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("paragraph_digests", paragraphs(F.col("_tree"))).withColumn("section_digests", sections(F.col("paragraph_digests")))
    return out.withColumn("fingerprint", root(F.col("section_digests"))).drop("_tree")


def tree_columns(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the paragraphs, root and branches of the tree of a column of text, named after `name`."""
    out = df.withColumn("_tree", pieces(F.col(text))).withColumn(f"{name}_paragraphs", paragraphs(F.col("_tree")))
    out = out.withColumn("_sections", sections(F.col(f"{name}_paragraphs")))
    out = out.withColumn(f"{name}_root", root(F.col("_sections")))
    return out.withColumn(f"{name}_branches", branches(F.col("_tree"), F.col(f"{name}_paragraphs"), F.col("_sections"))).drop("_tree", "_sections")


def neighbours(df: DataFrame, doc_id: str, size: Column) -> DataFrame:
    """_id, _before, _need, _copies: each distinct id with the one before it (before the first: the last) in
    ascending order, nulls first; _need is the largest size of a row of that one, _copies the rows of _id.

    Only ids and sizes are sorted, in ranges; a range's first row looks up the end of the range before.
    """
    ids = df.groupBy(F.col(doc_id).alias("_id")).agg(F.max(size).alias("_size"), F.count(F.lit(1)).alias("_copies"))
    ranged = in_ranges(ids, ["_id"], "ids", tasks_for(df, 1 << 30))
    row = F.struct("_id", "_size")
    own = Window.partitionBy("_pid").orderBy("_id")
    ends = ranged.groupBy("_pid").agg(F.max(row).alias("_end"))
    whole = Window.orderBy("_pid")  # one row for each range
    last = F.last("_end").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = ends.select(F.col("_pid").alias("_range"), F.coalesce(F.lag("_end").over(whole), last).alias("_over"))
    placed = ranged.withColumn("_prior", F.lag(row).over(own)).join(F.broadcast(ends), F.col("_pid") == F.col("_range"))
    prior = F.coalesce("_prior", "_over")
    return placed.select("_id", prior["_id"].alias("_before"), prior["_size"].alias("_need"), "_copies")


def fingerprint_edits(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, how like it they and the next text's are, and where it was edited.

    edited_places lists the paragraphs that differ, as section.paragraph from 0, found by comparing branches
    from the top down; joined by commas.

    The edited text has the last floor(n/4) of n code points replaced by the first as many (or all) of
    the next document by ascending doc_id (nulls first; after the last the first; a lone id follows
    itself). Null texts count as empty. Rows that share an id each have the row with the next greater
    id as next; of several such rows, the one with the least fingerprint. Every row stays; other
    columns are not read. An empty table gives an empty result.

    Texts are shuffled once, by id. Each row sends the document before it no more than the beginning
    that it needs and its own pieces' digests.
    """
    docs = df.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    links = settle(neighbours(docs, "_doc", F.length("_text")), "neighbours")
    sent = docs.join(links, F.col("_doc").eqNullSafe(F.col("_id")))
    sent = tree_columns(sent.select("_before", "_text", F.expr("left(_text, cast(_need div 4 as int))").alias("_head")), "_text", "_its")
    if links.where("_copies > 1").limit(1).count():
        sent = sent.select("_before", F.struct(F.col("_its_root").alias("r"), "_head", F.col("_its_branches").alias("_next")).alias("_row"))
        sent = sent.groupBy("_before").agg(F.min("_row").alias("_row")).select("_before", "_row._head", "_row._next")
    else:
        sent = sent.select("_before", "_head", F.col("_its_branches").alias("_next"))
    both = docs.join(sent, F.col("_doc").eqNullSafe(F.col("_before")))
    cut = "cast(length(_text) div 4 as int)"
    both = both.select("_doc", "_text", F.expr(f"left(_text, length(_text) - {cut}) || left(_head, {cut})").alias("_edit"), "_next")
    both = tree_columns(tree_columns(both, "_text", "_own"), "_edit", "_new")
    places = F.transform(edited_branches(F.col("_own_paragraphs"), F.col("_new_paragraphs")), lambda x: F.concat_ws(".", x["section"], x["paragraph"]))
    return both.select(
        F.col("_doc").alias(doc_id),
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2("_edit", 256).alias("edited_sha256"),
        F.col("_own_root").alias("fingerprint"),
        F.col("_new_root").alias("edited_fingerprint"),
        likeness(F.col("_own_branches"), F.col("_new_branches")).alias("near_edited"),
        likeness(F.col("_own_branches"), F.col("_next")).alias("near_next"),
        F.when(F.col("_own_root") == F.col("_new_root"), "").otherwise(F.concat_ws(",", places)).alias("edited_places"),
    )


def _sql_paragraphs(text: str) -> str:
    """DuckDB: digests of the pieces of a text's paragraphs, by section."""
    digest = f"list_transform(regexp_extract_all(p, '{PIECE}'), lambda x: substr(sha256(x), 1, {PIECE_DIGITS}))"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: {digest}))"


def _sql_tree(x: str) -> str:
    """DuckDB: paragraph digests of pieces, then root and branches, of a column as given by _sql_paragraphs."""
    own = f"list_transform({x}, lambda s: list_transform(s, lambda p: sha256(coalesce(array_to_string(p, ''), ''))))"
    parts = f"list_transform({own}, lambda s: sha256(array_to_string(s, '')))"
    every = f"list_concat({parts}, flatten({own}), flatten(flatten({x})))"
    short = f"list_distinct(list_transform({every}, lambda h: ('0x' || substr(h, 1, {SHORT_DIGITS}))::BIGINT))"
    return f"{{'paragraphs': {own}, 'root': sha256(array_to_string({parts}, '')), 'branches': {short}}}"


def _sql_like(a: str, b: str) -> str:
    return f"2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


_DIFFERENT = "list_filter(range(1, greatest(coalesce(len(a.paragraphs[k]), 0), coalesce(len(b.paragraphs[k]), 0)) + 1), lambda i: a.paragraphs[k][i] IS DISTINCT FROM b.paragraphs[k][i])"
_PLACES = f"flatten(list_transform(range(1, greatest(len(a.paragraphs), len(b.paragraphs)) + 1), lambda k: list_transform({_DIFFERENT}, lambda i: (k - 1) || '.' || (i - 1))))"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nxt
  FROM documents
), e AS (
  SELECT doc_id, t, nxt, left(t, length(t) - length(t) // 4) || left(nxt, length(t) // 4) AS edited FROM d
), x AS (
  SELECT doc_id, t, edited, {_sql_paragraphs("t")} AS x, {_sql_paragraphs("edited")} AS y, {_sql_paragraphs("nxt")} AS z FROM e
), f AS (
  SELECT doc_id, t, edited, {_sql_tree("x")} AS a, {_sql_tree("y")} AS b, {_sql_tree("z")} AS c FROM x
)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, a.root AS fingerprint,
       b.root AS edited_fingerprint, {_sql_like("a.branches", "b.branches")} AS near_edited,
       {_sql_like("a.branches", "c.branches")} AS near_next, coalesce(array_to_string({_PLACES}, ','), '') AS edited_places
FROM f
"""
