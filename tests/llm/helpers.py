"""Small document tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = DOCS + ", _fp long, shard int, _pid int, slot string, _text string"


def awkward():
    long_text = " ".join(f"word{i % 97} x{i}" for i in range(9000))
    rows = [
        (3, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
        (1, None, "en", "a", None),
        (2, "", None, "b", 0),
        (2, "", None, "b", 0),
        (7, "   \n\t ", "fr", None, 6),
        (None, "the quick brown fox jumps over the lazy dog", "en", "a", 1),
        (5, "É à 日本語 🤷🏽 <|endoftext|> a\x00b", "fr", "c", 3),
        (6, long_text, "en", "a", 3),
        (8, long_text + " tail", "en", "a", 3),
        (9, "one two", "en", "c", 3),
        (10, "one two", "en", "c", 3),
    ]
    return rows


def frame(spark, rows=None, clash=False):
    rows = awkward() if rows is None else rows
    if clash:
        return spark.createDataFrame([(*r, 1, 2, 3, "s", "t") for r in rows], CLASH)
    return spark.createDataFrame(rows, DOCS)
