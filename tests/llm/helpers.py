"""Awkward tables: nulls in any column, empty and very long texts, ties, repeated rows, and extra
columns whose names are those of the operators' own columns."""

from pyspark.sql import functions as F

CLASHING = ("fp", "bucket", "record", "kept", "keep_id", "score", "predicted", "component_id", "row", "start", "tie", "part",
            "label", "hash", "top", "spans", "by_id", "by_text", "kept_id", "ids", "text_sha256", "held_out", "pos", "h1", "declared",
            "block", "uid", "n", "k1", "texts", "token", "band", "own", "spare", "n_shingles", "vector", "row", "row_group", "at", "parent", "anchor_id",
            "d", "top", "range", "depth", "h", "donor")

LONG = "lorem ipsum dolor " * 20_000


def with_clashes(df):
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING if c not in df.columns})


def documents(spark, rows):
    """rows: (doc_id, text); lang, source and n_chars are null in places."""
    full = [(i, t, None if n % 3 else "en", None if n % 2 else "src", None if n % 4 == 0 or t is None else len(t)) for n, (i, t) in enumerate(rows)]
    return with_clashes(spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3))


AWKWARD = [(1, "Some text, of words."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG), (6, "Some text, of words."), (7, "Some text, of words. "),
           (None, "Some text, of words."), (None, None), (6, "Some text, of words."), (8, "naïve café 漢字 😀 ŉ İ"), (9, "a"), (9, "b"), (10, "x" * 70_000)]
