"""Small awkward tables that every operator must take."""

from __future__ import annotations

LONG = "word " * 20_000 + "x" * 50_000


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    line = "This passage is shared by many of the documents here."
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, LONG, "en", None, 1), (4, " \n\t\n ", "en", "b", 5),
        (5, "tie text one two three", "en", "b", 5), (5, "tie text one two three", "en", "b", 5), (6, "tie text one two three", "en", "b", 5),
        (None, "no id at all", "en", "c", 3), (None, None, None, None, None), (7, "é" * 300 + "\n" + "😀 " * 90, "fr", "c", 9),
        *[(10 + k, f"start {k}\n  {line} \n{line.upper()}\nend {k}", "en", "d", 9) for k in range(6)],
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"'clash' as `{name}`" for name in CLASHES])


#: Names that operators use inside, or give to new columns.
CLASHES = (
    "h", "fp", "key", "size", "rank", "words", "signature", "content", "first", "score", "n_lines", "row", "kept", "gone", "gone_id", "s", "id",
    "of", "times", "part", "taken", "start", "end", "k", "text_", "row.doc_id", "__w", "__l", "__h", "__p", "__r", "__c", "__s", "__id", "__source",
    "__size", "__times", "__copy", "__gone", "__gone_id", "__kept", "__n_lines", "__n_dropped", "__base_failed", "__pii", "__toxicity", "__ids",
    "__decoded", "__key", "__hash", "__end", "__range",
)


def same_values(df, out, but=()):
    """Whether ``out`` has every row of ``df`` as often as ``df``, value for value, in all columns but the named ones."""
    columns = [f"`{c}`" for c in df.columns if c not in but]
    count = lambda d: sorted(map(str, d.select(*columns).collect()))
    return count(df) == count(out)


def write_tables(df, labels, folder: str) -> str:
    """A folder that the thin queries can read."""
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return folder


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")
