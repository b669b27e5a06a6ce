"""CSV sources and sinks, the driver tables, and the dispatcher over corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .files import load_archive


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: quoted line breaks, doubled quotes and a byte-order mark are understood."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1)


def load_dialogues(spark: SparkSession, path: str, split: str = "validation", limit: int | None = None, prefix: str = "dialogue") -> DataFrame:
    """(doc_id, text, reference, lang, meta) of a CSV with ID, dialogue, section_text and section_header.

    Rows with a blank side go first; a limit then takes the smallest IDs, as numbers where they are numbers.
    """
    rows = read_csv(spark, path)
    body = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    meta = F.create_map(F.lit("section_header"), F.coalesce("section_header", F.lit("")), F.lit("split"), F.lit(split))
    out = rows.select(
        F.concat_ws("-", F.lit(prefix), F.lit(split), "ID").alias("doc_id"), body("dialogue").alias("text"), body("section_text").alias("reference"),
        F.lit("en").alias("lang"), meta.alias("meta"), "ID",
    ).where("text <> '' and reference <> ''")
    if limit is not None:
        out = out.orderBy(F.col("ID").try_cast("bigint"), "ID").limit(limit)
    return out.drop("ID")


def positional_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two single-file tables side by side by row number, as ``pos``; their row counts must agree.

    A multi-line CSV file is read by one task, which numbers its rows; this is for files of that size.
    Tables of several files have no row order, so they are an error.
    """
    for df in (left, right):
        if len(df.inputFiles()) > 1:
            raise ValueError("rows of several files have no order to pair them by")
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows do not pair with {m}")
    number = lambda df: df.coalesce(1).withColumn("pos", F.monotonically_increasing_id())
    return number(left).join(number(right), "pos")


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def load_corpus(spark: SparkSession, name: str, path: str, split: str = "auto", lang: str = "en", limit: int | None = None) -> DataFrame:
    """A paired corpus by kind: ``archive`` (zip pairs) or ``dialogues`` (CSV)."""
    if name == "archive":
        return load_archive(spark, path, lang, "gs" if split == "auto" else split, limit)
    if name == "dialogues":
        return load_dialogues(spark, path, "validation" if split == "auto" else split, limit)
    raise ValueError(f"no corpus {name!r}; there are archive and dialogues")


#: A setting of the session: the number of partitions that a driver table is dealt to; unset, it is read where it is.
PARTITIONS = "spanloom.tablePartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.

    A row group is read by one task. A session that reads tables of few row groups on many cores may
    ask for its rows to be dealt out, by the setting ``PARTITIONS``; nothing here looks at their size.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df
