"""File sources: documents as text, whatever their format, and archives of full texts with summaries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LANGUAGES
from ..functions.text import docx_text, normalise_newlines, strip

#: Suffixes taken from uploads, and their largest size in bytes.
UPLOADS, UPLOAD_BYTES = (".txt", ".md", ".csv", ".pdf", ".docx"), 25 * 1024 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, errors = [], []
        for content, kind in zip(batch["content"], batch["suffix"], strict=True):
            text, error = None, None
            try:
                if kind == ".docx":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        text = z.read("word/document.xml").decode("utf-8", errors="replace")
                elif kind == ".pdf":
                    import pymupdf

                    with pymupdf.open(stream=content, filetype="pdf") as pdf:
                        text = "\n\n".join(page.get_text() for page in pdf)
                else:
                    text = content.decode("utf-8", errors="replace")
            except Exception as e:  # noqa: BLE001  one unreadable file is a row with its error
                error = f"{type(e).__name__}: {e}"
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": batch["path"], "suffix": batch["suffix"], "raw": texts, "error": errors})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the files under a path: plain text, PDF or DOCX by suffix.

    Bytes that are no UTF-8 are replaced; line ends become \\n, then white space at the ends goes,
    before anything counts offsets. PDF needs pymupdf; without it such a file has an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", suffix(F.col("path")).alias("suffix"), "content")
    raw = files.mapInPandas(_decode, "path string, suffix string, raw string, error string")
    text = F.when(F.col("suffix") == ".docx", docx_text(F.col("raw"))).otherwise(F.col("raw"))
    return raw.select("path", strip(normalise_newlines(text)).alias("text"), "error")


def rejected_uploads(files: DataFrame) -> DataFrame:
    """``files`` (path, content, text) plus ``reject_reason`` and ``status``, null where an upload is taken."""
    kind, size = suffix(F.col("path")), F.length("content")
    reason = (
        F.when(~kind.isin(*UPLOADS), "unsupported suffix").when(size > UPLOAD_BYTES, "too large").when(size == 0, "empty")
        .when(F.coalesce(strip(F.col("text")), F.lit("")) == "", "no text")
    )
    status = F.when(reason == "too large", 413).when(reason.isNotNull(), 400)
    return files.withColumn("reject_reason", reason).withColumn("status", status)


# ---------------------------------------------------------------- archives


def archive_name(split: str, lang: str, prefix: str = "corpus") -> str:
    """File name of an archive; a wrong language or split is a ValueError."""
    if lang not in LANGUAGES:
        raise ValueError(f"lang is one of {LANGUAGES}, not {lang!r}")
    names = {"gs": "gs", "ls": "large-scale", "large-scale": "large-scale"}
    if split not in names:
        raise ValueError(f"split is gs or ls, not {split!r}")
    return f"{prefix}_{names[split]}_train_{lang}.zip"


def _opened(path: str):
    """A seekable file of any store that has a file system in pyarrow; a member is read without the rest of its archive."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return system.open_input_file(inner)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The names of an archive's text members, from its directory alone."""
    for batch in batches:
        for path in batch["path"]:
            with _opened(path) as file, zipfile.ZipFile(file) as z:
                names = [i.filename for i in z.infolist() if not i.is_dir() and i.filename.endswith(".txt")]
            for at in range(0, len(names), 10_000):
                part = names[at : at + 10_000]
                yield pd.DataFrame({"archive": [path] * len(part), "member": part})


def _read_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (archive, doc_id, full, short) with the two members' texts; a few pairs are held at a time."""
    for batch in batches:
        for archive, rows in batch.groupby("archive", sort=False):
            with _opened(archive) as file, zipfile.ZipFile(file) as z:
                for at in range(0, len(rows), 64):
                    part = rows.iloc[at : at + 64]
                    body = lambda c: [z.read(name).decode("utf-8", errors="replace") for name in part[c]]  # noqa: B023, E731
                    yield pd.DataFrame({"archive": part["archive"], "doc_id": part["doc_id"], "text": body("full"), "reference": body("short")})


def load_archive(spark: SparkSession, path: str, lang: str = "en", split: str = "gs", limit: int | None = None, prefix: str = "corpus") -> DataFrame:
    """(doc_id, text, reference, lang, meta) of the pairs in zip archives, in the order of their trailing number.

    ``path`` names archives, or a folder that holds the one of the language and split. Members under
    /fulltext/ meet those under /summaries/ (without their _sum) by stem, by names alone; then the
    members of pairs are read, spread over tasks. Pairs with a blank side go before a limit counts; with
    a limit only as many pairs are read, in their order, as it takes to fill it.
    """
    name = archive_name(split, lang, prefix)
    files = path if path.endswith(".zip") else f"{path.rstrip('/')}/{name}"
    members = spark.read.format("binaryFile").load(files).select("path").mapInPandas(_listed, "archive string, member string")
    members = members.withColumn("stem", F.regexp_extract("member", r"([^/]+)\.txt$", 1))
    full = members.where(F.contains("member", F.lit("/fulltext/"))).select("archive", F.col("stem").alias("doc_id"), F.col("member").alias("full"))
    short = members.where(F.contains("member", F.lit("/summaries/"))).select(
        "archive", F.regexp_replace("stem", "_sum$", "").alias("doc_id"), F.col("member").alias("short")
    )
    pairs = full.join(short, ["archive", "doc_id"])
    order = [F.coalesce(F.regexp_extract("doc_id", r"_(\d+)$", 1).try_cast("int"), F.lit(0)), F.col("doc_id"), F.col("archive")]

    def read(some: DataFrame) -> DataFrame:
        bodies = some.select("archive", "doc_id", "full", "short").mapInPandas(_read_pairs, "archive string, doc_id string, text string, reference string")
        return bodies.withColumns({c: strip(F.col(c)) for c in ("text", "reference")}).where("text <> '' and reference <> ''")

    found = read(pairs)
    if limit is not None:
        n, most = pairs.count(), 2 * limit + 16
        while True:
            found = read(pairs.orderBy(*order).limit(most))
            if most >= n or found.count() >= limit:
                break
            most *= 4
    meta = F.create_map(F.lit("split"), F.lit(split), F.lit("source"), F.regexp_extract("archive", "([^/]+)$", 1))
    out = found.withColumn("lang", F.lit(lang)).withColumn("meta", meta).orderBy(*order).select("doc_id", "text", "reference", "lang", "meta")
    return out if limit is None else out.limit(limit)
