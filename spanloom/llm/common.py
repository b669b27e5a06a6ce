"""Helpers that the operators of this subpackage share: inputs, shared storage and size checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table  # noqa: F401  the operators' queries read their tables by it

#: Used only where a local session names no shared folder, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/spanloom"
#: Rows of one Arrow batch, so that a batch of long texts stays small.
ARROW_ROWS = 256
#: Bits of the map that tells which rows may have a key of another table.
MAP_BITS = 1 << 24
#: A table is broadcast only if it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 20_000
#: The white space of all word and line rules here, as a Java/RE2 character class and as characters.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one for local runs.

    A cluster's executors don't share a machine's folders, so there the setting must be made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
    return (folder or LOCAL_SHARED).rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it new among the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends in files any executor can read."""
    path = f"{shared_dir(df.sparkSession)}/spanloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a materialised frame that no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def map_of(keys: DataFrame, key: str) -> bytes:
    """A map of ``MAP_BITS`` bits of 64-bit keys; so much reaches the driver, however many keys there are."""
    place = F.col(key).bitwiseAND(MAP_BITS - 1)
    per_row = 1 << 15
    rows = keys.groupBy((place / per_row).cast("int").alias("row")).agg(F.bitmap_construct_agg(place % per_row).alias("bits")).collect()
    out = bytearray(MAP_BITS // 8)
    for r in rows:
        out[r["row"] * per_row // 8 : (r["row"] + 1) * per_row // 8] = r["bits"]
    return bytes(out)


def may_be_in(key: Column, bits: bytes) -> Column:
    """Whether a key's bit is set in a map: false only for keys that are not in it. A full map only lets more through."""

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.frombuffer(bits, np.uint8)
        for keys in batches:
            place = keys.to_numpy(np.int64) & (MAP_BITS - 1)
            yield pd.Series((table[place >> 3] >> (place & 7) & 1).astype(bool))

    return test(key)


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few; beyond that the plan shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows of ``df``, chosen by a hash of the keys; all of them if there are no more.

    The share is set by a count and tested row by row, so no task and no driver gathers candidates.
    Four standard deviations above ``rows`` are allowed for.
    """
    n = df.count()
    if n <= rows:
        return df
    place = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys], F.lit("sample")), F.lit(1 << 30))
    return df.where(place < F.lit(int(rows / n * (1 << 30))))
