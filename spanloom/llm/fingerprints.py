"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Only DataFrame functions. Every 5-word shingle is hashed once; its highest bits name a bin and each
bin keeps its least hash. After one sort of a text's hashes bins are contiguous, so their minima are
the elements whose bin differs from the element before. An empty bin borrows from the first
non-empty bin of its own fixed pseudo-random sequence. The fingerprint keeps the low 8 bits of each
bin; chance agreement of those bits is taken out of the likeness.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words in a shingle, bins of a fingerprint (a power of two), bits kept of each bin.
SHINGLE, BINS, BITS = 5, 256, 8
#: Tries of an empty bin that are written out; the whole sequence stands behind them.
TRIES = 8
#: Rows that a range of doc_ids is meant to hold; the most ranges of each of two levels, and the most parts of one doc_id.
RANGE_ROWS, MAX_LIMITS, MAX_PARTS = 1000, 256, 65_536
RANGE = ("__r1", "__r2", "__r3")


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space ones; an empty array for none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(common.SPACE_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, common.SPACE + "+"))


def _probe_table(bins: int) -> list[list[int]]:
    """For each bin a pseudo-random order of all bins: steps of an odd stride from a random start."""
    out = []
    for j in range(bins):
        seed = hashlib.sha256(f"bin {j}".encode()).digest()
        start, stride = int.from_bytes(seed[:4], "big"), int.from_bytes(seed[4:8], "big") | 1
        out.append([(start + t * stride) % bins for t in range(bins)])
    return out


def _literal(rows: list[list[int]]) -> Column:
    return F.from_json(F.lit(str(rows)), "array<array<int>>")


def with_signature(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, bins: int = BINS) -> DataFrame:
    """``df`` plus ``out``: a byte for each bin, null for a text without words.

    Fewer words than a shingle make one shingle of all.
    """
    shift = 64 - (bins - 1).bit_length()
    w, h, mins, at, pos = (f"__{out}_{k}" for k in ("words", "hashes", "mins", "bins", "places"))
    df = df.withColumn(w, words(F.col(text)))
    n = F.size(w)
    tuples = F.transform(
        F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)])
    )
    df = df.withColumn(h, F.when(n > 0, F.sort_array(tuples))).drop(w)
    top = lambda x: F.shiftrightunsigned(x, shift).cast("int")
    df = df.withColumn(mins, F.filter(h, lambda x, i: (i == 0) | (top(x) != top(F.get(h, i - 1))))).drop(h)
    df = df.withColumn(at, F.transform(mins, top))
    df = df.withColumn(pos, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.array_position(at, j).cast("int")))
    probes = _probe_table(bins)
    first, every = _literal([p[:TRIES] for p in probes]), _literal(probes)

    def fill(p: Column, j: Column) -> Column:
        one = F.element_at(first, j + 1)
        tried = [F.nullif(F.get(pos, F.get(one, F.lit(t))), F.lit(0)) for t in range(TRIES)]
        rest = F.array_position(at, F.get(F.array_intersect(F.element_at(every, j + 1), F.col(at)), F.lit(0))).cast("int")
        return F.coalesce(F.nullif(p, F.lit(0)), *tried, rest)

    low = lambda p: (F.element_at(mins, p).bitwiseAND((1 << BITS) - 1) - (1 << (BITS - 1))).cast("tinyint")
    filled = F.transform(F.transform(pos, fill), low)
    return df.withColumn(out, F.when(F.size(mins) > 0, filled)).drop(mins, at, pos)


def packed(signature: Column) -> Column:
    """Two lowercase hex digits a bin; an empty string for a text without words."""
    digits = F.split(F.lit(" ".join(f"{v:02x}" for v in range(1 << BITS))), " ")
    half = 1 << (BITS - 1)
    return F.coalesce(F.array_join(F.transform(signature, lambda v: F.get(digits, v.cast("int") + half)), ""), F.lit(""))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard likeness of two signatures, from 0 to 1.

    Bins of unlike shingles agree in one of 2**BITS cases; that share is subtracted. Two texts
    without words are alike, one with and one without are not.
    """
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / float(bins)
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (agree - chance) / (1.0 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(corrected)


def _shares(n: int) -> Column:
    return F.array(*[F.lit(k / n) for k in range(n)])


def _lows(limits: Column) -> Column:
    """Distinct lower limits of ranges; a limit that percentiles repeat is a common id, which gets a range of its own."""
    repeated = F.filter(limits, lambda v, i: (i > 0) & (v == F.get(limits, i - 1)) & (v < F.lit(2**63 - 1)))
    return F.sort_array(F.array_distinct(F.concat(limits, F.transform(repeated, lambda v: v + 1))))


def _place(lows: Column) -> Column:
    """The number of the range that holds doc_id, from 1; 0 for a null one."""
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(F.lit(1), F.size(F.filter(lows, lambda b: b <= F.col("doc_id"))))).cast("int")


def _ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) plus ``__hash`` of the text and the columns RANGE, whose order is that of doc_id, then hash.

    Percentiles split the ids into ranges, and percentiles inside each range split it again. A range
    with a single id that too many rows share, null included, is split by the hash. The tables of
    limits have at most one row for each range of a level.
    """
    docs = docs.withColumn("__hash", F.xxhash64("text"))
    n = docs.count()
    first = max(1, min(MAX_LIMITS, n // RANGE_ROWS))
    second = max(1, min(MAX_LIMITS, -(-n // (first * RANGE_ROWS))))
    found = docs.agg(_lows(F.percentile_approx("doc_id", _shares(first), F.lit(40 * first))).alias("lows")).first()["lows"]
    docs = docs.withColumn("__r1", _place(F.lit(found or [0]).cast("array<bigint>")))
    inner = docs.groupBy(F.col("__r1").alias("k1")).agg(_lows(F.percentile_approx("doc_id", _shares(second), F.lit(40 * second))).alias("__lows"))
    inner = common.materialise(inner, "fingerprint-limits")
    docs = docs.join(F.broadcast(inner), F.col("__r1") == F.col("k1")).withColumn("__r2", _place(F.col("__lows"))).drop("k1", "__lows")
    counts = docs.groupBy(F.col("__r1").alias("k1"), F.col("__r2").alias("k2")).agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    )
    parts = F.least(F.lit(MAX_PARTS), F.ceil(F.col("n") / RANGE_ROWS)).cast("long").alias("__parts")
    common_ids = counts.where(F.col("low").eqNullSafe(F.col("high")) & (F.col("n") > RANGE_ROWS)).select("k1", "k2", parts)
    common_ids = common.materialise(common_ids, "fingerprint-common-ids")
    docs = docs.join(F.broadcast(common_ids), (F.col("__r1") == F.col("k1")) & (F.col("__r2") == F.col("k2")), "left")
    # The upper 32 bits of the hash as a number from 0, in the order of the signed hash.
    upper = F.shiftright("__hash", 32) + F.lit(1 << 31)
    part = F.shiftright(upper * F.coalesce("__parts", F.lit(1)), 32).cast("int")
    return docs.withColumn("__r3", part).drop("k1", "k2", "__parts")


def _following(tops: DataFrame) -> DataFrame:
    """RANGE with ``into``: the range that precedes each in descending order, whose last row it follows; the first follows the last.

    Windows run inside a range of the first level; one row of each of these, at most MAX_LIMITS and two for each
    common id, is ordered as a whole.
    """
    place = F.struct(*RANGE)
    inside = Window.partitionBy("__r1").orderBy(F.col("__r2").desc(), F.col("__r3").desc())
    tops = tops.select(*RANGE, F.lead(place).over(inside).alias("__after"))
    firsts = tops.groupBy("__r1").agg(F.max(place).alias("__first"))
    down = Window.orderBy(F.col("__r1").desc())
    top = F.max("__first").over(Window.partitionBy())
    firsts = firsts.select(F.col("__r1").alias("k1"), F.coalesce(F.lead("__first").over(down), top).alias("__next"))
    after = F.coalesce("__after", "__next").alias("__after")
    return tops.join(F.broadcast(firsts), F.col("__r1") == F.col("k1")).select(place.alias("into"), after).select("into", "__after.*")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, signature, next_text, next_signature) by descending doc_id; after the last, the first.

    Equal doc_ids are ordered by a hash of the text, then by the text. A window runs inside each range; the first row of
    the range that follows is appended to a range as its last row, so no window spans the table.
    """
    docs = _ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    tops = common.materialise(docs.groupBy(*RANGE).agg(F.max(F.struct("doc_id", "__hash")).alias("top")), "fingerprint-tops")
    n = tops.count()
    same = [F.col(c) == F.col(f"t{c}") for c in RANGE] + [F.col("doc_id").eqNullSafe(F.col("top.doc_id")), F.col("__hash") == F.col("top.__hash")]
    named = tops.select(*[F.col(c).alias(f"t{c}") for c in RANGE], "top")
    heads = docs.join(common.bounded_broadcast(named, n), reduce(lambda a, b: a & b, same)).groupBy(*RANGE).agg(F.max("text").alias("text"))
    ends = heads.join(_following(tops), list(RANGE)).select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(0).cast("bigint").alias("__hash"), "into.*")
    every = docs.withColumn("__end", F.lit(False)).unionByName(ends.withColumn("__end", F.lit(True)))
    every = with_signature(every, "text", "signature")
    order = Window.partitionBy(*RANGE).orderBy("__end", F.col("doc_id").desc_nulls_last(), F.col("__hash").desc(), F.col("text").desc())
    every = every.withColumn("next_text", F.lead("text").over(order)).withColumn("next_signature", F.lead("signature").over(order))
    return every.where(~F.col("__end")).select("doc_id", "text", "signature", "next_text", "next_signature")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited texts, and their likeness to the edited and the next text.

    Defined cases: a null text is empty; a text without words has the fingerprint ''; a single row is
    its own next; repeated rows repeat, and all but the last of equal rows are followed by their equal;
    a null doc_id comes last; equal doc_ids, null among them, are ordered by a hash of their texts and
    are spread by it; no rows, no result; other columns are not read.
    """
    near = with_next(docs)
    m = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.substring("next_text", F.lit(1), m))
    near = with_signature(near.withColumn("edited", edited), "edited", "edited_signature")
    return near.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("signature")).alias("fingerprint"),
        packed(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`fingerprint_documents` over all documents."""
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))
