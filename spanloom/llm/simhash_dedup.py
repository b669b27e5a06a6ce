"""SimHash near-dedup: fingerprints, and a binary trie self-join that prunes by the Hamming budget.

All fingerprints within ``budget`` bits of each other agree on at least one of ``budget + 1``
disjoint bit blocks. Each distinct fingerprint goes, once per block, to the trie that holds the
fingerprints with its block value; inside that trie node pairs are traversed together, the differing
bits of the path are accumulated, and a pair is left as soon as the budget is exceeded. A trie
answers with one link per fingerprint to the root of its local group, which keeps every connection
without listing all pairs. Tries that would exceed ``max_trie`` fingerprints are cut along a deeper
prefix into pairs of subtrees (again only pairs within the budget), so no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected
from .near_copies import likeness_links, set_id, shingle_set

#: Fixed values of the contract: words in a shingle, differing bits of a link, hash seed.
SHINGLE, BUDGET, SEED = 3, 2, 42
#: Fingerprints of one local trie before it is cut into subtree pairs.
MAX_TRIE = 1 << 16
#: Subtree pairs of at most so many fingerprints a side are compared by XOR at once.
LEAF = 48
_BLOCK = 1 << 15


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer; a text without words gives 0.

    Shingles are hashed in blocks of bounded size, so a very long text needs little memory.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(shingle, len(ends)) - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, len(last), _BLOCK):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + _BLOCK], last[k : k + _BLOCK])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(last)).tobytes(), "big")


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """:func:`simhash` as a signed 64-bit column."""

    @F.pandas_udf("long")
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return signed(text)


def fingerprints_and_sets(text: Column, shingle: int = SHINGLE) -> Column:
    """A struct of :func:`simhash` (fp) and of the digest of the text's set of shingles (set).

    Both come from one worker: two iterator UDFs side by side keep two for each task, and those live on.
    """

    @F.pandas_udf("fp long, set long")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            fp = np.array([simhash(t, shingle) for t in texts], np.uint64).astype(np.int64)
            yield pd.DataFrame({"fp": fp, "set": pd.array([set_id(shingle_set(t)) for t in texts], dtype="Int64")})

    return both(text)


def trie_groups(prints: np.ndarray, budget: int) -> np.ndarray:
    """For sorted distinct uint64 fingerprints: the index of each one's group representative.

    Two fingerprints share a group if links of at most ``budget`` bits connect them. Node pairs are
    ranges of the sorted array; a pair whose members are in one group already adds nothing.
    """
    parent = np.arange(len(prints))

    def roots(lo: int, hi: int) -> np.ndarray:
        r = parent[lo:hi]
        while True:
            up = parent[r]
            if np.array_equal(up, r):
                parent[lo:hi] = r
                return r
            r = up

    stack = [(0, len(prints), 0, len(prints), 63, 0)]
    while stack:
        a0, a1, b0, b1, bit, err = stack.pop()
        if a0 >= a1 or b0 >= b1 or err > budget:
            continue
        same = a0 == b0 and a1 == b1
        if same and a1 - a0 == 1:
            continue
        if max(a1 - a0, b1 - b0) <= LEAF or bit < 0:
            ra, rb = roots(a0, a1), roots(b0, b1)
            if ra[0] == rb[0] and (ra == ra[0]).all() and (rb == rb[0]).all():
                continue
            near = np.bitwise_count(prints[a0:a1, None] ^ prints[None, b0:b1]) <= budget
            i, j = np.nonzero(near & (ra[:, None] != rb[None, :]))
            for x, y in {(int(ra[p]), int(rb[q])) for p, q in zip(i, j)}:
                while parent[x] != x:
                    x = int(parent[x])
                while parent[y] != y:
                    y = int(parent[y])
                if x != y:
                    parent[max(x, y)] = min(x, y)
            continue
        one = np.uint64(1 << bit)
        am = a0 + int(np.searchsorted(prints[a0:a1] & one, one))
        bm = am if same else b0 + int(np.searchsorted(prints[b0:b1] & one, one))
        stack.append((a0, am, b0, bm, bit - 1, err))
        stack.append((am, a1, bm, b1, bit - 1, err))
        stack.append((a0, am, bm, b1, bit - 1, err + 1))
        if not same:
            stack.append((am, a1, b0, bm, bit - 1, err + 1))
    return roots(0, len(prints))


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(shift, width) of ``budget + 1`` disjoint bit blocks that cover 64 bits."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _local_links(budget: int):
    """mapInPandas over rows sorted by trie: (fp, root) for each fingerprint that a trie links to another."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(block: np.ndarray, value: np.ndarray, sub: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(value) != 0) | (np.diff(sub) != 0)) + 1
            lo, hi = np.r_[0, cut], np.r_[cut, len(fp)]
            out = []
            for a, b in zip(lo[hi - lo > 1], hi[hi - lo > 1]):
                prints = np.unique(fp[a:b].view(np.uint64))
                at = trie_groups(prints, budget)
                far = at != np.arange(len(prints))
                if far.any():
                    out.append(np.stack([prints[far], prints[at[far]]]).view(np.int64))
            rows = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            return pd.DataFrame({"a": rows[0], "b": rows[1]})

        for batch in batches:
            new = tuple(batch[c].to_numpy(np.int64) for c in ("block", "value", "sub", "fp"))
            if not len(new[0]):
                continue
            if held and tuple(x[-1] for x in held[-1][:3]) == tuple(x[-1] for x in new[:3]) == tuple(x[0] for x in new[:3]):
                held.append(new)
                continue
            cols = [np.concatenate(x) for x in zip(*held, new)]
            tail = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = int(tail[-1]) + 1 if len(tail) else 0
            if cut:
                yield solve(*(c[:cut] for c in cols))
            held = [tuple(c[cut:] for c in cols)]
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held)))

    return links


def hamming_links(prints: DataFrame, budget: int = BUDGET, max_trie: int = MAX_TRIE) -> DataFrame:
    """Links (a, b) among the distinct values of ``prints.fp`` that connect all pairs within ``budget`` bits."""
    sides = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("value"))
        for k, (s, w) in enumerate(_blocks(budget))
    ]
    keyed = prints.select("fp", F.explode(F.array(*sides)).alias("s")).select("s.block", "s.value", "fp")
    hot = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > max_trie)
    hot = common.materialise(hot, "hot-tries")
    n_hot = hot.count()
    if n_hot:
        marked = keyed.join(common.bounded_broadcast(hot, n_hot), ["block", "value"], "left")
        rest = F.col("fp")
        for k, (s, w) in enumerate(_blocks(budget)):  # the 16 bits above the block, or from bit 0
            rest = F.when(F.col("block") == k, F.shiftrightunsigned("fp", (s + w) % 64).bitwiseAND(0xFFFF)).otherwise(rest)
        masks = [m for m in range(1 << 16) if m.bit_count() <= budget]
        depth = F.least(F.lit(16), F.ceil(F.log2(F.col("n") / max_trie)) + 2).cast("int")
        low = rest.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), depth) - 1)
        pairs = F.transform(
            F.filter(F.lit(masks), lambda m: m < F.call_function("shiftleft", F.lit(1), depth)),
            lambda m: F.least(low, low.bitwiseXOR(m)) * 65536 + F.greatest(low, low.bitwiseXOR(m)),
        )
        whole = F.array(F.lit(-1).cast("long"))
        keyed = marked.withColumn("sub", F.explode(F.when(F.col("n").isNull(), whole).otherwise(pairs)))
    else:
        keyed = keyed.withColumn("sub", F.lit(-1).cast("long"))
    keyed = keyed.select(F.col("block").cast("long"), "value", "sub", "fp")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "block", "value", "sub").sortWithinPartitions("block", "value", "sub")
    return dealt.mapInPandas(_local_links(budget), "a long, b long")


def near_duplicate_groups(
    docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, max_trie: int = MAX_TRIE, likeness: bool = True
) -> DataFrame:
    """One row (doc_id, fp, component_id) per input row.

    ``component_id`` is the smallest doc_id that links reach: links of at most ``budget`` bits and,
    with ``likeness``, links of texts whose 5-word shingles have a Jaccard likeness of 0.8 or more. Defined
    cases: null and empty texts, and texts of white space, have fingerprint 0 and link like any
    other; fewer words than a shingle are one shingle; rows with equal doc_id keep their own
    fingerprints; a null doc_id gets the smallest doc_id of its group, null if it has none; an empty
    table gives no rows; other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    if likeness:
        prints = docs.select("doc_id", fingerprints_and_sets(F.col("text"), shingle).alias("both"), F.xxhash64("text").alias("digest"))
        prints = prints.select("doc_id", "both.fp", "both.set", "digest")
    else:
        prints = docs.select("doc_id", fingerprints(F.col("text"), shingle).alias("fp"))
    prints = common.materialise(prints, "simhash")
    classes = common.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    links = hamming_links(classes.select("fp"), budget, max_trie)
    if likeness:
        links = links.unionByName(likeness_links(docs.select("text"), prints.select("fp", "set", "digest")))
    found = connected(links)
    joined = common.materialise(found.join(classes, found.node == classes.fp).select("fp", "root", "first"), "simhash-linked")
    smallest = joined.groupBy("root").agg(F.min("first").alias("smallest"))
    members = classes.join(
        joined.select(F.col("fp").alias("__fp"), "root").join(smallest, "root").select("__fp", "smallest"),
        F.col("fp") == F.col("__fp"), "left",
    ).select("fp", F.coalesce("smallest", "first").alias("component_id"))
    # Written, so that both sides of the last join are shuffled for it and a very common fingerprint can be split.
    members = common.materialise(members, "simhash-members")
    return prints.join(members, "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's view of :func:`near_duplicate_groups` over all documents: links by bits alone."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicate_groups(docs, likeness=False).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, max_trie: int = MAX_TRIE) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate group; all columns kept.

    Defined cases as in :func:`near_duplicate_groups`; rows that share the surviving doc_id are one
    document, of which one row stays; rows without a doc_id stay if no row of their group has one.
    """
    groups = near_duplicate_groups(docs, budget, shingle, max_trie)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int")
    ids = common.materialise(groups.groupBy("doc_id").agg(F.sum(stays).alias("n"), F.xxhash64("doc_id").alias("key")), "simhash-ids")
    repeated = ids.agg(F.max("n")).first()[0] or 0
    gone = ids.where("n = 0")
    # The caller's row travels in one column, so that no name of it meets a name from here. Only rows that may go are shuffled.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id").alias("key"))
    rows = rows.withColumn("suspect", common.may_be_in(F.col("key"), common.map_of(gone, "key")))
    left = rows.where("suspect").join(gone.select(F.col("doc_id").alias("id")), F.col("row.doc_id").eqNullSafe(F.col("id")), "left_anti")
    kept = rows.where("not suspect").unionByName(left).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return kept.dropDuplicates(["doc_id"]) if repeated > 1 else kept
