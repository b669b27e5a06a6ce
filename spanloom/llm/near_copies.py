"""Links of all texts whose 5-word shingle sets have a Jaccard likeness of at least 0.8.

Candidates come from prefix filtering, which misses no such pair: under one order of all shingles,
rare ones first, two sets this alike share a shingle of their prefixes (the first fifth and one). Sets
that share prefix shingles are gathered into candidate groups, and likeness is computed inside a group
on the whole sets. A group that is too large for one task is dealt into cells that together hold every
candidate pair: its prefix shingles, or pairs of blocks of it, whichever is less to ship. Inside a cell one set
at a time is counted against all others, and sets that are connected with the largest part need no
turn of their own. Sets are sets of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

#: Words in a shingle, hash seed, fifths of the union that two linked sets share.
WORDS, SEED, FIFTHS = 5, 42, 4
#: Shingles and sets of one packed block; buckets of shingles for each shuffle partition, which are solved one by one;
#: the bytes of a hash that are shipped. A hash cut short can only add candidates.
BLOCK_SHINGLES, BLOCK_SETS, BUCKETS, HASH_BYTES = 1 << 18, 1 << 15, 2, 6
#: Shingles that one cell holds; larger groups and cells are dealt into blocks of half as many.
CELL_SHINGLES = 1 << 20
_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 16:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


_WORD_HASHES = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle are one; no words, none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h += w[k : len(w) - size + 1 + k] * _MIX[k]
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    return np.unique(h ^ (h >> np.uint64(29)))


def set_id(shingles: np.ndarray) -> int | None:
    """A digest of a set as a signed integer; None for an empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).astype(np.int64)) if len(shingles) else None


def set_ids(text: Column) -> Column:
    """:func:`set_id` of the shingles of a text column."""

    @F.pandas_udf("long")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([set_id(shingle_set(t)) for t in texts], dtype="Int64")

    return ids(text)


def _short(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return out.reshape(-1).view("<u8")


#: Rows between the steps: a block's sets (bucket below 0), or the part of a block that one bucket of shingles holds.
PACKED = "bucket long, block long, ids binary, counts binary, h binary"
RETURNED = "block long, ids binary, counts binary, places binary, often binary, h binary"


def _packed(buckets: int):
    """mapInPandas over texts: blocks of distinct sets, dealt by shingle.

    A part has the ids of the sets that have shingles in its bucket, how many, and the shingles in the
    order of the sets. The sets of a block with their sizes are a row of their own.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[int, np.ndarray] = {}
        total = 0

        def flush() -> pd.DataFrame:
            ids = np.fromiter(sets, np.int64, len(sets))
            sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
            # The same sets in the same order make the same block, whichever attempt of a task packs them.
            block = int(np.uint64(xxhash.xxh64_intdigest(ids.tobytes(), SEED)).astype(np.int64))
            h = np.concatenate(list(sets.values())) & np.uint64((1 << 8 * HASH_BYTES) - 1)
            place, bucket = np.repeat(np.arange(len(sets)), sizes), (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, h, place = bucket[order], h[order], place[order]
            cut = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            out = [(-1 - block % buckets, block, ids.tobytes(), sizes.astype("<u4").tobytes(), None)]
            for a, b in zip(cut, cut[1:]):
                used, count = np.unique(place[a:b], return_counts=True)
                out.append((int(bucket[a]), block, ids[used].tobytes(), count.astype("<u4").tobytes(), _short(h[a:b])))
            return pd.DataFrame(out, columns=["bucket", "block", "ids", "counts", "h"])

        for batch in batches:
            for text in batch["text"]:
                s = shingle_set(text)
                name = set_id(s)
                if name is not None and name not in sets:
                    sets[name] = s
                    total += len(s)
                if total >= BLOCK_SHINGLES or len(sets) >= BLOCK_SETS:
                    yield flush()
                    sets, total = {}, 0
        if sets:
            yield flush()

    return blocks


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas over parts sorted by bucket: back to each block the shingles that several distinct sets hold, and how many do."""
    bucket, held = None, []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.bucket < 0:
                yield pd.DataFrame([(r.block, r.ids, r.counts, None, None, None)], columns=["block", "ids", "counts", "places", "often", "h"])
                continue
            if r.bucket != bucket:
                if held:
                    yield _shared_of_bucket(held)
                bucket, held = r.bucket, []
            held.append((r.block, np.frombuffer(r.ids, np.int64), np.frombuffer(r.counts, "<u4"), _long(r.h)))
    if held:
        yield _shared_of_bucket(held)


def _shared_of_bucket(held: list[tuple]) -> pd.DataFrame:
    h = np.concatenate([x[3] for x in held])
    name = np.concatenate([np.repeat(x[1], x[2]) for x in held])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    order = order[np.r_[same, False] | np.r_[False, same]]  # shingles that stand once are in no pair
    order = order[np.lexsort((name[order], h[order]))]
    hs, names = h[order], name[order]
    new_h = np.r_[True, hs[1:] != hs[:-1]][: len(hs)]
    fresh = new_h | np.r_[True, names[1:] != names[:-1]][: len(hs)]
    run = np.cumsum(new_h) - 1
    n = np.bincount(run[fresh], minlength=int(run[-1]) + 1 if len(run) else 0)
    often = np.zeros(len(h), np.uint32)
    often[order] = n[run]
    out, at = [], 0
    for block, ids, counts, part in held:
        mine = often[at : at + len(part)]
        at += len(part)
        keep = np.flatnonzero(mine > 1)
        if len(keep):
            place = np.repeat(np.arange(len(ids)), counts)[keep]
            used, place = np.unique(place, return_inverse=True)
            out.append((block, ids[used].tobytes(), None, place.astype("<u2").tobytes(), mine[keep].astype("<u4").tobytes(), _short(part[keep])))
    return pd.DataFrame(out, columns=["block", "ids", "counts", "places", "often", "h"])


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas over returned parts sorted by block, its sets first: (id, size, h) of each shared prefix shingle."""
    block, sizes, parts = None, {}, []

    def solve() -> pd.DataFrame:
        name, often, h = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (list(zip(*parts)) or [[]] * 3))
        order = np.lexsort((h, often, name))
        name, often, h = name[order], often[order], h[order]
        # Partitions that hold the same texts pack the same block.
        fresh = np.r_[True, (name[1:] != name[:-1]) | (h[1:] != h[:-1])][: len(name)]
        name, h = name[fresh], h[fresh]
        known, at, n_shared = np.unique(name, return_inverse=True, return_counts=True)
        size = np.fromiter((sizes[int(x)] for x in known), np.int64, len(known))
        # Unshared shingles come first in the order and need no place: a prefix has what is left of it for shared ones.
        left = n_shared - (FIFTHS * size + 4) // 5 + 1
        rank = np.arange(len(name)) - np.r_[0, np.cumsum(n_shared)][at]
        keep = rank < left[at]
        return pd.DataFrame({"id": name[keep], "size": size[at[keep]], "h": h[keep].view(np.int64)})

    for batch in batches:
        for r in batch.itertuples(index=False):
            if r.block != block:
                if parts:
                    yield solve()
                block, sizes, parts = r.block, {}, []
            ids = np.frombuffer(r.ids, np.int64)
            if r.counts is not None:
                sizes = dict(zip(ids.tolist(), np.frombuffer(r.counts, "<u4").tolist(), strict=True))
            else:
                parts.append((ids[np.frombuffer(r.places, "<u2")], np.frombuffer(r.often, "<u4"), _long(r.h)))
    if parts:
        yield solve()


def group_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect exactly what links between all pairs of likeness 0.8 or more connect.

    A set's turn counts its shingles in all other sets at once. A pair inside one component adds
    nothing, so turns end when all sets that had none are connected; the rarer parts go first.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.r_[0, np.cumsum(np.bincount(shingle))]
    order = np.argsort(shingle, kind="stable")
    holders = np.repeat(np.arange(n), size)[order]
    of_set = np.split(shingle, np.cumsum(size)[:-1])
    label, waiting, links = np.arange(n), np.ones(n, bool), []
    while True:
        most = int(np.bincount(label[waiting], minlength=n).argmax())
        turns = np.flatnonzero(waiting & (label != most))
        if not len(turns):
            return links
        i = int(turns[0])
        waiting[i] = False
        both = np.bincount(np.concatenate([holders[edges[x] : edges[x + 1]] for x in of_set[i]]), minlength=n)
        near = 5 * both >= FIFTHS * (size[i] + size - both)
        near &= label != label[i]
        if near.any():
            found, at = np.unique(label[near], return_index=True)
            links += [(i, int(j)) for j in np.flatnonzero(near)[at]]
            label[np.isin(label, found)] = label[i]


def _cell_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas over rows (root, cell, pair, fp, text) sorted by the first three: links (a, b) of fingerprints."""
    name, prints, sets = None, [], []

    def solve() -> pd.DataFrame:
        found = group_links(sets)
        return pd.DataFrame({"a": [prints[i] for i, _ in found], "b": [prints[j] for _, j in found]}, dtype="int64")

    for batch in batches:
        for r in batch.itertuples(index=False):
            if (r.root, r.cell, r.pair) != name:
                if len(sets) > 1:
                    yield solve()
                name, prints, sets = (r.root, r.cell, r.pair), [], []
            prints.append(int(r.fp))
            sets.append(shingle_set(r.text))
    if len(sets) > 1:
        yield solve()


def _cells(prefix: DataFrame, found: DataFrame, cell_shingles: int) -> DataFrame:
    """(id, root, cell, pair): cells of bounded size that together hold every candidate pair.

    ``prefix`` has the shared prefix shingles (id, size, h), ``found`` the groups (node, root). A small
    group is one cell. A larger one has a cell for each prefix shingle, if that ships fewer rows than
    pairs of its blocks do; cells that are still too large are dealt into pairs of blocks.
    """
    members = prefix.groupBy("id", "size").agg(F.count("*").alias("held"))
    members = common.materialise(members.join(found, F.col("id") == F.col("node")).select("id", "size", "held", "root"), "likeness-members")
    block = max(1, cell_shingles // 2)
    blocks = F.ceil(F.col("total") / block)
    groups = members.groupBy("root").agg(F.sum("size").alias("total"), F.sum("held").alias("held"), F.count("*").alias("n"))
    big = common.materialise(groups.where(F.col("total") > cell_shingles).select("root", (F.col("held") < F.col("n") * blocks).alias("by_shingle")), "likeness-large")
    n_big = big.count()
    whole = members.select("id", "size", "root", F.lit(0).cast("long").alias("cell"))
    if not n_big:
        return whole.select("id", "root", "cell", F.lit(0).cast("long").alias("pair"))
    marked = members.join(common.bounded_broadcast(big.withColumnRenamed("root", "root_"), n_big), F.col("root") == F.col("root_"), "left")
    whole = marked.where(~F.coalesce("by_shingle", F.lit(False))).select(*whole.columns[:3], F.lit(0).cast("long").alias("cell"))
    split = marked.where("by_shingle").select("id", "size", "root").join(prefix.select(F.col("id").alias("id_"), "h"), F.col("id") == F.col("id_"))
    cells = common.materialise(whole.unionByName(split.select("id", "size", "root", F.col("h").alias("cell"))), "likeness-cells")
    large = cells.groupBy("root", "cell").agg(F.sum("size").alias("total")).where(F.col("total") > cell_shingles)
    large = common.materialise(large.select(F.col("root").alias("r"), F.col("cell").alias("c"), blocks.cast("long").alias("blocks")), "likeness-blocks")
    cells = cells.join(common.bounded_broadcast(large, large.count()), (F.col("root") == F.col("r")) & (F.col("cell") == F.col("c")), "left")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    return cells.select("id", "root", "cell", F.explode(pairs).alias("pair"))


def likeness_links(texts: DataFrame, prints: DataFrame, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """Links (a, b) among ``prints.fp`` that connect all texts of likeness 0.8 or more.

    ``texts`` has the texts, ``prints`` the rows (fp, set, digest) of the same texts with their
    :func:`set_ids` and a 64-bit digest of the text. Texts with equal sets of shingles count as one set;
    texts without words are in no link.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = texts.select("text").mapInPandas(_packed(n * BUCKETS), PACKED)
    shared = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(_shared, RETURNED)
    back = shared.repartition(n, "block").sortWithinPartitions("block", F.col("counts").isNull())
    prefix = common.materialise(back.mapInPandas(_prefixes, "id long, size long, h long").distinct(), "likeness-prefixes")
    first = prefix.groupBy(F.col("h").alias("k")).agg(F.min("id").alias("b"))
    found = connected(prefix.join(first, F.col("h") == F.col("k")).select(F.col("id").alias("a"), "b"))
    named = prints.where("`set` is not null").groupBy("set").agg(F.min("fp").alias("fp"), F.max("fp").alias("other"), F.min("digest").alias("digest"))
    cells = _cells(prefix, found, cell_shingles)
    cells = cells.join(named, F.col("id") == F.col("set")).select(F.col("digest").alias("key"), "root", "cell", "pair", "fp")
    cells = common.materialise(cells, "likeness-dealt")
    # Only texts that may be in a cell are shuffled, and copies of one meet before that.
    rows = texts.select("text", F.xxhash64("text").alias("digest"))
    rows = rows.where(common.may_be_in(F.col("digest"), common.map_of(cells, "key"))).groupBy("digest").agg(F.min("text").alias("text"))
    rows = rows.join(cells, F.col("digest") == F.col("key")).select("root", "cell", "pair", "fp", "text")
    dealt = rows.repartition(n, "root", "cell", "pair").sortWithinPartitions("root", "cell", "pair")
    between = dealt.mapInPandas(_cell_links, "a long, b long")
    # Equal sets in another order of words may have different fingerprints.
    equal = prints.join(named.where("fp <> other").select(F.col("set").alias("s"), F.col("fp").alias("b")), F.col("set") == F.col("s"))
    return between.unionByName(equal.select(F.col("fp").alias("a"), "b").where("a <> b"))
