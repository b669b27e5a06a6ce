import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.llm import near_copies as nc
from spanloom.llm import simhash_dedup as sd


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(sets, also=lambda i, j: False):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a and b and 5 * len(a & b) >= 4 * len(a | b)) or also(i, j):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited(seed, n=160):
    """Texts, copies edited in a few words, copies of copies, texts that share a long passage, short and empty ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    passage = rng.choices(words, k=60)
    texts = [rng.choices(words, k=rng.randint(3, 150)) for _ in range(n // 4)]
    texts += [rng.choices(words, k=rng.randint(5, 80)) + passage for _ in range(n // 8)]
    while len(texts) < n:
        new = list(rng.choice(texts))
        for _ in range(rng.randint(0, 3)):
            new[rng.randrange(len(new))] = rng.choice(words)
        texts.append(new)
    return [" ".join(t) for t in texts] + ["", " \n", "a b", "A  b", "a b c d e a b c d e a b c d e", "b c d e a b c d e a b c d"]


@pytest.mark.parametrize("seed", range(4))
def test_group_links_connect_what_all_pairs_connect(seed):
    texts = [t for t in edited(seed) if t.strip()]
    want = brute_groups([brute_set(t) for t in texts])
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in nc.group_links([nc.shingle_set(t) for t in texts]):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(texts))] == want


def test_groups_against_all_pairs(spark):
    texts = edited(7)
    prints = [sd.simhash(t) for t in texts]
    want = brute_groups([brute_set(t) for t in texts], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= sd.BUDGET)
    bits = brute_groups([set()] * len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= sd.BUDGET)
    assert len(set(want)) < len(set(bits))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in sd.near_duplicate_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in sd.one_of_each_group(docs).collect()) == sorted(set(want))


@pytest.mark.parametrize("cell_shingles", [1, 400, 4000])
def test_groups_dealt_into_cells_lose_no_link(spark, cell_shingles, monkeypatch):
    """However small the cells, what is connected stays the same."""
    texts = edited(11)
    want = brute_groups([brute_set(t) for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = docs.select(F.col("doc_id").alias("fp"), nc.set_ids(F.col("text")).alias("set"), F.xxhash64("text").alias("digest"))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in nc.likeness_links(docs.select("text"), prints, cell_shingles).collect():
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(texts))] == want


def test_a_large_group_of_near_copies_needs_few_turns():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    base, texts = rng.choices(words, k=150), []
    for _ in range(3000):
        new = list(base)
        for _ in range(rng.randint(1, 4)):
            new[rng.randrange(len(new))] = rng.choice(words)
        texts.append(" ".join(new))
    sets = [nc.shingle_set(t) for t in texts]
    began = time.process_time()
    links = nc.group_links(sets)
    assert time.process_time() - began < 20 and len(links) > 2000


def test_equal_partitions_lose_no_link(spark):
    """Partitions of the same texts pack the same block; shared shingles count once all the same."""
    texts = edited(13, 40)
    prints = [sd.simhash(t) for t in texts]
    want = brute_groups([brute_set(t) for t in texts], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 1)
    part = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in sd.near_duplicate_groups(part.union(part).union(part), budget=1).collect()}
    assert [got[i] for i in range(len(texts))] == want
