import random

import numpy as np
import pytest
import xxhash

from spanloom.llm import simhash_dedup as sd
from tests.llm.helpers import awkward


def brute_simhash(text):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in _words(text)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_groups(prints, budget):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", ["", None, "one", "One two", "a b c d", "É b\x0bC\xa0d " * 9, " \t\r\n"])
def test_fingerprint(text):
    assert sd.simhash(text) == brute_simhash(text)


def test_fingerprint_over_block_edges(monkeypatch):
    monkeypatch.setattr(sd, "_BLOCK", 7)
    text = " ".join(str(random.Random(1).random()) for _ in range(100))
    assert sd.simhash(text) == brute_simhash(text)


def _clustered(seed, n=400):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_local_trie(budget, monkeypatch):
    monkeypatch.setattr(sd, "LEAF", 4)
    prints = _clustered(budget)
    got = sd.trie_groups(np.array(prints, np.uint64), budget)
    assert got.tolist() == brute_groups(prints, budget)


@pytest.mark.parametrize("max_trie", [1 << 16, 8])
def test_groups_on_spark(spark, max_trie):
    prints = _clustered(9, 150)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    links = sd.hamming_links(df, 2, max_trie)
    found = {r["node"]: r["root"] for r in sd.connected(links).collect()}
    want = brute_groups(prints, 2)
    sets, got = {}, {}
    for i, p in enumerate(prints):
        signed = int(np.uint64(p).astype(np.int64))
        sets.setdefault(want[i], set()).add(signed)
        got.setdefault(found.get(signed, signed), set()).add(signed)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, got.values()))


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    prints = [brute_simhash(t) for _, t in rows]
    groups = brute_groups(prints, 2)
    least = {}
    for (d, _), g in zip(rows, groups, strict=True):
        least[g] = min(d, least.get(g, d))
    want = sorted((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, groups, strict=True))
    got = sorted(tuple(r) for r in sd.op7_simhash_dedup(spark, sf).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want


def test_awkward_rows(spark):
    df = awkward(spark)
    out = sd.near_duplicate_groups(df)
    assert out.count() == df.count()
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in out.collect()}
    assert by[(1, 0)] == by[(2, 0)] == by[(4, 0)] == by[(None, 0)] == 1
    kept = sd.one_of_each_group(df)
    assert kept.columns == df.columns and set(map(str, kept.collect())) <= set(map(str, df.collect()))
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 6 not in ids and 1 in ids and 2 not in ids
    assert sd.near_duplicate_groups(df.limit(0)).count() == 0
