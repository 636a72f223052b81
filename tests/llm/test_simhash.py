"""Fingerprints and groups against brute force."""

import random

import numpy as np
import xxhash

from factspark.llm import simhash
from factspark.llm._graph import components


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = low.split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if bin(a ^ b).count("1") <= radius:
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i, _ in prints}


def test_groups(spark):
    r = random.Random(5)
    words = [f"W{k}é" for k in range(40)]
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two")]
    for i in range(10, 200):
        if i % 4 and i > 20:
            base = docs[r.randrange(6, len(docs))][1].split(" ")
            base[r.randrange(len(base))] = r.choice(words)
            docs.append((i, " ".join(base)))
        else:
            docs.append((i, " ".join(r.choice(words) for _ in range(r.randrange(5, 200)))))
    prints = [(i, brute_print(t)) for i, t in docs]
    want = brute_groups(prints)
    assert len(set(want.values())) < len(docs)
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, node int, fp int").repartition(5)
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in simhash.near_groups(df).collect()}
    assert got == {i: (p, want[i]) for i, p in prints}


def test_tiles_and_blocks(spark):
    """One big cloud of near prints, more than a tile, and a chain."""
    r = random.Random(7)
    base = r.getrandbits(64)
    prints = {base}
    while len(prints) < 400:
        prints.add(base ^ (1 << r.randrange(12)) ^ (1 << r.randrange(64)))
    chain = r.getrandbits(64)
    for k in range(0, 60, 3):
        prints.add(chain)
        chain ^= 7 << k
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "fp long, node long")
    for tile in (32, 4096):
        found = {x.node: x.root for x in components(simhash.near_links(df, 3, tile=tile)).collect()}
        want = brute_groups([(i, p) for i, p in enumerate(sorted(prints))])
        assert {i: found.get(i, i) for i in want} == want


def test_lanes():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 8, dtype=np.uint64)
    prints = base[r.integers(0, 8, 500)] ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 500).astype(np.uint64))
    group = np.sort(r.integers(0, 5, 500))
    for radius in (0, 1, 2, 3, 5):
        got = {(int(a), int(b)) for i, j in simhash.near_lanes(prints, group, radius, list(range(64))) for a, b in zip(i, j)}
        want = {(a, b) for a in range(500) for b in range(a + 1, 500) if group[a] == group[b] and bin(int(prints[a] ^ prints[b])).count("1") <= radius}
        assert got == want


def test_edges(spark):
    schema = "doc_id long, text string"
    assert simhash.near_groups(spark.createDataFrame([], schema)).collect() == []
    rows = simhash.near_groups(spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "zz"), (9, "q w"), (9, "a b c d")], schema)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in rows if r.component_id) == [("7", 7), ("7", 7), ("9", 7), ("9", 7), ("None", 7)]
    kept = simhash.keep_one_of_each(spark.createDataFrame([(3, "x y z"), (1, "x y z"), (None, "x y z")], schema))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1"]
    again = [(5, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 3), (8, "a b c d", 4), (None, "a b c d", 5), (None, "alone here now", 6), (None, "alone here now", 7), (9, "other words are here", 8)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(again, "doc_id long, text string, row int")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "a b c d"), ("9", "other words are here"), ("None", "alone here now")]
