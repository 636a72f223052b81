"""Contamination, phrases and offsets against brute force."""

import random
import re

from factspark.llm import decontaminate

SPLIT = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return [w for w in SPLIT.split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def brute(docs, items, width=13):
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            own = words(item)
            n = min(width, len(own))
            for a in range(len(own) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == own[a : a + n]:
                        hit |= set(range(s, s + n))
                        names.add(str(name))
        out.append((str(i), len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    stock = ["the", "of", "and", "É", "é", "x1", "日本", "Stone", "stone", "river"]
    text = lambda n: " ".join(r.choice(stock) + r.choice(["", "", str(r.randrange(9))]) for _ in range(n))
    items = [(k, text(r.choice([1, 2, 5, 12, 13, 14, 40]))) for k in range(12)] + [(3, text(20)), (50, None), (51, " .,"), (None, text(15))]
    docs = []
    for i in range(60):
        parts = text(r.randrange(60)).split(" ")
        if i % 2:
            own = (r.choice(items)[1] or "").split(" ")
            a = r.randrange(len(own))
            at = r.randrange(len(parts) + 1)
            parts[at:at] = own[a if i % 3 else 0 :]
        docs.append((i, r.choice([" ", "--", "\n"]).join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "!?"), (None, items[6][1]), (None, "nothing"), (7, items[5][1]), (7, "the")], items


def test_contamination(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        d = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id long, text string, item string, pos int").repartition(4)
        b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(x for x in r["items"] if x is not None), r.contaminated) for r in decontaminate.contamination(d, b).collect())
        want = [(i, n, h, tuple(x for x in names if x != "None"), c) for i, n, h, names, c in brute(docs, items)]
        assert got == want
        kept = decontaminate.drop_contaminated(d, b)
        assert kept.columns == d.columns and kept.count() == sum(not x[-1] for x in want)


def test_offsets_and_empty(spark):
    b = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    d = spark.createDataFrame([(1, "x One, two THREE y one two three")], "doc_id long, text string")
    row = decontaminate.contamination(d, b).first()
    assert sorted((o.item_id, o.at) for o in row.offsets) == [("a", 1), ("a", 5)] and row.n_hit == 6
    assert decontaminate.contamination(d.limit(0), b).collect() == []
    assert [r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect()] == [0]


def test_proximity(spark):
    b = spark.createDataFrame([("p", "rare alpha beta"), ("q", "gamma")], "item_id string, text string")
    d = spark.createDataFrame([(1, "rare x alpha y beta"), (2, "alpha beta rare"), (3, "rare a b c d e f alpha beta"), (4, "gamma gamma"), (5, None), (None, "rare alpha beta")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.at) for r in decontaminate.near_phrases(d, b, slop=2).collect())
    assert got == [(1, "p", 0), (4, "q", 0), (4, "q", 1)]
