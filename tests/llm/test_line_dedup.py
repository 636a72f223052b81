"""Fuzzy line dedup against brute force."""

import random

from factspark.llm import line_dedup


def shingle_set(line):
    """Every shingle: 8 UTF-16 units from every character, or the whole of a shorter line."""
    units = line.encode("utf-16-be")
    return {units[k : k + 16] for k in range(0, max(1, len(units) - 15), 2)}


def brute(docs, similarity=0.8):
    """Kept text of each row, comparing all pairs of lines."""
    rows = [(i, p, line.strip(" ").lower()) for i, t in sorted(docs) if t is not None for p, line in enumerate(t.split("\n"))]
    rows = [r for r in rows if r[2]]
    texts = sorted({r[2] for r in rows})
    sets = {t: shingle_set(t) for t in texts}
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for k, a in enumerate(texts):
        for b in texts[:k]:
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                root[find(a)] = find(b)
    seen, gone = set(), set()
    for i, p, t in rows:
        g = find(t)
        if g in seen:
            gone.add((i, p))
        seen.add(g)
    kept = {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}
    return kept, gone, links


def corpus(seed):
    r = random.Random(seed)
    words = ["river", "montaña", "été", "of", "the", "bridge", "under", "stone", "walks", "42", "日本語", "zeitung"]
    base = [" ".join(r.choice(words) + r.choice(["", "ly", "ness"]) for _ in range(r.randrange(8, 40))) for _ in range(25)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 8)):
            line = r.choice(base) if r.random() < 0.5 else " ".join(r.choice(words) + str(r.randrange(99)) for _ in range(r.randrange(1, 30)))
            if r.random() < 0.4:
                parts = line.split(" ")
                parts[r.randrange(len(parts))] = r.choice(words)
                line = " ".join(parts)
            lines.append(r.choice(["", " "]) + (line.upper() if r.random() < 0.1 else line))
        docs.append((i, "\n".join(lines + [""] * r.randrange(2))))
    return docs + [(100, None), (101, ""), (102, "\n\n"), (103, "x"), (104, "X \ny")]


def test_against_all_pairs(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(i, t, 9, "k", 1, 2) for i, t in docs], "doc_id long, text string, n_lines int, h string, gone int, row int").repartition(5)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    kept, gone, links = brute(docs)
    assert links > 30
    missed = sum(got[i].text != t for i, t in kept.items())
    assert missed <= 0.05 * len(docs)
    assert abs(sum(r.n_removed for r in got.values()) - len(gone)) <= 0.03 * len(gone)
    for i, t in docs:
        assert got[i].n_lines == (0 if t is None else t.count("\n") + 1) and got[i].h == "k" and got[i].gone == 1


def test_same_shingles(spark):
    lines = [t for _, t in corpus(2) if t and "\n" not in t] + ["a", "ab cd", "abcdefgh", "abcdefghi", "x" * 50, "日本語日本語日本語", "a  b--c", "1234567890"]
    df = spark.createDataFrame([(t,) for t in lines], "line string")
    for r in df.select("line", line_dedup.grams(df.line).alias("s")).collect():
        assert len(set(r.s)) == len(shingle_set(r.line)) and len(r.s) == max(1, len(r.line) - 7)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).collect() == []
    rows = line_dedup.dedup_lines(spark.createDataFrame([(None, "same line here"), (2, "same line here\nother"), (2, "same line here\nother"), (3, "Other"), (4, "w" * 60_000)], schema)).collect()
    assert sorted((str(r.doc_id), r.text[:20], r.n_removed) for r in rows) == [("2", "same line here\nother", 0), ("2", "same line here\nother", 0), ("3", "", 1), ("4", "w" * 20, 0), ("None", "", 1)]
