"""Lines of a hot band find their near copies, and no other lines."""

import random

import test_line_dedup
from factspark.llm import line_dedup


def test_hot_bands(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    template = [word() for _ in range(45)]
    lines = []
    for _ in range(400):
        own = [word() for _ in range(15)]
        other = own[:]
        for k in r.sample(range(15), 4):
            other[k] = word()
        lines += [" ".join(template + own), " ".join(template + other)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    rows = line_dedup.line_rows(df)
    of = {x.h: x.doc_id for x in rows.selectExpr("doc_id", "xxhash64(line) AS h").collect()}
    keys = {of[x[0]]: set(x[1:]) for x in line_dedup.signatures(rows).collect()}
    sets = {x.doc_id: set(x.s) for x in df.select("doc_id", line_dedup.grams(df.text).alias("s")).collect()}
    bands = {}
    for i, ks in keys.items():
        for k in ks:
            bands.setdefault(k, []).append(i)
    assert max(map(len, bands.values())) > 256
    links = {(a, b) for m in bands.values() for a in m for b in m if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(links) > 200
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.doc_id for x in line_dedup.dedup_lines(df).collect() if x.n_removed}
    assert got >= {i for i in sets if find(i) != i}
    # Nothing but lines that are similar to an earlier one, over all pairs.
    assert all(any(len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k]) for k in range(len(lines)) if k != i) for i in got)


def test_repeats_leave_the_signature_whole(spark):
    """A line that is mostly one repeated shingle has bands that differ, and meets its near copies."""
    tail = " ".join(str(k * k) for k in range(40))
    lines = [c * 3000 + tail for c in "abcdefgh"]
    rows = line_dedup.line_rows(spark.createDataFrame([(k, t + end) for k, t in enumerate(lines) for end in ("", "!")], "doc_id long, text string"))
    signed = line_dedup.signatures(rows).collect()
    assert len(signed) == 16 and all(len(set(x[1:])) == len(line_dedup.BANDS) for x in signed)
    got = line_dedup.dedup_lines(spark.createDataFrame([(k, t + end) for k, t in enumerate(lines) for end in ("", "!")], "doc_id long, text string")).collect()
    assert sum(x.n_removed for x in got) >= 8


def test_one_letter_more(spark):
    """Runs without spaces, one letter inserted: nearly all are similar by full shingles."""
    r = random.Random(3)
    letters = "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03\u516b\u4e5d\u5341abcdefgh"
    docs = []
    for i in range(200):
        run = "".join(r.choice(letters) for _ in range(100))
        k = r.randrange(100)
        docs += [(2 * i, run), (2 * i + 1, run[:k] + r.choice(letters) + run[k:])]
    similar = sum(len(test_line_dedup.shingle_set(a) & test_line_dedup.shingle_set(b)) >= 0.8 * len(test_line_dedup.shingle_set(a) | test_line_dedup.shingle_set(b)) for (_, a), (_, b) in zip(docs[::2], docs[1::2]))
    assert similar == 200
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(x.n_removed for x in got) >= 0.97 * similar


def test_recall_on_the_tables(spark):
    """Links found against all pairs of full shingle sets, over the lines of a test table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = {x.line for x in line_dedup.line_rows(docs).select("line").distinct().collect()}
    sets = {x: test_line_dedup.shingle_set(x) for x in lines}
    # All pairs that share a shingle at all, counted by an inverted index over sorted sizes.
    where = {}
    for t, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(t)
    shared = {}
    for t, s in sets.items():
        count = {}
        for g in s:
            for o in where[g]:
                if o < t:
                    count[o] = count.get(o, 0) + 1
        for o, n in count.items():
            if n >= 0.8 * (len(s) + len(sets[o]) - n):
                shared[o, t] = n
    rows = spark.createDataFrame([(t,) for t in sets], "line string").selectExpr("line", "xxhash64(line) AS h")
    of = {x.line: x.h for x in rows.collect()}
    keys = {x[0]: set(enumerate(x[1:])) for x in line_dedup.signatures(rows).collect()}
    met = sum(bool(keys[of[a]] & keys[of[b]]) for a, b in shared)
    assert len(shared) > 100 and met >= 0.97 * len(shared)
