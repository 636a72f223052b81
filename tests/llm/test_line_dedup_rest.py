"""Lines of a hot band meet though each shares its rarest shingles with lines that are not similar."""

import random

from factspark.llm import line_dedup


def test_rarest_shingles_mislead(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    template, groups = [word() for _ in range(42)], 100
    # Four lines of a group share ten words; five more they share with one line of the next group each.
    own = [[word() for _ in range(10)] for _ in range(groups)]
    decoys = [[word() for _ in range(5)] for _ in range(2 * groups)]
    lines = [" ".join(template + own[g] + decoys[(2 * g + k) % (2 * groups)]) for g in range(groups) for k in range(4)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    rows = line_dedup.line_rows(df)
    of = {x.h: x.doc_id for x in rows.selectExpr("doc_id", "xxhash64(line) AS h").collect()}
    keys = {of[x[0]]: set(x[1:]) for x in line_dedup.signatures(rows).collect()}
    sets = {x.doc_id: set(x.s) for x in df.select("doc_id", line_dedup.grams(df.text).alias("s")).collect()}
    similar = lambda i, k: len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])
    root = {i: i for i in sets}
    links = [(i, k) for i in sets for k in sets if k < i and keys[i] & keys[k] and similar(i, k)]
    assert len(links) > 300 and all(i // 4 == k // 4 for i, k in links)
    for _ in range(4):
        for i, k in links:
            root[i] = root[k] = min(root[i], root[k])
    got = {x.doc_id for x in line_dedup.dedup_lines(df).collect() if x.n_removed}
    assert got == {i for i in sets if root[i] != i}
