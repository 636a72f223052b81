"""Which pairs of a band's lines are compared, and by which way they meet."""

import random

from factspark import storage
from factspark.llm import line_dedup


def decoys(groups, seed=11):
    """Four lines of a group are similar; each shares its rarest words with one line of the next group, which is not."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    template = [word() for _ in range(42)]
    own = [[word() for _ in range(10)] for _ in range(groups)]
    shared = [[word() for _ in range(5)] for _ in range(2 * groups)]
    return [" ".join(template + own[g] + shared[(2 * g + k) % (2 * groups)]) for g in range(groups) for k in range(4)]


def run(spark, monkeypatch, lines):
    """Lines that go, lines that similar pairs of a band let go, similar pairs by hash, and the rows of each table."""
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    tables = {}

    def kept(frame, label, *rest, **named):
        out = storage.materialize(frame, label, *rest, **named)
        tables.setdefault(label, []).extend(out.select("a", "b").collect() if label == "met" else [None] * out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", kept)
    gone = {x.doc_id for x in line_dedup.dedup_lines(df).collect() if x.n_removed}
    rows = line_dedup.line_rows(df)
    of = {x.h: x.doc_id for x in rows.selectExpr("doc_id", "xxhash64(line) AS h").collect()}
    keys = {of[x[0]]: set(x[1:]) for x in line_dedup.signatures(rows).collect()}
    sets = {x.doc_id: set(x.s) for x in df.select("doc_id", line_dedup.grams(df.text).alias("s")).collect()}
    links = {(i, k) for i in sets for k in sets if k < i and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])}
    root = {i: i for i in sets}
    for _ in range(4):
        for i, k in sorted(links):
            if keys[i] & keys[k]:
                root[i] = root[k] = min(root[i], root[k])
    met = {tuple(sorted((of[a], of[b]), reverse=True)) for a, b in tables.get("met", [])}
    return gone, {i for i in sets if root[i] != i}, met - links, tables


def test_sketches_rule_out_pairs(spark, monkeypatch):
    """In a large band the shared shingles of lines that are not similar bring few of them to a comparison."""
    gone, wanted, unlike, tables = run(spark, monkeypatch, decoys(100))
    assert gone == wanted and len(tables["prefixes"]) > 0
    assert len(unlike) <= 100  # about 200 pairs share their rarest words


def test_small_bands_need_no_prefixes(spark, monkeypatch):
    """All pairs of a small band are decided without a table of shingles."""
    gone, wanted, _, tables = run(spark, monkeypatch, decoys(15))
    assert gone == wanted and len(gone) > 30
    assert len(tables["prefixes"]) == 0


def test_sketch_bounds_the_overlap(spark):
    """No pair of lines that shares enough shingles is ruled out by sketches; long and short lines included."""
    r = random.Random(2)
    lines = ["a", "abcdefgh", "w" * 5000] + decoys(5) + ["".join(r.choice("abcd ") for _ in range(9000))]
    df = spark.createDataFrame(enumerate(lines), "h long, line string")
    sets = {x.h: set(x.s) for x in df.select("h", line_dedup.grams(df.line).alias("s")).collect()}
    rows = {x.h: x for x in line_dedup.sketches(df.withColumn("n", line_dedup.F.size(line_dedup.F.array_distinct(line_dedup.grams(df.line))))).collect()}
    assert set(rows) == set(sets)
    for i, x in rows.items():
        assert x.n == len(sets[i])
        for k, y in rows.items():
            apart = sum(bin((p ^ q) & (2**64 - 1)).count("1") for p, q in zip(x.bits, y.bits))
            assert apart <= len(sets[i] ^ sets[k])
