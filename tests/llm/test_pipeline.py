"""Each stage of the pipeline on all that the one before kept, against brute force."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_line_dedup import brute as brute_lines  # noqa: E402
from test_simhash import brute_groups, brute_print  # noqa: E402

from factspark.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def contaminated(text, items, width=13):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)) if w]
    hit = set()
    for item in items:
        own = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item)) if w]
        n = min(width, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = toxicity.train_on_labels(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(corpus_pipeline.materialize(stage(spark, steps[-1], SF), "test"))
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    assert all(s.columns == columns for s in steps[:-1])
    assert set(rows[1]) == {i for i, r in rows[0].items() if toxicity.scores([r.text], model)[0] < 0.5}
    kept, _, _ = brute_lines([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == set(kept) and sum(rows[2][i].text != t for i, t in kept.items()) <= 0.02 * len(kept)
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    groups = brute_groups(sorted((i, brute_print(r.text)) for i, r in rows[2].items()))
    assert set(rows[3]) == {i for i, g in groups.items() if i == g}
    assert set(rows[4]) == {i for i, r in rows[3].items() if not contaminated(r.text, items)}
    assert set(rows[5]) == set(rows[4])
    size = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows[4].values())
    taken = sum(r.taken for r in rows[5].values())
    assert abs(taken - 1.5 * size) <= 20 + 0.001 * size
    assert all(0 <= r.taken <= 2 * r.size for r in rows[5].values())
    assert sorted(r.taken for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.taken for r in rows[5].values())
