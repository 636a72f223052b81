"""License notices are found in whole texts, and nothing else is."""

import random

import pytest

from factspark.llm import licenses


@pytest.fixture(scope="module")
def filler():
    r = random.Random(4)
    words = "the river walks under a stone bridge version of public work free license and terms".split()
    return lambda n: " ".join(r.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model(spark, filler):
    rows = [(i, "\n".join(filler(20) for _ in range(5))) for i in range(200)]
    return licenses.train(spark.createDataFrame(rows, "doc_id long, text string"))


def families(model, texts):
    return [sorted({f["family"] for f in found}) for found in licenses.scan_texts(texts, model, 0.5, 0.8)]


def test_templates_in_context(model, filler):
    texts = [filler(30) + "\n" + t + "\n" + filler(30) for _, t in licenses.TEMPLATES]
    assert families(model, texts) == [[f] for f, _ in licenses.TEMPLATES]
    long = "\n".join(filler(30) for _ in range(3000))
    assert families(model, [long + "\nLicensed under CC BY-NC 4.0."]) == [["CC-BY-NC-4.0"]]


def test_wrapped_over_lines(model):
    text = "/* Redistribution and use in source and binary\n * forms, with or without modification, are\n * permitted provided that the following conditions\n * are met */"
    assert families(model, [text]) == [["BSD-3-Clause"]]
    found = licenses.scan_texts([text], model, 0.5, 0.8)[0]
    assert [(f["first_line"], f["last_line"]) for f in found] == [(0, 3)]


def test_nothing_found(model, filler):
    texts = [*licenses.DECOYS, None, "", "\n\n", filler(500), "GNU Apache MIT", "licensed license"]
    assert families(model, texts) == [[]] * len(texts)


def test_frame(spark, model):
    schema = "doc_id long, text string"
    assert licenses.scan(spark.createDataFrame([], schema), model).collect() == []
    rows = licenses.scan(spark.createDataFrame([(None, "Released under the MIT License."), (2, None), (2, "x")], schema), model).collect()
    assert sorted((str(r.doc_id), len(r.licences)) for r in rows) == [("2", 0), ("2", 0), ("None", 1)]
    assert licenses.train(spark.createDataFrame([], schema)).families[0] == licenses.UNKNOWN


def test_whole_table(spark):
    """Against a plain search for the exact notices."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.families for r in licenses.op10_license_scan(spark, "/root/testdata/sf0.01").collect()}
    short = {f: [t for g, t in licenses.TEMPLATES if g == f] for f, _ in licenses.TEMPLATES}
    for r in docs.collect():
        want = sorted(f for f, ts in short.items() if any(line.strip().lower() == t.lower() for line in (r.text or "").split("\n") for t in ts))
        assert set(want) <= set(got[r.doc_id].split(",")) - {""} if want else True, (r.doc_id, want, got[r.doc_id])
        if got[r.doc_id] and not want:
            assert "icen" in r.text, r.doc_id
    assert any(got.values())
