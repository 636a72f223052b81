"""Scratch tables end with their scope."""

import os

from factspark import storage


def test_scratch(spark):
    rows = spark.range(10)
    with storage.scratch(spark):
        outer = storage.materialize(rows, "outer")
        with storage.scratch(spark):
            inner = storage.materialize(rows, "inner")
            kept = storage.materialize(inner.filter("id > 4"), "kept", lasting=True)
            last = inner.inputFiles()[0]
        assert not os.path.exists(last.removeprefix("file://"))
        assert kept.count() == 5 and outer.count() == 10
        final = storage.materialize(kept, "final", lasting=True)
        last = kept.inputFiles()[0]
    assert not os.path.exists(last.removeprefix("file://")) and final.count() == 5
