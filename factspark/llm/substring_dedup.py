"""Substring dedup over windows of words (super-k-mer partitioning)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _segments as seg


def dedup_words(docs: DataFrame, width: int = 50) -> DataFrame:
    """Remove the words of repeated passages, keeping each passage's first document.

    A window is ``width`` consecutive words (separated by bytes 09-0D and 20) of one
    document. A word goes if some window covers it whose word sequence also starts
    in a document with a smaller doc_id; windows are judged on the input.

    Returns doc_id, n_words, n_removed, spans (word offsets [start, end) that go)
    and kept (the other words, joined by one space), a row for each input row.
    Null and empty texts have no words. Rows without doc_id stay whole. Repeated rows
    count as one document. Columns besides doc_id and text are ignored.
    """
    unit = seg.Unit("word", width, min(16, width))
    seg.small_batches(docs)
    base = seg.with_body(docs)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200).to_pylist()
                out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "kept": []}
                for row in part:
                    words = row["body"].split()
                    gone = seg.covered(row["spans"], width, len(words))
                    keep = words if not row["spans"] else [words[k] for k in np.flatnonzero(~gone)]
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))) if row["spans"] else np.zeros(0, int)
                    out["doc_id"].append(row["doc_id"])
                    out["n_words"].append(len(words))
                    out["n_removed"].append(len(words) - len(keep))
                    out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)])
                    out["kept"].append(b" ".join(keep))
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    return seg.with_spans(base, unit).mapInArrow(finish, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
