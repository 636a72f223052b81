"""Substring dedup over bytes (a sparse suffix array in ranges)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _segments as seg


def dedup_bytes(docs: DataFrame, width: int = 50) -> DataFrame:
    """Remove repeated byte strings, keeping each one's first document.

    A byte goes if a ``width``-byte string covers it that also starts in a document
    with a smaller doc_id. Only suffixes that begin at a locally smallest 16-byte
    gram are kept, one for some 18 bytes, each with the bytes around it that its
    windows need: every ``width``-byte string holds such a place, at the same offset
    in all copies. Sampled splitters deal the suffixes out by their leading bytes;
    each range is sorted by multikey quicksort, eight bytes a step. Suffixes with
    equal leading bytes never straddle two ranges, so no match crosses a boundary.

    Returns doc_id, n_bytes, n_removed, n_spans, spans (byte offsets [start, end) that
    go) and kept (binary), a row for each input row. A null text is empty. Rows
    without doc_id stay whole. Repeated rows count as one document. Columns besides
    doc_id and text are ignored.
    """
    unit = seg.Unit("byte", width, 16)
    seg.small_batches(docs)
    base = seg.with_body(docs)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept": []}
                for row in batch.slice(begin, 200).to_pylist():
                    body, edge = row["body"], np.zeros(0, int)
                    keep = body
                    if row["spans"]:
                        gone = seg.covered(row["spans"], width, len(body))
                        keep = np.frombuffer(body, dtype=np.uint8)[~gone].tobytes()
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    out["doc_id"].append(row["doc_id"])
                    out["n_bytes"].append(len(body))
                    out["n_removed"].append(len(body) - len(keep))
                    out["n_spans"].append(len(edge) // 2)
                    out["spans"].append([{"start": int(a), "end": int(b)} for a, b in zip(edge[0::2], edge[1::2], strict=True)])
                    out["kept"].append(keep)
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
    return seg.with_spans(base, unit).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
