"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from ._linear import fit_softmax

#: Lengths of the n-grams, in UTF-8 bytes of the lower-cased text.
LENGTHS = (4, 6, 8)
#: An n-gram that occurs at least so often in a text is a feature of its own.
OFTEN = (2, 4)
#: Cells that n-grams are hashed to, and n-grams that the model keeps.
HASH_BITS, FEATURES = 20, 1 << 12
#: Log-count ratio, in size, that the model keeps an n-gram for.
LEAST_RATIO = 1.5
#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 30_000
#: Labelled rows that must have an n-gram for the model to keep it.
LEAST_ROWS = 3
#: Text handled by one round of numpy calls.
CHUNK_BYTES = 1 << 18
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    cells: np.ndarray  # hash cells of the kept n-grams, sorted
    weights: np.ndarray
    bias: float


def _normal(text: str | None) -> bytes:
    """Letters only, lower case, words between single spaces."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "


def _often(cell: np.ndarray, times: int) -> np.ndarray:
    """The cell of "this n-gram occurs at least so often"."""
    return (cell * 0x2545F491 + times * 0x9E3779B1 >> 5) & ((1 << HASH_BITS) - 1)


def _present(texts: list[str | None], known: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row, cell) of distinct n-grams present in some consecutive rows; of ``known`` cells only, if given."""
    flags = kept = None
    if known is not None:
        kept = np.zeros(1 << HASH_BITS, dtype=bool)
        kept[known] = True
        every = np.arange(1 << HASH_BITS)
        flags = kept | np.logical_or.reduce([kept[_often(every, times)] for times in OFTEN])
    begin = 0
    while begin < len(texts):
        parts, size, end = [], 0, begin
        while end < len(texts) and (end == begin or size < CHUNK_BYTES):
            parts.append(_normal(texts[end]))
            size += len(parts[-1])
            end += 1
        joined = b"".join(parts) + bytes(8)
        ends = np.cumsum([len(p) for p in parts])
        eight = np.ndarray((len(joined) - 8,), dtype="<u8", buffer=joined, strides=(1,))
        found = []
        for n in LENGTHS:
            cell = ((eight & np.uint64((1 << (8 * n)) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - HASH_BITS)).astype(np.int32)
            at = np.flatnonzero(flags[cell]) if flags is not None else np.arange(len(cell))
            row = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[row]
            found.append(row[inside].astype(np.int64) << HASH_BITS | cell[at[inside]])
        pairs, count = np.unique(np.concatenate(found), return_counts=True)
        again = [pairs[count >= times] for times in OFTEN]
        pairs = np.unique(np.concatenate([pairs, *[(p >> HASH_BITS << HASH_BITS) | _often(p & ((1 << HASH_BITS) - 1), times) for p, times in zip(again, OFTEN, strict=True)]]))
        if kept is not None:
            pairs = pairs[kept[pairs & ((1 << HASH_BITS) - 1)]]
        yield begin, pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)
        begin = end


def _counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rows of each label that have an n-gram of each cell, and rows of each label."""
    blocks = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((2, 1 << HASH_BITS), dtype=np.int32), np.zeros(2, dtype=np.int64)
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            rows += np.bincount(toxic, minlength=2)
            for begin, row, cell in _present(batch.column(0).to_pylist(), None):
                for y in (0, 1):
                    total[y] += np.bincount(cell[toxic[row + begin] == y], minlength=1 << HASH_BITS).astype(np.int32)
        if rows.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([*range(blocks), -1], pa.int32()), "cells": [*[np.ascontiguousarray(x).tobytes() for x in np.split(total, blocks, axis=1)], rows.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, dtype=np.int64 if block < 0 else np.int32)
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "cells": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    schema = "block int, cells binary"
    total, rows = np.zeros((2, blocks, (1 << HASH_BITS) // blocks), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for r in labelled.select("text", "toxic").mapInArrow(count, schema).repartition(8, "block").mapInArrow(add, schema).collect():  # 8 MB at any size
        if r.block < 0:
            rows += np.frombuffer(r.cells, dtype=np.int64)
        else:
            total[:, r.block] += np.frombuffer(r.cells, dtype=np.int32).reshape(2, -1)
    total = total.reshape(2, -1)
    return total[0], total[1], int(rows[0]), int(rows[1])


def train(labelled: DataFrame, most_rows: int = TRAIN_ROWS, smoothing: float = 0.5, l2: float = 5e-3) -> Model:
    """Fit the classifier on (doc_id, text, toxic).

    At most about ``most_rows`` rows are used, chosen by a hash of doc_id. Each n-gram's
    value, where present, is its log-count ratio log((p + a) / (P + 2a)) -
    log((q + a) / (N + 2a)); the n-grams whose ratio weighs most, by the square root of
    the rows that have them, are kept, and logistic regression is fitted on them. With
    rows of one label only, or none, the score is the smoothed share of that label.
    """
    spark = labelled.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    rows = labelled.filter("toxic is not null").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = rows.count()
    if n > most_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    clean, toxic, n_clean, n_toxic = _counts(rows)
    if not n_clean or not n_toxic:
        share = (n_toxic + 0.5) / (n_clean + n_toxic + 1) if n_clean + n_toxic else 0.25
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    ratio = np.log((toxic + smoothing) / (n_toxic + 2 * smoothing)) - np.log((clean + smoothing) / (n_clean + 2 * smoothing))
    weight = np.where((toxic + clean >= LEAST_ROWS) & (np.abs(ratio) >= LEAST_RATIO), np.abs(ratio) * np.sqrt(toxic + clean), 0)
    cells = np.sort(np.argsort(-weight, kind="stable")[:FEATURES])
    cells = cells[weight[cells] > 0]

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sparse: list[bytes] = [b""] * batch.num_rows
            for begin, row, cell in _present(batch.column(0).to_pylist(), cells):
                ends = np.searchsorted(row, np.arange(row[-1] + 2)) if len(row) else []
                index = np.searchsorted(cells, cell).astype(np.uint16)
                for k in range(len(ends) - 1):
                    sparse[begin + k] = index[ends[k] : ends[k + 1]].tobytes()
            yield pa.RecordBatch.from_pydict({"sparse": pa.array(sparse, pa.binary()), "toxic": batch.column(1)})

    got = rows.select("text", "toxic").mapInArrow(entries, "sparse binary, toxic int").collect()  # bounded by most_rows
    columns = np.concatenate([np.frombuffer(r.sparse, dtype=np.uint16) for r in got]).astype(np.int64)
    at = np.repeat(np.arange(len(got)), [len(r.sparse) // 2 for r in got])
    weights, bias = fit_softmax(at, columns, ratio[cells][columns], np.array([r.toxic for r in got]), len(cells), 2, l2)
    return Model(cells, (weights[:, 1] - weights[:, 0]) * ratio[cells], float(bias[1] - bias[0]))


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    """Probability of label 1 of each text."""
    out = np.full(len(texts), model.bias)
    if len(model.cells):
        for begin, row, cell in _present(texts, model.cells):
            out[begin : begin + (row.max() + 1 if len(row) else 0)] += np.bincount(row, weights=model.weights[np.searchsorted(model.cells, cell)])
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def with_score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score of every whole text; null and blank texts get the model's base score.

    A column of that name is replaced. The score depends on the text only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(texts, model))], names=[*batch.schema.names, column])

    docs = docs.drop(column)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Whether labels of this document are kept for measuring: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled documents that are not held out; of an id's labels the largest counts, of its texts each.

    At most about ``most_rows`` labels, chosen by a hash of doc_id, are joined with the
    texts, so their broadcast has a fixed bound, and the joined rows are written once.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if n > most_rows:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    return train(materialize(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id"), "labelled"), 2 * most_rows)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
