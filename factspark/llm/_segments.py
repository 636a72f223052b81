"""Which windows of a document also start in an earlier document.

The common part of word-window and byte-string deduplication:

1. A fixed-size sketch counts all grams. Frequent grams rank last as minimisers,
   so windows that only touch a common passage go to rare, well-spread buckets.
2. Every run of windows with one minimiser is noted by a 48-bit hash. Packed
   arrays of those hashes are dealt out by hash range; hashes met in one document
   only are dropped there, as no window can match without its minimiser.
3. Runs that are left travel as one packed piece of text to their bucket, where
   their windows are sorted and compared exactly.
4. Stretches whose grams are all frequent (the inside of a common passage) are
   first reduced to distinct texts with their smallest document, cut up, compared in
   the same way and joined back, so a passage in a third of all documents is compared
   once.

The result is exact: hashes only choose the bucket. Rows without a doc_id or with
a null text have no windows. Rows that repeat a doc_id count as one document with
several texts, which never remove each other's words.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from . import _windows as win

#: Text handled by one round of numpy calls.
CHUNK_BYTES = 1 << 20
#: Windows compared by one sort in a bucket.
BUCKET_WINDOWS = 1 << 18
#: Bytes of a suffix that range partitioning looks at.
LEAD = 16
#: Sampled leading bytes of each task, and of the corpus.
SAMPLES, MOST_SAMPLES = 256, 1 << 16
#: Ranges (or hash classes) of pieces in a shuffle partition; one is in memory at a time.
DEALS = 4
LOW48 = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class Unit:
    """What a window is made of."""

    kind: str  # "word" or "byte"
    width: int = 50
    gram: int = 16


@dataclass(frozen=True)
class Plan:
    """What the whole corpus tells before its windows are compared."""

    unit: Unit
    hot: np.ndarray
    grams: int
    deals: int
    splitters: list[bytes]


@dataclass
class Chunk:
    """Runs of windows in some consecutive rows."""

    rows: np.ndarray  # row of each run
    first: np.ndarray  # first window of each run, counted within its row
    count: np.ndarray  # windows in each run
    key: np.ndarray  # minimiser of each run
    grams: np.ndarray
    at: np.ndarray  # first window of each run, counted within the chunk
    cut: Callable[[int, int], bytes]  # text of some windows: first (within the chunk) and count
    place: Callable[[int], int]  # where the run's minimiser starts, counted from its first window


def chunks(texts: list[bytes | None], unit: Unit, hot: np.ndarray | None) -> Iterator[Chunk]:
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < CHUNK_BYTES):
            size += len(texts[end] or b"") + 1
            end += 1
        yield _chunk(texts[begin:end], begin, unit, hot)
        begin = end


def _chunk(texts: list[bytes | None], at: int, unit: Unit, hot: np.ndarray | None) -> Chunk:
    joined = b"\n".join(x or b"" for x in texts)
    begins = np.cumsum([0] + [len(x or b"") + 1 for x in texts])
    buffer = np.frombuffer(joined, dtype=np.uint8)
    if unit.kind == "word":
        starts, ends, tokens = win.word_hashes(buffer)
        grams, bounds = win.token_grams(tokens, unit.gram), np.searchsorted(starts, begins)
        limit = bounds[1:]
    else:
        grams, bounds = win.byte_grams(buffer, unit.gram), begins
        limit = begins[1:] - 1
    order = win.rank_grams(grams, hot)
    least = win.sliding_min(order, unit.width - unit.gram + 1)
    first, count = win.runs(least, bounds[:-1])
    row = np.searchsorted(bounds, first, side="right") - 1
    count = np.minimum(count, limit[row] - unit.width + 1 - first) if len(first) else count
    good = count > 0
    first, count, row = first[good], count[good], row[good]

    def cut(a: int, n: int) -> bytes:
        b = a + n + unit.width - 2
        return b" ".join(joined[starts[a] : ends[b]].split()) if unit.kind == "word" else joined[a : b + 1]

    def place(k: int) -> int:
        return int(np.argmin(order[first[k] : first[k] + unit.width - unit.gram + 1]))

    return Chunk(row + at, first - bounds[row], count, least[first] if len(first) else least[:0], grams, first, cut, place)


def _plain(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the cells of each block; of the sampled leading bytes (block -1) keep those with the smallest hashes."""
    sums: dict[int, np.ndarray] = {}
    leads: set[bytes] = set()
    for batch in batches:
        for block, raw in zip(_plain(batch, "block"), _plain(batch, "cells"), strict=True):
            if block < 0:
                leads |= {raw[k : k + LEAD] for k in range(0, len(raw), LEAD)}
                leads = set(sorted(leads, key=lambda x: hashlib.md5(x).digest())[:MOST_SAMPLES]) if len(leads) > 2 * MOST_SAMPLES else leads
            else:
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, dtype=np.int64)
    rows = [(k, v.tobytes()) for k, v in sums.items()] + ([(-1, b"".join(sorted(leads)))] if leads else [])
    yield pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int32()), "cells": pa.array([r[1] for r in rows], pa.binary())})


def sketch(docs: DataFrame, unit: Unit) -> Plan:
    """Which grams are frequent, how many there are, and sampled splitters of the range of leading bytes."""
    cells, blocks = 1 << win.SKETCH_BITS, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, leads = np.zeros(cells, dtype=np.int64), b""
        for batch in batches:
            texts = [x or b"" for x in _plain(batch, "body")]
            for begin in range(0, len(texts), 400):
                joined = b"\n".join(texts[begin : begin + 400])
                buffer = np.frombuffer(joined, dtype=np.uint8)
                grams = win.token_grams(win.word_hashes(buffer)[2], unit.gram) if unit.kind == "word" else win.byte_grams(buffer, unit.gram)
                total += np.bincount((grams & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
                if unit.kind == "byte" and len(leads) < SAMPLES * LEAD:
                    leads += b"".join(joined[k : k + LEAD] for k in range(begin * 7 % 4096, len(grams) - LEAD, 1 << 14))
        if total.any():
            parts = total.reshape(blocks, -1)
            yield pa.RecordBatch.from_pydict({"block": pa.array([*range(blocks), -1], pa.int32()), "cells": pa.array([*[x.tobytes() for x in parts], leads[: SAMPLES * LEAD]], pa.binary())})

    schema = "block int, cells binary"
    summed = docs.select("body").mapInArrow(count, schema).repartition(8, "block").mapInArrow(_add_sketches, schema)
    total, leads = np.zeros((blocks, cells // blocks), dtype=np.int64), []
    for row in summed.collect():  # 2 MB and at most 2 * MOST_SAMPLES leads, at any input size
        if row.block < 0:
            leads = sorted(row.cells[k : k + LEAD] for k in range(0, len(row.cells), LEAD))
        else:
            total[row.block] += np.frombuffer(row.cells, dtype=np.int64)
    total = total.reshape(-1)
    deals = DEALS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    splitters = [bytes(leads[k * len(leads) // deals]) for k in range(1, deals)] if leads else []
    return Plan(unit, total > max(win.HOT_LEAST, win.HOT_FACTOR * total.mean()), int(total.sum()), deals, splitters)


def _pack_docs(ids: np.ndarray, uids: np.ndarray) -> bytes:
    """Document keys in a few bytes each: ids as differences, then uids."""
    raw = np.diff(ids, prepend=0).astype(np.int64).tobytes() + uids.astype(np.int32).tobytes()
    return len(ids).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_docs(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:4], "little")
    raw = pa.decompress(packed[4:], decompressed_size=12 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, dtype=np.int64, count=n)), np.frombuffer(raw, dtype=np.int32, offset=8 * n)


def _is_hot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(62)) > 0


def _pair(row: np.ndarray, low: np.ndarray) -> np.ndarray:
    return win.mix64(low ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shared_minimisers(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, uid, lows): 48-bit hashes of each document's minimisers that other documents have too."""
    unit, hot = plan.unit, plan.hot
    deals = max(64, -(-plan.grams // (1 << 24)))

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            rows, lows = [], []
            for c in chunks(_plain(batch, "body"), unit, hot):
                rare = ~_is_hot(c.key)
                rows.append(c.rows[rare])
                lows.append(c.key[rare] & LOW48)
            row, low = np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(lows or [np.zeros(0, np.uint64)])
            if not len(row):
                continue
            deal = (low % np.uint64(deals)).astype(np.int64)
            sort = np.lexsort((row, deal))
            row, low, deal = row[sort], low[sort], deal[sort]
            edges = np.flatnonzero(np.diff(deal, prepend=-1, append=-1))
            out: dict[str, list] = {"deal": [], "chunk": [], "docs": [], "row": [], "low": [], "high": []}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own, local = np.unique(row[a:b], return_inverse=True)
                out["deal"].append(int(deal[a]))
                out["chunk"].append(int(uids[0]))
                out["docs"].append(_pack_docs(ids[own], uids[own]))
                out["row"].append(local.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes())
                out["low"].append((low[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                out["high"].append((low[a:b] >> np.uint64(32)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=noted)

    noted = pa.schema([("deal", pa.int64()), ("chunk", pa.int64()), ("docs", pa.binary()), ("row", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within one range of hashes, keep those of more than one document."""
        held: list[tuple] = []
        deal = None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            key = np.concatenate([x[3] for x in held])
            doc = np.concatenate([x[1][0][x[2]] for x in held])
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            keep = np.zeros(len(order), dtype=bool)
            keep[order] = np.repeat(many, np.diff(np.append(first, len(key))))
            at, rows = 0, {"chunk": [], "docs": [], "row": [], "lows": []}
            for chunk, docs_, local, low in held:
                mask = keep[at : at + len(low)]
                at += len(low)
                if mask.any():
                    own, again = np.unique(local[mask], return_inverse=True)
                    rows["chunk"].append(chunk)
                    rows["docs"].append(_pack_docs(docs_[0][own], docs_[1][own]))
                    rows["row"].append(again.astype(np.uint32).tobytes())
                    rows["lows"].append(low[mask].astype(np.uint32).tobytes())
            if rows["chunk"]:
                yield pa.RecordBatch.from_pydict(rows, schema=settled)

        for batch in batches:
            for d, chunk, docs_, row, low, high in zip(*(_plain(batch, x) for x in noted.names), strict=True):
                if d != deal:
                    yield from flush()
                    held.clear()
                    deal = d
                docs2 = _unpack_docs(docs_)
                local = np.frombuffer(row, dtype=np.uint16 if len(docs2[0]) < 65536 else np.uint32)
                value = np.frombuffer(low, dtype=np.uint32).astype(np.uint64) | (np.frombuffer(high, dtype=np.uint16).astype(np.uint64) << np.uint64(32))
                held.append((chunk, docs2, local, value))
        yield from flush()

    settled = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("row", pa.binary()), ("lows", pa.binary())])

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "uid": [], "lows": []}
            for _, docs_, row, lows in zip(*(_plain(batch, x) for x in settled.names), strict=True):
                own_ids, own_uids = _unpack_docs(docs_)
                local = np.frombuffer(row, dtype=np.uint32)
                value = np.frombuffer(lows, dtype=np.uint32)[np.argsort(local, kind="stable")]
                ends = np.cumsum(np.bincount(local, minlength=len(own_ids)))
                out["doc_id"] += own_ids.tolist()
                out["uid"] += own_uids.tolist()
                out["lows"] += [value[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict(out, schema=per_doc)

    per_doc = pa.schema([("doc_id", pa.int64()), ("uid", pa.int32()), ("lows", pa.binary())])
    return (
        docs.select("doc_id", "uid", "body")
        .mapInArrow(note, "deal long, chunk long, docs binary, row binary, low binary, high binary")
        .repartition("deal")
        .sortWithinPartitions("deal")
        .mapInArrow(settle, "chunk long, docs binary, row binary, lows binary")
        .mapInArrow(by_document, "doc_id long, uid int, lows binary")
        .groupBy("doc_id", "uid")
        .agg(F.collect_list("lows").alias("lows"))
    )


PIECES = pa.schema([("deal", pa.int32()), ("docs", pa.binary()), ("row", pa.binary()), ("first", pa.binary()), ("count", pa.binary()), ("key", pa.binary()), ("texts", pa.binary())])


def pieces(docs: DataFrame, shared: DataFrame, plan: Plan) -> DataFrame:
    """The packed runs whose windows may occur elsewhere, in blocks by deal.

    A document's 32-bit hashes say which of its runs to send. A block has the pieces that some hundred documents send to one range of leading
    bytes (or class of minimisers): their texts compressed together, and arrays of
    document, first window, number of windows and place or hash of the minimiser.
    """
    unit, byte = plan.unit, plan.unit.kind == "byte"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            lists = _plain(batch, "lows")
            sizes = [sum(len(y) for y in x) // 4 for x in lists]
            low32 = np.frombuffer(b"".join(y for x in lists for y in x), dtype=np.uint32).astype(np.uint64)
            known = np.sort(_pair(np.repeat(np.arange(len(lists)), sizes), low32))
            if not len(known):
                continue
            rows, firsts, counts, keys, texts, deals = [], [], [], [], [], []
            for c in chunks(_plain(batch, "body"), unit, plan.hot):
                pair = _pair(c.rows, c.key & np.uint64(0xFFFFFFFF))
                at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                take = np.flatnonzero(~_is_hot(c.key) & (known[at] == pair))
                rows.append(c.rows[take])
                firsts.append(c.first[take])
                counts.append(c.count[take])
                texts += [c.cut(a, n) for a, n in zip(c.at[take].tolist(), c.count[take].tolist(), strict=True)]
                if byte:
                    places = [c.place(k) for k in take.tolist()]
                    keys.append(np.array(places, dtype=np.uint8))
                    deals += [bisect.bisect_right(plan.splitters, t[a : a + LEAD]) for t, a in zip(texts[len(texts) - len(take) :], places, strict=True)]
                else:
                    keys.append(c.key[take])
                    deals += (c.key[take] % np.uint64(plan.deals)).astype(np.int64).tolist()
            row, first, count, key = (np.concatenate(x) for x in (rows, firsts, counts, keys))
            if not len(row):
                continue
            deal = np.array(deals)
            order = np.argsort(deal, kind="stable")
            edges = np.flatnonzero(np.diff(deal[order], prepend=-1, append=-1))
            out: dict[str, list] = {n: [] for n in PIECES.names}
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine = order[a:b]
                own, local = np.unique(row[mine], return_inverse=True)
                out["deal"].append(int(deal[mine[0]]))
                out["docs"].append(_pack_docs(ids[own], uids[own]))
                out["row"].append(local.astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes())
                out["first"].append(first[mine].astype(np.uint32).tobytes())
                out["count"].append(count[mine].astype(np.uint8).tobytes())
                out["key"].append(key[mine].tobytes())
                joined = b"\n".join(texts[k] for k in mine.tolist())
                out["texts"].append(len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_pydict(out, schema=PIECES)

    joined = docs.join(shared, ["doc_id", "uid"]).select("doc_id", "uid", "body", "lows")
    return joined.mapInArrow(pack, "deal int, docs binary, row binary, first binary, count binary, key binary, texts binary")


#: Windows in one stretch of frequent grams, at most.
LONGEST_STRETCH = 4096


def frequent_stretches(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, uid, first, text, name): the longest stretches of windows in which every gram is frequent."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, uids = _plain(batch, "doc_id"), _plain(batch, "uid")
            for c in chunks(_plain(batch, "body"), plan.unit, plan.hot):
                take = np.flatnonzero(_is_hot(c.key))
                if not len(take):
                    continue
                row, at, count = c.rows[take], c.at[take], c.count[take]
                new = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + count[:-1])))
                # Long stretches are cut at fixed distances from their start.
                start = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                new |= (at - at[start][group]) // LONGEST_STRETCH != np.concatenate(([0], (at - at[start][group])[:-1] // LONGEST_STRETCH))
                start = np.flatnonzero(new)
                total = np.add.reduceat(count, start)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": [ids[r] for r in row[start]], "uid": pa.array([uids[r] for r in row[start]], pa.int32()), "first": c.first[take][start],
                    "text": pa.array([c.cut(a, n) for a, n in zip(at[start].tolist(), total.tolist(), strict=True)], pa.binary()),
                })

    found = docs.select("doc_id", "uid", "body").mapInArrow(pack, "doc_id long, uid int, first long, text binary")
    return found.withColumn("name", F.sha2("text", 256))


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): sort rows by several keys, looking at a further key only where all before are tied.

    The partition step of multikey quicksort, for all tied groups at once. Rows of
    one class (numbered along the order) are equal in every key.
    """
    order = np.argsort(keys[0], kind="stable")
    value = keys[0][order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    for key in keys[1:]:
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(tied):
            break
        inner = np.lexsort((key[order[tied]], group[tied]))
        order[tied] = order[tied][inner]
        value = key[order[tied]]
        new[tied[1:]] |= (value[1:] != value[:-1]) & (group[tied[1:]] == group[tied[:-1]])
    return order, np.cumsum(new) - 1


def byte_classes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, class) of every window of every text, in order; equal windows have equal classes."""
    joined = b"".join(texts)
    lengths = np.array([len(x) for x in texts])
    counts = lengths - width + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.repeat(np.cumsum(lengths) - lengths, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    view = np.ndarray((len(joined) - 7,), dtype=">u8", buffer=joined, strides=(1,))
    steps = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
    order, cls = multikey_order([view[start + k].astype(np.uint64) for k in steps])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = cls
    return owner, out


def word_classes(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """As byte_classes, of windows of ``width`` words joined by one space."""
    found: list[bytes] = []
    owner: list[int] = []
    for k, text in enumerate(texts):
        gaps = [-1, *np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32).tolist(), len(text)]
        found += [text[gaps[i] + 1 : gaps[i + width]] for i in range(len(gaps) - width)]
        owner += [k] * (len(gaps) - width)
    order = sorted(range(len(found)), key=found.__getitem__)
    cls, at, last = np.empty(len(found), dtype=np.int64), -1, None
    for k in order:
        if found[k] != last:
            at, last = at + 1, found[k]
        cls[k] = at
    return np.array(owner), cls


def earliest(groups: list[tuple[list[bytes], list[int]]], unit: Unit) -> list[list[np.ndarray]]:
    """For buckets of distinct texts with their smallest documents: of each text, each window's smallest document."""
    texts = [t for g in groups for t in g[0]]
    docs = np.array([d for g in groups for d in g[1]], dtype=np.int64)
    owner, cls = (byte_classes if unit.kind == "byte" else word_classes)(texts, unit.width)
    least = np.full(cls.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, cls, docs[owner])
    split = np.split(least[cls], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
    out, at = [], 0
    for g in groups:
        out.append(split[at : at + len(g[0])])
        at += len(g[0])
    return out


def _compare(unit: Unit, answer: Callable) -> Callable:
    """A mapInArrow function over rows sorted by key; ``answer`` turns (rows of a bucket, texts, mins) into output rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        full: list[tuple[list[tuple], list[bytes], list[int]]] = []
        waiting, key = 0, None
        out: list[tuple] = []

        def close() -> None:
            nonlocal waiting
            if not rows:
                return
            least: dict[bytes, int] = {}
            for r in rows:
                if least.get(r[-1], r[0]) >= r[0]:
                    least[r[-1]] = r[0]
            if len(least) == 1:
                (text, doc), = least.items()
                out.extend(answer(rows, {text: np.full(1, doc)}))
            elif min(least.values()) < max(r[0] for r in rows):
                full.append((rows.copy(), list(least), list(least.values())))
                waiting += sum(len(t) for t in least)
            rows.clear()

        def settle() -> None:
            nonlocal waiting
            for (own, texts, _), mins in zip(full, earliest([(t, d) for _, t, d in full], unit) if full else [], strict=True):
                out.extend(answer(own, dict(zip(texts, mins, strict=True))))
            full.clear()
            waiting = 0

        for batch in batches:
            for row in zip(*(_plain(batch, n) for n in batch.schema.names), strict=True):
                if row[1] != key:
                    close()
                    key = row[1]
                    if waiting >= BUCKET_WINDOWS:
                        settle()
                    if len(out) >= 50_000:
                        yield out
                        out = []
                rows.append(row)
        close()
        settle()
        if out:
            yield out

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The blocks of one deal at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(_plain(batch, n) for n in PIECES.names), strict=True):
            if held and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _compare_deal(blocks: list[tuple], unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, uid, first, count) of the windows in these blocks that start in an earlier document."""
    byte = unit.kind == "byte"
    docs, uids, firsts, counts, keys, texts = [], [], [], [], [], []
    for _, who, row, first, count, key, packed in blocks:
        who2 = _unpack_docs(who)
        local = np.frombuffer(row, dtype=np.uint32 if len(who2[0]) > 65535 else np.uint16)
        docs.append(who2[0][local])
        uids.append(who2[1][local])
        firsts.append(np.frombuffer(first, dtype=np.uint32).astype(np.int64))
        count_ = np.frombuffer(count, dtype=np.uint8).astype(np.int64)
        counts.append(count_)
        keys.append(np.frombuffer(key, dtype=np.uint8 if byte else np.uint64))
        joined = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
        if byte:
            ends = np.cumsum(count_ + unit.width) - 1
            texts += [joined[a:b] for a, b in zip((ends - count_ - unit.width + 1).tolist(), ends.tolist(), strict=True)]
        else:
            texts += joined.split(b"\n")
    doc, uid, first, count, key = (np.concatenate(x) for x in (docs, uids, firsts, counts, keys))
    index: dict[bytes, int] = {}
    which = np.fromiter((index.setdefault(t, len(index)) for t in texts), dtype=np.int64, count=len(texts))
    distinct = list(index)
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    most = np.full(len(distinct), np.iinfo(np.int64).min)
    np.minimum.at(least, which, doc)
    np.maximum.at(most, which, doc)
    # Texts with different minimisers have no window in common.
    any_row = np.empty(len(distinct), dtype=np.int64)
    any_row[which] = np.arange(len(which))
    if byte:
        places = key[any_row].tolist()
        group_of: dict = {}
        group = np.fromiter((group_of.setdefault(t[a : a + LEAD], len(group_of)) for t, a in zip(distinct, places, strict=True)), dtype=np.int64, count=len(distinct))
    else:
        group = np.unique(key[any_row], return_inverse=True)[1]
    several = np.bincount(group)[group] > 1
    whole = ~several[which] & (least[which] < doc)
    out = [(doc[whole], uid[whole], first[whole], count[whole])]
    members = np.flatnonzero(several)
    members = members[np.argsort(group[members], kind="stable")]
    windows = count[any_row[members]]
    # Whole groups at a time, some hundred thousand windows together.
    cut = np.flatnonzero(np.diff(group[members], prepend=-1)) if len(members) else np.zeros(0, dtype=np.int64)
    size = np.add.reduceat(windows, cut) if len(cut) else cut
    part = np.cumsum(size) // BUCKET_WINDOWS
    part_of = np.repeat(part, np.diff(np.append(cut, len(members)))) if len(cut) else cut
    by_text = np.argsort(which, kind="stable")
    text_at = np.searchsorted(which[by_text], np.arange(len(distinct) + 1))
    for p in np.unique(part_of):
        own = members[part_of == p]
        owner, cls = (byte_classes if byte else word_classes)([distinct[k] for k in own], unit.width)
        low = np.full(cls.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, cls, least[own][owner])
        mins, base = low[cls], np.cumsum(np.bincount(owner, minlength=len(own))) - np.bincount(owner, minlength=len(own))
        soonest = np.minimum.reduceat(mins, base)
        live = np.flatnonzero(soonest < most[own])
        if not len(live):
            continue
        rows = np.concatenate([by_text[text_at[k] : text_at[k + 1]] for k in own[live]])
        start = np.repeat(base[live], text_at[own[live] + 1] - text_at[own[live]])
        n = count[rows]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = mins[np.repeat(start, n) + inner] < np.repeat(doc[rows], n)
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[np.cumsum(n)] = edge[0] = True
        before = np.concatenate(([False], gone[:-1]))
        begin = np.flatnonzero(gone & (edge[:-1] | ~before))
        after = np.concatenate((gone[1:], [False]))
        end = np.flatnonzero(gone & (edge[1:] | ~after))
        row = np.repeat(rows, n)[begin]
        out.append((doc[row], uid[row], first[row] + inner[begin], end - begin + 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def removed_windows(docs: DataFrame, unit: Unit) -> DataFrame:
    """(doc_id, uid, spans), each span a first and a count: windows of a document that also start in one with a smaller doc_id.

    ``docs`` has doc_id (not null), uid and body; uid tells rows with the same doc_id apart.
    """
    plan = sketch(docs, unit)
    partitions = plan.deals // DEALS

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in _held(batches):
            doc, uid, first, count = _compare_deal(blocks, unit)
            yield pa.RecordBatch.from_pydict({"doc_id": doc, "uid": uid.astype(np.int32), "first": first, "count": count.astype(np.int32)})

    dealt = pieces(docs, shared_minimisers(docs, plan), plan)
    dealt = dealt.repartitionById(partitions, (F.col("deal") / DEALS).cast("int")).sortWithinPartitions("deal")
    rare = dealt.mapInArrow(compare, "doc_id long, uid int, first long, count int")
    return rare.select("doc_id", "uid", F.array(F.struct("first", "count")).alias("spans")).unionByName(_frequent_windows(docs, plan))


def _frequent_windows(docs: DataFrame, plan: Plan) -> DataFrame:
    """The same of stretches of frequent grams: distinct texts are cut up and compared, and joined back whole."""
    unit, often = plan.unit, materialize(frequent_stretches(docs, plan), "frequent")
    distinct = often.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.min("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, lasts = (_plain(batch, n) for n in ("name", "doc_id", "last"))
            for c in chunks(_plain(batch, "text"), unit, plan.hot):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": [ids[r] for r in c.rows], "key": c.key.astype(np.int64), "last": [lasts[r] for r in c.rows], "name": [names[r] for r in c.rows], "at": c.first,
                    "count": c.count.astype(np.int32), "piece": pa.array([c.cut(a, n) for a, n in zip(c.at.tolist(), c.count.tolist(), strict=True)], pa.binary()),
                }, schema=cut_schema)

    cut_schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("last", pa.int64()), ("name", pa.string()), ("at", pa.int64()), ("count", pa.int32()), ("piece", pa.binary())])

    def mins(rows: list[tuple], found: dict[bytes, np.ndarray]) -> list[tuple]:
        out = []
        for _, _, last, name, at, count, text in rows:
            least = found[text]
            if len(least) == 1:
                if least[0] < last:
                    out.append((name, at, count, int(least[0])))
                continue
            edges = np.flatnonzero(np.diff(least, prepend=least[0] - 1, append=least[-1] - 1))
            out += [(name, at + int(a), int(b - a), int(least[a])) for a, b in zip(edges[:-1], edges[1:], strict=True) if least[a] < last]
        return out

    schema = pa.schema([("name", pa.string()), ("at", pa.int64()), ("n", pa.int32()), ("least", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _compare(unit, mins)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    parts = distinct.mapInArrow(cut, "doc_id long, key long, last long, name string, at long, count int, piece binary")
    solved = parts.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "name string, at long, n int, least long")
    # Written first, so that the join reads plain inputs, which AQE splits where a name is hot.
    by_name = materialize(solved.groupBy("name").agg(F.collect_list(F.struct("at", "n", "least")).alias("found")), "solved")
    earlier = F.filter("found", lambda s: s["least"] < F.col("doc_id"))
    spans = F.transform(earlier, lambda s: F.struct((F.col("first") + s["at"]).alias("first"), s["n"].alias("count")))
    return often.join(by_name, "name").select("doc_id", "uid", spans.alias("spans")).filter(F.size("spans") > 0)


def merged_spans(windows: DataFrame) -> DataFrame:
    """(doc_id, uid, spans): the windows of each document in one list."""
    return windows.groupBy("doc_id", "uid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(spans: list[dict] | None, width: int, n: int) -> np.ndarray:
    """Which of ``n`` tokens some removed window covers."""
    mark = np.zeros(n + 1, dtype=np.int64)
    for x in spans or ():
        mark[x["first"]] += 1
        mark[min(n, x["first"] + x["count"] + width - 1)] -= 1
    return np.cumsum(mark)[:n] > 0


def with_body(docs: DataFrame) -> DataFrame:
    """doc_id, uid and the UTF-8 body of every row (an empty body for null).

    uid is a 32-bit hash of the text. It only has to tell rows with one doc_id apart.
    """
    # A plain column, not an alias of it, lets both joins below read one exchange.
    named = docs if dict(docs.dtypes)["doc_id"] == "bigint" else docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return named.select("doc_id", F.hash("text").alias("uid"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("body"))


def with_spans(base: DataFrame, unit: Unit) -> DataFrame:
    """doc_id, body and spans of every row; rows without doc_id have none."""
    named = base.filter("doc_id is not null")
    windows = merged_spans(removed_windows(named, unit))
    found = named.join(windows, ["doc_id", "uid"], "left").select("doc_id", "body", "spans")
    return found.unionByName(base.filter("doc_id is null").select("doc_id", "body", F.lit(None).cast(found.schema["spans"].dataType).alias("spans")))


def small_batches(docs: DataFrame) -> None:
    """Bound the rows that travel to Python at once: texts may be long."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
