"""SimHash fingerprints and the groups of documents that they link."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize
from ._graph import components
from ._joins import small

#: Text turned into fingerprints by one round of numpy calls.
SHINGLES_AT_ONCE = 1 << 16
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is set if more than half of the shingles' hashes have it."""
    words = text.translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1 :]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        pairs = zip(starts[at : min(n, at + SHINGLES_AT_ONCE)].tolist(), stops[at : at + SHINGLES_AT_ONCE].tolist(), strict=False)
        hashes = np.array([digest(view[a:b], seed) for a, b in pairs], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): a signed long for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py() or b"", shingle, seed) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("body"))
    return body.mapInArrow(run, "doc_id long, fp long")


def near_lanes(prints: np.ndarray, group: np.ndarray, radius: int, planes_first: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs in one group within ``radius`` bits; ``group`` is sorted.

    The prints stand in blocks of 64 with bit b of all of them in one word (plane b).
    Shifting every plane by d lanes lines each print up with the one d places on, so
    one pass over the planes yields the distance of all pairs d apart. Distances are
    kept as bit-sliced counters, fed by carry-save addition, with a sticky overflow
    bit; blocks in which every lane is past the radius, or out of its group, are
    abandoned before the next planes are read.
    """
    n = len(prints)
    if n < 2:
        return
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, dtype="<u8")
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")  # 64 x blocks
    planes = np.concatenate((planes, np.zeros((64, 1), dtype="<u8")), axis=1)
    last = np.searchsorted(group, group, side="right") - 1  # last member of each row's group
    room = last - np.arange(n)
    width = max(1, int(radius).bit_length())
    limit = [(radius >> k) & 1 for k in range(width)]

    def ahead(plane: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
        jump, shift = divmod(d, 64)
        low = plane[np.minimum(at + jump, blocks)]
        if not shift:
            return low
        return (low >> np.uint64(shift)) | (plane[np.minimum(at + jump + 1, blocks)] << np.uint64(64 - shift))

    most = np.zeros(blocks * 64, dtype=np.int64)
    most[:n] = room
    reach = most.reshape(-1, 64)
    furthest = reach.max(axis=1)
    for d in range(1, int(room.max()) + 1):
        at = np.flatnonzero(furthest >= d)
        alive = np.packbits(reach[at] >= d, axis=1, bitorder="little").view("<u8").reshape(-1)
        count = [np.zeros(len(at), dtype="<u8") for _ in range(width)]
        for step, b in enumerate(planes_first):
            carry = planes[b][at] ^ ahead(planes[b], at, d)
            for k in range(width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            alive &= ~carry  # overflow: past 2**width - 1, so past the radius
            if step % 4 == 3:
                live = np.flatnonzero(alive)
                if not len(live):
                    break
                if len(live) < 0.7 * len(at):
                    at, alive, count = at[live], alive[live], [c[live] for c in count]
        else:
            above = np.zeros(len(at), dtype="<u8")
            for k in range(width):  # bit-sliced comparison with the radius
                above = (count[k] | above) if not limit[k] else (count[k] & above)
            alive &= ~above
            hit = np.flatnonzero(alive)
            if len(hit):
                lanes = np.unpackbits(alive[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, lane = np.nonzero(lanes)
                i = at[hit[r]] * 64 + lane
                yield i, i + d


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root (the smallest index) of each of ``n`` items under the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            while root[b] != b:
                root[b] = root[root[b]]
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def near_links(prints: DataFrame, radius: int = 3, parts: int = 6, tile: int = 1024) -> DataFrame:
    """(a, b): links that join all prints within ``radius`` bits of each other, through one another or directly.

    ``prints`` has fp (distinct) and node. The 64 bits are cut into ``parts`` strips.
    Two prints within the radius agree on at least parts - radius strips, so each
    choice of that many strips (20 of 3 for 6 and 3) makes a table of buckets, and
    every near pair shares a bucket. Buckets of over ``tile`` prints are cut into
    tiles, and each pair of tiles is compared on its own, so no bucket is one task.
    """
    cuts = np.linspace(0, 64, parts + 1).astype(int)
    tables = list(combinations(range(parts), parts - radius))
    masks = [sum(((1 << int(cuts[s + 1] - cuts[s])) - 1) << int(cuts[s]) for s in t) for t in tables]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    strips = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    rows = prints.select("fp", "node", F.inline(strips))
    rows = materialize(rows, "strips")
    sizes = rows.groupBy("k", "key").count().filter("count > 1")
    rows = rows.join(sizes, ["k", "key"])
    small = rows.filter(F.col("count") <= tile).select("k", "key", F.lit(0).alias("u"), F.lit(0).alias("v"), F.lit(0).alias("side"), "fp", "node")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    large = rows.filter(F.col("count") > tile).withColumn("tiles", F.ceil(F.col("count") * 2 / tile)).withColumn("own", own)
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)))
    large = large.select("k", "key", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "node")
    orders = [[b for b in range(64) if not m >> b & 1] for m in masks]  # the strips of the key are equal: never read

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, fps, nodes, group in _whole_groups(batches):
            root = _forest(len(fps), near_lanes(fps.view(np.uint64), group, radius, orders[k]))
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_pydict({"a": nodes[moved], "b": nodes[root[moved]]})

    dealt = small.unionByName(large).repartition("k", "key", "u", "v").sortWithinPartitions("k", "key", "u", "v", "node")
    return dealt.mapInArrow(compare, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, fp, node, group number) of whole groups of one table k, some thousands of rows at a time."""
    held: list[np.ndarray] = []

    def out(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        new = np.any(x[:4, 1:] != x[:4, :-1], axis=0)
        group = np.concatenate(([0], np.cumsum(new)))
        change = np.flatnonzero(x[0, 1:] != x[0, :-1]) + 1
        for a, b in zip(np.concatenate(([0], change)), np.append(change, x.shape[1]), strict=True):
            yield int(x[0, a]), np.ascontiguousarray(x[4, a:b]), x[5, a:b], group[a:b]

    for batch in batches:
        x = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "key", "u", "v", "fp", "node")])
        held.append(x)
        if sum(h.shape[1] for h in held) >= 16384:
            x = np.concatenate(held, axis=1)
            new = np.flatnonzero(np.any(x[:4, 1:] != x[:4, :-1], axis=0))
            if len(new):
                cut = new[-1] + 1
                yield from out(x[:, :cut])
                held = [x[:, cut:]]
            else:
                held = [x]
    if held and sum(h.shape[1] for h in held):
        yield from out(np.concatenate(held, axis=1))


def near_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each input row.

    Documents link if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id that links reach, the document's own
    included. Null, empty and blank texts have fingerprint zero, which links like
    any other. A row without doc_id belongs to the group of its fingerprint, but is
    never the smallest; alone, its component_id is null. Repeated rows link to each
    other. Columns besides doc_id and text are ignored.
    """
    prints = materialize(fingerprints(docs), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    distinct = materialize(distinct, "distinct")
    named = distinct.filter("node is not null")
    # One document may carry several fingerprints if its id is repeated: those link too.
    twice = prints.filter("doc_id is not null").join(distinct, "fp").filter("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = prints.groupBy("doc_id").agg(F.countDistinct("fp").alias("n")).filter("n > 1").select(F.col("doc_id").alias("a"))
    links = near_links(named, radius).unionByName(twice.join(repeated, "a", "left_semi"))
    roots = components(links)
    by_print = distinct.join(roots, distinct.node == roots.node, "left").select("fp", F.coalesce("root", distinct.node).alias("component_id"))
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of ``docs`` of each group, unchanged: that with the smallest doc_id.

    Of rows that repeat that doc_id the one with the smallest text stays (null first).
    Rows without doc_id stay only where no named row has their text's fingerprint, one
    for each fingerprint.
    """
    groups = materialize(near_groups(docs, radius), "groups")
    first = materialize(groups.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "first")
    several = materialize(first.filter("n > 1").select(F.col("doc_id").alias("id")), "several")
    # The ids that do not stay as they are: fewer than those that do, so that documents are not shuffled for them.
    others = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).unionByName(several).distinct()
    once = docs.filter("doc_id is not null").join(small(materialize(others, "others")), F.col("doc_id") == F.col("id"), "left_anti")
    # Rows travel as one struct, so their column names cannot clash with ours.
    rows = docs.filter("doc_id is not null").select(F.struct(*docs.columns).alias("row")).join(small(several), F.col("row.doc_id") == F.col("id"), "left_semi")
    number = F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))
    named = once.unionByName(rows.withColumn("number", number).filter("number = 1").select("row.*"))
    nameless = materialize(docs.filter("doc_id is null").select(F.monotonically_increasing_id().alias("id"), F.struct(*docs.columns).alias("row")), "nameless")
    if nameless.isEmpty():
        return named
    prints = fingerprints(nameless.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text"))).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
    alone = prints.join(groups.filter("doc_id is not null").select("fingerprint"), "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    return named.unionByName(nameless.join(alone.select("id"), "id", "left_semi").select("row.*"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
