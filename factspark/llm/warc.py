"""Writing and reading web archives as a table of chunk rows.

An archive is text whose rows are WARC records and whose row separator is the
blank line that ends a record. A payload longer than a chunk becomes several rows:
the record and its numbered continuation records (segments, as the format calls
them).

Payloads are cut into rows of record and chunk number by the JVM, straight after the
scan; from there on neither the writer nor the reader holds more of a record than two
chunks, and digests are carried from chunk to chunk. Only ids, digests and sizes are
shuffled to find revisits, whose payloads then go no further; of responses, those of
several chunks are shuffled, by record. (Spark itself holds a page's cell whole while it
scans the source table.) A payload that contains the bytes between two records is cut
inside them, so the separator occurs between records only. Each file is one gzip
stream, which one task reads.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, materialize
from ._joins import small

CHUNK = 256 * 1024
# Fixed values of the format (WARC 1.1).
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
BETWEEN = END + VERSION
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_table(pages: DataFrame, chunk: int) -> DataFrame:
    """(rid, page_id, url, k, size, chunk, digest): the payloads of (page_id, url, payload) in rows of at most ``chunk`` bytes.

    rid numbers the input rows and k a row's chunks; the last chunk has the digest of
    all. Written once, so that a lost executor cannot number rows anew.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", F.octet_length("payload").cast("long").alias("size"), "payload")
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / chunk)).cast("int")
    cut = rows.select("rid", "page_id", "url", "size", F.explode(F.sequence(F.lit(0), last)).alias("k"), "payload")
    cut = cut.select("rid", "page_id", "url", "k", "size", F.substr("payload", F.col("k") * chunk + 1, F.lit(chunk)).alias("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha1()
        for batch in batches:
            digests = []
            for k, size, piece in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("k", "size", "chunk")), strict=True):
                if k.as_py() == 0:
                    sha = hashlib.sha1()
                sha.update(piece.as_buffer())
                digests.append(_digest(sha) if (k.as_py() + 1) * chunk >= size.as_py() else None)
            yield batch.append_column("digest", pa.array(digests, pa.string()))

    return materialize(cut.mapInArrow(run, "rid long, page_id long, url string, k int, size long, chunk binary, digest string"), "chunks")


def with_revisits(heads: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add record_type and refers_to to (rid, page_id, url, size, digest).

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the
    smallest page_id is the response and the others revisit it.
    """
    first = materialize(heads.groupBy("digest").agg(F.min("page_id").alias("first_id")), "first")
    joined = heads.join(small(first), "digest")
    again = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("rid", "page_id", "url", "size", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


def segments_of(pieces: Iterator[bytes], chunk: int, head: int) -> Iterator[bytes]:
    """A block, given in pieces, in segments of about ``chunk`` bytes.

    The first has the whole head of ``head`` bytes; none starts with, or contains, the
    separator's bytes. No more than a segment and a piece are held.
    """
    held, first = b"", True
    for piece in pieces:
        held += piece
        while True:
            at = held.find(BETWEEN)
            least = max(chunk, head) if first else chunk
            # Behind a cut there must be enough to see whether the separator starts or a segment would start with it.
            if 0 <= at < least:
                end = at + len(END) + 2
            elif len(held) >= least + len(BETWEEN):
                end = least + 2 * held.startswith(VERSION, least)
            else:
                break
            yield held[:end]
            held, first = held[end:], False
    while (at := held.find(BETWEEN)) >= 0:
        yield held[: at + len(END) + 2]
        held, first = held[at + len(END) + 2 :], False
    if len(held) > max(chunk, head if first else 0):
        end = max(chunk, head if first else 0)
        end += 2 * held.startswith(VERSION, end)
        if end < len(held):
            yield held[:end]
            held = held[end:]
    if held or first:
        yield held


def _head(*fields: tuple[str, object]) -> bytes:
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def record_rows(row: dict, pieces: Iterator[bytes], chunk: int, date: str) -> Iterator[bytes]:
    """The rows (records) of one page, whose payload comes in pieces."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    url = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in row["url"] or "about:blank")
    name = f"<urn:x-page:{row['page_id']}:{row['digest']}>"
    common = [("WARC-Date", date), ("WARC-Target-URI", url)]
    if row["record_type"] == "revisit":
        refers = f"<urn:x-page:{row['refers_to']}:{row['digest']}>"
        yield _head(("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http))) + http
        return

    def record(k: int, segment: bytes, last: bool) -> bytes:
        size = ("Content-Length", len(segment))
        if k == 1:
            head = _head(("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("WARC-Segment-Number", None if last else 1), ("Content-Type", "application/http; msgtype=response"), size)
        else:
            total = len(http) + row["size"] if last else None
            head = _head(("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), *common, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total), size)
        return head + segment

    # One segment waits, as only the last one has the total length.
    waiting, k = None, 0
    for segment in segments_of(itertools.chain([http], pieces), chunk, len(http)):
        if waiting is not None:
            yield record(k, waiting, False)
        waiting, k = segment, k + 1
    yield record(k, waiting, True)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for every row of (page_id, url, payload) to gzip archives under ``path``.

    A null payload is empty and a null url is about:blank. Rows that repeat a page_id
    and its payload are all written; a page without page_id is never the one that
    others refer to. Other columns are ignored.
    """
    names = ["rid", "page_id", "url", "size", "digest", "record_type", "refers_to", "k", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(names, (batch.column(i)[k].as_py() for i in range(len(names))), strict=True)) for batch in batches for k in range(batch.num_rows))
        held, size = [], 0
        for _, own in itertools.groupby(rows, key=lambda row: row["rid"]):
            head = next(own)
            pieces = (row["chunk"] or b"" for row in itertools.chain([head], own))
            for record in record_rows(head, pieces, chunk, date):
                held.append(record)
                size += len(record)
                if size > 4 * CHUNK:
                    yield pa.RecordBatch.from_pydict({"record": pa.array(held, pa.binary())})
                    held, size = [], 0
            for _ in own:  # a revisit reads no payload
                pass
        yield pa.RecordBatch.from_pydict({"record": pa.array(held, pa.binary())})

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    chunks = chunk_table(clean, chunk)
    heads = materialize(with_revisits(chunks.filter("digest is not null").select("rid", "page_id", "url", "size", "digest"), least_bytes), "heads")
    revisits = heads.filter("record_type = 'revisit'").withColumns({"k": F.lit(0), "chunk": F.lit(None).cast("binary")})
    answers = heads.filter("record_type = 'response'")
    payloads = chunks.select("rid", "k", "chunk", F.col("size").alias("_size"))
    one = payloads.filter(F.col("_size") <= chunk).drop("_size").join(small(answers), "rid")
    several = payloads.filter(F.col("_size") > chunk).drop("_size").join(small(answers.filter(F.col("size") > chunk)), "rid")
    several = several.repartition("rid").sortWithinPartitions("rid", "k")
    written = [x.select(*names).mapInArrow(run, "record binary") for x in (revisits, one, several)]
    records = written[0].unionByName(written[1]).unionByName(written[2])
    records.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(path)


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.removeprefix(VERSION).partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n"))
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str | None) -> int | None:
    found = urn.strip("<>").split(":")[2] if urn else "None"
    return None if found == "None" else int(found)


def _digest(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``: (record, segment, of, page_id, record_type, refers_to, digest, size, chunk).

    A record in one piece is checked and comes without its chunk; of others, chunk
    holds the payload bytes of each segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(0):
                fields, block = _parse(raw.as_py())
                kind, number = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1))
                name = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
                digest, whole = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, "WARC-Segment-Number" not in fields
                size = None
                if kind != "continuation":
                    http, _, block = block.partition(END)
                    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                if kind == "response" and whole and (_digest(hashlib.sha1(block)) != digest or len(block) != size):
                    raise ValueError(f"{name}: the payload does not have the recorded digest")
                out.append((name, number, fields.get("WARC-Segment-Total-Length"), _page(name), kind, _page(fields.get("WARC-Refers-To")), digest, size, None if whole else block))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names)

    names = ["record", "segment", "total", "page_id", "record_type", "refers_to", "digest", "size", "chunk"]
    types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    lines = spark.read.option("lineSep", BETWEEN.decode()).text(path).filter(F.length("value") > 0)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, "record string, segment int, total string, page_id long, record_type string, refers_to long, digest string, size long, chunk binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each payload checked.

    Segments meet at their record, in order, and the digest is carried from chunk to
    chunk; a payload that does not fit its recorded digest or length is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def finish() -> list[tuple]:
            if not state:
                return []
            if _digest(state["sha"]) != state["digest"] or state["bytes"] != state["size"]:
                raise ValueError(f"{state['record']}: the payload does not have the recorded digest")
            found = [(state["page_id"], state["bytes"], state["digest"], "response", None)] * state["copies"]
            state.clear()
            return found

        for batch in batches:
            out: list[tuple] = []
            for k in range(batch.num_rows):
                record, segment, _, page_id, _, _, digest, size, chunk = (batch.column(i)[k].as_py() for i in range(9))
                if segment == 1 and state.get("record") == record and state["last"] == 1:
                    state["copies"] += 1
                    continue
                if state.get("record") != record:
                    out += finish()
                    state.update(record=record, page_id=page_id, digest=digest, size=size, sha=hashlib.sha1(), bytes=0, copies=1, last=0)
                if segment == state["last"]:
                    continue
                if segment != state["last"] + 1:
                    raise ValueError(f"{record}: segment {state['last'] + 1} is missing")
                state["sha"].update(chunk)
                state["bytes"] += len(chunk)
                state["last"] = segment
            yield pack(out)
        yield pack(finish())

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    segments = read_segments(spark, path)
    whole = segments.filter("chunk is null").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    cut = segments.filter("chunk is not null").repartition("record").sortWithinPartitions("record", "segment").mapInArrow(run, schema)
    return whole.unionByName(cut)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = fresh_path(spark, "warc")
    write_warc(pages.select("page_id", "url", F.encode("html", "UTF-8").alias("payload")), path)
    return read_warc(spark, path)
