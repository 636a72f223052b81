"""Archives round trip, whatever the payloads hold."""

import base64
import hashlib

import pytest

from factspark.llm import warc

TRAPS = [b"", b"x", b"\r\n\r\nWARC/1.1\r\n" * 3, b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", b"\r\n\r\n", b"a\r\n\r\n", b"a\r\n\r", b"\x00\xff\xfe" * 1000, b"0123456789" * 40_000, b"\r\n\r\nWARC/1.1\r\n" * 2000]


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.mark.parametrize("chunk", [64, 1000, warc.CHUNK])
def test_round_trip(spark, tmp_path, chunk):
    payloads = [t + bytes(str(k), "ascii") * (k % 3) for k, t in enumerate(TRAPS * 4)] if chunk > 64 else [t[:5000] for t in TRAPS]
    rows = [(100 - k, f"http://x/{k}\r\n y", bytearray(p), "z") for k, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary, record string").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"), chunk=chunk)
    first = {}
    for i, _, p, _ in rows:
        first[bytes(p)] = min(first.get(bytes(p), i), i)
    want = sorted((i, len(p), digest(p), "response" if first[bytes(p)] == i else "revisit", None if first[bytes(p)] == i else first[bytes(p)]) for i, _, p, _ in rows)
    for split in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        assert sorted(tuple(r) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_whole_payload_from_segments(spark, tmp_path):
    payload = b"\r\n\r\nWARC/1.1\r\n" * 50 + bytes(range(256)) * 9
    warc.write_warc(spark.createDataFrame([(1, None, bytearray(payload))], "page_id long, url string, payload binary"), str(tmp_path / "w"), chunk=100)
    rows = warc.read_segments(spark, str(tmp_path / "w")).orderBy("segment").collect()
    assert len(rows) > 20 and b"".join(bytes(r.chunk) for r in rows) == payload
    assert max(len(r.chunk) for r in rows) <= 110


def test_edges(spark, tmp_path):
    schema = "page_id long, url string, payload binary"
    warc.write_warc(spark.createDataFrame([], schema), str(tmp_path / "e"))
    assert warc.read_warc(spark, str(tmp_path / "e")).collect() == []
    big = bytearray(b"q" * 3000)
    df = spark.createDataFrame([(None, "u", None), (None, "u", big), (4, None, big), (4, "u", big), (5, "u", None), (6, "v", None)], schema)
    warc.write_warc(df, str(tmp_path / "n"), chunk=1000)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "n")).collect())
    assert got == [("4", 3000, "response", None), ("4", 3000, "response", None), ("5", 0, "response", None), ("6", 0, "revisit", 5), ("None", 0, "revisit", 5), ("None", 3000, "revisit", 4)]
    warc.write_warc(df, str(tmp_path / "m"), least_bytes=1)
    assert sum(r.record_type == "response" for r in warc.read_warc(spark, str(tmp_path / "m")).collect()) == 5


def test_damage_is_an_error(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "u", bytearray(b"payload"))], "page_id long, url string, payload binary"), str(tmp_path / "w"))
    text = spark.read.text(str(tmp_path / "w"), wholetext=True).filter("length(value) > 0").first()[0]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(text.replace("payload\r", "pAyload\r").encode())
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()


def test_long_payload_is_streamed():
    """200 MB pass through the writer's state in pieces; a few chunks are held at a time."""
    import tracemalloc

    piece, n = b"0123456789abcdef" * (warc.CHUNK // 16), 800
    row = {"page_id": 1, "url": "u", "size": n * len(piece), "digest": "D", "record_type": "response", "refers_to": None}
    tracemalloc.start()
    total = sum(len(r) for r in warc.record_rows(row, (bytes(piece) for _ in range(n)), warc.CHUNK, "1970-01-01T00:00:00Z"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > n * len(piece) and peak < 8 * warc.CHUNK
