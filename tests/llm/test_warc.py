import gzip
import hashlib
import io
import zlib

import pytest

from critiq.llm import warc

FORM = "page_id long, url string, html string"


def plain(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    last = {}
    for i, p in raw:
        if len(p) >= 1000 and i is not None:
            last[p] = max(i, last.get(p, i))
    return sorted(((i, len(p), hashlib.sha1(p).hexdigest(), *(("revisit", last[p]) if last.get(p, i) != i else ("response", None)))
                   for i, p in raw), key=str)


def test_contract(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, None, big), (3, "x", big), (4, "x", "<p>" * 20), (5, "x", "<p>" * 20), (6, "http://b/ü\r\n\r\nx", None),
            (7, "x", ""), (None, "x", big), (3, "x", big), (8, "x", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (None, "x", "n" * 2000), (None, "x", "n" * 2000)]
    got = warc.digest(spark.createDataFrame(rows, FORM).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert warc.digest(spark.createDataFrame([], FORM)).count() == 0


def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    rows = [(k, f"http://h/{k}", f"page {k} " * (k * 7)) for k in range(60)] + [(100, "u", "long " * 400_000)]
    pages = spark.createDataFrame(rows, FORM).coalesce(1)
    made = warc.archive(pages)
    names = made.collect()
    assert len(names) > 3 and sum(r.n_records for r in names) == len(rows)
    for r in names:                                             # a normal gzip reader reads the members in turn
        with open(r.archive.removeprefix("file://").removeprefix("file:"), "rb") as f:
            members = f.read()
        n = gzip.decompress(members).count(b"WARC/1.1\r\nWARC-Type")
        assert n == r.n_records
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read(made).collect()}
    assert got == {i: h for i, _, h in rows}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_stream_is_cut_anywhere(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    data = [warc.record(k, "u", b"x\r\n\r\n" * k, "d", 5 if k % 2 else None) for k in range(5)]
    one = gzip.compress(b"".join(data))
    several = b"".join(gzip.compress(d) for d in data)
    for stream in (one, several):
        assert list(warc.records(warc.inflate(io.BytesIO(stream)))) == data
    with pytest.raises(ValueError):
        list(warc.records([b"".join(data)[:-3]]))
    assert zlib.decompress(one, 31) == b"".join(data)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "x", "y", "z", 3)], "page_id long, html string, digest string, last string, n int")
    assert warc.digest(df).first().payload_digest == hashlib.sha1(b"x").hexdigest()
