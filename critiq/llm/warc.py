"""WARC: writing, normalising and reading gzip archives.

``write_monolithic`` writes pages as WARC records into archives that are one gzip stream
each (the kind that cannot be read from the middle).  ``normalise`` inflates each archive once,
as a stream, rewrites every record as a gzip member of its own and writes a sidecar
index (JSON lines: offset and length of the member, record id, type).  ``read`` seeks each
record by the index.  Archives are rolled at ``ARCHIVE_BYTES`` of records, so a task
holds one record and a bounded buffer; files go to a folder that all executors share,
through pyarrow's file systems, under a temporary name first and then in one rename,
so that a repeated or lost task leaves no half file.

Deduplication: of pages with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest
page_id is the response, the others are revisits that refer to it.

Rows: null html = empty payload.  Null page_id: its record has no page id; it is never the response that
others refer to, unless all ids of the group are null (then all are responses).  Rows that repeat
the largest page_id are all responses.  Repeated rows: a record each.  Empty table: no record.
Other columns of the table are not archived, but url (if there is one) is the target URI."""
from __future__ import annotations

import hashlib
import json
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import prepare, shared_dir, shared_table

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
          "payload binary")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record.  A revisit holds the HTTP head only; length and digest are those of the full payload."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    uri = "".join(c for c in (url or "urn:none") if c > " " and c != "\x7f").encode("utf-8").decode("latin-1")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode("latin-1").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def _page(urn: str | None):
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def records(pieces):
    """Record by record (bytes with head) out of an inflated stream."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            size = end + 4 + int(parse(bytes(held[at:end]))["Content-Length"]) + 4
            if size > len(held):
                break
            yield bytes(held[at:size])
            at = size
        del held[:at]
    if held:
        raise ValueError(f"archive ends inside a record ({len(held)} bytes left)")


def inflate(stream):
    """Pieces of a gzip file, whatever its members."""
    box = zlib.decompressobj(31)
    while chunk := stream.read(CHUNK):
        while chunk:
            yield box.decompress(chunk)
            chunk = box.unused_data
            if box.eof:
                box = zlib.decompressobj(31)


def _target(uri: str):
    return pafs.FileSystem.from_uri(uri)


class _File:
    """Written under a name of this attempt's own; ``keep`` gives it its final name."""

    def __init__(self, uri: str):
        self.uri, (self.fs, self.path) = uri, _target(uri)
        context = TaskContext.get()
        self.mine = f"{self.path}.{context.taskAttemptId() if context else 0}.tmp"
        self.out = self.fs.open_output_stream(self.mine)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def keep(self) -> None:
        self.out.close()
        self.fs.move(self.mine, self.path)


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """(archive string): names of the written archives; ``pages`` (page_id, url, html, digest, refers_to)."""
    def write(batches):
        part, names = TaskContext.get().partitionId(), []
        file = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if file is None:
                    file, box, size = _File(f"{folder}/part-{part:05d}-{len(names):04d}.warc.gz"), zlib.compressobj(6, wbits=31), 0
                data = record(row[0], row[1], (row[2] or "").encode("utf-8"), row[3], row[4])
                file.write(box.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    file.write(box.flush())
                    file.keep()
                    names.append(file.uri)
                    file = None
        if file is not None:
            file.write(box.flush())
            file.keep()
            names.append(file.uri)
        yield pa.RecordBatch.from_pydict({"archive": pa.array(names, pa.string())})
    _target(folder)[0].create_dir(_target(folder)[1], recursive=True)
    return pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "archive string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, index, n_records): each archive again with a gzip member per record, and its index."""
    def run(batches):
        for batch in batches:
            out = {"archive": [], "index": [], "n_records": []}
            for name in batch.column("archive").to_pylist():
                base = f"{folder}/{name.rsplit('/', 1)[-1]}"
                file, index, at, n = _File(base), _File(base + ".idx"), 0, 0
                fs, path = _target(name)
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in records(inflate(stream)):
                        head = parse(data[:data.index(b"\r\n\r\n")])
                        box = zlib.compressobj(6, wbits=31)
                        member = box.compress(data) + box.flush()
                        file.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "id": head["WARC-Record-ID"],
                                                "type": head["WARC-Type"]}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                file.keep()
                index.keep()
                out["archive"].append(base)
                out["index"].append(base + ".idx")
                out["n_records"].append(n)
            yield pa.RecordBatch.from_pydict(out)
    _target(folder)[0].create_dir(_target(folder)[1], recursive=True)
    return archives.mapInArrow(run, "archive string, index string, n_records long")


def _fields(data: bytes) -> tuple:
    cut = data.index(b"\r\n\r\n")
    head = parse(data[:cut])
    block = data[cut + 4:cut + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4:]
    revisit = head["WARC-Type"] == "revisit"
    size, sha1 = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, sha1):
        raise ValueError(f"record {head['WARC-Record-ID']} does not hold the payload that its head names")
    return (_page(head["WARC-Record-ID"]), size, sha1, head["WARC-Type"], _page(head.get("WARC-Refers-To")),
            None if revisit else payload)


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record (see ``RECORD``), sought by the sidecar index."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for name, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                fs, path = _target(name)
                with fs.open_input_stream(_target(index)[1]) as stream:
                    entries = [json.loads(x) for x in stream.read().splitlines()]
                rows, size = [], 0
                with fs.open_input_file(path) as file:
                    for e in entries:
                        file.seek(e["offset"])
                        got = _fields(zlib.decompress(file.read(e["length"]), 31))
                        rows.append(got if with_payload else (*got[:-1], None))
                        size += len(got[-1] or b"") * with_payload + 100
                        if size >= 8 << 20:
                            yield _batch(names, rows)
                            rows, size = [], 0
                yield _batch(names, rows)
    return archives.mapInArrow(run, RECORD)


def _batch(names, rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def referred(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and refers_to."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    pages = pages.select("page_id", url.alias("url"), "html", F.sha1(raw).alias("digest"), F.length(raw).alias("bytes"))
    last = (pages.filter(F.col("bytes") >= MIN_REVISIT).groupBy("digest", "bytes")
            .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null")
            .select("digest", F.col("bytes").alias("b"), "last"))
    last = shared_table(last, "payloads")
    return (pages.join(last, (pages["digest"] == last["digest"]) & (pages["bytes"] == last["b"]), "left")
            .select("page_id", "url", "html", pages["digest"],
                    F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to")))


def archive(pages: DataFrame) -> DataFrame:
    """Write, normalise and index all pages below the shared folder: (archive, index, n_records)."""
    import uuid
    spark = pages.sparkSession
    prepare(spark)
    folder = f"{shared_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
    if "://" not in folder and ":/" not in folder:
        folder = "file://" + folder
    raw = shared_table(write_monolithic(referred(pages), f"{folder}/raw"), "archives")
    return shared_table(normalise(raw.repartition(max(1, raw.count())), f"{folder}/members"), "normalised")


def digest(pages: DataFrame) -> DataFrame:
    names = archive(pages)
    found = read(names.repartition(max(1, names.count())), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
q AS (SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS n, sha1(raw) AS d FROM p),
m AS (SELECT d, n, max(page_id) AS last FROM q WHERE n >= 1000 GROUP BY d, n HAVING count(*) > 1)
SELECT q.page_id, q.n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN m.last IS NOT NULL AND m.last IS DISTINCT FROM q.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.last IS DISTINCT FROM q.page_id THEN m.last END AS refers_to
FROM q LEFT JOIN m ON q.d = m.d AND q.n = m.n
"""
