"""WARC archives with an index: write records, then read selected ones by byte range.

Writing gives every record its own gzip member and yields the index (file,
offset, length, URL, digest) record by record.  Reading starts from the
index: the selected entries are sorted by file and offset, neighbouring
ranges are coalesced into one read, and the records are cut out of it.

Files are opened through pyarrow's file systems, so the folder may be on any
store that Spark's executors share (file, hdfs, s3, ...).
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import col, cut, pieces, scratch_path

_ID = "urn:kestrel:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, {id}"
RECORD = "url string, record_type string, payload binary, payload_bytes long, payload_digest string, {ids}"


@dataclass(frozen=True)
class WarcParams:
    """min_revisit: least payload bytes for which an equal payload is a
    revisit.  gap, read: ranges less than `gap` bytes apart are read together,
    up to `read` bytes at once.  split: bytes of a file one task reads.
    broadcast_revisits: most revisits (some 100 bytes each) that are broadcast
    to the pages; beyond, a join on the id moves the payloads.
    date: the records' date, fixed so that rewriting gives the same bytes."""
    min_revisit: int = 100
    gap: int = 1 << 16
    read: int = 8 << 20
    split: int = 64 << 20
    level: int = 2
    broadcast_revisits: int = 200_000
    date: str = "2000-01-01T00:00:00Z"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def _record(kind: str, page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to, date: str) -> bytes:
    """One uncompressed WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, params: WarcParams):
    """Rows (page id, url, payload, digest, response's id or null) -> one archive per task, and its index.

    Every attempt writes a file of its own name and only the attempt that
    succeeds hands on its index, so a repeated task cannot mix two layouts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(name, compression=None)
            offsets, lengths = [], []
            for page, url, payload, digest, revisit, refers in (
                    x for at in pieces(batch.column(2)) for x in zip(*(c.slice(*at).to_pylist() for c in batch.columns))):
                member = gzip.compress(_record("revisit" if revisit else "response", page, url, payload, digest,
                                               len(payload), refers, params.date), params.level, mtime=0)
                out.write(member)
                offsets.append(offset)
                lengths.append(len(member))
                offset += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name.rsplit("/", 1)[1]] * len(offsets), pa.string()), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64()), batch.column(1), batch.column(3), batch.column(0)],
                names=["file", "offset", "length", "url", "digest", "page_id"])
        if out is not None:
            out.close()
    return run


def write(pages: DataFrame, folder: str | None = None, html: str = "html", url: str = "url", key: str = "page_id",
          params: WarcParams = WarcParams()) -> tuple[DataFrame, str]:
    """Write one record per row and return the index and the folder (a new shared one unless given).

    The payload is the html in UTF-8, null as empty.  Of the rows with equal
    payloads of at least min_revisit bytes those with the smallest id are
    responses, the others revisits that refer to it; smaller payloads are all
    responses.  A null id is never smallest.  Rows without a URL get a record
    without a target URI; white space and control characters in a URL are
    percent-encoded.  Other columns are not read; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(col(key).alias("page_id"), col(url).cast("string").alias("url"), payload.alias("payload"))
    digest = F.sha2("payload", 256)
    narrow = cut(rows.select("page_id", digest.alias("digest"), F.octet_length("payload").alias("n"))
                 .filter(F.col("n") >= params.min_revisit).select("page_id", "digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1 and refers_to is not null").drop("n")
    # only revisits; a payload that many pages share is a skewed key of the larger side, which AQE splits
    revisits = cut(narrow.join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
                   .select(F.col("page_id").alias("rid"), F.col("digest").alias("rdigest"), "refers_to").distinct())
    few = revisits.count() <= params.broadcast_revisits
    kind = pages.select(col(key)).schema[0].dataType.simpleString()
    joined = rows.withColumn("digest", digest) \
        .join(F.broadcast(revisits) if few else revisits, F.col("page_id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left") \
        .select("page_id", "url", "payload", "digest", F.col("rdigest").isNotNull().alias("revisit"), "refers_to")
    index = cut(joined.mapInArrow(_writer(folder, params), INDEX.format(id=f"page_id {kind}")))
    return index, folder


def _ranges(entries: Iterator[tuple], params: WarcParams) -> Iterator[list[tuple]]:
    """Runs of sorted (file, offset, length, digest, id) entries that one read covers."""
    run: list[tuple] = []
    for e in entries:
        if run and (e[0] != run[-1][0] or e[1] - (run[-1][1] + run[-1][2]) > params.gap
                    or e[1] + e[2] - run[0][1] > params.read):
            yield run
            run = []
        run.append(e)
    if run:
        yield run


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and its block."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _reader(folder: str, id_type: pa.DataType, params: WarcParams):
    def number(urn: str | None):
        text = None if urn is None else urn.strip("<>").removeprefix(_ID)
        return None if text in (None, "None") else (int(text) if pa.types.is_integer(id_type) else text)

    def entries(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        at, file = None, None
        for group in _ranges(entries(batches), params):
            if group[0][0] != at:
                at, file = group[0][0], fs.open_input_file(f"{path}/{group[0][0]}")
            lo, hi = group[0][1], max(e[1] + e[2] for e in group)
            data = file.read_at(hi - lo, lo)
            rows = []
            for _, offset, length, digest, _ in group:
                h, block = _parse(data[offset - lo:offset - lo + length])
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rsplit(b"Content-Length: ", 1)[1])
                if h["WARC-Type"] == "revisit":
                    body, found = None, h["WARC-Payload-Digest"].removeprefix("sha256:")
                else:
                    body, found = payload, hashlib.sha256(payload).hexdigest()
                if found != digest:
                    raise ValueError(f"record at {at}:{offset} does not match its digest in the index")
                rows.append((h.get("WARC-Target-URI"), h["WARC-Type"], body, size, found,
                             number(h["WARC-Record-ID"]), number(h.get("WARC-Refers-To"))))
            types = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), id_type, id_type]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                             names=["url", "record_type", "payload", "payload_bytes",
                                                    "payload_digest", "page_id", "refers_to"])
    return run


def read(index: DataFrame, folder: str, where: Column | None = None, params: WarcParams = WarcParams()) -> DataFrame:
    """Records of the index entries that meet `where` (all by default), by coalesced byte-range reads.

    Columns url, record_type, payload (null for a revisit), payload_bytes,
    payload_digest, page_id, refers_to, all from the archive.  A response is
    checked against the index's digest.
    """
    chosen = index if where is None else index.filter(where)
    kind = index.schema["page_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    part = F.floor(F.col("offset") / params.split)
    return chosen.repartition("file", part).sortWithinPartitions("file", "offset") \
        .select("file", "offset", "length", "digest", "page_id") \
        .mapInArrow(_reader(folder, id_type, params), RECORD.format(ids=f"page_id {kind}, refers_to {kind}"))


def round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Write the pages as WARC archives in the shared folder and read all records back."""
    index, folder = write(pages, params=params)
    return read(index, folder, params=params)


ORACLE_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
       case when f.first is null or f.first = p.page_id then 'response' else 'revisit' end as record_type,
       case when f.first is null or f.first = p.page_id then null else f.first end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""
