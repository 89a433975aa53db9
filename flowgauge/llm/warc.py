"""WARC archives with an index: written record by record, read by byte ranges.

Tasks write one gzip member per record into archives in the shared folder and return
an index row for each: file, offset, length, URL, digest. The index lists only what a
finished task wrote; a file left by a lost or repeated attempt is in no row and so is
never read. Reading starts from the index: the selected rows are range-sorted by file
and offset, ranges that lie close together become one read, and each task sees only
the bytes that its rows name.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from flowgauge.llm.shared import new_folder, pick
from flowgauge.session import stored

CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"       # the tables carry no time of capture
LEVEL = 2                           # of compression
GAP = 1 << 16                       # bytes that are read over to join two ranges
MOST = 1 << 23                      # bytes of one read, unless one record is longer
FILE = 1 << 28                      # an archive is closed beyond this size
INDEX = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
         "file string, offset long, length long")
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def file_system(uri):
    """File system and path of a Hadoop-style address."""
    uri = re.sub("^s3[an]:", "s3:", uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def payload_digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value):
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id, url, payload, digest, refers_to):
    """One WARC record. A revisit keeps the HTTP headers, whose Content-Length is that
    of the whole payload, and leaves the payload out."""
    revisit = refers_to is not None
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return CRLF.join([*(line.encode("utf-8", "replace") for line in lines), b"", block, b"", b""])


def parsed(data):
    """(page_id, url, record_type, refers_to, digest, payload_bytes, payload)."""
    head, _, rest = data.partition(CRLF + CRLF)
    fields = dict(line.split(b": ", 1) for line in head.split(CRLF)[1:])
    block = rest[:int(fields[b"Content-Length"])]
    http, _, payload = block.partition(CRLF + CRLF)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda name: int(x) if (x := fields.get(name, b"").removeprefix(b"<urn:page:").rstrip(b">")) else None
    revisit = fields[b"WARC-Type"] == b"revisit"
    url = fields.get(b"WARC-Target-URI")
    return (number(b"WARC-Record-ID"), url.decode() if url is not None else None, fields[b"WARC-Type"].decode(),
            number(b"WARC-Refers-To"), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), size, None if revisit else payload)


def first_pages(pages, least_bytes):
    """digest and the smallest page_id of every payload that occurs more than once."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.sha1(F.encode(payload, "UTF-8")).alias("sha"), F.octet_length(payload).alias("size"))
    groups = rows.filter(F.col("size") >= least_bytes).groupBy("sha").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return stored(groups.filter("n > 1").select("sha", "first"), "copies")


def write_archives(pages, folder=None, least_bytes=0):
    """Writes every page and returns the index. A payload of ``least_bytes`` or more is
    kept once, under its smallest page_id; rows that share that id are all responses."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    plain = pick(pages, "page_id", "url", "html")
    store, path = file_system(folder)
    store.create_dir(path)
    sha = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    refers = F.when(F.col("first") != F.coalesce("page_id", F.col("first") + 1), F.col("first"))
    marked = (plain.withColumn("sha", sha).join(first_pages(plain, least_bytes), "sha", "left")
              .select("page_id", "url", "html", refers.alias("refers_to")))

    def run(batches):
        store, path = file_system(folder)
        out, name, offset = None, None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, source, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or offset >= FILE:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    payload = (source or "").encode("utf-8", "replace")
                    digest = payload_digest(payload)
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = pack.compress(record(page_id, url, payload, digest, refers_to)) + pack.flush()
                    out.write(data)
                    rows.append((page_id, url, "response" if refers_to is None else "revisit", refers_to, digest, name, offset, len(data)))
                    offset += len(data)
                columns = list(zip(*rows)) or [()] * 8
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return folder, stored(marked.mapInArrow(run, INDEX), "index")


def _ranges(rows):
    """Sorted (file, offset, length) rows joined into reads."""
    group, low, high = [], 0, 0
    for row in rows:
        name, offset, length = row
        if group and (name != group[0][0] or offset > high + GAP or offset + length - low > MOST):
            yield group, low, high
            group = []
        if not group:
            low = high = offset
        group.append(row)
        high = max(high, offset + length)
    if group:
        yield group, low, high


def read_records(selected, folder):
    """The records that index rows name, digests of whole payloads verified; a record
    that is not what its row says fails the job."""
    ordered = selected.select("file", "offset", "length", "payload_digest").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        store, path = file_system(folder)
        name, source = None, None
        for batch in batches:
            digests = batch.column(3).to_pylist()
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            at = 0
            for group, low, high in _ranges(rows):
                if group[0][0] != name:
                    name = group[0][0]
                    source = store.open_input_file(f"{path}/{name}")
                data = source.read_at(high - low, low)
                out = []
                for _, offset, length in group:
                    row = parsed(zlib.decompress(data[offset - low:offset - low + length], 31))
                    if row[4] != digests[at] or row[6] is not None and payload_digest(row[6]) != row[4]:
                        raise ValueError(f"{name} at {offset}: not the record that the index names")
                    out.append(row)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return ordered.mapInArrow(run, RECORDS)


def archived(pages, least_bytes=0):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page,
    read back from the archives written of them.

    A null html is an empty payload, a null url leaves its header out, a null page_id
    never becomes the response of others; repeated rows are repeated records; an empty
    table gives no archive and no row."""
    folder, index = write_archives(pages, least_bytes=least_bytes)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
