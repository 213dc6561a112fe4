"""WARC archives, index first.

Writing: each task appends its records, one gzip member each, to a file of its own in the shared
folder and returns one index row per record: file, offset, length, URL and payload digest. The
index is written as Parquet by Spark, so only attempts that Spark has accepted are in it; a file
that a lost executor left behind is in no index row and is never read.

Reading: records are selected in the index, before any archive byte is read. The selected
ranges are sorted by file and offset, ranges less than ``GAP`` bytes apart are coalesced
to one read, and a read is cut after about ``SPAN`` bytes. Reads are dealt to one task for every
``SPAN`` bytes of the selected records: the rows that say where to read are few and small, so their own size would
put them all into one task. Digests are verified on what was read.

Equal payloads are stored once: the page with the largest id of each digest is a response, the
others are revisit records that name it. Which page that is comes from an aggregation over
digests, looked up by a broadcast of bounded size or under salted digests; pages themselves are
moved once, by page id, so that a payload shared by a third of all pages stays spread.

Defined results: null html is an empty payload; rows that repeat the largest page id of their
payload are all responses; a null page id is smaller than any other; payloads below ``least``
bytes are always responses. Other columns are ignored. File access goes through Arrow's file
systems, which take local, HDFS and object-store addresses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import join_small, new_folder, written

GAP = 64 * 1024
SPAN = 8 * 1024 * 1024
DATE = "2024-01-01T00:00:00Z"
EMPTY_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
END = b"\r\n\r\n"

INDEX = ("page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, "
         "file string, offset bigint, length bigint")
RECORD = ("page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")


def _files(address: str):
    """Arrow file system and path of an address with or without a scheme."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """One uncompressed WARC/1.1 record. A revisit holds the HTTP header but no payload."""
    header = EMPTY_HTTP + b"Content-Length: %d" % len(payload) + END
    block = header + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "").split()), "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + END + block + END


def parsed(record: bytes) -> dict:
    """Header fields, HTTP content length and payload of one record."""
    head, _, rest = record.partition(END)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(END)
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x in (None, "None") else int(x)
    name = lambda key: fields.get(key, "<urn:page:None>")[len("<urn:page:"):-1]
    return {"page_id": number(name("WARC-Record-ID")), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
            "refers_to": number(name("WARC-Refers-To")), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": said, "payload": payload}


def _roles(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that revisit another, without their texts."""
    narrow = written(pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"),
                                  F.octet_length("html").alias("size")).where(F.col("size") >= least).drop("size"), "warc-digests")
    keepers = narrow.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    return join_small(narrow, written(keepers, "warc-keepers"), ["sha"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).dropDuplicates(["page_id", "sha"])


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes one record per page below ``folder`` and returns the index, itself a written table."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    roles = _roles(rows, least).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to", F.lit(True).alias("again"))
    own = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    marked = own.join(roles, own["page_id"].eqNullSafe(roles["p"]) & (own["sha"] == roles["s"]), "left")
    marked = marked.select("page_id", "url", F.coalesce("again", F.lit(False)).alias("again"), "refers_to", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, system, name, offset = None, None, None, 0
        try:
            for batch in batches:
                columns: dict[str, list] = {k.split()[0]: [] for k in INDEX.split(", ")}
                for page_id, url, again, refers_to, html in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None:
                        # Attempts never share a file: its name is drawn anew.
                        system, root = _files(folder)
                        system.create_dir(root, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    payload, kind = html.encode(), "revisit" if again else "response"
                    digest = base32_sha1(payload)
                    data = zlib.compress(record_bytes(page_id, url, payload, digest, refers_to, kind), level=1, wbits=31)
                    out.write(data)
                    for k, v in zip(columns, (page_id, url, kind, refers_to if again else None, digest, len(payload), name, offset, len(data))):
                        columns[k].append(v)
                    offset += len(data)
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in zip(*columns.values())], schema=_arrow(INDEX))
        finally:
            if out is not None:
                out.close()

    return written(marked.mapInArrow(run, INDEX), "warc-index")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def reads_of(index: DataFrame, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Selected index rows -> coalesced reads: (file, begin, end, parts), parts sorted by offset.

    A file is one task's output, so a window over one file is bounded by what a task writes.
    """
    order = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    apart = F.coalesce((F.col("offset") - before > gap) | (F.floor(F.col("offset") / span) > F.floor(F.lag("offset").over(order) / span)), F.lit(True))
    rows = index.select("file", "offset", "length", apart.cast("int").alias("new"))
    rows = rows.withColumn("read", F.sum("new").over(order))
    return rows.groupBy("file", "read").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("parts")).drop("read")


def read_archives(index: DataFrame, folder: str, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Records of the selected index rows (a written table), from coalesced range reads of the archives."""
    size = index.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0
    reads = reads_of(index.select("file", "offset", "length"), gap, span)
    reads = reads.repartition(size // span + 1, "file", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _files(folder)
        schema = _arrow(RECORD)
        for batch in batches:
            for read in batch.to_pylist():
                with system.open_input_file(f"{root}/{read['file']}") as source:
                    data = source.read_at(read["end"] - read["begin"], read["begin"])
                rows = []
                for part in read["parts"]:
                    at = part["offset"] - read["begin"]
                    row = parsed(zlib.decompress(data[at:at + part["length"]], wbits=31))
                    if row["record_type"] == "response" and (base32_sha1(row["payload"]) != row["payload_digest"] or len(row["payload"]) != row["payload_bytes"]):
                        raise ValueError(f"{read['file']} at {part['offset']}: the payload does not match its digest")
                    rows.append(row)
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return reads.mapInArrow(run, RECORD)


def report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages, selects every record in the index, reads the archives back."""
    folder = new_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder, least)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
