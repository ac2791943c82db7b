"""WARC archives with revisit records for repeated payloads.

Archives are written and read by Spark itself: a record is one row of a text
table whose rows end in the two line ends that close a WARC record, and archives
are read back as whole files of bounded size. So any store that Spark reaches
will do, a lost task is run again, and its half-written files never count.

Revisit resolution moves headers only: they are shuffled by payload digest, the
original of each digest is joined to its repeats, and the repeats of each
archive go to that archive, which is then written again.

Defined cases: a missing payload is empty; a missing url is written as an empty
target; a missing page_id is smaller than any other; of repeated rows of the
largest page_id one is the response, by its place in the archives; an empty
table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.llm.common import map_batches, quoted, whole_bytes, with_number
from riskframe.operators.keyed import attach_by_key
from riskframe.session import materialize, new_shared_path

#: A file ends with the record that takes it beyond this.
ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def head_of(fields: dict[str, str]) -> bytes:
    return ("WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in fields.items()) + END).encode()


def http_head(payload_bytes: int) -> bytes:
    return (
        f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {payload_bytes}{END}{END}"
    ).encode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def response_record(page: str, url: str, payload: bytes, name: str, date: str = DATE) -> bytes:
    block = http_head(len(payload)) + payload
    fields = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id(name),
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"),
        "WARC-Payload-Digest": "sha1:" + payload_digest(payload),
        "X-Page-ID": page,
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    return head_of(fields) + block


def revisit_record(fields: dict[str, str], original: dict, date: str = DATE) -> bytes:
    """The record's fresh header: it keeps its target and digest, and names the response."""
    block = http_head(int(fields["X-Payload-Length"]))
    new = {
        "WARC-Type": "revisit",
        "WARC-Record-ID": record_id(fields["WARC-Record-ID"]),
        "WARC-Date": date,
        "WARC-Target-URI": fields["WARC-Target-URI"],
        "WARC-Profile": PROFILE,
        "WARC-Refers-To": record_id(original["record"]),
        "WARC-Refers-To-Target-URI": original["url"],
        "WARC-Refers-To-Date": date,
        "WARC-Payload-Digest": fields["WARC-Payload-Digest"],
        "X-Page-ID": fields["X-Page-ID"],
        "X-Payload-Length": fields["X-Payload-Length"],
        "X-Refers-To-Page-ID": original["page"],
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    return head_of(new) + block


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields, header and block, payload) of each record of an archive file."""
    data, at = gzip.decompress(content), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        close = end + 4 + int(fields["Content-Length"])
        if data[close : close + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its header says")
        block = data[end + 4 : close]
        yield fields, data[at:close], block[block.index(b"\r\n\r\n") + 4 :]
        at = close + 4


def _write(records: DataFrame, path: str) -> str:
    """Write (chunk, value) as gzip archives; a task's chunks are files of their own."""
    (
        records.write.partitionBy("chunk")
        .option("lineSep", END + END)
        .option("compression", "gzip")
        .text(path)
    )
    return path


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each archive file; none if nothing was written."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.gz")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )


class _Chunks:
    """Numbers the archives of a task by the bytes that went into them."""

    def __init__(self) -> None:
        self.bytes = 0

    def place(self, record: bytes) -> int:
        chunk = self.bytes // ARCHIVE_BYTES
        self.bytes += len(record)
        return chunk


_RECORDS = "chunk int, value string"


def _as_records(chunks: list[int], values: list[bytes]) -> list[pa.Array]:
    return [pa.array(chunks, pa.int32()), pa.array(values, pa.binary()).cast(pa.string())]


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> str:
    """One response record per row, in archives below the new folder ``path``."""
    named = with_number(
        pages.select(
            F.coalesce(quoted(page_id).cast("string"), F.lit("")).alias("page"),
            F.coalesce(quoted(url), F.lit("")).alias("url"),
            whole_bytes(html).alias("payload"),
        ),
        "number",
    )

    def make():
        chunks = _Chunks()

        def step(page, target, payload, number):
            rows = zip(page.to_pylist(), target.to_pylist(), payload.to_pylist(), number.to_pylist())
            values = [response_record(p, u, data, f"page/{n}/{p}") for p, u, data, n in rows]
            return None, _as_records([chunks.place(v) for v in values], values)

        return step

    return _write(map_batches(named, [], [F.col(c) for c in named.columns], _RECORDS, make), path)


HEADER = (
    "at int, record string, type string, page string, url string, payload_bytes bigint, digest string, refers_to string"
)


def read_headers(files: DataFrame) -> DataFrame:
    """One row per record with its place (path, at); payloads are held against their digests."""

    def make():
        def step(contents):
            index, rows = [], []
            for i, content in enumerate(contents.to_pylist()):
                for at, (fields, _, payload) in enumerate(read_records(content)):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and digest != payload_digest(payload):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    index.append(i)
                    rows.append(
                        (
                            at, fields["WARC-Record-ID"], fields["WARC-Type"], fields["X-Page-ID"],
                            fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest,
                            fields.get("X-Refers-To-Page-ID"),
                        )
                    )
            kinds = [pa.int32(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            return pa.array(index, pa.int64()), [pa.array(c, k) for c, k in zip(columns, kinds)]

        return step

    return map_batches(files, ["path"], [F.col("content")], HEADER, make)


def resolve_revisits(headers: DataFrame, least_bytes: int = 0, page_type: str = "bigint") -> DataFrame:
    """(path, repeats): the repeats of each archive, each with its place and its original.

    The original of a digest is the record of the largest page_id. ``headers``
    must be a written table.
    """
    shared = headers.where(F.col("payload_bytes") >= least_bytes).select(
        "path", "at", "record", "page", "url", "digest", F.expr(f"try_cast(page AS {page_type})").alias("id")
    )
    originals = materialize(
        shared.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "path", "at", "record", "page", "url")).alias("original"))
        .where(F.col("n") > 1),
        "originals",
    )
    joined = attach_by_key(shared, originals, "digest")
    repeats = joined.where((F.col("path") != F.col("original.path")) | (F.col("at") != F.col("original.at")))
    one = F.struct("at", F.struct("original.record", "original.url", "original.page").alias("original"))
    return repeats.groupBy("path").agg(F.collect_list(one).alias("repeats"))  # one archive's records


def write_deduplicated(files: DataFrame, repeats: DataFrame, path: str) -> str:
    """Every record again, repeats as revisit records, in archives below the new folder ``path``."""

    def make():
        chunks = _Chunks()

        def step(contents, repeated):
            index, places, values = [], [], []
            for i, (content, own) in enumerate(zip(contents.to_pylist(), repeated.to_pylist())):
                original = {r["at"]: r["original"] for r in own or []}
                for at, (fields, whole, payload) in enumerate(read_records(content)):
                    if at in original:
                        value = revisit_record(fields, original[at])
                    else:
                        fresh = fields | {"WARC-Record-ID": record_id(fields["WARC-Record-ID"])}
                        value = head_of(fresh) + whole[whole.index(b"\r\n\r\n") + 4 :]
                    index.append(i)
                    places.append(chunks.place(value))
                    values.append(value)
            return pa.array(index, pa.int64()), _as_records(places, values)

        return step

    joined = files.join(repeats, "path", "left")
    return _write(map_batches(joined, [], [F.col("content"), F.col("repeats")], _RECORDS, make), path)


def deduplicate_pages(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    folder: str | None = None,
) -> tuple[str, DataFrame]:
    """The folder of the deduplicated archives and, read back from it, one row per record:
    page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``folder`` is a new folder for archives to keep; without it they go with the session.
    """
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType.simpleString()
    files = read_archives(spark, write_archives(pages, new_shared_path(spark, "archives"), page_id, url, html))
    headers = materialize(read_headers(files), "headers")
    out = folder or new_shared_path(spark, "deduplicated")
    write_deduplicated(files, resolve_revisits(headers, least_bytes, kind), out)
    back = read_headers(read_archives(spark, out))
    return out, back.select(
        F.expr(f"try_cast(page AS {kind})").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.expr(f"try_cast(refers_to AS {kind})").alias("refers_to"),
    )
