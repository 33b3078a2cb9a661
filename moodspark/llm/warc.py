"""WARC archives: one gzip member for each record, written from tables and read one record after the other."""

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import batches, join_unique, measured
from moodspark.plans.session import cut_lineage, scratch_folder

CHUNK = 1 << 20
# An archive is closed and the next one opened after so many bytes.
ARCHIVE_BYTES = 64 << 20
# Shorter payloads are never replaced by a reference.
LEAST_BYTES = 100
_DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that is cut short or whose content does not fit its headers."""


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    content: bytes = b""

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")


def digest(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def _clean(value: str) -> str:
    """A value on one line."""
    return "".join(c if c.isprintable() else "%" + "%".join(f"{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def write_record(out: BinaryIO, headers: dict[str, str], content: bytes, level: int = 6) -> int:
    """Write a record as a gzip member of its own; its length in the archive."""
    lines = ["WARC/1.1", *[f"{k}: {_clean(v)}" for k, v in headers.items()], f"WARC-Block-Digest: {digest(content)}",
             f"Content-Length: {len(content)}", "", ""]
    member = gzip.compress("\r\n".join(lines).encode() + content + b"\r\n\r\n", level, mtime=0)
    out.write(member)
    return len(member)


def read_records(source: BinaryIO, chunk: int = CHUNK) -> Iterator[Record]:
    """The records of an archive, one after the other, each checked against its length and digests.

    Members are decompressed as chunks arrive, so of the archive no more than a chunk and a record is held.
    """
    data = source.read(chunk)
    while data:
        member, parts = zlib.decompressobj(wbits=31), []
        while not member.eof:
            if not data:
                raise WarcError("the archive ends within a member")
            try:
                parts.append(member.decompress(data))
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from e
            data = member.unused_data if member.eof else source.read(chunk)
        data = data or source.read(chunk)
        yield _parsed(b"".join(parts))


def _parsed(block: bytes) -> Record:
    head, found, rest = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no valid Content-Length") from e
    content, end = rest[:length], rest[length:]
    if len(content) != length or end != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {length}, the block has {len(rest) - 4}")
    wanted = headers.get("warc-block-digest")
    if wanted and wanted != digest(content):
        raise WarcError("the block's digest does not fit")
    wanted = headers.get("warc-payload-digest")
    if wanted and headers.get("warc-type") == "response" and wanted != digest(content):
        raise WarcError("the payload's digest does not fit")
    return Record(headers, content)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    digits = (record_id or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def mark_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The pages with the page that their payload repeats in `first_id`, null for responses.

    Payloads are compared by digest, which goes through the shuffle instead of the page. Only payloads that occur
    twice are joined back, from the pages' own task if they are measured to be few.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    sums = marked.where(F.octet_length("html") >= least_bytes).groupBy(F.sha2("html", 256).alias("digest")).agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("pages")
    )
    repeated = cut_lineage(sums.where("pages > 1"))
    marked = marked.withColumn("digest", F.sha2("html", 256))
    few = measured(repeated, 88)
    if few is repeated:
        joined = join_unique(marked, repeated, "digest", "pages", "page_id")
    else:
        joined = marked.join(few.drop("pages"), "digest", "left")
    repeats = (F.octet_length("html") >= least_bytes) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    return joined.select("page_id", "url", "html", "digest", F.when(repeats, F.col("first_id")).alias("first_id"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write the archives below `folder`, any address that Arrow's file systems know; the list of them.

    Every task writes files with names of its own and lists them when they are complete, so what a lost task leaves
    is in no list and is not read.
    """
    kind = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(rows):
        files, base = pa.fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        done, out, path, records, size = [], None, "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, records, size))
                out = None

        for batch in batches(rows, 16 << 20):
            for page_id, url, html, sha, first in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "first_id"))):
                if out is None:
                    path = f"{base}/pages-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, records, size = files.open_output_stream(path, compression=None), 0, 0
                    size += write_record(out, {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                                               "WARC-Date": _DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                headers = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": _record_id(page_id), "WARC-Date": _DATE}
                if url is not None:
                    headers["WARC-Target-URI"] = url
                headers["WARC-Payload-Digest"] = f"sha256:{sha}"
                if first is not None:
                    headers |= {"WARC-Refers-To": _record_id(first), "WARC-Payload-Length": str(len(html)),
                                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                headers["Content-Type"] = "text/html; charset=utf-8"
                size += write_record(out, headers, html if first is None else b"", level)
                records += 1
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kind)], schema=kind)

    return cut_lineage(marked.mapInArrow(run, "path string, records long, bytes long").withColumn("folder", F.lit(folder)))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every page record in the listed archives.

    Archives are dealt to tasks by name; one is read by one task, a record at a time.
    """
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(rows):
        for batch in rows:
            for folder, path in zip(batch["folder"].to_pylist(), batch["path"].to_pylist()):
                files, _ = pa.fs.FileSystem.from_uri(folder)
                out = []
                with files.open_input_stream(path, compression=None) as source:
                    for record in read_records(source):
                        if record.kind not in ("response", "revisit"):
                            continue
                        h, revisit = record.headers, record.kind == "revisit"
                        out.append((
                            _page_id(h["warc-record-id"]), h.get("warc-target-uri"),
                            int(h["warc-payload-length"]) if revisit else len(record.content),
                            h["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(record.content).hexdigest(),
                            record.kind, _page_id(h["warc-refers-to"]) if revisit else None,
                        ))
                        if len(out) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    parts = max(archives.sparkSession.sparkContext.defaultParallelism, 1)
    total = archives.agg(F.count("*").alias("n")).first()["n"]
    return archives.select("folder", "path").repartition(max(1, min(total, 100_000), min(parts, total)), "path").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write every page as a record, read the archives back; one row for every page.

    Of pages with equal payloads of `least_bytes` and more, those with the smallest page_id are responses and the
    others revisits of it; a page without an id never comes first unless none has one, and then all are responses. A
    null html is an empty payload, a null url no header; control characters in an address are written as %XX. Repeated
    rows give a record each, and rows of one id and payload are the same kind of record. Other columns are not read;
    an empty table gives an empty result.
    """
    folder = folder or scratch_folder(pages.sparkSession, "warc")
    # Without a scheme a folder is one of the file system that the session has by default.
    path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration())
    files.mkdirs(path)
    folder = re.sub("^file:/+", "file:///", files.makeQualified(path).toString())
    return read_archives(write_archives(mark_revisits(pages, least_bytes), folder))


def records_of(data: bytes) -> list[Record]:
    """All records of an archive in memory, for small ones."""
    return list(read_records(io.BytesIO(data)))


ARCHIVE_SQL = """
WITH p AS (
    SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, url, payload_bytes, p.payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND payload_bytes >= 100
"""
