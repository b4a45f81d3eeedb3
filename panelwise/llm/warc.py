"""WARC archives of pages, with a two-level capture index for range reads.

Every record is a gzip member of its own. The archives are written by Spark's text writer, whose commit
protocol keeps files of failed tasks out: a member ends with the top byte of its size, which is zero, and this
byte is the line separator. The index is sorted by the URL with its host reversed, in compressed blocks; the
directory keeps each block's first key only.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm.common import rows, utf8
from panelwise.session import cut

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = (
    "url_key string, url string, page_id long, record_type string, payload_digest string, refers_to long, "
    "path string, offset long, size long"
)
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def encoded(url: str) -> str:
    """The URL as records hold it: all but visible ASCII percent-encoded."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def url_key(url: str | None) -> str:
    """The URL, encoded as in its record, in sort order: host parts reversed, then path and query; null has the empty key."""
    if not url:
        return ""
    url = encoded(url)
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:  # no valid host or port
        return url.lower()
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.lower().split("."))) + (f":{port}" if port else "") + ")" + rest


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(data) + packer.flush()
    if member[-1]:  # 16 MB and more: an empty member behind it ends with a zero byte
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member += packer.compress(b"") + packer.flush()
    return member


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the page with the same payload."""
    name = lambda i: "<urn:page:>" if i is None else f"<urn:page:{i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {encoded(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    least: int = 1000, records: int = 20_000,
) -> None:
    """Write a record per page to archive files of at most ``records`` records under ``path``.

    The payload is the html's UTF-8 bytes, null as none. Of pages with equal payloads of at least ``least`` bytes, that
    with the largest id is a response and the others are revisits that refer to it; rows that repeat this id
    are responses too, and so are pages without an id.
    """
    data = utf8(html)
    chosen = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        data.alias("payload"), F.sha1(data).alias("digest"),
    )
    large = F.octet_length("payload") >= least
    # written: one small row per payload with copies, so that the join can split a payload with very many
    firsts = cut(
        chosen.filter(large & F.col("page_id").isNotNull()).groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    )
    refers = F.when(large & (F.col("first") != F.col("page_id")), F.col("first"))
    decided = chosen.join(firsts, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers"))

    def build(batches: Iterator[pa.RecordBatch]):
        for batch in rows(batches, "payload"):
            members = [_member(record(i, u, p, d, r))[:-1] for i, u, p, d, r in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])

    members = decided.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("lineSep", "\x00").option("maxRecordsPerFile", records).text(path)


def members(content) -> Iterator[tuple[int, int, bytes]]:
    """Offset, size and data of the gzip members of an archive; empty members belong to the one before."""
    view, at, found = memoryview(content), 0, None
    while at < len(view):
        reader, fed, parts = zlib.decompressobj(31), at, []
        while not reader.eof and fed < len(view):
            parts.append(reader.decompress(view[fed:fed + 16384]))
            fed += 16384
        if not reader.eof:
            raise ValueError("an archive ends inside a record")
        stop = min(fed, len(view)) - len(reader.unused_data)
        data = b"".join(parts)
        if data:
            if found:
                yield found
            found = (at, stop - at, data)
        elif found:
            found = (found[0], stop - found[0], found[2])
        at = stop
    if found:
        yield found


def parse(data: bytes) -> dict:
    """A record's fields; ``payload`` is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(m[1]) if (m := re.search(r"page:(-?\d+)>", fields.get(name, ""))) else None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), "refers_to": number("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def build_index(spark: SparkSession, archives: str, index: str, block_lines: int = 3000) -> None:
    """Write the capture index of the archives: compressed blocks of lines sorted by URL key, with their first keys."""

    def scan(batches: Iterator[pa.RecordBatch]):
        kinds = {"string": pa.string(), "long": pa.int64()}
        names, types = zip(*[f.split() for f in CAPTURE.split(", ")])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                found = []
                for offset, size, data in members(content.as_buffer()):
                    f = parse(data)
                    found.append((
                        url_key(f["url"]), f["url"], f["page_id"], f["record_type"], f["payload_digest"], f["refers_to"],
                        path.as_py(), offset, size,
                    ))
                columns = list(zip(*found)) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names)
                )

    def compress(batches: Iterator[pa.RecordBatch]):
        def block(lines):
            data = pa.BufferOutputStream()
            held = pa.Table.from_batches(lines)
            with pa.ipc.new_stream(data, held.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(held)
            keys = held.column("url_key")
            return pa.RecordBatch.from_arrays(
                [pa.array([keys[0].as_py()]), pa.array([keys[-1].as_py()]), pa.array([data.getvalue().to_pybytes()], pa.binary())],
                names=["first_key", "last_key", "lines"],
            )

        waiting, held = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_lines - held)
                waiting.append(part)
                held, at = held + part.num_rows, at + part.num_rows
                if held == block_lines:
                    yield block(waiting)
                    waiting, held = [], 0
        if waiting:
            yield block(waiting)

    captures = cut(_files(spark, archives).mapInArrow(scan, CAPTURE))
    # a URL with very many captures is spread over slices by the file and offset
    order = ["url_key", "path", "offset"]
    blocks = captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        compress, "first_key string, last_key string, lines binary"
    )
    blocks.withColumn("block", F.monotonically_increasing_id()).write.parquet(index)


def _open(lines) -> pa.Table:
    return pa.ipc.open_stream(lines).read_all()


def captures(spark: SparkSession, index: str) -> DataFrame:
    """All captures of an index, by opening its blocks."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lines in batch.column("lines"):
                yield from _open(lines.as_buffer()).to_batches()

    return spark.read.parquet(index).select("lines").mapInArrow(run, CAPTURE)


def lookup(spark: SparkSession, index: str, urls: list[str]) -> DataFrame:
    """Captures of a stated list of URLs: binary search in the directory, then inside the blocks that it names.

    The directory has a row per block, so a row per some thousand captures; only the blocks found are read.
    """
    blocks = spark.read.parquet(index)
    directory = blocks.select("first_key", "last_key", "block").orderBy("first_key", "last_key").collect()
    firsts = [r["first_key"] for r in directory]
    keys = sorted({url_key(u) for u in urls})
    wanted = set()
    for key in keys:
        at = bisect.bisect_right(firsts, key) - 1
        while at >= 0 and directory[at]["last_key"] >= key:
            wanted.add(directory[at]["block"])
            at -= 1

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lines in batch.column("lines"):
                held = _open(lines.as_buffer())
                order = held.column("url_key").to_pylist()
                for key in keys:
                    low, high = bisect.bisect_left(order, key), bisect.bisect_right(order, key)
                    if low < high:
                        yield from held.slice(low, high - low).to_batches()

    return blocks.filter(F.col("block").isin(sorted(wanted))).select("lines").mapInArrow(run, CAPTURE)


def read_records(spark: SparkSession, archives: str, found: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of captures, each read as the range of bytes that its capture names.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, for revisits from their headers; a
    response's digest is computed anew from its payload and must agree.
    """
    ranges = found.groupBy("path").agg(F.collect_list(F.struct("offset", "size")).alias("ranges"))
    names = [f.split()[0] for f in _RECORD.split(", ")][: None if with_payload else -1]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in _RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for content, spans in zip(batch.column("content"), batch.column("ranges").to_pylist()):
                view, held, out = memoryview(content.as_buffer()), 0, []
                for span in spans:
                    piece = view[span["offset"]:span["offset"] + span["size"]]
                    fields = parse(next(members(piece))[2])
                    if fields["payload"] is not None and hashlib.sha1(fields["payload"]).hexdigest() != fields["payload_digest"]:
                        raise ValueError(f"damaged record of page {fields['page_id']}")
                    out.append([fields[n] for n in names])
                    held += fields["payload_bytes"] if with_payload else 0
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        held, out = 0, []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = ", ".join(_RECORD.split(", ")[: len(names)])
    return _files(spark, archives).join(ranges, "path").select("content", "ranges").mapInArrow(run, schema)
