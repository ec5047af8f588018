"""WARC archives: a writer that leaves one gzip member per record and a splittable reader."""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import filesystem, partitions, scratch

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: What the reader returns: why a record is broken besides.
READ = RECORD + ", reason string"


def with_revisits(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int = 1000) -> DataFrame:
    """Rows to archive: of equal payloads of ``least_bytes`` or more, the largest id is the response, others revisit it.

    A null payload is empty. Rows that repeat the largest id are responses too;
    a null id is a revisit if any equal payload has an id, else a response.
    The payload itself goes along for responses only.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(F.encode(body, "UTF-8")).alias("payload_digest"))
    # only groups with a copy cross the shuffle after partial sums, so a payload that a third of the pages share costs a row per task
    groups = (
        rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.max("id").alias("largest"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    rows = rows.join(groups, "payload_digest", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    return rows.select(
        "id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("largest")).alias("refers_to"),
        "payload_bytes", "payload_digest", F.when(~revisit, F.encode("payload", "UTF-8")).alias("payload"))


def _urn(value: int | None) -> str:
    return "<urn:page:" + ("" if value is None else str(value)) + ">"


def _record(row: dict, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['id'])}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"]))
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {_urn(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str | None = None, archive_bytes: int = 256 << 20, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row (columns of RECORD) to ``folder``; returns the manifest (path, bytes, records).

    Each task attempt writes files of its own name and only successful attempts
    reach the manifest, so a repeated task leaves no double records. The
    manifest is a table beside the archives; a new archive starts after
    ``archive_bytes`` compressed bytes.
    """
    spark = rows.sparkSession
    folder = folder or scratch(spark, "warc")

    def write(batches: Iterator):
        import pyarrow as pa

        fs, base = filesystem(folder)
        context, files, out, size, n = TaskContext.get(), 0, None, 0, 0
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{files}.warc.gz"
                    out, size, n = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(_record(row, date)) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out, files = None, files + 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    manifest = rows.mapInArrow(write, "path string, bytes long, records long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def members(file, start: int, end: int, step: int = 1 << 20) -> Iterator[bytes | None]:
    """Decoded gzip members that begin in [start, end) and hold a WARC record; None for one that breaks off.

    The range is scanned for the gzip magic. A candidate counts if its first
    bytes decode to a WARC version line; a record belongs to the range it
    starts in, however far it reaches. Bytes between members are passed over.
    """
    size = file.size()
    buffer, base, at = file.read_at(min(end + 2, size) - start, start), start, 0  # a magic may straddle the end

    def more() -> bool:
        nonlocal buffer
        extra = file.read_at(min(step, max(0, size - base - len(buffer))), base + len(buffer))
        buffer += extra
        return bool(extra)

    while base + at < end:
        if len(buffer) - at < 3:
            more()
        found = buffer.find(MAGIC, at)
        if found < 0 or base + found >= end:
            if found < 0 and base + len(buffer) < end and more():
                at = max(at, len(buffer) - step - 2)
                continue
            return
        try:
            while True:
                head = zlib.decompressobj(31).decompress(buffer[found:found + 4096], 256)
                if len(head) >= 16 or len(buffer) - found >= 4096 or not more():
                    break
            if not (head.startswith(b"WARC/") and b"\r\n" in head):
                raise zlib.error
        except zlib.error:
            at = found + 1
            continue
        decoder, parts, fed = zlib.decompressobj(31), [], found
        try:
            while not decoder.eof:
                if fed >= len(buffer) and not more():
                    raise zlib.error
                piece = buffer[fed:fed + step]
                parts.append(decoder.decompress(piece))
                fed += len(piece)
        except zlib.error:
            yield None
            at = found + 1
            continue
        at = fed - len(decoder.unused_data)
        yield b"".join(parts)
        if at > step:  # what is done leaves memory
            buffer, base, at = buffer[at:], base + at, 0


def parse(record: bytes) -> tuple[dict[str, str], bytes, int | None]:
    """(headers in lower case, payload, length the HTTP header states) of one record.

    Without a Content-Length the block is the rest of the record. The payload
    is the HTTP body as it is stored: chunks and encodings are not undone.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = _fields(head)
    size = _length(headers)
    if size is not None and size > len(rest):
        raise ValueError("block shorter than its Content-Length")
    block = rest.removesuffix(b"\r\n\r\n") if size is None else rest[:size]
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, block, None
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, payload, _length(_fields(http))


def _length(fields: dict[str, str]) -> int | None:
    stated = fields.get("content-length")
    if stated is None:
        return None
    if not (stated.isascii() and stated.isdigit()):
        raise ValueError("Content-Length is no number")
    return int(stated)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.decode("utf-8", "replace").strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def sha1_of(stated: str) -> str | None:
    """Lower-case hex of a stated SHA-1 in hex or base32 of any case; None for another or none."""
    kind, mark, value = stated.rpartition(":")
    if mark and kind.lower() not in ("sha1", "sha-1"):
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value, casefold=True) if len(value) == 32 else b""
    except (ValueError, binascii.Error):
        return None
    return raw.hex() if len(raw) == 20 else None


def _number(urn: str | None) -> int | None:
    tail = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of all archives of a manifest (path, bytes), a task per byte range.

    Returns the columns of READ. Records of every type are returned. Length
    and digest are taken from the payload read; those of a revisit are as
    stated, for its payload is elsewhere. A record that breaks off, has no
    type, a wrong length or a SHA-1 that differs from its payload is returned
    with record_type ``broken`` and the reason; other digests are not compared.
    An id is a number only if this module's writer gave it, else null.
    """
    spark = manifest.sparkSession
    ranges = (
        manifest.filter("bytes > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))))
        .select("path", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end")).repartition(partitions(spark)))

    def read(batches: Iterator):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in READ.split(", ")]
        out: list[tuple] = []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as file:
                    held = 0
                    for record in members(file, row["start"], row["end"]):
                        out.append(_row(record, with_payload))
                        held += len(out[-1][-2] or b"") + 200
                        if held > 8 << 20:
                            yield packed()
                            out, held = [], 0
                if out:
                    yield packed()
                    out = []

    return ranges.mapInArrow(read, READ)


def _row(record: bytes | None, with_payload: bool) -> tuple:
    if record is None:
        return *[None] * 2, "broken", *[None] * 4, "breaks off"
    try:
        headers, payload, length = parse(record)
    except ValueError as why:
        return *[None] * 2, "broken", *[None] * 4, str(why)
    number, url = _number(headers.get("warc-record-id")), headers.get("warc-target-uri")
    kind, digest = headers.get("warc-type"), sha1_of(headers.get("warc-payload-digest", ""))
    reason = None if kind else "no WARC-Type"
    if kind != "revisit":
        stated, length, found = digest, len(payload), hashlib.sha1(payload).hexdigest()
        if stated not in (None, found):
            reason = "payload differs from its digest"
        digest = found
    return (
        number, url, "broken" if reason else kind, _number(headers.get("warc-refers-to")), length, digest,
        payload if with_payload and kind != "revisit" else None, reason)
