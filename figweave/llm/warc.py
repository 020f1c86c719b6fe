"""WARC archives: segmented, chunk-framed records written and read back with Spark."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figweave.llm.shared import join_counted, new_path, write_table

#: Up to so many (id, id) rows, 16 bytes each, are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
FLUSH_BYTES = 8 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = "type string, record_id string, origin string, page_id long, segment long, total long, digest string, refers_to long, block binary"
READ = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, status string"


def chunked(payload: bytes, size: int) -> bytes:
    """payload in HTTP chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes | None:
    """The payload of a chunk-framed body; None where the framing is broken."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        try:
            size = int(framed[at:end].split(b";")[0], 16) if end > at else -1
        except ValueError:
            return None
        if size < 0 or end + 2 + size + 2 > len(framed):
            return None
        if size == 0:
            return b"".join(parts)
        parts.append(framed[end + 2 : end + 2 + size])
        at = end + 2 + size
        if framed[at : at + 2] != b"\r\n":
            return None
        at += 2


def _record(block: bytes, **headers: object) -> bytes:
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n"


def _records(page: object, row: int, url: str | None, payload: bytes, first: object, date: str, segment: int, chunk: int) -> list[bytes]:
    known = None if pd.isna(page) else int(page)
    name = f"<urn:page:{'' if known is None else known}/{row}>"
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    shared = {"WARC_Date": date, "X_Page_ID": known, "WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}"}
    if not pd.isna(first):
        return [_record(HTTP, WARC_Type="revisit", WARC_Record_ID=name, WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        WARC_Refers_To=f"<urn:page:{int(first)}>", **shared)]
    body = HTTP + chunked(payload, chunk)
    n = -(-len(body) // segment)
    out = []
    for k in range(n):
        total = len(body) if k == n - 1 and n > 1 else None
        kind = {"WARC_Type": "response", "WARC_Record_ID": name, **shared} if not k else {
            "WARC_Type": "continuation", "WARC_Record_ID": f"{name[:-1]}#{k + 1}>", "WARC_Date": date, "WARC_Segment_Origin_ID": name}
        out.append(_record(body[k * segment : (k + 1) * segment], **kind, WARC_Segment_Number=k + 1 if n > 1 else None, WARC_Segment_Total_Length=total))
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_revisit_bytes: int = 100, segment_bytes: int = 16384, chunk_bytes: int = 4096, records_per_file: int = 2000,
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row as gzip archives under `path`, which must not exist.

    Of equal payloads of at least min_revisit_bytes, the row with the smallest id is the response, others revisit it. A block
    over segment_bytes continues in `continuation` records, so no record and, with records_per_file, no archive is large,
    however long a page is. Payloads are written where they are read: only (id, digest) is shuffled.

    Null payload: empty. Null url: empty. A null id: always a response, read back with a null id. Rows that repeat the smallest id are all responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    meta = write_table(pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")), "warc-meta")
    long = meta.filter((F.col("n") >= min_revisit_bytes) & F.col("id").isNotNull())
    firsts = long.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n_rows")).filter("n_rows > 1")
    revisits = write_table(
        join_counted(long.select("id", "digest"), write_table(firsts, "warc-firsts"), ["digest"], "n_rows", meta.count())
        .filter("id <> first").select("id", "first").distinct(), "warc-revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.join(revisits, "id", "left")
    rows = rows.withColumn("first", F.when(F.octet_length("payload") >= min_revisit_bytes, F.col("first"))).select("id", "row", "url", "payload", "first")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, n = [], 0
            for page, row, url, body, first in zip(*(batch[c] for c in batch.columns)):
                made = _records(page, row, url, bytes(body), first, date, segment_bytes, chunk_bytes)
                out += made
                n += sum(map(len, made))
                if n > FLUSH_BYTES:
                    yield pd.DataFrame({"record": out})
                    out, n = [], 0
            yield pd.DataFrame({"record": out})

    rows.mapInPandas(make, "record binary").select(F.col("record").cast("string")).write.options(
        lineSep="\r\n", compression="gzip", maxRecordsPerFile=records_per_file).text(path)


BROKEN = ("broken", *[None] * 8)


def _headers(raw: bytes) -> dict[str, str]:
    """Named fields of a record's head, names in lower case; a line without a colon is left out."""
    fields = (x.partition(":") for x in raw.decode(errors="replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in fields if colon}


def _number(text: str | None) -> int | None:
    """A field's number; None where the field is missing or no number."""
    return int(text) if text and text.isascii() and text.lstrip("-").isdigit() and len(text) < 19 else None


def _parse(data: bytes) -> Iterator[tuple]:
    """Records of an archive. A block that is cut short comes with what it has, and a broken row behind it. One without length, type or identifier is a broken row; where the next record begins cannot be known without a length, so reading goes on at the next `WARC/` line."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = _headers(data[at:end]) if end >= 0 and data.startswith(b"WARC/", at) else {}
        size = _number(head.get("content-length"))
        if size is None or size < 0:
            yield BROKEN
            at = data.find(b"\r\n\r\nWARC/", at) + 4
            if at < 4:
                return
            continue
        name, kind = head.get("warc-record-id"), head.get("warc-type")
        refers = head.get("warc-refers-to")
        if name and kind:
            yield (kind, name, head.get("warc-segment-origin-id", name), _number(head.get("x-page-id")), _number(head.get("warc-segment-number")),
                   _number(head.get("warc-segment-total-length")), head.get("warc-payload-digest", "").removeprefix("sha256:"),
                   _number(refers.strip("<>").rpartition(":")[2]) if refers else None, data[end + 4 : end + 4 + size])
        if not (name and kind) or end + 4 + size > len(data):
            yield BROKEN
        at = end + 4 + size + 4


def _inflated(rest: bytes) -> tuple[bytes, bool]:
    """The bytes of a gzip file, and whether all of it could be read; a damaged member ends it, with what it gave before."""
    parts, at, z = [], 0, None
    while at < len(rest):
        z = z or zlib.decompressobj(31)
        piece = memoryview(rest)[at : at + (1 << 16)]
        try:
            parts.append(z.decompress(piece))
        except zlib.error:
            return b"".join(parts), False
        at += len(piece) - len(z.unused_data)
        z = None if z.eof else z
    return b"".join(parts), z is None


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under `path`, one row each (columns of RECORD). 

    What is damaged gives a row of type `broken` (all else null) and never fails a task: a head without length, type or identifier, and a gzip
    stream that ends early or cannot be read, up to which its records come back. So does one whose block is cut short: it has what is there of it, which reassemble() reports.
    """
    columns = [x.split()[0] for x in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data, whole = _inflated(bytes(content))
                out, n = [] if whole else [BROKEN], 0
                for record in _parse(data):
                    out.append(record)
                    n += len(record[-1] or b"")
                    if n > FLUSH_BYTES:
                        yield _frame(out, columns)
                        out, n = [], 0
                yield _frame(out, columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    for c in ("page_id", "segment", "total", "refers_to", "payload_bytes"):
        if c in out:
            out[c] = out[c].astype("Int64")
    return out


def reassemble(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit: columns of READ, and `payload` if asked for.

    Continuations are grouped with their origin by its identifier and ordered by segment number; the total length is verified, chunk framing decoded and the
    payload digest verified. `status` is ok, or what failed: segments, length, framing or digest (then bytes and digest are those of the header or null).
    A group is one page, whose segments one row must hold anyway. No records give no rows.
    """
    part = F.struct(F.coalesce("segment", F.lit(1)).alias("k"), F.col("block"))
    groups = records.filter("origin is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.min(F.when(F.col("type") != "continuation", F.col("type"))).alias("type"), F.max("total").alias("total"),
        F.max("digest").alias("digest"), F.max("refers_to").alias("refers_to"), F.sort_array(F.collect_list(part)).alias("parts"))
    ks, blocks = F.transform("parts", lambda p: p["k"]), F.transform("parts", lambda p: p["block"])
    gapless = (F.size("parts") == F.element_at("parts", -1)["k"]) & (F.size(F.array_distinct(ks)) == F.size("parts")) & ((F.size("parts") == 1) | F.col("total").isNotNull())
    groups = groups.select("page_id", "type", "total", "digest", "refers_to", gapless.alias("gapless"), F.array_join(F.transform(blocks, lambda b: b.cast("string")), "").cast("binary").alias("block"))
    columns = [x.split()[0] for x in READ.split(", ")] + ["payload"] * with_payload

    def one(page, kind, total, digest, refers, gapless, block) -> tuple:
        block = bytes(block)
        if kind is None or not gapless:
            return (page, kind or "response", None, digest or None, refers, "segments", None)
        if not pd.isna(total) and total != len(block):
            return (page, kind, None, digest, refers, "length", None)
        if kind == "revisit":
            return (page, kind, None, digest, refers, "ok", None)
        payload = unchunked(block.partition(b"\r\n\r\n")[2])
        if payload is None:
            return (page, kind, None, digest, refers, "framing", None)
        found = hashlib.sha256(payload).hexdigest()
        return (page, kind, len(payload), found, refers, "ok" if found == digest else "digest", payload)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [one(*row)[: len(columns)] for row in zip(*(batch[c].astype(object) for c in batch.columns))]
            yield _frame(out, columns)

    return groups.mapInPandas(join, READ + ", payload binary" * with_payload)


def resolve_revisits(read: DataFrame) -> DataFrame:
    """Rows of reassemble() with the payload size of revisits taken from the response that they refer to.

    A hot response, one that a third of all records revisit, is joined by broadcast; the others by shuffle.
    """
    revisits = read.filter("record_type = 'revisit'").drop("payload_bytes")
    sizes = read.filter("record_type <> 'revisit'").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"))
    counts = revisits.groupBy("refers_to").agg(F.count("*").alias("n_rows")).join(sizes, "refers_to", "left")
    total = revisits.count()
    if not total:
        return read
    found = join_counted(revisits, write_table(counts, "warc-refers"), ["refers_to"], "n_rows", total).drop("n_rows")
    return read.filter("record_type <> 'revisit'").unionByName(found)


def archive_path(spark: SparkSession) -> str:
    """A new place for archives in the shared folder."""
    return new_path(spark, "warc")
