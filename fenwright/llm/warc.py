"""WARC archives: written with segmented records and chunked bodies, read back by reassembly.

Writing: one response or revisit record for each page, a file for each partition of the join that finds equal payloads (so pages
are shuffled once; Spark's advisory partition size sets the files' size). Of pages with equal payloads (of at least
`least` bytes) the one with the largest id is the response and the others revisit it. A
record's block is an HTTP response; bodies over CHUNK bytes are framed in chunks. A block over
SEGMENT bytes is cut into a first record and continuation records, which name the first
(WARC-Segment-Origin-ID), their number, and at the last the total length. Files are gzip'd text of
raw records: Spark's text writer ends each with the two line breaks that WARC asks for.

Reading: a file, of one gzip member or one for each record, is unpacked as its records are parsed, one after
another. Records of one origin are gathered, ordered by number and joined; numbers must be 1..n and the bytes as
many as the last one says, or the job fails. Chunk framing and content codings are then taken off. Records of other types
(`warcinfo`, `request`, `metadata`, ..) and their segments are passed over. A sha1 digest that is given must be right.

Cases: null html is an empty payload. Repeated rows have records of their own; with an id that
is the largest of its payload all of them are responses. A null id is never the largest unless all are null, and
such rows are responses. Line breaks in a url are escaped. An empty table gives archives without records.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwright.llm import _store, _text

SEGMENT, CHUNK = 16 << 10, 4 << 10
END = b"\r\n\r\n"
PARSED = "origin string, number int, total long, type string, page_id long, url string, digest string, refers_to long, block binary"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)) + b"0" + END


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body: sizes in hexadecimal, extensions after a semicolon and trailers allowed."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        at = line + 2
        out.append(body[at : at + size])
        if len(out[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk ends where it should not")
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, name: str, segment: int = SEGMENT, chunk: int = CHUNK) -> list[bytes]:
    """The records of one page, each without its final line breaks."""
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else None
    own = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{n}')}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit or len(payload) <= chunk:
        block = http + b"Content-Length: %d" % len(payload) + END + (b"" if revisit else payload)
    else:
        block = http + b"Transfer-Encoding: chunked" + END + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own(1)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", refers_to)]
    if len(parts) == 1:
        return [_record(fields, block)]
    out = [_record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", own(n)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own(1)), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part))
    return out


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Archives of page_id, url and html of pages under path."""
    spark = pages.sparkSession
    _text.bounded_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload")))
    firsts = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("first"))
    firsts = _store.written(firsts, "warc-firsts")  # a table, so that Spark can split a payload of very many pages in the join
    joined = rows.join(firsts, "sha", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = f"{TaskContext.get().partitionId()}", 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n += 1
                out += records(r["page_id"], r["url"], r["payload"], _digest(r["payload"]), r["first"] if r["revisit"] else None, r["revisit"], f"{task}/{n}", segment, chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = joined.select("page_id", "url", "payload", "first", "revisit").mapInArrow(run, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


def unpacked(packed: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """What gzip members, one after another, hold, in parts of `step` bytes at most."""
    rest = packed
    while rest:
        member = zlib.decompressobj(47)
        while not member.eof:
            part = member.decompress(rest, step)
            rest = member.unconsumed_tail or (member.unused_data if member.eof else b"")
            if not part and not rest and not member.eof:
                raise ValueError("an archive ends inside a gzip member")
            yield part


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record of an archive that comes in parts; no more than a record and a part is held."""
    held = bytearray()

    def more() -> bool:
        part = next(parts, None)
        held.extend(part or b"")
        return part is not None

    while True:
        searched = 0
        while (head := held.find(END, searched)) < 0:
            searched = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("a record does not begin where it should")
                return
        first, *lines = held[:head].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("a record does not begin where it should")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        end = head + 4 + int(fields["content-length"])
        while len(held) < end + 4 and more():
            pass
        if held[end : end + 4] != END:
            raise ValueError("a record does not end where it should")
        yield fields, bytes(held[head + 4 : end])
        del held[: end + 4]


def _payload(block: bytes) -> tuple[bytes, int]:
    """The body of an HTTP response without its framing and codings, and the length it is said to have."""
    head, _, body = block.partition(END)
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode(errors="replace").split("\r\n")[1:])}
    codings = [c.strip() for name in ("content-encoding", "transfer-encoding") for c in fields.get(name, "").lower().split(",") if c.strip()]
    for coding in reversed(codings):
        if coding == "chunked":
            body = dechunked(body)
        elif coding in ("gzip", "x-gzip", "deflate"):
            body = b"".join(unpacked(body))
        elif coding != "identity":
            raise ValueError(f"a body in an unknown coding: {coding}")
    return body, len(body) if codings else int(fields.get("content-length", len(body)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per response or revisit: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""
    _text.bounded_batches(spark)
    number = lambda v: None if v is None else int(v)
    sha1 = lambda v: v[5:] if v.lower().startswith("sha1:") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                rows, size = [], 0
                for f, block in parse(unpacked(packed.as_py())):
                    if f["warc-type"] not in ("response", "revisit", "continuation") and "warc-segment-number" not in f:
                        continue
                    rows.append((f.get("warc-segment-origin-id", f["warc-record-id"]), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f["warc-type"], number(f.get("warc-page-id")), f.get("warc-target-uri"), sha1(f.get("warc-payload-digest", "")), number(f.get("warc-refers-to-page-id")), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in PARSED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    parsed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, PARSED)
    # Whole records go on as they are; segments meet by origin, no more of them than one record has.
    parts = F.sort_array(F.collect_list(F.struct("number", "total", "block")))
    head = lambda c: F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c)
    meta = ("type", "page_id", "url", "digest", "refers_to")
    grouped = parsed.where("number is not null").groupBy("origin").agg(*map(head, meta), parts.alias("parts")).where("type is null or type in ('response', 'revisit')")
    numbers = F.transform("parts", lambda p: p.number) == F.sequence(F.lit(1), F.size("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.length(p.block))
    # binary concat of an array: through hexadecimal text would double it, so the pieces travel as a list
    checked = grouped.select(*meta, F.transform("parts", lambda p: p.block).alias("blocks"), F.assert_true(numbers & (F.element_at("parts", -1).total == length) & F.col("type").isNotNull(), F.lit("segments are missing")).alias("ok"))
    checked = checked.where("ok is null").drop("ok")
    single = parsed.where("number is null").select(*meta, F.array("block").alias("blocks"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                payload, said = _payload(b"".join(r["blocks"]))
                if r["type"] == "revisit":
                    out.append((r["page_id"], r["url"], "revisit", r["refers_to"], said, r["digest"], None))
                    continue
                digest = _digest(payload)
                if len(payload) != said or r["digest"] not in (None, digest):
                    raise ValueError(f"page {r['page_id']}: the payload is not what was written")
                out.append((r["page_id"], r["url"], r["type"], None, len(payload), digest, payload))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    out = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return single.unionByName(checked).mapInArrow(decode, out)


def judge(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and give what is read back."""
    path = _store.new_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
