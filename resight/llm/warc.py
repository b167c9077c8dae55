"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Payloads are written once: of equal ones the row with the largest id is the response, the others are revisit records that refer
to it.  Long records are cut into segments.  The reader groups continuation records by the id of their origin, orders them by
segment number, verifies the total length and decodes the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import written

#: Bytes of a record's block, beyond which it is cut into segments.
SEGMENT_BYTES = 16 << 10
#: Records in a file at most: with the segment size, 64 MB before packing, which a reading task holds.
RECORDS_PER_FILE = 4000
_PARTS = 1000
#: Repeated payloads up to which their table (a digest and an id each) is broadcast; beyond it is joined.
BROADCAST_DIGESTS = 500_000
#: Payloads shorter than that are written again each time.
SHORTEST_REVISITED = 1000
_CHUNK = 8 << 10
_GZIP_STEP = 1 << 14
_DATE = "2020-01-01T00:00:00Z"
_END = b"\r\n"
_ID = re.compile(r"<urn:row:(-?[0-9]*):([0-9]+)>")


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + _END + block


def chunked(payload: bytes, size: int = _CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join([*(b"%x\r\n%b\r\n" % (len(p), p) for p in parts), b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(_END, at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            break
        if n < 0 or body[at + n : at + n + 2] != _END:
            return None
        out.append(body[at : at + n])
        at += n + 2
    return b"".join(out)


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int) -> list[bytes]:
    """The records of one page: a response, in segments if it is long, or a revisit of the page refers_to with the same payload.

    A record is named by page and payload.
    """
    row = int(digest[:15], 16)
    name = lambda p: f"<urn:row:{'' if p is None else p}:{row}>"
    me = name(page_id)
    uri = [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))]
    whole = [*uri, ("WARC-Date", _DATE), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response")]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", me), *whole, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
        return [_record(fields, f"{http}Content-Length: {len(payload)}\r\n\r\n".encode())]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), ("WARC-Record-ID", me), *whole], block)]
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", me), *whole, ("WARC-Segment-Number", "1")], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        part_id = f"<urn:row:{'' if page_id is None else page_id}:{row}:{i}>"
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", part_id), *uri, ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(i)), *last], part))
    return out


_NEXT = re.compile(rb"(?:^|\n)(?=WARC/[0-9])")


def parse(data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes | int]]:
    """Header fields, with names in lower case, and block of each record of an archive file.

    Where there is no record, or one without a valid length, or one that is cut short: None and the place in the file; the
    reading goes on at the next line that begins a record.
    """
    at = 0
    while at < len(data):
        if data[at] in _END:
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        fields: dict[str, str] = {}
        if end >= 0 and data.startswith(b"WARC/", at):
            fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]))
        size = _number(fields.get("content-length"))
        if size is None or size < 0 or end + 4 + size > len(data):
            yield None, at
            following = _NEXT.search(data, at + 1)
            at = following.end() if following else len(data)
            continue
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def _unpacked(content: bytes) -> tuple[bytes, bool]:
    """The bytes of a file, gzipped (one member or many) or not, and whether it is whole.  Each byte is read once, however many members there are."""
    if content[:2] != b"\x1f\x8b":
        return content, True
    out, view, at = [], memoryview(content), 0
    while content[at : at + 2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            while not d.eof and at < len(content):
                part = view[at : at + _GZIP_STEP]
                out.append(d.decompress(part))
                at += len(part)
        except zlib.error:
            return b"".join(out), False
        if not d.eof:
            return b"".join(out), False
        at -= len(d.unused_data)  # no more than a step
    return b"".join(out), not content[at:].strip(b"\0\r\n")


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT_BYTES, shortest: int = SHORTEST_REVISITED) -> None:
    """Writes gzipped WARC files to a folder, through Spark's text writer.

    A null payload counts as empty, a null url leaves out the field, null ids come before others.  Rows with the id of the
    response and its payload are responses as well.  Empty tables give files without pages.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.filter(F.octet_length("payload") >= shortest)
    first = written(long.groupBy("digest").agg(F.max("id").alias("to"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "to"), "repeated")
    # short payloads, many of which are empty, meet nothing; both sides of the other join are dealt anew, so that Spark can split a frequent one
    long = long.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first.hint("merge"), "digest", "left")
    rows = long.unionByName(rows.filter(F.octet_length("payload") < shortest), allowMissingColumns=True)
    rows = rows.withColumn("to", F.expr("CASE WHEN NOT id <=> to THEN to END")).select("id", "url", "payload", "digest", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:row:info>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        out = [info]
        for b in batches:
            for i in range(b.num_rows):
                p, u, body, d, to = (b.column(c)[i].as_py() for c in ("id", "url", "payload", "digest", "to"))
                out += page_records(p, u, body, d, to, segment)
                if len(out) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out = []

    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_PART = "record string, page bigint, type string, refers bigint, bytes bigint, digest string, declared string, segment bigint, total bigint, block binary, problem string"
_PAGE = "page_id bigint, record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, problem string, payload binary"


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])), body


def _payload(block: bytes) -> bytes | None:
    fields, body = _http(block)
    return dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


def _declared(field: str | None) -> str | None:
    """A digest field as algorithm:hex; null without one, or where it is none of sha1, sha256 and md5 in hex or base32."""
    kind, _, value = (field or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    size = {"sha1": 20, "sha256": 32, "md5": 16}.get(kind)
    if size is None:
        return None
    value = value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        return f"{kind}:?"  # meets no payload
    return f"{kind}:{raw.hex()}"


def _verified(body: bytes, declared: str | None) -> bool:
    """Whether the payload has its declared digest; one without a known digest passes."""
    if declared is None:
        return True
    kind, _, value = declared.partition(":")
    return hashlib.new(kind, body).hexdigest() == value


def _number(text: str | None) -> int | None:
    """A whole number of a header field, null where it is none."""
    try:
        return int(text) if text else None
    except ValueError:
        return None


def _part(**known) -> tuple:
    return tuple(known.get(x.split()[0]) for x in _PART.split(", "))


def _parts_of(path: str, content: bytes, with_payload: bool) -> Iterator[tuple]:
    data, whole = _unpacked(content)
    if not whole:
        yield _part(record=f"{path}#gzip", problem="gzip")
    for i, (f, block) in enumerate(parse(data)):
        if f is None:
            yield _part(record=f"{path}#{block}", problem="record")
            continue
        kind, me, number = f.get("warc-type"), f.get("warc-record-id") or f"{path}#{i}", f.get("warc-segment-number")
        segment, declared = _number(number), _declared(f.get("warc-payload-digest"))
        page = _number(m[1]) if (m := _ID.fullmatch(me)) else None
        if number and segment is None:
            yield _part(record=f"{path}#{i}", problem="record")
        elif kind == "revisit":
            to = _ID.fullmatch(f.get("warc-refers-to", ""))
            digest = declared.partition(":")[2] if declared and declared.startswith("sha1:") else None
            yield _part(record=me, page=page, type=kind, refers=_number(to[1]) if to else None, bytes=_number(_http(block)[0].get("content-length")), digest=digest)
        elif kind == "continuation":
            if (origin := f.get("warc-segment-origin-id")) and segment:
                yield _part(record=origin, segment=segment, total=_number(f.get("warc-segment-total-length")), block=block)
            else:
                yield _part(record=me, problem="record")
        elif kind == "response" and (segment or with_payload):
            yield _part(record=me, page=page, type=kind, declared=declared, segment=segment or 1, total=None if segment else len(block), block=block)
        elif kind == "response":  # whole: only its figures go on
            body = _payload(block)
            if body is None or not _verified(body, declared):
                yield _part(record=me, page=page, type=kind, problem="framing" if body is None else "digest")
            else:
                yield _part(record=me, page=page, type=kind, bytes=len(body), digest=hashlib.sha1(body).hexdigest())


def _columns(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in fields.split(", ")), strict=True)
    of = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], of[k]) for i, k in enumerate(kinds)], names=list(names))


def _parts(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows = []
                for row in _parts_of(path.as_py(), content.as_py(), with_payload):
                    rows.append(row)
                    if len(rows) >= _PARTS:
                        yield _columns(rows, _PART)
                        rows = []
                yield _columns(rows, _PART)

    return run


def _assemble(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page", "record", "type", "refers", "bytes", "digest", "declared", "problem", "copies", "parts")
        for b in batches:
            rows = []
            for one in zip(*(b.column(c) for c in names), strict=True):
                page, record, kind, refers, size, digest, declared, problem, copies = (x.as_py() for x in one[:-1])
                # records of one name are copies of each other
                body, parts = None, [p for _, p in sorted({x["segment"]: x for x in one[-1].as_py()}.items())]
                if parts and not problem:
                    total = next((x["total"] for x in parts if x["total"] is not None), None)
                    block = b"".join(x["block"] for x in parts)
                    if [x["segment"] for x in parts] != list(range(1, len(parts) + 1)) or total != len(block):
                        problem = "segments"
                    elif (body := _payload(block)) is None:
                        problem = "framing"
                    elif not _verified(body, declared):
                        problem = "digest"
                    else:
                        size, digest = len(body), hashlib.sha1(body).hexdigest()
                if problem:
                    size = digest = body = None
                rows += [(page, record, size, digest, kind, refers, problem, body if with_payload else None)] * copies
            yield _columns(rows, _PAGE)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(page_id, record_id, payload_bytes, payload_digest, record_type, refers_to, problem, payload) of the pages in a folder of archives.

    Segments are brought together whatever files they are in.  Foreign archives are read too: a record without one of our names has
    no page_id; one without a payload digest of a known kind (sha1, sha256, md5) isn't verified.  Errors are rows with a problem and
    no figures: segments (not all there), framing (broken chunks), digest (differs from the record's), record (no record, no valid length
    or cut short; the reading goes on at the next one), gzip (a damaged file; what can be unpacked is read).  Records of other types
    are passed over.  payload is filled on request, and never for revisits.  A file is read whole (2 GB at most, Spark's limit).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = files.mapInArrow(_parts(with_payload), _PART)
    pages = parts.groupBy("record").agg(
        *(F.max(c).alias(c) for c in ("page", "type", "refers", "bytes", "digest", "declared", "problem")),
        F.greatest(F.lit(1), F.count("type")).alias("copies"),
        F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "total", "block"))).alias("parts"),
    )
    return pages.mapInArrow(_assemble(with_payload), _PAGE)
