"""WARC archives: write captures, read records back, and assemble transactions.

``write`` turns captures into request, response (or revisit) and metadata
records; ``read`` parses archives into one row a record; ``assemble`` joins the
records of a capture through WARC-Concurrent-To into one nested row. Archives
are written by Spark's text writer and read by its binary-file reader, so they
may lie in any store that Spark reaches.

Rules: a null payload is empty. A capture without a url gets an empty target. Of
captures with equal payloads of at least ``min_revisit`` bytes the one with the
smallest id is the response and others revisit it; captures that repeat that id
are responses too. A capture with a null id is a response, and none revisits it.
Record ids stem from id and payload: rows that repeat both are all written, and
``assemble`` makes them one capture, whose ``n_metadata`` counts them.
Equal payloads are found by SHA-1. Payloads are told by length, so no payload can
be mistaken for a record's end. Empty tables give empty results, and only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, remove, ship

#: Digits of base 32 as conv() writes them and as RFC 4648 does.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_B32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records of one archive file at most, and its bytes before it is packed.
FILE_RECORDS = 6_000
FILE_BYTES = 1 << 29
#: Bytes that are unpacked at once.
_STEP = 1 << 20
#: Parts that a hot digest's narrow rows are dealt out over.
_SALTS = 16
#: Bytes of payloads that a worker hands on at once.
_OUT = 16 << 20
_EOL = "\r\n"
_DATE = "2024-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 10 hex digits are 8 of base 32."""
    hexa = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexa, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _B32_DIGITS)


def _record(kind: str, record_id: Column, fields: dict[str, Column], block: Column) -> Column:
    """A record as text that ends in CR LF CR; the writer adds the last LF.
    Fields whose value is null are left out."""
    lines = [F.lit(f"WARC/1.1{_EOL}WARC-Type: {kind}{_EOL}WARC-Date: {_DATE}{_EOL}WARC-Record-ID: "), record_id, F.lit(_EOL)]
    for name, value in fields.items():
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit("")))
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit(_EOL + _EOL), block, F.lit(f"{_EOL}\r"))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def write(captures: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> None:
    """Archives of all captures under ``path``, whole-file gzip."""
    own = captures.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        _one_line(F.col(f"`{url_col}`").cast("string")).alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"),
    )
    own = own.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    # who is first is told by narrow rows alone, dealt out over salts where a digest is
    # hot; only then do payloads travel, by id and digest
    narrow = materialise(own.select("id", "digest", "size"), "warc-digests")
    some = narrow.filter((F.col("size") >= min_revisit) & F.col("id").isNotNull()).select("id", "digest")
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS)).alias("salt")
    copies = some.groupBy("digest", salt).agg(F.min("id").alias("first"), F.max("id").alias("last")).groupBy("digest").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    copies = copies.filter("last > first").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    later = some.select("id", "digest", salt).join(copies, ["digest", "salt"]).filter("id > first").select("id", "digest", "first").distinct()
    marked = own.join(later, ["id", "digest"], "left")

    def urn(kind, key):
        """A record id that can be told from the capture's id and payload alone."""
        h = F.md5(F.concat(F.lit(f"{kind}:"), key))
        parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.uuid()))
    held = lambda id_: F.concat(id_, F.lit(":"), F.col("digest"))
    marked = marked.withColumn("own", urn("capture", held(key))).withColumn("revisit", F.col("first").isNotNull())
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("size").cast("string"), F.lit(_EOL + _EOL))
    common = {"WARC-Target-URI": F.col("url"), "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest"))}
    response = _record("response", F.col("own"), common | {"Content-Type": F.lit("application/http;msgtype=response")}, F.concat(head, F.col("payload")))
    again = common | {
        "WARC-Refers-To": urn("capture", held(F.col("first").cast("string"))),
        "WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        "Content-Type": F.lit("application/http;msgtype=response"),
    }
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    tail = F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1)
    get = F.concat(F.lit("GET "), F.when(F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail)), F.lit(f" HTTP/1.1{_EOL}Host: "), host, F.lit(_EOL + _EOL))
    request = _record("request", urn("request", F.col("own")), {"WARC-Target-URI": F.col("url"), "WARC-Concurrent-To": F.col("own"), "Content-Type": F.lit("application/http;msgtype=request")}, get)
    known = F.concat(F.lit("captureId: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f"{_EOL}payloadLength: "), F.col("size").cast("string"), F.lit(f"{_EOL}firstCapture: "), F.coalesce(F.when(F.col("revisit"), F.col("first")).cast("string"), F.lit("")), F.lit(_EOL))
    metadata = _record("metadata", urn("metadata", F.col("own")), {"WARC-Target-URI": F.col("url"), "WARC-Concurrent-To": urn("request", F.col("own")), "Content-Type": F.lit("application/warc-fields")}, known)
    records = F.array(request, F.when(F.col("revisit"), _record("revisit", F.col("own"), again, head)).otherwise(response), metadata)
    # archives are bounded by bytes: the largest payload tells how many records one
    # may hold, small payloads and large ones having archives of their own
    small = FILE_BYTES * 3 // FILE_RECORDS
    largest = narrow.agg(F.max("size")).first()[0] or 0
    for name, some, most in (("small", F.col("size") <= small, small), ("large", F.col("size") > small, largest)):
        if name == "small" or largest > small:
            per_file = max(3, min(FILE_RECORDS, 3 * (FILE_BYTES // max(1, most))))
            rows = marked.filter(some).select(F.explode(records).alias("value"))
            rows.write.mode("append").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    remove(narrow)


def _unpacked(data) -> Iterator[bytes]:
    """The bytes of an archive, gzip or plain, in steps."""
    data = memoryview(data)
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[at : at + _STEP]) for at in range(0, len(data), _STEP))
        return
    at = 0
    while at < len(data):  # any number of gzip members
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            step = data[at : at + _STEP // 8]
            at += len(step)
            yield member.decompress(step)
        at -= len(member.unused_data)


def parse(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of one archive, gzip or plain; names of
    fields are lower-cased. A record that breaks off is an error. Besides ``data``
    itself no more than a record and a step of the archive are held."""
    steps, held, done = _unpacked(data), bytearray(), 0

    def more() -> bool:
        step = next(steps, None)
        if step is not None:
            held.extend(step)
        return step is not None

    while held or more():
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if not held:
            return
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {done}")
        lines = bytes(held[:end]).split(b"\r\n")[1:]
        fields = {a.strip().lower().decode(): b.strip().decode() for a, _, b in (x.partition(b":") for x in lines)}
        stop = end + 4 + int(fields["content-length"])
        while len(held) < stop + 4 and more():
            pass
        if len(held) < stop:
            raise ValueError(f"the record at byte {done} breaks off")
        yield fields, bytes(held[end + 4 : stop])
        done += stop + 4
        del held[: stop + 4]


RECORD = "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, declared_digest string, payload_digest string, payload_bytes long, payload binary"


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row a record. ``payload`` is the body behind the HTTP head (responses,
    requests) or the whole block (metadata); digest and size are those of the
    payload as it was read, for revisits null."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.binary()]

    def run(batches):
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                for f, block in parse(b.column(0)[i].as_buffer()):
                    kind = f.get("warc-type")
                    body = block.partition(b"\r\n\r\n")[2] if kind in ("response", "request", "revisit") else block
                    full = kind == "response"
                    kept = body if payload or kind == "metadata" else None
                    rows.append((f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, b32encode(hashlib.sha1(body).digest()).decode() if full else None, len(body) if full else None, kept))
                    size += len(kept or b"")
                    if len(rows) >= 500 or size >= _OUT:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    ship(spark)
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``capture_id`` (the response's or revisit's
    record id) and the structs ``response``, ``request`` and ``metadata``, each
    null where there is no such record.

    A record that names another in WARC-Concurrent-To belongs to that record's
    capture; one hop over a request is followed. Of several records of a kind the
    one with the smallest record id is taken; ``n_requests`` and ``n_metadata``
    count them. Records that name a capture that isn't there make a row without
    response. A record that names none, or with a null id, stands for itself."""
    fields = [c for c in records.columns if c not in ("record_id", "concurrent_to")]
    is_anchor = F.col("record_type").isin("response", "revisit")
    hops = records.filter((F.col("record_type") == "request") & F.col("concurrent_to").isNotNull() & F.col("record_id").isNotNull())
    hops = hops.groupBy(F.col("record_id").alias("via")).agg(F.min("concurrent_to").alias("onward"))
    body = F.struct("record_id", *fields)
    side = records.filter(~is_anchor | F.col("record_type").isNull()).join(hops, F.col("concurrent_to") == F.col("via"), "left")
    lone = F.concat(F.lit("<none:"), F.uuid(), F.lit(">"))
    side = side.select(F.coalesce("onward", "concurrent_to", "record_id", lone).alias("capture_id"), "record_type", body.alias("r"))
    main = records.filter(is_anchor).select(F.coalesce("record_id", lone).alias("capture_id"), "record_type", body.alias("r"))

    def least(kind):
        return F.min_by(F.when(kind, F.col("r")), F.when(kind, F.col("r.record_id")))

    request, metadata = F.col("record_type") == "request", F.col("record_type") == "metadata"
    sides = side.groupBy("capture_id").agg(
        least(request).alias("request"), least(metadata).alias("metadata"),
        F.count_if(request).alias("n_requests"), F.count_if(metadata).alias("n_metadata"),
    )
    mains = main.groupBy("capture_id").agg(F.min_by("r", F.coalesce("r.record_id", F.lit(""))).alias("response"))
    both = mains.join(sides, "capture_id", "full")
    return both.select("capture_id", "response", "request", "metadata", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def metadata_field(name: str) -> Column:
    """A field of a capture's metadata block, null if it is empty."""
    return F.nullif(F.regexp_extract(F.col("metadata.payload").cast("string"), rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))


def write_and_read(captures: DataFrame, **columns) -> DataFrame:
    """Write archives to the shared folder and assemble their captures. The archives
    are read once: records without payloads are kept as a table."""
    spark = captures.sparkSession
    path = new_path(spark, "warc")
    write(captures, path, **columns)
    return assemble(materialise(read(spark, path, payload=False), "warc-records"))
