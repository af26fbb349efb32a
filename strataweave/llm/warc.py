"""A content-addressed WARC archive of pages.

Payload bytes are stored once: of the pages with equal payloads of ``LEAST_DEDUP`` bytes or
more, the one with the smallest page_id becomes a ``response`` record that carries the
payload, the others become ``revisit`` records that carry headers only and name that
response by its record id and the SHA-256 of the payload. ``read_records`` parses archives
into exact headers and payloads. ``headers`` and ``payloads`` keep them in tables apart, the
payloads once for each digest that was verified against the bytes read; ``reconstruct`` joins
them by digest, and each record is whole again.

Archives are gzip files of WARC/1.1 records, written and read through Spark's own file
sources, so any store that Spark reaches will do, and a lost task is simply run again. A file has
``RECORDS_PER_FILE`` records and the bytes of one partition at most. The reader takes archives of
one or many gzip members, as other writers make them, and inflates them piece by piece: what it
holds is the compressed file and one record.

A null html is an empty payload. A null page_id never is the smallest; pages with equal
payloads and only null ids are all responses, as are rows that share the smallest id.
CR and LF in an url are percent-encoded; a null url has no target line. Columns besides
page_id, url and html are ignored. An empty table gives an archive without records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, settle, shared_dir

LEAST_DEDUP = 100
RECORDS_PER_FILE = 4000
#: Bytes read or inflated at a time.
PIECE = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, page_id long, url string, refers_to_id string, declared string, header binary, payload_bytes long, payload_digest string"


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A uuid-shaped id that follows from the record's own content."""
    h = F.sha2(F.concat_ws("\n", F.lit("page"), page_id.cast("string"), digest, F.coalesce(url, F.lit(""))), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def plan_records(pages: DataFrame) -> DataFrame:
    """Adds payload, payload_digest, record_type and the response that a revisit names."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    narrow = rows.select("page_id", "url", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= LEAST_DEDUP)
    first = (
        narrow.groupBy("payload_digest")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    # Written first: the join below then reads plain rows on both sides, which Spark can split where a digest is hot.
    again = (
        narrow.select("page_id", "payload_digest")
        .join(settle(first, "warc-first"), "payload_digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
        .distinct()
    )
    ids = [F.col("a.page_id").eqNullSafe(F.col("b.page_id")), F.col("a.payload_digest") == F.col("b.payload_digest")]
    joined = rows.alias("a").join(settle(again, "warc-again").alias("b"), ids, "left")
    return joined.select(
        "a.*",
        F.when(F.col("first_id").isNull(), "response").otherwise("revisit").alias("record_type"),
        "first_id",
        "first_url",
    )


def record_text(planned: DataFrame) -> DataFrame:
    """One WARC record per row, without its last line feed (the writer's separator)."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    safe = lambda url: F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("url"), F.col("payload_digest"))),
        line("WARC-Date", F.lit(DATE)),
        optional("WARC-Target-URI", safe(F.col("url"))),
        optional("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit(PROFILE)),
                line("WARC-Refers-To", record_id(F.col("first_id"), F.col("first_url"), F.col("payload_digest"))),
                optional("WARC-Refers-To-Target-URI", safe(F.col("first_url"))),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block_bytes.cast("string")),
        F.lit("\r\n"),
    )
    return planned.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, path: str) -> str:
    record_text(plan_records(pages)).write.option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def inflated(content: bytes) -> Iterator[bytes]:
    """An archive's bytes in pieces; plain, or one or many gzip members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, member, chunk = memoryview(content), 0, None, b""
    while True:
        if not chunk:
            chunk = bytes(view[at : at + PIECE])
            at += len(chunk)
        if member is None:
            chunk = chunk.lstrip(b"\0")
            if not chunk and at >= len(view):
                return
            member = zlib.decompressobj(31)
        data = member.decompress(chunk, PIECE) if chunk else member.flush()
        ended = not chunk
        chunk = member.unconsumed_tail
        if data:
            yield data
        if member.eof:
            chunk, member = member.unused_data, None
        elif ended:
            raise ValueError("a truncated archive")


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields by lower-case name, exact header with its blank line, block) of each record of one archive."""
    pieces, held = inflated(content), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not more():
                if held.strip():
                    raise ValueError("a truncated archive")
                return
        head = bytes(held[: end + 4])
        lines = head.decode("utf-8").lstrip("\r\n").rstrip("\r\n").split("\r\n")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        size = end + 4 + int(fields["content-length"])
        while len(held) < size + 4 and more():
            pass
        if len(held) < size:
            raise ValueError("a truncated archive")
        yield fields, head, bytes(held[end + 4 : size])
        del held[: size + 4]


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Rows of every record in the archives: exact headers, and what the carried payload hashes to."""
    schema = RECORD + (", payload binary" if with_payload else "")

    def parse(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for n, c in zip(names, zip(*rows))], schema=arrow)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for f, head, block in parse_archive(content.as_py()):
                    cut = block.index(b"\r\n\r\n") + 4
                    payload = block[cut:] if f["warc-type"] == "response" else None
                    page = f.get("warc-page-id")
                    row = [
                        f["warc-record-id"], f["warc-type"], None if page is None else int(page), f.get("warc-target-uri"), f.get("warc-refers-to"),
                        f["warc-payload-digest"].removeprefix("sha256:"), head + block[:cut], None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(),
                    ]
                    rows.append(row + [payload] * with_payload)
                    size += len(row[6]) + (len(block) if with_payload else 0)
                    if len(rows) >= 4000 or size > 1 << 24:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, schema)


def headers(records: DataFrame) -> DataFrame:
    """Every record without its payload: ids, the digest it declares, its exact WARC and HTTP headers."""
    return records.select("record_id", "record_type", "page_id", "url", "refers_to_id", "declared", "header")


def payloads(records: DataFrame) -> DataFrame:
    """Payload bytes once for each digest; raises where a payload doesn't match the digest that its record declares."""
    carried = [c for c in ("payload_bytes", "payload") if c in records.columns]
    sound = F.when(F.col("payload_digest") == F.col("declared"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("payload digest mismatch in "), F.col("record_id")))
    )
    return records.filter("record_type = 'response'").select(sound.alias("payload_digest"), *carried).dropDuplicates(["payload_digest"])


def reconstruct(records: DataFrame) -> DataFrame:
    """Every record with its payload's digest and size and the page that it refers to, by joins on digest and record id.

    With a ``payload`` column in ``records``, every record gets its full payload back, and as
    ``record`` the bytes of header and payload. Raises where a record's payload is not there.
    Both joins read written tables, so that they can be split where very many revisit one response.
    """
    heads = headers(records)
    store = settle(payloads(records), "warc-payloads")
    first = heads.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("declared").alias("named"))
    first = settle(first.dropDuplicates(["refers_to_id"]), "warc-responses")
    there = F.when(F.col("payload_bytes").isNotNull(), F.col("declared")).otherwise(F.raise_error(F.concat(F.lit("no payload for "), F.col("record_id"))))
    whole = heads.join(store, heads.declared == store.payload_digest, "left").withColumn("payload_digest", there)
    again = whole.filter("record_type = 'revisit'").join(first, "refers_to_id", "left")
    matched = F.when(F.col("named") == F.col("declared"), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("record_id")))
    )
    again = again.withColumn("payload_digest", matched).drop("named")
    back = whole.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)
    return back.withColumn("record", F.concat("header", "payload")) if "payload" in back.columns else back


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = reconstruct(settle(read_records(spark, path), "warc-records"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
