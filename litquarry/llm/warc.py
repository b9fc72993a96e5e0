"""WARC archives: one gzip member per record, written by tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litquarry.llm.common import giving_back, new_folder, written
from litquarry.llm.files import input_stream, make_folder, output

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 20


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id) -> str:
    return f"<urn:page:{quote(str(page_id), safe='')}>"


def _record(page_id, url, payload: bytes, refers_to, digest_hex: str, date: str) -> bytes:
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if page_id is not None:
        fields.append(f"WARC-Record-ID: {_urn(page_id)}")
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    fields += [f"WARC-Date: {date}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode(), f"WARC-Block-Digest: {_digest(block)}"]
    if revisit:
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def plan_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every page; refers_to is null for responses.

    Of equal payloads of ``min_bytes`` bytes or more the largest id is the response. Null payload is empty.
    A page with a null id is always a response and nobody's target. Rows that repeat the largest id are
    responses too. Payloads are told apart by SHA-256; only ids and digests meet to find the targets, so a
    payload that a third of all pages hold is a partial aggregate, and payloads are shuffled by page.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha2("payload", 256).alias("key"))
    last = keyed.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where(F.col("least") < F.col("refers_to"))
    revisits = keyed.join(last, "key").where(F.col("page_id") < F.col("refers_to")).select("page_id", "key", "refers_to").distinct()
    return (
        rows.withColumn("key", F.sha2("payload", 256))
        .join(revisits, ["page_id", "key"], "left")
        .select("page_id", "url", "payload", F.sha1("payload").alias("digest"), "refers_to")
    )


def write_warc(planned: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per partition of ``plan_revisits`` to ``folder``; returns the written manifest (path, n_records)."""
    make_folder(folder)

    def archive(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        uri, n = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        with output(uri) as out:
            for batch in batches:
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(_record(page_id, url, payload.encode(), refers_to, digest, date))
                    n += 1
        yield pa.RecordBatch.from_pydict({"path": pa.array([uri], pa.string()), "n_records": pa.array([n], pa.int64())})

    return written(planned.sortWithinPartitions("page_id").mapInArrow(giving_back(archive), "path string, n_records long"), "warc-manifest")


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record, in order: members are inflated as they are read, framed by Content-Length.

    Raises ValueError on a truncated member, a wrong length or a block digest that doesn't match.
    """
    with input_stream(uri) as source:
        waiting = source.read(CHUNK)
        while waiting:
            inflate, parts = zlib.decompressobj(31), []
            while not inflate.eof:
                if not waiting and not (waiting := source.read(CHUNK)):
                    raise ValueError(f"{uri}: the last member is cut off")
                parts.append(inflate.decompress(waiting))
                waiting = inflate.unused_data
            head, found, body = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields.get("Content-Length", -1))
            if not found or lines[0] != VERSION or len(body) != size + 4 or body[size:] != b"\r\n\r\n":
                raise ValueError(f"{uri}: a record doesn't have the length that it states")
            block = body[:size]
            if _digest(block) != fields["WARC-Block-Digest"]:
                raise ValueError(f"{uri}: the block of {fields.get('WARC-Record-ID')} has another digest")
            yield fields, block
            waiting = waiting or source.read(CHUNK)


def read_warc(spark: SparkSession, manifest: DataFrame, *, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """Records of the archives that ``manifest`` names, one task's file at a time.

    page_id, url, record_type, refers_to, payload_bytes and payload_digest (hex SHA-1, both of the full payload:
    a revisit states them), and the payload of responses (null for revisits) unless ``with_payload`` is off.
    A payload that doesn't have its stated digest raises ValueError.
    """

    def scan(batches) -> Iterator:
        import pyarrow as pa

        def rows(uri: str) -> Iterator[tuple]:
            page = lambda x: None if x is None else unquote(x[len("<urn:page:") : -1])
            for fields, block in read_records(uri):
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                response = fields["WARC-Type"] == "response"
                if response and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(stated["Content-Length"])):
                    raise ValueError(f"{uri}: the payload of {fields.get('WARC-Record-ID')} has another digest or length")
                yield page(fields.get("WARC-Record-ID")), fields.get("WARC-Target-URI"), fields["WARC-Type"], page(fields.get("WARC-Refers-To")), int(stated["Content-Length"]), digest, payload.decode() if response and with_payload else None

        def batch(found: list[tuple]):
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

        for b in batches:
            for uri in b.column(0).to_pylist():
                found, held = [], 0
                for row in rows(uri):
                    found.append(row)
                    held += len(row[-1] or "") + 200
                    if held > 8 << 20:
                        yield batch(found)
                        found, held = [], 0
                if found:
                    yield batch(found)

    out = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload string"
    files = manifest.where(F.col("n_records") > 0).select("path")
    read = files.repartition(max(1, files.count())).mapInArrow(giving_back(scan), out)
    return read.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def warc_round_trip(pages: DataFrame, *, with_payload: bool = True, min_bytes: int = 1000, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    planned = plan_revisits(pages, min_bytes=min_bytes, **columns)
    manifest = write_warc(planned, new_folder(spark, "warc"))
    return read_warc(spark, manifest, id_type=planned.schema["page_id"].dataType.simpleString(), with_payload=with_payload)
