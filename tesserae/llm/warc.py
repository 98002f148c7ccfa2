"""WARC archives: a writer with one gzip member a record, and a sequential reader.

Archives go to the shared folder through its own file system (a URI other than of files
is opened by pyarrow with its own credentials), so any executor can read what another one
wrote. A part has the attempt of its task in its name, and the manifest, which Spark
commits once a task, says which parts count: a task that runs twice leaves parts behind
that nobody reads.

The reader inflates member by member in blocks of 64 KiB, takes the block by its
Content-Length, and compares the digest of the payload with the header's, the number of
records with the manifest's. A difference or a cut-off member raises; ``strict=False``
reports records of another digest with verified = false instead.

Of pages with equal payloads that with the largest page_id is the response and the
others revisit it; payloads that much of all pages share are found by a broadcast of their
digests, so these pages are not gathered; rows that repeat that page_id are responses too. Null html is an
empty payload, null url an empty target, null page_id is below every other one. An
empty table writes no record and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import join_skewed
from tesserae.runtime import cut, shared_dir, tune

BLOCK = 1 << 16
ROTATE = 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long, size long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def encode_record(page_id, url: str, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit without payload."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Date": "2020-01-01T00:00:00Z",
        "WARC-Target-URI": re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest32(payload)}",
        "WARC-Block-Digest": f"sha1:{digest32(block)}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def iter_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream with read(n)."""
    rest = b""
    while rest or (rest := stream.read(BLOCK)):
        member, data, need, head = zlib.decompressobj(31), bytearray(), None, {}
        while not member.eof:
            if not rest and not (rest := stream.read(BLOCK)):
                raise ValueError("the archive ends inside a record")
            data += member.decompress(rest)
            rest = member.unused_data if member.eof else b""
            if need is None and (at := data.find(b"\r\n\r\n")) >= 0:
                lines = bytes(data[:at]).decode("utf-8", "surrogatepass").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
                need = int(head["Content-Length"])
                del data[: at + 4]
        if need is None or len(data) != need + 4 or data[need:] != b"\r\n\r\n":
            raise ValueError("a record differs from its Content-Length")
        yield head, bytes(data[:need])


def _file_system(base: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", base) if re.match(r"[a-z0-9]+:", base) else f"file://{base}")


def write_archives(pages: DataFrame) -> DataFrame:
    """Writes page_id, url, html; returns the manifest: path, records, size."""
    spark = pages.sparkSession
    tune(spark)
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("__d", F.sha1("payload"))
    again = rows.groupBy("__d").agg(F.max("page_id").alias("__keep"), F.count("*").alias("__n")).filter("__n > 1")
    rows = join_skewed(rows, cut(again, "warc-copies"), ["__d"], "__n", pages.count(), "left")
    rows = rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("__keep")), F.col("__keep")).alias("refers_to"))

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = _file_system(base)
        system.create_dir(root, recursive=True)
        out, part, done = None, 0, []

        def close():
            out.close()
            done.append((f"{base}/{name}", records, size))

        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    name, records, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part:04d}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                    part += 1
                data = encode_record(page_id, url, payload, refers)
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= ROTATE:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "size"])

    return cut(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, strict: bool = True) -> DataFrame:
    """Every record of the archives of a manifest, in the columns of ``RECORD``."""

    def read(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_())])
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = _file_system(path)
                rows, met = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for head, block in iter_records(stream):
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        whole, met = head["WARC-Type"] == "response", met + 1
                        good = digest32(block) == head["WARC-Block-Digest"].removeprefix("sha1:") and (not whole or digest32(payload) == told)
                        if strict and not good:
                            raise ValueError(f"record {met} of {path} differs from its digest")
                        refers = re.sub(r"[^-0-9]", "", head.get("WARC-Refers-To", "").rpartition(":")[2])
                        rows.append((
                            int(head["X-Page-ID"]) if head["X-Page-ID"] else None, head["WARC-Target-URI"],
                            len(payload) if whole else int(head["X-Payload-Length"]), digest32(payload) if whole else told,
                            head["WARC-Type"], int(refers) if refers else None,
                            good,
                        ))
                        if len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows = []
                if met != records:
                    raise ValueError(f"{path} has {met} records, not {records}")
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    paths = manifest.select("path", "records")
    return paths.repartition(max(1, min(paths.count(), 20_000))).mapInArrow(read, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = read_archives(write_archives(pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    nibble = lambda k: f"(instr('0123456789abcdef', h[{k}]) - 1)"
    five = f"((({nibble('(5 * i) // 4 + 1')} * 16 + {nibble('(5 * i) // 4 + 2')}) >> (3 - (5 * i) % 4)) & 31) + 1"
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
    SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {five}, 1)), '') AS payload_digest,
      CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> keep THEN keep END AS refers_to FROM k"""
