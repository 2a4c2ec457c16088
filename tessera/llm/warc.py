"""WARC archives of Zstandard frames with a dictionary.

An archive opens with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame or plain; each record after it is one
frame. The reader loads the dictionary, decodes frame by frame, and checks
each record: version line, needed headers, Content-Length against the block,
payload digest and payload length.

Of records with equal payloads of at least min_revisit bytes the one with the
largest id is a response, the others are revisits that refer to it and carry
no payload. Shorter payloads are always responses.

Contract: a null payload is empty. Rows with a null id are never chosen as
the target of a revisit while others exist; rows that repeat an id and its
payload are written once each: one of the copies is the response, the others
revisit it. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import files
from tessera.llm.files import frugal
from tessera.session import shared_dir, stored

SKIPPABLE = 0x184D2A5D
#: The dictionary is trained on at most so many payload bytes, taken from at most so many rows.
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 400, 2 << 20, 64 << 10
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
PARTS = "file string, n_records bigint, n_bytes bigint"
OUT = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: HTTP headers, and for a response the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Payload-Length", size), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    if url is not None:
        head.insert(2, ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", name(refers_to))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The checked content of one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if missing := [k for k in NEEDED if k not in fields]:
        raise ValueError(f"a record lacks {', '.join(missing)}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block has {len(rest) - 4} bytes; its header says {size}")
    number = lambda x: None if (i := re.fullmatch(r"<urn:x-page:(-?\d*)>", x)[1]) == "" else int(i)
    kind, block = fields["warc-type"], rest[:size]
    _, found, payload = block.partition(b"\r\n\r\n")
    sha1 = fields["warc-payload-digest"].removeprefix("sha1:")
    out = {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": int(fields["warc-payload-length"]), "payload_digest": sha1, "record_type": kind, "refers_to": None}
    if kind == "revisit":
        if payload or fields.get("warc-profile") != REVISIT:
            raise ValueError("a revisit must have its profile and no payload")
        out["refers_to"] = number(fields["warc-refers-to"])
    elif kind != "response" or not found or len(payload) != out["payload_bytes"] or hashlib.sha1(payload).hexdigest() != sha1:
        raise ValueError("a response's payload differs from its headers")
    return out


def write_dictionary(out, dictionary: bytes) -> None:
    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)


def read_records(f) -> Iterator[dict]:
    """Records of an archive; f: a binary stream."""
    head = f.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise ValueError("the archive doesn't open with a dictionary frame")
    raw = f.read(struct.unpack("<I", head[4:])[0])
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    held = b""
    frame, parts = reader.decompressobj(), []
    while True:
        if not held and not (held := f.read(1 << 20)):
            break
        parts.append(frame.decompress(held))
        held = b""
        if frame.eof:
            held = frame.unused_data
            yield parsed(b"".join(parts))
            frame, parts = reader.decompressobj(), []
    if parts:
        raise ValueError("the archive ends within a frame")


def trained(pages: DataFrame, payload_col: str) -> bytes:
    """A dictionary from a bounded sample: the starts of the first SAMPLE_ROWS payloads. Empty if that is too little to train on."""
    rows = pages.select(F.substring(F.coalesce(F.col(payload_col), F.lit("")), 1, SAMPLE_BYTES // SAMPLE_ROWS).alias("p")).limit(SAMPLE_ROWS).collect()
    samples = [r["p"].encode() for r in rows if r["p"]]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _write(folder: str, dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.zst"
        first = next(batches, None)
        if first is None:
            return
        writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        n = size = 0
        with files.writing(name) as out:
            write_dictionary(out, zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b"")
            b = first
            while b is not None:
                for page_id, url, payload, payload_size, sha1, refers_to, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "sha1", "refers_to", "revisit")), strict=True):
                    frame = writer.compress(record(page_id, url, payload.encode(), payload_size, sha1, refers_to, revisit))
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                b = next(batches, None)
        yield pa.RecordBatch.from_pydict({"file": [name], "n_records": [n], "n_bytes": [size]})

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for b in batches:
        for row in b.to_pylist():
            rows: list[dict] = []
            n = 0
            with files.opened(row["file"]) as f:
                for x in read_records(io.BufferedReader(f, 1 << 20)):
                    rows.append(x)
                    n += 1
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            if n != row["n_records"]:
                raise ValueError(f"{row['file']} holds {n} records; the list says {row['n_records']}")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 1000, level: int = 3) -> DataFrame:
    """Writes archives below folder and returns their list: file, n_records, n_bytes.

    Digests shrink to one row each before the shuffle (partial aggregation).
    Those that occur twice are written, so that the planner brings them to the
    payloads while they are few; payloads that turn out to be revisits leave
    their text behind before it is written. Nothing depends on rows' numbers:
    rows with one id and payload are counted by url, and come out as so many records.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload.cast("binary")).alias("sha1"))
    by_id = rows.filter(F.col("size") >= min_revisit).groupBy("sha1", "size", "page_id").agg(F.count(F.lit(1)).alias("c"))
    by_digest = by_id.groupBy("sha1", "size").agg(F.max(F.struct("page_id", "c")).alias("best"), F.sum("c").alias("n")).filter("n > 1")
    repeated = stored(by_digest.select(F.col("sha1").alias("r_sha1"), F.col("size").alias("r_size"), F.col("best.page_id").alias("best"), F.col("best.c").alias("ties")), "payload-digests")
    joined = rows.join(repeated, (F.col("sha1") == F.col("r_sha1")) & (F.col("size") == F.col("r_size")), "left")
    at_best = F.col("page_id").eqNullSafe(F.col("best"))
    revisit = F.col("ties").isNotNull() & ~at_best
    columns = ["page_id", "url", "payload", "size", "sha1", "refers_to", "revisit"]
    marked = joined.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("best"))).withColumn("payload", F.when(revisit, "").otherwise(F.col("payload")))
    if not repeated.filter("ties > 1").isEmpty():
        tied = F.col("ties").isNotNull() & (F.col("ties") > 1) & at_best
        alike = joined.filter(tied).groupBy("page_id", "sha1", "size", "url").agg(F.count(F.lit(1)).alias("c"), F.min("payload").alias("payload"))
        first = joined.filter(tied).groupBy(F.col("page_id").alias("f_id"), F.col("sha1").alias("f_sha1"), F.col("size").alias("f_size")).agg(F.min(F.struct("url")).alias("f"))
        copies = alike.join(first, F.col("page_id").eqNullSafe(F.col("f_id")) & (F.col("sha1") == F.col("f_sha1")) & (F.col("size") == F.col("f_size"))).withColumn("copy", F.explode(F.expr("sequence(1L, c)")))
        again = (F.col("copy") > 1) | ~F.col("url").eqNullSafe(F.col("f.url"))
        copies = copies.withColumn("revisit", again).withColumn("refers_to", F.when(again, F.col("page_id"))).withColumn("payload", F.when(again, "").otherwise(F.col("payload")))
        marked = marked.filter(~tied).select(columns).unionByName(copies.select(columns))
    marked = marked.select(columns)
    marked.mapInArrow(frugal(_write(folder, trained(pages, payload_col), level)), PARTS).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(PARTS).parquet(f"{folder}/manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the listed archives, checked."""
    # by number, so that the few rows of the list are not brought to one task
    return manifest.repartition(max(1, manifest.count())).mapInArrow(frugal(_read), OUT)


def archive_report(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes archives of all pages and reports on each record as read back."""
    return read_archives(write_archives(pages, folder or shared_dir(pages.sparkSession, "warc")))
