"""WARC archives as dictionary-compressed Zstandard: one skippable frame with the dictionary, then one frame a record."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, map_arrow, scratch, table

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary is trained on this many records at most, the first by hash among those with payloads of so many bytes at most.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 32 << 10, 64 << 10


def train_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary from sample records; empty where there is too little to train on."""
    import zstandard

    if sum(map(len, samples)) < 8 * 1024 or len(samples) < 8:
        return b""
    size = max(1024, min(DICTIONARY_BYTES, sum(map(len, samples)) // 10))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # the samples have too little in common
        return b""


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record: a response with the payload, or a revisit with the HTTP head only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, payload and its declared length; raises ValueError on a broken record or a payload that misses its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length mismatch")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError("payload digest mismatch")
    return {"fields": fields, "payload": payload, "length": length, "digest": digest}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records_in(stream) -> Iterator[bytes]:
    """Decompressed records of an open archive, one frame at a time; memory holds a record and a read buffer."""
    import zstandard

    start, kept = stream.read(8), b""
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == DICTIONARY_FRAME:
        words = stream.read(struct.unpack("<I", start[4:])[0])
        if words[:4] == struct.pack("<I", ZSTD_FRAME):
            words = zstandard.ZstdDecompressor().decompress(words)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    else:
        reader, kept = zstandard.ZstdDecompressor(), start
    while kept or (kept := stream.read(1 << 16)):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(kept))
            if frame.eof:
                kept = frame.unused_data
                break
            if not (kept := stream.read(1 << 16)):
                raise ValueError("archive ends inside a record")
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) below folder; gives (file, records, bytes) per archive.

    Of rows with equal payloads of at least min_payload bytes, those with the smallest page_id are responses and the others
    revisit it; smaller payloads are always responses. A null html is an empty payload, a null url leaves its header out, a
    null page_id is never the original when another row has an id. Repeated rows with the smallest id are responses each.
    Each task writes to a name of its own attempt and then moves the file, so a retried task replaces its own archive.
    Other columns are ignored. An empty table gives no archive.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= min_payload).groupBy("sha1").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1 and original is not null").select("sha1", "original"), "warc-groups")
    usable = rows.where((F.length("payload") > 0) & (F.length("payload") <= SAMPLE_BYTES))
    samples = usable.orderBy(F.xxhash64("sha1", "page_id"), "page_id", "url").limit(SAMPLE_RECORDS).collect()  # the least of each task, then of all
    words = train_dictionary([record_bytes(r.page_id, r.url, bytes(r.payload), sha1_base32(bytes(r.payload)), None, date) for r in samples])
    # groups is read from a table: if it is small the planner broadcasts it, else a sort-merge join whose hot digests AQE splits
    marked = rows.join(groups, "sha1", "left").select("page_id", "url", "payload", F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")).alias("refers_to"))

    def write(batches):
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        attempt = f"{base}/.{uuid.uuid4().hex}.tmp"
        options = {"level": level, "write_checksum": True}
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), **options) if words else zstandard.ZstdCompressor(**options)
        n = size = 0
        sink = None
        for b in batches:
            columns = [b.column(i) for i in range(4)]
            for page_id, url, body, refers_to in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3].to_pylist()):
                if sink is None:
                    sink = store.open_output_stream(attempt, compression=None)
                    if words:
                        packed = zstandard.ZstdCompressor(level=19).compress(words)
                        size += sink.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed) or 0
                body = body.as_buffer().to_pybytes()
                sink.write(packer.compress(record_bytes(page_id, url, body, sha1_base32(body), refers_to, date)))
                n += 1
        if sink is not None:
            size = sink.tell()
            sink.close()
            store.move(attempt, name)
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return cut(map_arrow(marked, write, "file string, records bigint, bytes bigint"), "warc-files")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to. Ids are integers."""

    def read(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        number = lambda x: int(x[10:-1]) if x and len(x) > 11 else None  # noqa: E731  <urn:page:N>
        for b in batches:
            for file in b.column(0).to_pylist():
                held, held_bytes = [], 0
                with store.open_input_stream(file, compression=None, buffer_size=1 << 16) as stream:
                    for raw in records_in(stream):
                        r = parse_record(raw)
                        f, response = r["fields"], r["fields"]["WARC-Type"] == "response"
                        held.append((number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), r["payload"] if response else None, r["length"], r["digest"], f["WARC-Type"], number(f.get("WARC-Refers-To"))))
                        held_bytes += len(raw)
                        if held_bytes > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)
                            held, held_bytes = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=names)

    n = max(1, files.count())
    return map_arrow(files.select("file").repartition(n, "file"), read, "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    files = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
