"""WARC archives in Zstandard frames: a dictionary in a leading skippable frame, then one frame per record.

Archives are files in the folder that the cluster shares. Every attempt of a task gives its files names of their
own, and the list of files, a table that Spark commits, has only those of the attempts that counted; so a task that runs
again or twice leaves files that nobody reads. Reading takes the files on the list through Spark's binary
file source, loads the dictionary, decodes frame by frame and checks headers and
lengths. A file is cut at ``roll`` bytes, so that it fits in a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import send_if_small, shared_dir, table, text_bytes

#: Fixed values of the formats: the skippable frame that holds a dictionary, a Zstandard frame, a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
TRAINED = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id) -> str:
    return f"<urn:page:{page_id}>"


def encode_record(page_id, url: str | None, payload: bytes, kind: str, refers_to=None) -> bytes:
    """One record. A revisit has an empty block and the digest and the full length of its payload."""
    block = payload if kind == "response" else b""
    sha = digest(payload)
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers and block of one record; ValueError if version, headers, lengths or digests are wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("not a WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, header says {length}")
    block = rest[:length]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    return fields, block


def train_dictionary(samples: list[bytes], size: int = 16_384):
    """A Zstandard dictionary of some records; of the records themselves where they are too few to train on."""
    import zstandard

    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _load_dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if data.startswith(TRAINED) else zstandard.DICT_TYPE_RAWCONTENT)


def encode_archive(records: list[bytes], level: int = 3) -> bytes:
    import zstandard

    dictionary = train_dictionary([r[:4096] for r in records[:: max(1, len(records) // 128)]])
    raw = dictionary.as_bytes()
    press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw + b"".join(press.compress(r) for r in records)


def decode_archive(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """The records of an archive; ValueError where it is malformed."""
    import zstandard

    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise ValueError("dictionary frame is cut off")
        raw = data[8 : 8 + size]
        if raw.startswith(ZSTD_FRAME):  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = _load_dictionary(raw), 8 + size
    view = memoryview(data)
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if bytes(view[at : at + 4]) != ZSTD_FRAME:
            raise ValueError(f"no frame at byte {at}")
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        out, used = [], at
        while not d.eof:
            if used >= len(data):
                raise ValueError("frame is cut off")
            part = view[used : used + 65_536]
            try:
                out.append(d.decompress(part))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame at byte {at}: {e}") from e
            used += len(part)
        at = used - len(d.unused_data)
        yield decode_record(b"".join(out))


def _write(folder: str, roll: int):
    def write(batches: Iterator):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        attempt = uuid.uuid4().hex

        def close():
            nonlocal number, held, size
            name = f"{task:06d}-{number:06d}-{attempt}.warc.zst"
            with store.open_output_stream(f"{root}/_draft-{name}", compression=None) as f:  # the frames are made here
                f.write(encode_archive(held))
            store.move(f"{root}/_draft-{name}", f"{root}/{name}")
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["file", "records"])
            number, held, size = number + 1, [], 0
            return done

        for batch in batches:
            ids, urls, payloads, kinds, refers = (batch.column(i) for i in range(5))
            for i, u, p, k, r in zip(ids.to_pylist(), urls.to_pylist(), text_bytes(payloads), kinds.to_pylist(), refers.to_pylist(), strict=True):
                held.append(encode_record("" if i is None else i, u, p or b"", k, r))
                size += len(held[-1])
                if size >= roll:
                    yield close()
        if held:
            yield close()

    return write


def classify(pages: DataFrame, least_bytes: int = 0, keep: str = "largest", id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` with record_type and refers_to: of equal payloads of at least ``least_bytes`` bytes the row with
    the largest (``keep="smallest"``: smallest) id is the response; others revisit it. Smaller ones are all responses. Rows
    that repeat the response's id are responses; payloads of only null ids are responses. Columns with the two new names are replaced."""
    rows = pages.select(F.struct(*[c for c in pages.columns if c not in ("record_type", "refers_to")]).alias("row"))
    payload, page = F.coalesce(F.col(f"row.`{payload_col}`"), F.lit("")), F.col(f"row.`{id_col}`")
    marked = rows.withColumn("key", F.when(F.octet_length(payload) >= least_bytes, F.sha2(payload, 256)))
    best = F.max(page) if keep == "largest" else F.min(page)
    first = marked.filter("key is not null").groupBy("key").agg(best.alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("key", "first")
    joined = marked.join(send_if_small(first, "first-pages"), "key", "left")
    again = F.col("first").isNotNull() & ~page.eqNullSafe(F.col("first"))
    return joined.select("row.*", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, roll: int = 8 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the classified pages as archives into ``folder``; returns the list of files (file, records)."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    files = pages.select(id_col, url_col, payload_col, "record_type", "refers_to").mapInArrow(_write(folder, roll), "file string, records long")
    files.write.parquet(f"{folder}/_files")
    return pages.sparkSession.read.schema("file string, records long").parquet(f"{folder}/_files")


def read_archives(spark: SparkSession, folder: str, files: DataFrame | None = None) -> DataFrame:
    """Records of the archives of a folder that are in ``files`` (column file, as ``write_archives`` returns it; default: the
    list in the folder): record_id, url, record_type, refers_to, payload_length, payload_digest, block (bytes). A malformed archive fails the read."""

    def read(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                out: list = []
                for h, block in decode_archive(data):
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    length = int(h.get("x-payload-length", len(block)))
                    if h["warc-type"] == "response" and (stated != digest(block) or length != len(block)):
                        raise ValueError(f"payload of {h['warc-record-id']} differs from its header")
                    out.append((h["warc-record-id"], h.get("warc-target-uri"), h["warc-type"], h.get("warc-refers-to"), length, stated, block))
                    if len(out) >= 1024:
                        yield _rows(pa, out)
                        out = []
                if out:
                    yield _rows(pa, out)

    if files is None:
        files = spark.read.schema("file string, records long").parquet(f"{folder}/_files")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")
    listed = found.join(send_if_small(files.select("file"), "archives"), "file", "left_semi").select("content")
    return listed.mapInArrow(read, "record_id string, url string, record_type string, refers_to string, payload_length long, payload_digest string, block binary")


def _rows(pa, out):
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["record_id", "url", "record_type", "refers_to", "payload_length", "payload_digest", "block"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def op8_warc(spark, sf_dir):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(classify(table(spark, sf_dir, "pages")), folder)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    records = read_archives(spark, folder, files)
    return records.select(page(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), g AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS resp FROM p
), b AS (
  SELECT *, CAST(unhex(h) AS BIT)::VARCHAR AS bits FROM g
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
         + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = resp THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> resp THEN resp END AS refers_to
FROM b
"""
