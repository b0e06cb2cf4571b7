"""WARC archives whose records are Zstandard frames of their own, compressed with a dictionary that the archive carries."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimcheck.llm.common import new_folder

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads below this many bytes are always stored; a revisit would save nothing.
MIN_REVISIT_BYTES = 100
#: A new archive begins when the records of the open one have this many bytes before compression.
ARCHIVE_BYTES = 32 << 20
#: Size of a dictionary, and the bytes of records, taken evenly from the whole archive, that it is built from.
DICTIONARY_BYTES, TRAINING_BYTES = 64 << 10, 4 << 20
LEVEL = 3

WRITTEN = "path string, records long, bytes long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the payload's length, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = response_id is not None
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("Page-Id", page_id),
        ("Refers-To-Page-Id", response_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records that are spread evenly over the archive; None if they are too few to give one."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x[: 1 << 17] for x in records[::step]], steps=1, d=8, k=256)
    except zstandard.ZstdError:
        return None


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame, then each record as a frame. Without a dictionary no such frame leads."""
    dictionary = build_dictionary(records)
    out = []
    if dictionary is not None:
        raw = dictionary.as_bytes()
        out.append(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
        dictionary.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    return b"".join([*out, *(compressor.compress(x) for x in records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    view, dictionary, at = memoryview(archive), None, 0
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE_MAGIC:
        (size,) = struct.unpack_from("<I", view, 4)
        dictionary, at = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])), 8 + size
    while at < len(view):
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, step = [], 1 << 18
        while not reader.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("the archive ends within a record")
            parts.append(reader.decompress(chunk))
            at += len(chunk)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record that _record made."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda k: int(fields[k]) if k in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of page {fields.get('Page-Id')} does not match its digest")
        return number("Page-Id"), fields.get("WARC-Target-URI"), len(payload), digest, "response", None, payload
    length = int(http.rpartition(b"Content-Length: ")[2])
    return number("Page-Id"), fields.get("WARC-Target-URI"), length, digest, "revisit", number("Refers-To-Page-Id"), None


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    """Writes archives; gives their paths.

    A repeated attempt makes the same archives of its sorted rows. It writes under a name of its own and then takes the
    archive's, so a lost or doubled attempt does no harm.
    """
    from pyspark import TaskContext

    task = TaskContext.get()
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    records, held, n = [], 0, 0

    def seal() -> pa.RecordBatch:
        nonlocal records, held, n
        name = f"{task.partitionId():06d}-{n:04d}.warc.zst"
        data = pack(records)
        draft = f"{root}/_{name}-{task.taskAttemptId()}"
        with files.open_output_stream(draft, compression=None) as out:
            out.write(data)
        files.move(draft, f"{root}/{name}")
        row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)]), pa.array([len(data)])], ["path", "records", "bytes"])
        records, held, n = [], 0, n + 1
        return row

    for batch in batches:
        for page_id, url, html, digest, response_id in zip(*batch.columns, strict=True):
            records.append(_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), digest.as_py(), response_id.as_py(), date))
            held += len(records[-1])
            if held >= ARCHIVE_BYTES:
                yield seal()
    if records:
        yield seal()


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_digest, response_id) of each page; response_id is null unless the page is a revisit.

    Of pages with equal payloads of at least min_bytes bytes the least page_id is the response. Rows that share the
    least page_id are all responses; a null page_id is never the least and revisits it, and without any other all are responses.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(payload, 256)
    heads = pages.where(F.octet_length(payload) >= min_bytes).groupBy(F.unhex(digest).alias("digest")).agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    found = pages.withColumns({"payload_digest": digest, "_key": F.when(F.octet_length(payload) >= min_bytes, F.unhex(digest))})
    found = found.join(heads, F.col("_key") == F.col("digest"), "left")
    return found.select("page_id", "url", "html", "payload_digest", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("least")), F.col("least")).alias("response_id"))


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages (page_id, url, html) into archives (*.warc.zst) under folder.

    A null html is an empty payload, a null page_id or url leaves its field out; an empty table gives no archive. Other
    columns are ignored. The folder is a URI that all executors can write to.
    """
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    ordered = with_revisits(pages).sortWithinPartitions("page_id", "url", "payload_digest")
    ordered.mapInArrow(lambda it: _write(it, folder, date), WRITTEN).write.format("noop").mode("overwrite").save()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the folder's archives. Responses are checked against their digest; revisits have no payload."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for archive in batch.column(0):
                some, held = [], 0
                for record in unpack(archive.as_py()):
                    some.append(parse(record))
                    held += len(record)
                    if held > ARCHIVE_BYTES // 4:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)
                        some, held = [], 0
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content").mapInArrow(rows, READ)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages into archives and reads them back."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{os.path.abspath(folder)}"
    write_warc(pages, folder)
    return read_warc(spark, folder)
