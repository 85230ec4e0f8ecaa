"""Archives of records, each compressed alone with a Zstandard dictionary that the archive itself carries in its first frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm.store import keep, new_path

#: Fixed values of the formats: the skippable frame that announces a dictionary, and the profile of a revisit.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit with the payload's HTTP header only."""
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    broken = url is not None and ("\r" in url or "\n" in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {escaped(url) if broken else url}"] if url is not None else []),
        *(["WARC-Target-URI-Escaped: line-ends"] if broken else []),
        *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def escaped(url: str) -> str:
    """A url on one line: line ends as %0D and %0A. One that holds a line end says so, and its own such escapes are escaped, so that reading restores it."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def parse(data: bytes) -> tuple:
    """A record's row; a payload that does not fit its digest or lengths raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    found = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != found):
        raise ValueError("a payload doesn't fit its digest")
    number = lambda key: int(fields[key]) if key in fields else None
    url = fields.get("WARC-Target-URI")
    if "WARC-Target-URI-Escaped" in fields:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return number("WARC-Page-ID"), url, size, found, fields["WARC-Type"], number("WARC-Refers-To-Page-ID")


def train(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary from records; too few of them serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].rjust(8, b"\n"))


class Archive:
    """One file: the dictionary in a skippable frame, then a frame per record. The name appears when the file is whole."""

    def __init__(self, path: str, dictionary: zstandard.ZstdCompressionDict, level: int) -> None:
        self.files, self.path = fs.FileSystem.from_uri(path)
        self.part = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.part"
        self.out = self.files.open_output_stream(self.part)
        data = dictionary.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
        self.bytes = self.records = 0

    def add(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.bytes += len(frame)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.files.move(self.part, self.path)
        return self.path, self.records, self.bytes


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive's bytes."""
    kind, size = struct.unpack_from("<II", data)
    if kind != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    view = memoryview(data)[8 + size :]
    while len(view):
        frame = decompressor.decompressobj()
        parts, at = [], 0
        while not frame.eof:
            step = view[at : at + 65536]
            if not len(step):
                raise ValueError("an archive ends within a frame")
            parts.append(frame.decompress(step))
            at += len(step)
        view = view[at - len(frame.unused_data) :]
        yield b"".join(parts)


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = 16_000_000, dictionary_bytes: int = 32_768, sample_bytes: int = 1_000_000, level: int = 6, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` under ``path``; returns (file, records, bytes) per archive.

    Of equal payloads of at least ``least_bytes`` bytes the one with the least page_id is written whole, rows with others are
    revisits of it. Payloads compare by SHA-1 and length, counted before any page is moved, so many copies of one page are not
    gathered. Pages with a null page_id are always written whole; repeated rows of one page_id and payload are one page, each
    written alike. A null html is an empty payload. Rows are sorted in each task and files named by task, so a task that runs
    again writes the same files; a file takes its name when it is whole. A file's dictionary is trained on its first
    ``sample_bytes`` of records.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    slim = rows.where(F.col("page_id").isNotNull() & (F.col("size") >= least_bytes)).select("page_id", "digest", "size")
    firsts = slim.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    again = slim.join(firsts.drop("last"), ["digest", "size"]).where("page_id > refers_to").distinct()
    dealt = rows.join(again, ["page_id", "digest", "size"], "left").sortWithinPartitions("page_id", "digest", "url")

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, archive, held, done, sequence = TaskContext.get().partitionId(), None, [], [], 0

        def begin() -> Archive:
            nonlocal sequence
            sequence += 1
            out = Archive(f"{path}/part-{task:06d}-{sequence:04d}.warc.zst", train(held, dictionary_bytes), level)
            for data in held:
                out.add(data)
            held.clear()
            return out

        waiting = 0
        for batch in batches:
            for page, url, payload, refers in zip(batch["page_id"].astype("Int64"), batch["url"], batch["payload"], batch["refers_to"].astype("Int64")):
                data = record(None if pd.isna(page) else int(page), url, bytes(payload), None if pd.isna(refers) else int(refers), date)
                if archive:
                    archive.add(data)
                else:
                    held.append(data)
                    waiting += len(data)
                    if waiting >= sample_bytes:
                        archive, waiting = begin(), 0
                if archive and archive.bytes >= file_bytes:
                    done.append(archive.close())
                    archive = None
        if held:
            archive = begin()
        if archive:
            done.append(archive.close())
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    files, folder = fs.FileSystem.from_uri(path)
    files.create_dir(folder, recursive=True)
    columns = dealt.select("page_id", "url", "payload", "refers_to")
    return keep(columns.mapInPandas(written, "file string, records long, bytes long"), "archives")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Rows come back as they were written: null ids and urls as null, urls with line ends as they were, repeated rows as often, in no order; no archives or
    empty ones give no rows. A record is held whole, so the longest page bounds the memory; a file's other records are not.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                out = pd.DataFrame([parse(r) for r in read_archive(bytes(content))], columns=[c.split()[0] for c in ROWS.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("content").mapInPandas(rows, ROWS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives into the shared folder and read them back. An empty table gives an empty result."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
