"""WARC archives of one Zstandard frame per record behind a dictionary in a leading skippable frame.

An archive is a string of bytes that follows the public WARC-Zstandard layout: a skippable frame with the magic number
0x184D2A5D holds the dictionary (itself compressed or not), then each record is a frame of its own. ``write`` makes
bounded archives as rows (archive, content), which Spark's own writers commit to any shared store; ``read`` takes such
rows, or files through Spark's binaryFile source.

Defined cases: a null payload is empty; a null URL leaves out WARC-Target-URI; a null page_id comes after all others
when the first of equal payloads is chosen; rows that repeat the first page_id and its payload are all responses; an
empty table makes no archive. Columns besides the named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, hash_sample

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 4_000_000
#: Rows and characters of each that a dictionary is trained on, and its size.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 4096, 32_768
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
ARCHIVES = "archive string, content binary"
RECORDS = "archive string, record_type string, record_id string, target_uri string, refers_to_id string, payload binary, payload_bytes long, payload_digest string, error string"


class WarcError(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, page_id: str = "page_id", payload: str = "html") -> bytes:
    """A dictionary from the starts of a bounded, hash-chosen sample of payloads; empty where too few are there to train on."""
    starts = pages.select(F.substring(F.col(payload), 1, SAMPLE_CHARS).alias("p"), F.col(page_id).alias("id"))
    chosen = hash_sample(starts.filter("p <> ''"), SAMPLE_ROWS, "id", of=pages)
    samples = sorted(r.p.encode() for r in chosen.collect())
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""  # samples too small or too much alike


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None, min_revisit: int = 0) -> bytes:
    """One uncompressed record. A revisit keeps the HTTP header, with the full payload's length, and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + quote(uri, safe="%:/?#[]@!$&'()*+,;=-._~"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def page_urn(page_id) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def with_revisits(pages: DataFrame, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload and refers_to: null for responses, else the smallest page_id with an equal payload of at least min_bytes bytes.

    Payloads meet by SHA-256. Only the digests of those that occur more than once, one row for each, join the pages: they
    travel to them if they are few, and else what joins by one popular payload can be split, since they are cut first.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    keyed = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("__key"), F.octet_length(body).alias("__bytes"))
    firsts = cut(keyed.filter(F.col("__bytes") >= min_bytes).groupBy("__key").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n"))
    return keyed.join(broadcast_if_small(firsts, 1_000_000), "__key", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first")).alias("refers_to"))


def write(pages: DataFrame, dictionary: bytes = b"", archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Archives of about archive_bytes at most, unless one record is larger, as rows of ARCHIVES. pages: see with_revisits."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        head = dictionary_frame(dictionary) if dictionary else b""
        frames, size, number, task = [head], len(head), 0, TaskContext.get().partitionId()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{number:06d}.warc.zst"]), pa.array([b"".join(frames)], pa.binary())], ["archive", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, uri, payload, first = (batch.column(k)[i].as_py() for k in range(4))
                frame = how.compress(record("response" if first is None else "revisit", page_urn(page), uri, payload.encode(), page_urn(first)))
                if len(frames) > 1 and size + len(frame) > archive_bytes:
                    yield made()
                    frames, size, number = [head], len(head), number + 1
                frames.append(frame)
                size += len(frame)
        if len(frames) > 1:
            yield made()

    return pages.mapInArrow(archives, ARCHIVES)


def frames_of(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """Each frame's magic number and the places where it begins and ends, from the block headers alone."""
    at, end = 0, len(data)
    while at < end:
        if end - at < 8:
            raise WarcError(f"{end - at} bytes after the last frame")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            stop = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        elif bytes(data[at : at + 4]) == FRAME_MAGIC:
            stop = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
            last = False
            while not last:
                if stop + 3 > end:
                    raise WarcError("a frame is cut short")
                head = int.from_bytes(data[stop : stop + 3], "little")
                last, kind = bool(head & 1), head >> 1 & 3
                stop += 3 + (1 if kind == 1 else head >> 3)
            stop += 4 * bool(data[at + 4] & 4)
        else:
            raise WarcError(f"no frame begins at byte {at}")
        if stop > end:
            raise WarcError("a frame is cut short")
        yield magic, at, stop
        at = stop


def load_dictionary(frame: bytes) -> zstandard.ZstdCompressionDict | None:
    raw = frame[8:]
    if raw[:4] == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw) if raw else None


_LINE = re.compile(r"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*?)[ \t]*\Z", re.S)


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    found: dict[str, str] = {}
    for line in lines:
        if not (m := _LINE.match(line)):
            raise WarcError(f"not a header: {line[:80]!r}")
        found.setdefault(m[1].lower(), m[2])
    return first, found


def parse(raw: bytes) -> dict:
    """One record, checked: version, mandatory headers, lengths, the closing line ends and the digests."""
    head, there, rest = raw.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    if not there or not re.fullmatch(r"WARC/1\.[01]", version):
        raise WarcError(f"no WARC header: {version[:40]!r}")
    if missing := [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in fields]:
        raise WarcError(f"headers are missing: {', '.join(missing)}")
    if not re.fullmatch(r"[0-9]+", fields["content-length"]) or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {fields['content-length']} does not fit a block of {len(rest) - 4} bytes")
    block = rest[:-4]
    if (said := fields.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != digest(block):
        raise WarcError("the block digest does not fit")
    payload, size, said = block, len(block), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = _fields(http)[1].get("content-length", "")
        size = int(length) if length.isdigit() else len(payload)
    if fields["warc-type"] != "revisit":
        if size != len(payload):
            raise WarcError(f"the payload has {len(payload)} bytes and should have {size}")
        if said and said != digest(payload):
            raise WarcError("the payload digest does not fit")
    elif payload or not said or "warc-refers-to" not in fields:
        raise WarcError("a revisit needs a payload digest, what it refers to, and no payload")
    bare = lambda s: s.strip("<>") if s else None
    return {"record_type": fields["warc-type"], "record_id": bare(fields["warc-record-id"]), "target_uri": fields.get("warc-target-uri"), "refers_to_id": bare(fields.get("warc-refers-to")), "payload": None if fields["warc-type"] == "revisit" else payload, "payload_bytes": size, "payload_digest": said or digest(payload)}


def records(content: bytes) -> Iterator[dict]:
    """The records of one archive. A record that fails its checks becomes a row with its error; broken framing ends the archive with one such row."""
    how = zstandard.ZstdDecompressor()
    data = memoryview(content)
    try:
        for magic, begin, end in frames_of(data):
            frame = bytes(data[begin:end])
            if magic == DICTIONARY_MAGIC and begin == 0:
                how = zstandard.ZstdDecompressor(dict_data=load_dictionary(frame))
            elif frame[:4] == FRAME_MAGIC:
                try:
                    yield parse(how.decompressobj().decompress(frame))
                except (WarcError, zstandard.ZstdError) as e:
                    yield {"error": f"{type(e).__name__}: {e}"}
    except (WarcError, zstandard.ZstdError) as e:
        yield {"error": f"{type(e).__name__}: {e}"}


def read(archives: DataFrame, errors: str = "raise", payloads: bool = True) -> DataFrame:
    """The records of archives (archive, content) as RECORDS. errors: raise, or report them in the error column."""
    schema = pa.schema([("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                out, size = [], 0
                for r in records(content.as_buffer()):
                    if "error" in r and errors == "raise":
                        raise WarcError(f"{name.as_py()}: {r['error']}")
                    size += len(r.get("payload") or b"")
                    out.append(r | {"archive": name.as_py()} | ({} if payloads else {"payload": None}))
                    if size > 16_000_000 or len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return archives.select("archive", "content").mapInArrow(rows, RECORDS)


def read_files(spark, path: str, errors: str = "raise") -> DataFrame:
    """The records of *.warc.zst files in any store that Spark reads."""
    return read(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"), errors)


def export_files(archives: DataFrame, folder: str) -> int:
    """Writes each archive as a file into a folder that executors reach by a pyarrow file system; a file appears whole or not at all. Returns the number of files."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                store.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return archives.select("archive", "content").mapInArrow(files, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
