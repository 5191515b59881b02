"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame; writer and reader."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, materialize, scratch, table

#: Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS, SAMPLE_CHARS = 256, 8192
SALTS = 16
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary or string column."""
    digest = F.sha1(payload)
    symbols = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        symbols += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*symbols)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or, where the samples are too few to train on, their first bytes as plain content."""
    try:
        return zstd.train_dictionary(size, samples).as_bytes()
    except (zstd.ZstdError, ValueError):
        return (b"".join(samples) or b"WARC/1.1\r\nContent-Length: ")[:size]


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers.items()] + [f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def page_record(number: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit of the response of page ``refers_to``: the same HTTP header, no payload.

    The record's id is that of its page; records of pages without id have one of their archive and place, with a slash before.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {"WARC-Type": "revisit" if refers_to is not None else "response", "WARC-Record-ID": f"<urn:page:{number}>", "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(0x21, 0x7F))))
    headers |= {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
        return warc_record(headers, http)
    return warc_record(headers, http + payload)


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows ``(page_id, url, payload, payload_digest, refers_to)``; returns ``(path, records)``, one row per archive.

    A task writes archives of about ``archive_bytes`` under names of its own attempt, so a task that is run again never
    mixes with what a lost one left; only archives in the returned list count.
    """
    rows = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), "payload", "payload_digest", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        packer = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(dictionary), write_content_size=True)
        paths, counts, out, size = [], [], None, 0
        for batch in batches:
            for page, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is not None and size >= archive_bytes:
                    out.close()
                    out = None
                if out is None:
                    paths.append(f"{uuid.uuid4().hex}.warc.zst")
                    counts.append(0)
                    out = fs.open_output_stream(f"{root}/{paths[-1]}", compression=None)
                    size = out.write(leading_frame(dictionary))
                number = page if page is not None else f"/{paths[-1][:32]}-{counts[-1]}"  # a page without id: by its place
                size += out.write(packer.compress(page_record(number, url, payload, digest, refers)))
                counts[-1] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return rows.mapInArrow(run, "path string, records long")


def frames(archive: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The decoded record of each frame, or None and what is wrong with it; a dictionary comes from a leading skippable frame."""
    view, at, decoder = memoryview(archive), 0, zstd.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            yield None, "cut short"
            return
        magic, size = struct.unpack_from("<II", view, at)
        if magic == SKIPPABLE_MAGIC and at == 0:
            content = bytes(view[8 : 8 + size])
            if content[:4] == struct.pack("<I", FRAME_MAGIC):  # the dictionary may itself be compressed
                content = zstd.ZstdDecompressor().decompressobj().decompress(content)
            decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content))
            at += 8 + size
        elif magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        elif magic != FRAME_MAGIC:
            yield None, "no frame"
            return
        else:
            end = frame_end(view, at)
            if end is None:
                yield None, "cut short"
                return
            try:
                data = decoder.decompressobj().decompress(view[at:end])
            except zstd.ZstdError as e:
                yield None, f"broken frame: {e}"
                return
            at = end
            yield data, None


def frame_end(view: memoryview, at: int) -> int | None:
    """Where the frame that starts at ``at`` ends, found from its block headers; None if the data end before."""
    try:
        frame = zstd.get_frame_parameters(view[at : at + 18])
        at += zstd.frame_header_size(view[at : at + 18])
        last = False
        while not last:
            block = int.from_bytes(view[at : at + 3], "little") if at + 3 <= len(view) else None
            if block is None:
                return None
            last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
            at += 3 + (1 if kind == 1 else size)  # a block of kind 1 repeats one byte
    except zstd.ZstdError:
        return None
    at += 4 * frame.has_checksum
    return at if at <= len(view) else None


def parse_record(data: bytes) -> dict:
    """Fields of a record; ``error`` says which check failed (version, headers, lengths, digest), or is None."""
    out = dict.fromkeys(("page", "url", "type", "digest", "refers_to", "payload", "payload_bytes", "error"))
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            return out | {"error": "broken header"}
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not gap or not version.startswith(b"WARC/1."):
        return out | {"error": "no WARC version"}
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]:
        return out | {"error": f"no {missing[0]}"}
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "wrong length"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or not sizes or not sizes[0].isdigit():
        return out | {"error": "broken HTTP header"}
    of = lambda h: headers[h].removeprefix("<urn:page:").removesuffix(">") if h in headers else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    page = of("warc-record-id")
    out |= {"page": None if not page or page[0] == "/" else page, "url": headers.get("warc-target-uri"), "type": headers["warc-type"], "digest": digest, "refers_to": of("warc-refers-to"), "payload_bytes": int(sizes[0])}
    if out["type"] == "revisit":
        return out | {"error": None if not payload and out["refers_to"] else "broken revisit"}
    if len(payload) != out["payload_bytes"]:
        return out | {"error": "wrong payload length"}
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        return out | {"error": "wrong digest"}
    return out | {"payload": payload}


def read_archives(files: DataFrame) -> DataFrame:
    """Records of ``files(path, content)``, as Spark's ``binaryFile`` source gives them: one row per frame.

    Columns: path, page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for a revisit),
    error (null if every check holds). A broken frame ends its archive with a row that says why.
    """
    schema = "path string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"
    names = ("page", "url", "type", "payload_bytes", "digest", "refers_to", "payload", "error")
    empty = dict.fromkeys(names)
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
    columns = ("path", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "error")

    def batch(path: str, got: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(got), pa.string()), *(pa.array([x[n] for x in got], k) for n, k in zip(names, kinds, strict=True))], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = []
                for data, error in frames(content.as_buffer()):
                    got.append(parse_record(data) if error is None else empty | {"error": error})
                    if len(got) == 500:
                        yield batch(path, got)
                        got = []
                yield batch(path, got)

    return files.select("path", "content").mapInArrow(run, schema)


def with_revisits(pages: DataFrame, least_bytes: int = 0, salts: int = SALTS) -> DataFrame:
    """``(page_id, url, payload, payload_digest, refers_to)``: among equal payloads of ``least_bytes`` or more, all but the
    largest page_id refer to it. Null html is empty.

    Groups of copies are found by a partial aggregation of digests; what joins back to the pages is one narrow row per
    group of copies, and a hot group's pages are spread over ``salts`` keys.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    large = F.octet_length("payload") >= least_bytes
    copies = rows.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    copies = copies.select("payload_digest", "response", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int"))  # any will do: a group is under every salt
    joined = rows.join(copies, ["payload_digest", "salt"], "left")
    refers = F.when(large & (F.coalesce(F.col("page_id") < F.col("response"), F.col("response").isNotNull())), F.col("response"))
    return joined.select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def archive_pages(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page to archives in the shared folder; the list of archives ``(path, records)`` with full paths.

    The dictionary is trained on at most ``SAMPLE_ROWS`` pages (first by a hash of page_id); it changes sizes only.
    Repeated rows give a record each: those of the largest page_id are all responses. An empty table has no archives.
    """
    spark = pages.sparkSession
    short = pages.where("html is not null").select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    sample = bounded_sample(short, "page_id", SAMPLE_ROWS).select("html").collect()
    dictionary = train_dictionary([r[0].encode() for r in sample])
    folder = scratch(spark, "warc")
    listed = write_archives(with_revisits(pages, least_bytes), folder, dictionary, archive_bytes)
    return materialize(listed.select(F.concat(F.lit(f"{folder}/"), "path").alias("path"), "records"), "warc-list")


def archive_files(listed: DataFrame) -> DataFrame:
    """``(path, content)`` of the listed archives, read by Spark; archives that a lost attempt left are not in the list."""
    spark = listed.sparkSession
    first = listed.select("path").first()
    if first is None:
        return spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(first[0].rpartition("/")[0])
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", "content", name.alias("name")).join(listed.select(name.alias("name")), "name", "left_semi").select("path", "content")


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` through archives and back."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    back = read_archives(archive_files(archive_pages(pages)))
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("broken record: "), "error")))
    return back.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", checked.cast("string").alias("record_type"), F.col("refers_to").cast(kind))


#: Base32 is written out by groups of five hex digits (20 bits, four symbols).
OP4_SQL = (
    "WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), "
    "m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p) "
    "SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, "
    + " || ".join(f"substr('{BASE32}', ((('0x' || substr(h, {k + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for k in range(0, 40, 5) for s in (15, 10, 5, 0))
    + " AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, "
    "CASE WHEN page_id <> last THEN last END AS refers_to FROM m"
)
