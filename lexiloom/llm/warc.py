"""WARC archives, written from and read as tables of payload chunks.

A payload travels as rows (record, chunk number), a bounded piece in each, so
neither side needs memory for a whole record. Each chunk row that is read
carries the SHA-1 of the payload so far; that of the last row is the payload's.
Every record is a gzip member of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import all_passing, bounded_batches, cut, flag_bits, new_folder, one_task_a_file, whole_text
from .files import create, stream

#: Code points of a payload chunk that is written, bytes of one that is read.
CHUNK = 1 << 16
#: Smaller payloads are never replaced by a revisit.
LEAST = 1000
FILE_BYTES = 256 << 20

_CHUNKS = "page_id bigint, record_type string, refers_to bigint, url string, declared_bytes bigint, declared_digest string, chunk_no bigint, chunk_bytes bigint, payload_bytes bigint, running_digest string, last boolean, data binary"


def chunk_table(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages(page_id, url, html)`` -> record header columns and payload chunks.

    Of records with equal payloads of ``least`` bytes or more the largest
    page_id is the response and the others are revisits without payload. A null
    page_id is never the larger; rows that repeat a page_id with its payload are
    alike. Null html is an empty payload, null url an empty address.
    """
    spark = pages.sparkSession
    html = whole_text("html")
    size, digest = F.octet_length(html).cast("bigint"), F.sha1(html.cast("binary"))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), size.alias("n_bytes"), digest.alias("digest"), F.concat_ws(":", digest, F.xxhash64(html).cast("string"), size.cast("string")).alias("same"))
    # narrow: of payloads that are large enough and there more than once, which page keeps it
    large = base.where(F.col("n_bytes") >= least).groupBy("same")
    chosen = cut(large.agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "keep"))
    shared = spark.sparkContext.broadcast(flag_bits(chosen, F.xxhash64("same")))

    def flagged(hashes: pa.Array) -> pa.Array:
        return pa.array(all_passing(shared.value, hashes.to_numpy(zero_copy_only=False)))

    # only pages that may have a partner are sent to it; the others stay where they are
    seen = base.withColumn("partner", (F.col("n_bytes") >= least) & arrow_udf(flagged, "boolean")(F.xxhash64("same")))
    met = seen.where("partner").join(chosen, "same", "left")
    alone = seen.where("not partner").withColumn("keep", F.lit(None).cast(pages.schema["page_id"].dataType))
    marked = (
        met.select(alone.columns)
        .unionByName(alone)
        .withColumn("revisit", F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep")))
        .select("page_id", "url", "n_bytes", "digest", F.when(F.col("revisit"), F.col("keep")).alias("refers_to"), F.when(~F.col("revisit"), F.col("html")).otherwise("").alias("html"))
    )
    pieces = F.regexp_extract_all("html", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))  # in one pass over the payload
    pieces = F.when(F.col("html") == "", F.array(F.lit(""))).otherwise(pieces)
    return marked.select("page_id", "url", "n_bytes", "digest", "refers_to", F.posexplode(pieces).alias("chunk_no", "data")).select("page_id", "url", "n_bytes", "digest", "refers_to", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("data").cast("binary").alias("data"))


def _header(row, http: bytes) -> bytes:
    revisit = not pd.isna(row.refers_to)
    name = "" if pd.isna(row.page_id) else int(row.page_id)
    url = "".join(c if c.isprintable() and not c.isspace() else "%20" for c in row.url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row.digest)).decode()}",
        f"X-Payload-Length: {int(row.n_bytes)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else int(row.n_bytes))}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{int(row.refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _write(batches: Iterator[pd.DataFrame], folder: str, file_bytes: int) -> Iterator[pd.DataFrame]:
    done: list[tuple[str, int]] = []
    out = member = None
    uri, records = "", 0
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if row.chunk_no == 0:
                if member is not None:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                if out is not None and out.tell() >= file_bytes:
                    out.close()
                    done.append((uri, records))
                    out = None
                if out is None:
                    (uri, out), records = create(folder, ".warc.gz"), 0
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {int(row.n_bytes)}\r\n\r\n".encode()
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(member.compress(_header(row, http) + http))
                records += 1
            out.write(member.compress(row.data))
    if out is not None:
        out.write(member.compress(b"\r\n\r\n") + member.flush())
        out.close()
        done.append((uri, records))
    yield pd.DataFrame(done, columns=["path", "records"])


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write gzip WARC files; returns their manifest (path, records)."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    bounded_batches(pages.sparkSession)
    chunks = chunk_table(pages, least).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # pandas would turn nullable integers into doubles
    return cut(chunks.mapInPandas(lambda it: _write(it, folder, file_bytes), "path string, records bigint"))


def _fields(source) -> dict[str, str]:
    out = {}
    for line in iter(source.readline, b"\r\n"):
        if not line:
            raise ValueError("the archive ends within a header")
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _number(urn: str) -> int | None:
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def read_archive(uri: str, chunk: int = CHUNK, with_data: bool = True) -> Iterator[tuple]:
    """Chunk rows of one archive, at least one for each record.

    Raises ValueError where a payload does not have its declared digest or size.
    """
    with stream(uri) as raw, gzip.GzipFile(fileobj=raw, mode="rb") as source:
        while version := source.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no WARC record where one should be in {uri}")
            head = _fields(source)
            left = int(head["content-length"])
            status = source.readline()
            left -= len(status)
            for line in iter(source.readline, b"\r\n"):
                left -= len(line)
            left -= 2
            refers = _number(head["warc-refers-to"]) if "warc-refers-to" in head else None
            declared, size = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(), int(head["x-payload-length"])
            fixed = (_number(head["warc-record-id"]), head["warc-type"], refers, head["warc-target-uri"], size, declared)
            sha, number, seen = hashlib.sha1(), 0, 0
            while True:
                data = source.read(min(chunk, left))
                if len(data) < min(chunk, left):
                    raise ValueError(f"the archive {uri} ends within a payload")
                left -= len(data)
                seen += len(data)
                sha.update(data)
                if not left and refers is None and (sha.hexdigest(), seen) != (declared, size):
                    raise ValueError(f"a payload in {uri} differs from its digest")
                yield (*fixed, number, len(data), seen, sha.hexdigest(), not left, data if with_data else None)
                number += 1
                if not left:
                    break
            if source.read(4) != b"\r\n\r\n":
                raise ValueError(f"a record in {uri} does not end where it should")


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk table of the archives that ``manifest(path)`` lists."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        for pdf in batches:
            for uri in pdf["path"]:
                held, size = [], 0
                for row in read_archive(uri, chunk, with_data):
                    held.append(row)
                    size += row[7] if with_data else 1000
                    if size >= 4 << 20:
                        yield pd.DataFrame(held, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return one_task_a_file(manifest.select("path")).mapInPandas(rows, _CHUNKS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """One row for each page, as read back from its archive.

    Columns page_id, payload_bytes and payload_digest of the full payload,
    record_type and refers_to. See ``chunk_table`` for ties, nulls and repeated
    rows; an empty table gives an empty result; other columns are ignored.
    """
    chunks = read_archives(write_archives(pages), with_data=False).where("last")
    revisit = F.col("record_type") == "revisit"
    return chunks.select(
        "page_id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("running_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
