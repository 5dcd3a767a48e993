"""WARC archives in Zstandard: one dictionary, built from archived records, and one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir
from .common import stored

#: Fixed values of the format: the skippable frame that holds the dictionary, a frame's magic number, an empty skippable frame.
DICT_MAGIC, FRAME_MAGIC, EMPTY_FRAME = 0x184D2A5D, 0xFD2FB528, "P*M\x18\x00\x00\x00\x00"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored themselves.
REVISIT_BYTES = 1000
#: Records and bytes of each that the dictionary is built from (about so many, at most twice as many), and its bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 1000, 1 << 16, 1 << 16
#: Records that a reader holds at once.
READ_RECORDS = 256


def sha1_base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit, whose block has no payload, if refers_to is set."""
    uri = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "urn:none")
    block = HTTP_HEAD + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(digest)}", f"WARC-Block-Digest: sha1:{sha1_base32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and block of one record; the digest of the block and, of a response, of the payload are held against it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(hashlib.sha1(block).hexdigest())}":
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{sha1_base32(hashlib.sha1(payload).hexdigest())}":
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} differs")
    return {"fields": fields, "payload": payload}


def dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of too few records to train on, their bytes themselves as a raw one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=3).compress(data)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive: reads the dictionary of the leading skippable frame, passes over other such frames."""
    at, plain = 0, zstandard.ZstdDecompressor()
    reader = plain
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if magic == DICT_MAGIC and (raw := plain.decompress(data[at + 8 : end])):
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at = end
        else:
            one = reader.decompressobj()
            out = one.decompress(memoryview(data)[at:])
            if not one.eof:
                raise ValueError("the archive ends inside a frame")
            at = len(data) - len(one.unused_data)
            yield out


def _write(dict_data: bytes, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = zstandard.ZstdCompressionDict(dict_data) if dict_data else None
        press = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
        first = True
        for pdf in batches:
            out = [dictionary_frame(dict_data)] if first else []
            first = False
            for r in pdf.itertuples():
                ids = [None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to)]
                out.append(press.compress(record(ids[0], r.url, r.html.encode(), r.digest, ids[1], date)))
            yield pd.DataFrame({"frame": out})

    return run


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes pages (page_id, url, html) as archives into the folder path, by Spark's own writer and commit.

    So a lost executor leaves no half archive and path may be in any store that Spark writes to. Each file is a leading
    skippable frame with the dictionary, then a frame for each record; between frames the writer's separator is an empty
    skippable frame. Equal payloads of at least REVISIT_BYTES are stored once, in the response with the largest page_id.
    A partition makes an archive, so its size is that of an input split or of a shuffle partition.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("n", F.octet_length("html"))
    fit = base.where((F.col("n") > 0) & (F.col("n") <= SAMPLE_BYTES))
    share = max(1, fit.count() // SAMPLE_RECORDS)
    rows = fit.where(F.pmod(F.xxhash64("html"), F.lit(share)) == 0).select("html").limit(2 * SAMPLE_RECORDS).collect()
    words = dictionary(sorted(HTTP_HEAD + r[0].encode() for r in rows))
    key = ["digest", "n"]
    groups = base.where(F.col("n") >= REVISIT_BYTES).groupBy(*key).agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    dealt = base.join(stored(groups, "warc-copies"), key, "left").withColumn("refers_to", refers)
    made = dealt.select("page_id", "url", "html", "digest", "refers_to").mapInPandas(_write(words, date), "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def table(rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_digest", "refers_to", "payload", "archive"])
        return pdf.astype({"page_id": "Int64", "refers_to": "Int64"})

    for pdf in batches:
        for content, path in zip(pdf["content"], pdf["path"], strict=True):
            out = []
            for x in map(parse, frames(bytes(content))):
                if len(out) == READ_RECORDS:
                    yield table(out)
                    out = []
                f = x["fields"]
                ids = [None if (v := f.get(k, "null")[10:-1]) in ("", "null") else int(v) for k in ("WARC-Record-ID", "WARC-Refers-To")]
                out.append((ids[0], f["WARC-Target-URI"], f["WARC-Type"], base64.b32decode(f["WARC-Payload-Digest"][5:]).hex(), ids[1], x["payload"], path.rsplit("/", 1)[-1]))
            yield table(out)


def read_archives(spark, path: str) -> DataFrame:
    """The records of all archives of a folder: page_id, url, record_type, payload_digest, refers_to, payload, archive.

    Each digest is held against the bytes read. An archive is read whole, its records in groups of READ_RECORDS.
    """
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary, archive string"
    return spark.read.format("binaryFile").load(path).select("content", "path").mapInPandas(_read, schema)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, archive.

    A revisit's payload length is that of the response it refers to, found in the archives. A null html is an empty payload,
    a null url the target urn:none; characters outside visible ASCII are percent-encoded in the target. Rows repeated with
    the largest page_id of their payload are all responses; a null page_id is below all others. An empty table writes no
    archive and gives no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    got = read_archives(spark, path).select("page_id", F.octet_length("payload").cast("long").alias("n"), "payload_digest", "record_type", "refers_to", "archive")
    got = stored(got, "warc-records")  # so that the archives are read and held against their digests once
    whole = got.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("n").alias("full"))
    whole = whole.where(F.col("full") >= REVISIT_BYTES)
    full = F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("n"))
    return got.join(whole, ["refers_to", "payload_digest"], "left").select("page_id", full.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "archive")
