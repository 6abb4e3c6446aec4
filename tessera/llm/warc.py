"""WARC (operator 1): Zstandard archives with a shared dictionary, one frame per record.

Writing: a dictionary is trained on a bounded sample of payloads; every archive begins with a
skippable frame that holds it, then has one Zstandard frame per record. Archives are written by
Spark's own text writer, so they go to any store under Spark's commit protocol: a row is a
frame, and the line separator is an empty skippable frame, which decoders pass over. Equal
payloads: the digests' largest pages are found by an aggregate over ids and digests alone; of the
pages that become revisits a small row says so, which meets the payloads where these are dealt out
to archives, once. Revisit records hold no payload.

Reading: archives are read whole as binary files of a bounded size; the dictionary is loaded
from the leading frame, each record's frame decoded on its own, and headers and lengths
validated: version line, required fields, Content-Length against the block, payload digest
against the payload.

Defined results: a null payload is empty; rows with a null id are written and read back with a
null id and are never a response that others refer to; rows that share an id and a payload: one
is the response, those that are equal in id are responses too; an empty table gives an archive
without records, and an empty result; other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import hash_sample, materialize, own_shuffles, remove, scratch

# Fixed values of the formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: An empty skippable frame, all ASCII: the separator between the frames of records.
SEPARATOR = struct.pack("<II", SKIPPABLE_FIRST, 0).decode("ascii")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

DICTIONARY_BYTES = 64 << 10
#: Payloads the dictionary is trained on at most, and bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 16 << 10
ARCHIVE_BYTES = 48 << 20
MIN_REVISIT_BYTES = 0
LEVEL = 3

RECORD = "page_id long, record_type string, uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])


class WarcError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; the samples themselves where there are too few to train on."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, uri: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    clean = " ".join((uri or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """A record's fields, validated."""
    top, gap, rest = raw.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line")
    head = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            raise WarcError(f"not a header: {line!r}")
        head[key.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in head:
            raise WarcError(f"no {need}")
    if not head["content-length"].isdigit() or int(head["content-length"]) + 4 != len(rest) or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"a block of {len(rest) - 4} bytes under Content-Length {head['content-length']}")
    payload = rest[:-4]
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and digest and base32_sha1(payload) != digest:
        raise WarcError("the payload doesn't have its digest")
    if kind == "revisit" and "warc-refers-to" not in head:
        raise WarcError("a revisit that refers to nothing")
    number = lambda v: int(x) if v and (x := v[len("<urn:page:") : -1]) != "null" else None
    size = int(head["x-payload-length"]) if "x-payload-length" in head else len(payload)
    if kind == "response" and size != len(payload):
        raise WarcError("the payload doesn't have its length")
    return {"page_id": number(head["warc-record-id"]), "record_type": kind, "uri": head.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size, "refers_to": number(head.get("warc-refers-to")), "payload": payload}


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_DICTIONARY, len(dictionary)) + dictionary


def read_archive(data: bytes):
    """Yield the records of one archive."""
    import zstandard

    view = memoryview(data)
    decoder, at = None, 0
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0] if at + 4 <= len(view) else 0
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            if at + 8 > len(view):
                raise WarcError("a cut skippable frame")
            size = struct.unpack_from("<I", view, at + 4)[0]
            if at + 8 + size > len(view):
                raise WarcError("a cut skippable frame")
            if magic == SKIPPABLE_DICTIONARY:
                if at:
                    raise WarcError("a dictionary that doesn't lead")
                own = bytes(view[8 : 8 + size])
                if own[:4] == FRAME_MAGIC:
                    own = zstandard.ZstdDecompressor().decompress(own)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
            at += 8 + size
        elif bytes(view[at : at + 4]) == FRAME_MAGIC:
            d = (decoder or zstandard.ZstdDecompressor()).decompressobj()
            # frames are short, so the decoder is fed by steps and tells what it left
            parts, step = [], 1 << 16
            while not d.eof:
                if at >= len(view):
                    raise WarcError("a cut frame")
                parts.append(d.decompress(view[at : at + step]))
                at += min(step, len(view) - at) - len(d.unused_data)
            yield parse_record(b"".join(parts))
        else:
            raise WarcError(f"neither a frame nor a skippable one at byte {at}")


def _frames(dictionary: bytes):
    def run(batches):
        import zstandard

        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out = [dictionary_frame(dictionary)]
        for b in batches:
            for i, uri, payload, digest, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out.append(encoder.compress(record_bytes(i, uri, payload, base64.b32encode(digest).decode(), len(payload), first)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
            out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    return run


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", uri: str = "url", payload: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of about ``archive_bytes`` of payload each, in a folder."""
    src = pages.select(F.col(page_id).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    total = src.agg(F.sum(F.length("payload") + 512).alias("b"), F.count("*").alias("n")).first()
    size = total["b"] or 0
    dictionary = train_dictionary([bytes(v) for v in hash_sample(src, F.col("id"), F.substring("payload", 1, SAMPLE_BYTES), SAMPLE_ROWS, total["n"])])
    n = max(1, -(-int(size) // archive_bytes), min(64, int(size) // (1 << 20)))
    keyed = src.select(F.unhex(F.sha1("payload")).alias("digest"), F.coalesce("id", F.lit(0)).alias("rid"), F.col("id").isNull().alias("none"), "id", "uri", "payload")
    slim = keyed.select("digest", "rid", "none", "id", F.length("payload").alias("size"))
    # the responses of payloads that occur twice or more, and who refers to them
    first = slim.groupBy(F.col("digest").alias("d")).agg(F.max("id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size")).where(f"n > 1 AND size >= {int(min_revisit_bytes)}").select("d", "first")
    revisits = slim.join(first, F.col("digest") == F.col("d")).where("id < first OR (id IS NULL AND first IS NOT NULL)").select("digest", "rid", "none", "first").distinct()
    # a hash join on what the payloads are dealt by: one shuffle of theirs, and no sort
    key = ["digest", "rid", "none"]
    rows = keyed.repartition(n, *key).join(revisits.hint("shuffle_hash"), key, "left").select("id", "uri", "payload", "digest", "first")
    frames = rows.mapInArrow(_frames(dictionary), "frame binary")
    with own_shuffles(pages.sparkSession):
        frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def _decode(batches):
    for b in batches:
        for content in b.column(0):
            run: list[dict] = []
            size = 0
            for r in read_archive(content.as_py()):
                run.append(r)
                size += len(r["payload"])
                if size > 8 << 20 or len(run) >= 2000:
                    yield pa.RecordBatch.from_pylist(run, schema=_RECORD)
                    run, size = [], 0
            if run:
                yield pa.RecordBatch.from_pylist(run, schema=_RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in a folder."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decode, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back: what was archived of each page."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    out = materialize(read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "pages")
    remove(pages.sparkSession, path)
    return out
