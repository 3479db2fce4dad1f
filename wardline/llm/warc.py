"""WARC archives from a chunked record table, and back.

A payload is never one value: it is cut into chunks of bounded size, rows of (record identifier, chunk number). A chunk is written as a
record of its own, the first as ``response`` and the others as ``continuation`` with WARC-Segment-Number, as the format provides for
long records. Digests are carried from chunk to chunk: on the way in through the cell, on the way back through the rows of a record in
chunk order, which one task streams. Archives are written and read by Spark's own writers and readers, gzip-compressed, each of a
bounded size, so that reading one as a whole is bounded too.
"""

from __future__ import annotations

import uuid
from base64 import b32encode
from hashlib import sha1
from zlib import MAX_WBITS, decompressobj

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import narrow
from wardline.session import cut_lineage, shared_folder

#: Bytes of a chunk, of a block of records written as one row, and the blocks of an archive file.
CHUNK = 1 << 20
BLOCK = 8 << 20
BLOCKS_PER_FILE = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return b32encode(digest).decode()


def chunks_of(payload: bytes, size: int = CHUNK):
    """(chunk number from 1, bytes) at most ``size`` long and cut between characters; an empty payload is one empty chunk."""
    start, number = 0, 1
    while True:
        end = min(len(payload), start + size)
        while end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        yield number, payload[start:end]
        start, number = end, number + 1
        if start >= len(payload):
            return


def record(kind: str, record_id: str, fields: dict[str, object], payload: bytes) -> str:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": EPOCH, **fields, "Content-Length": len(payload)}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n" + payload.decode()


def records(page_id: int | None, number: int, url: str | None, payload: bytes, refers_to: int | None, first: bool, size: int = CHUNK):
    """The records of one page. ``first`` tells whether it carries its payload; others are revisits of ``refers_to``."""
    carried, each = sha1(), []
    for n, part in chunks_of(payload, size):
        carried.update(part)
        each.append((n, len(part)))
    payload_digest = base32(carried.digest())
    digest = f"sha1:{payload_digest}"
    # pages without an id, or with one id, differ in their payloads
    name = lambda page: f"urn:page:{'none' if page is None else page}:{payload_digest}"
    record_id = f"{name(page_id)}:{number}"
    about = {"WARC-Target-URI": f"<{' '.join(url.split())}>"} if url and url.split() else {}
    if not first:
        yield record("revisit", record_id, about | {"WARC-Profile": PROFILE, "WARC-Payload-Digest": digest, "WARC-Refers-To": f"<{name(refers_to)}:0>"}, b"")
        return
    start = 0
    for n, length in each:
        part = payload[start : start + length]
        start += length
        block = {"WARC-Block-Digest": f"sha1:{base32(sha1(part).digest())}"}
        if len(each) == 1:
            yield record("response", record_id, about | {"WARC-Payload-Digest": digest} | block, part)
        elif n == 1:
            yield record("response", record_id, about | {"WARC-Payload-Digest": digest, "WARC-Segment-Number": 1} | block, part)
        else:
            last = {"WARC-Segment-Total-Length": len(payload)} if n == len(each) else {}
            yield record("continuation", f"{record_id}:{n}", about | {"WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": n} | last | block, part)


def decided(pages: DataFrame) -> DataFrame:
    """Distinct ``page_id, url, html, sha`` with ``copies`` (how often the row occurs) and ``owner``, the smallest page with an equal payload.

    Only digests meet when owners are sought; a payload is shuffled once, by its page.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = narrow(pages, page_id=F.col("page_id").cast("long"), url=F.col("url"), html=html, sha=F.sha2(html, 256))
    key = {"none": F.col("page_id").isNull(), "id": F.coalesce("page_id", F.lit(0).cast("long"))}
    rows = rows.withColumns(key)
    slim = rows.select("none", "id", "sha")
    owners = slim.groupBy("sha").agg(F.min(F.struct("none", "id")).alias("owner"))
    owner = F.when(~F.col("owner.none"), F.col("owner.id")).alias("owner")
    plan = slim.groupBy("none", "id", "sha").agg(F.count("*").alias("copies")).join(owners, "sha").select("none", "id", "sha", "copies", owner)
    # equal keys on both sides of the join: the rows stay where the removal of repeated rows has put them
    return rows.dropDuplicates(["none", "id", "sha"]).join(plan, ["none", "id", "sha"]).select("page_id", "url", "html", "copies", "owner")


def write_archives(pages: DataFrame, folder: str, chunk: int = CHUNK) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``folder``.

    Of records with equal payloads the one with the smallest page_id is ``response`` and the others ``revisit`` it. NULL html is an
    empty payload; a NULL page_id comes after all others; of repeated rows one is written in full; an empty table writes an
    archive without records; other columns are ignored.
    """

    def work(batches):
        import pyarrow as pa

        block: list[str] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, copies, owner = (batch.column(c)[i].as_py() for c in ("page_id", "url", "copies", "owner"))
                payload = batch.column("html")[i].as_py().encode()
                for number in range(copies):
                    for text in records(page_id, number, url, payload, owner, page_id == owner and number == 0, chunk):
                        block.append(text)
                        size += len(text)
                        if size >= BLOCK:
                            yield pa.RecordBatch.from_pydict({"value": ["\r\n\r\n".join(block)]})
                            block, size = [], 0
        if block:
            yield pa.RecordBatch.from_pydict({"value": ["\r\n\r\n".join(block)]})

    blocks = decided(pages).mapInArrow(work, "value string")
    blocks.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(folder)


def _parsed(stream, step: int = 1 << 16):
    """(headers, payload) of each record of a gzip-compressed archive, holding one record at a time."""
    unzip, data, at = decompressobj(MAX_WBITS | 16), bytearray(), 0
    buffer = bytearray()

    def more() -> bool:
        nonlocal at, unzip
        if at >= len(stream):
            return False
        buffer.extend(unzip.decompress(stream[at : at + step]))
        at += step
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        head = dict(line.split(": ", 1) for line in bytes(buffer[:end]).decode().split("\r\n")[1:])
        length = int(head["Content-Length"])
        del buffer[: end + 4]
        while len(buffer) < length + 4:
            if not more():
                raise ValueError("archive ends within a record")
        data = bytes(buffer[:length])
        if buffer[length : length + 4] != b"\r\n\r\n":
            raise ValueError("record without its end")
        del buffer[: length + 4]
        yield head, data


CHUNK_ROWS = "record_id string, kind string, number long, last boolean, chunk binary, digest string, refers_to string, n_bytes long"


def read_chunks(spark, folder: str) -> DataFrame:
    """The chunk table of the archives: ``record_id, kind, number, last, chunk, digest, refers_to, n_bytes``.

    A payload in one chunk comes with its size and digest, recomputed and compared with the header, and without its bytes.
    """

    def work(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in CHUNK_ROWS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string(), pa.string(), pa.int64()]
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                for head, data in _parsed(memoryview(batch.column("content")[i].as_buffer())):
                    bare = lambda k: head[k][1:-1] if k in head else None  # noqa: E731, B023
                    if head.get("WARC-Block-Digest", "").removeprefix("sha1:") not in ("", base32(sha1(data).digest())):
                        raise ValueError(f"digest of {head['WARC-Record-ID']}")
                    digest, number = head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, int(head.get("WARC-Segment-Number", 0))
                    if head["WARC-Type"] == "response" and not number and digest != base32(sha1(data).digest()):
                        raise ValueError(f"digest of {head['WARC-Record-ID']}")
                    origin = bare("WARC-Segment-Origin-ID") or bare("WARC-Record-ID")
                    out.append((origin, head["WARC-Type"], number, "WARC-Segment-Total-Length" in head, data if number else None, digest, bare("WARC-Refers-To"), len(data)))
                    size += len(data)
                    if size > CHUNK or len(out) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("content").mapInArrow(work, CHUNK_ROWS)


def joined_digests(chunks: DataFrame) -> DataFrame:
    """``record_id, n_bytes, digest, expected`` of payloads in several chunks: a task streams each record's rows in chunk order."""

    def work(batches):
        import pyarrow as pa

        now, carried, length, expected = None, sha1(), 0, None
        names = ["record_id", "n_bytes", "digest", "expected"]
        for batch in batches:
            for i in range(batch.num_rows):
                record_id = batch.column("record_id")[i].as_py()
                if record_id != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, ([now], [length], [base32(carried.digest())], [expected]), strict=True)))
                    now, carried, length, expected = record_id, sha1(), 0, batch.column("digest")[i].as_py()
                part = batch.column("chunk")[i].as_buffer()
                carried.update(part)
                length += len(part)
        if now is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([now], [length], [base32(carried.digest())], [expected]), strict=True)))

    rows = chunks.where("number > 0").select("record_id", "number", "chunk", "digest")
    return rows.repartition(F.col("record_id")).sortWithinPartitions("record_id", "number").mapInArrow(work, "record_id string, n_bytes long, digest string, expected string")


def read_archives(spark, folder: str) -> DataFrame:
    """One row per page from its archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Sizes and digests of responses are recomputed from their chunks; a revisit gets the size of the record that it refers to.
    """
    chunks = read_chunks(spark, folder)
    single = chunks.where("number = 0")
    long = joined_digests(chunks).select(
        "record_id", F.lit("response").alias("kind"), F.when(F.col("digest") == F.col("expected"), F.col("digest")).alias("digest"), F.lit(None).cast("string").alias("refers_to"), "n_bytes"
    )
    rows = cut_lineage(single.select("record_id", "kind", "digest", "refers_to", "n_bytes").unionByName(long))
    page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS BIGINT)")
    responses = rows.where("kind = 'response'")
    sizes = responses.select(F.col("record_id").alias("to"), F.col("n_bytes").alias("size"), F.col("digest").alias("its"))
    revisits = rows.where("kind = 'revisit'")
    revisits = revisits.join(sizes, revisits["refers_to"] == sizes["to"], "left")
    agreed = F.when(F.col("its") == F.col("digest"), F.col("digest"))
    return responses.select(page("record_id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select(page("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), agreed.alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to").alias("refers_to"))
    )


def round_trip(pages: DataFrame, folder: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` as archives and read them back; see ``write_archives`` and ``read_archives``."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, chunk)
    return read_archives(pages.sparkSession, folder)
