"""WARC archives through a chunked record table.

A payload never travels as one value once it is cut: chunks() turns it into (record, chunk number) rows of at most
`chunk_bytes`, each with the SHA-256 of everything up to its end, and an oversized payload becomes a WARC segment chain (a
first record and `continuation` records). Archives are written by Spark's text writer, one record a row, with the
separator CRLF CRLF between records, and read back by its text reader, so any store that Spark reaches will do. The reader
folds a record's chunks in order with one running digest and holds one chunk at a time; a chunk that is missing, changed
or out of order stops the read with an error.

The reader finds records by CRLF CRLF WARC/1.0 CRLF. A payload in which that could appear is cut inside it, so that
no segment holds it and reading back is exact for all texts.

Of records with equal payloads of at least `min_revisit` bytes, that with the smallest page id is the response and the
others are revisits that name it and carry no payload.

Edge cases: a null payload is empty; a null id comes after all others and is written without its field, as is a null
URL; repeated rows are records of their own, one of them the response; an empty table writes no records and reads back
none. Columns other than id, URL and payload are not carried.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.llm.common import read, scratch_path, stash

NAME = "op10_warc_chunks"

CHUNK_BYTES = 1 << 20
MIN_REVISIT = 100
RECORDS_PER_FILE = 20_000
#: Copies of the table of first records over which the rows of one payload are dealt.
SALTS = 16
#: Fixed values of the format.
VERSION, GAP = b"WARC/1.0\r\n", b"\r\n\r\n"
RISK = GAP + b"WA"


def chunks(payload: bytes, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, memoryview, str]]:
    """Chunk number, bytes and the SHA-256 of the payload up to the chunk's end, as hex digits.

    Chunks end between code points and inside anything that could pass for the start of a record.
    """
    view, digest, at, number = memoryview(payload), hashlib.sha256(), 0, 0
    while number == 0 or at < len(payload):
        end = min(len(payload), at + chunk_bytes)
        while end < len(payload) and end > at + 1 and payload[end] & 0xC0 == 0x80:
            end -= 1
        while end < len(payload) and payload[end] & 0xC0 == 0x80:  # a chunk is one whole code point at least
            end += 1
        found = payload.find(RISK, at, end)
        if payload[at : at + 2] == RISK[len(GAP) :]:  # right after a header's own gap
            end = at + 1
        elif found >= 0:
            end = found + len(RISK) - 1
        digest.update(view[at:end])
        yield number, view[at:end], digest.copy().hexdigest()
        at, number = end, number + 1


def record_id(row: int, page_id: int | None, digest: str, archive: str) -> str:
    """A record's id, from its payload, page and row and the archive that it is written to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{digest}/{page_id}/{row}')}>"


def _head(fields: dict[str, object]) -> bytes:
    return VERSION + "\r\n".join(f"{k}: {v}" for k, v in fields.items() if v is not None).encode() + GAP


def records(row: int, page_id: int | None, url: str | None, payload: bytes, digest: str, first: tuple[int, int] | None, date: str, chunk_bytes: int, archive: str = "") -> Iterator[bytes]:
    """The WARC records of one row; first is the row and page id of the response that a revisit names."""
    uri = None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=~%-._")
    fields = {"WARC-Record-ID": record_id(row, page_id, digest, archive), "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": page_id, "X-Payload-Length": len(payload)}
    if first is not None:
        more = {"WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": record_id(*first, digest, archive), "X-Refers-To-Page": first[1], "Content-Length": 0}
        yield _head({"WARC-Type": "revisit"} | fields | more)
        return
    origin = fields["WARC-Record-ID"]
    found = chunks(payload, chunk_bytes)
    here = next(found)
    while here:
        number, data, running = here
        here = next(found, None)
        kind = {"WARC-Type": "response"} if not number else {"WARC-Type": "continuation"}
        segment = {}
        if number or here:
            segment = {"WARC-Segment-Number": number + 1, "WARC-Segment-Total-Length": None if here else len(payload), "X-Running-Digest": f"sha256:{running}"}
        if number:
            segment |= {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.UUID(origin[10:-1]), str(number))}>", "WARC-Segment-Origin-ID": origin}
        yield _head(kind | fields | segment | {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(data)}) + bytes(data)


def with_revisits(df: DataFrame, id_col: str, url_col: str, payload_col: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """_row, _id, _url, _payload, _digest, and _first_row and _first_id for the rows that are revisits.

    Rows are numbered once, in a table that both sides of the join read: another evaluation of df may number them in
    another way, and a payload would then be lost.
    """
    text = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("bigint").alias("_id"), F.col(url_col).alias("_url"), text.alias("_payload"), F.sha2(text.cast("binary"), 256).alias("_digest"))
    rows = stash(rows, "warc-rows", "zstd")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    firsts = rows.filter(F.octet_length("_payload") >= min_revisit).groupBy("_digest").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    salted = firsts.select(F.col("_digest").alias("_of"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = rows.join(salted, (F.col("_digest") == F.col("_of")) & (F.pmod("_row", F.lit(SALTS)).cast("int") == F.col("_salt")), "left")
    other = F.col("first._row") != F.col("_row")
    return joined.select("_row", "_id", "_url", "_payload", "_digest", F.when(other, F.col("first._row")).alias("_first_row"), F.when(other, F.col("first._id")).alias("_first_id"))


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES, min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the rows of df as gzip-compressed WARC files under path; record ids are new with each call."""
    archive = uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for i in range(batch.num_rows):
                row, page, url, payload, digest, first_row, first_id = (c[i].as_py() for c in batch.columns)
                first = None if first_row is None else (first_row, first_id)
                for record in records(row, page, url, payload.encode(), digest, first, date, chunk_bytes, archive):
                    out.append(record.decode())
                    held += len(record)
                    if held > 4 * chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    lines = with_revisits(df, id_col, url_col, payload_col, min_revisit).mapInArrow(run, "value string")
    lines.write.option("lineSep", GAP.decode()).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path, compression="gzip")


CHUNK_SCHEMA = "record string, chunk int, type string, page_id bigint, refers_to bigint, declared_bytes bigint, declared_digest string, total bigint, running string, data binary"


def _bare(value: str | None) -> str | None:
    return value and value.removeprefix("sha256:")


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def parse(value: bytes) -> dict:
    """A record as a row of the chunk table; value has no version line. data is None for a record that is verified whole."""
    head, _, body = value.partition(GAP)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    size = int(fields["Content-Length"])
    data = body[:size]
    row = {
        "record": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]), "chunk": int(fields.get("WARC-Segment-Number", "1")) - 1, "type": fields["WARC-Type"], "page_id": _number(fields.get("X-Page-Id")), "refers_to": _number(fields.get("X-Refers-To-Page")),
        "declared_bytes": int(fields["X-Payload-Length"]), "declared_digest": _bare(fields["WARC-Payload-Digest"]), "total": _number(fields.get("WARC-Segment-Total-Length")), "running": _bare(fields.get("X-Running-Digest")), "data": data,
    }
    if len(data) != size:
        raise ValueError(f"{row['record']}: {len(data)} of {size} bytes")
    if row["running"] is None:
        if row["type"] == "response" and hashlib.sha256(data).hexdigest() != row["declared_digest"]:
            raise ValueError(f"{row['record']}: the payload doesn't have its digest")
        row["data"] = None
    return row


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under path: a row for each record or segment."""
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            rows = [parse(v.as_py().encode().removeprefix(VERSION)) for v in batch.column(0) if len(v.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, types, strict=True)], names)

    lines = spark.read.schema("value string").option("lineSep", (GAP + VERSION).decode()).text(path)
    return lines.mapInArrow(run, CHUNK_SCHEMA)


RECORD_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def fold(chunk_rows: DataFrame) -> DataFrame:
    """One row per record; a record's chunks pass through one running digest in their order."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        record, digest, size, due = None, None, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["running"] is None:
                    out.append((row["page_id"], row["declared_bytes"], row["declared_digest"], row["type"], row["refers_to"]))
                    continue
                if row["chunk"] == 0:
                    record, digest, size, due = row["record"], hashlib.sha256(), 0, 0
                if row["record"] != record or row["chunk"] != due:
                    raise ValueError(f"{row['record']}: chunk {row['chunk']} without chunk {due}")
                digest.update(row["data"])
                size, due = size + len(row["data"]), due + 1
                if digest.hexdigest() != row["running"]:
                    raise ValueError(f"{record}: chunk {row['chunk']} doesn't have its digest")
                if row["total"] is not None:
                    if (size, digest.hexdigest()) != (row["total"], row["declared_digest"]):
                        raise ValueError(f"{record}: the payload doesn't have its size or digest")
                    out.append((row["page_id"], size, digest.hexdigest(), "response", None))
                    due = -1
            columns = list(zip(*out, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)
        if due > 0:
            raise ValueError(f"{record}: it has no last chunk")

    parts = int(chunk_rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return chunk_rows.repartition(parts, "record").sortWithinPartitions("record", "chunk").mapInArrow(run, RECORD_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return fold(read_chunks(spark, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives in the shared folder and read back from them."""
    path = scratch_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


#: What the archives must give back, from the table itself.
ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
