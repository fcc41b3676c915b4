"""WARC archives: write records with revisits, segments and chunked framing; read them back and reassemble them.

Archives are written and read by Spark's own text source, with the line ends of the format as separators. They so land on any
store that Spark knows, under its commit protocol. A compressed archive is read by one task as a stream, record by record; no
file and no record block has to fit into a row, only one segment and, after reassembly, one payload.

Defined cases: a null payload is an empty one. A null id is smaller than every other, and is written and read as null. Rows that
repeat the largest id of equal payloads are all responses. Records of an unknown type are passed over. A payload of which a
segment is missing, whose total length or digest is wrong, or whose framing is broken stops the job with its record id
(`on_damage="error"`), or comes back with `damage` set and null content (`on_damage="keep"`). Repeated segments count once.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradloom.session import stored

VERSION = b"WARC/1.1"
#: Bytes of block content that one record holds; what is longer continues in further segments.
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

SEGMENTS = ("origin string, kind string, number long, total long, uri string, payload_digest string, refers_to string, block binary")


def digest(payload: bytes) -> str:
    """Bare base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def label_revisits(pages: DataFrame, revisit_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Add what makes a record response or revisit: of equal payloads of at least `revisit_bytes` bytes, the largest id is the response.

    The winners come from a partial aggregate over digests and are stored; the join with the payloads so has two plain exchanges,
    and adaptive execution splits a digest that many pages share.
    """
    base = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
                        F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"))
    sha = F.unhex(F.sha1("payload"))
    winners = (base.where(F.octet_length("payload") >= revisit_bytes).select(sha.alias("won"), "page_id").groupBy("won")
               .agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    joined = base.withColumn("sha", sha).join(stored(winners, "responses"), F.col("sha") == F.col("won"), "left")
    is_response = F.col("won").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select("page_id", "url", "payload", "sha", "response_id", is_response.alias("is_response"))


def _chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at:at + CHUNK_BYTES]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def _record(kind: str, fields: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    lines = [VERSION, b"WARC-Type: " + kind.encode()]
    lines += [f"{name}: {' '.join(str(value).split())}".encode() for name, value in fields if value is not None]
    return b"\r\n".join([*lines, b"Content-Length: %d" % len(block), b"", block])


def _records(date: str, segment_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "response_id", "is_response"))):
                page, url, payload, sha, response, is_response = row
                name = f"<urn:page:{'null' if page is None else page}#{uuid.uuid4().hex}>"
                common = [("WARC-Target-URI", url), ("WARC-Date", date)]
                sealed = ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha).decode())
                if is_response:
                    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + _chunked(payload)
                    parts = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
                    if len(parts) == 1:
                        made = [_record("response", [("WARC-Record-ID", name), *common, sealed], block)]
                    else:
                        made = [_record("response", [("WARC-Record-ID", name), *common, sealed, ("WARC-Segment-Number", 1)], parts[0])]
                        for number, part in enumerate(parts[1:], 2):
                            total = len(block) if number == len(parts) else None
                            made.append(_record("continuation", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *common, ("WARC-Segment-Origin-ID", name),
                                                                 ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], part))
                else:
                    made = [_record("revisit", [("WARC-Record-ID", name), *common, sealed, ("WARC-Refers-To", f"<urn:page:{response}>")],
                                    HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload))]
                out += made
                size += sum(map(len, made))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return encode


def write_warc(labelled: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write rows of `label_revisits` as compressed archives, one by task. Continuations may land anywhere: the reader groups them."""
    records = labelled.mapInArrow(_records(date, segment_bytes), "record binary")
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n")
     .option("compression", "gzip").text(folder))


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records out of an archive's lines, which come in order. Only the record at hand is held."""
    names = ["origin", "kind", "number", "total", "uri", "payload_digest", "refers_to", "block"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    out, size = [], 0
    state, head, block, left, path = "outside", [], [], 0, None

    def flush():
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def broken(why):
        raise ValueError(f"{path}: {why}")

    for batch in batches:
        for line, file in zip(batch.column("line").to_pylist(), batch.column("path").to_pylist()):
            if file != path:
                if state != "outside":
                    broken("ends inside a record")
                path = file
            if state == "outside":
                if line.startswith(b"WARC/"):
                    state, head = "head", []
                elif line:
                    broken("a record ends elsewhere than its length says")
                continue
            if state == "head":
                if line:
                    head.append(line)
                    continue
                fields = _fields(head)
                left, block, state = int(fields["content-length"]), [], "block"
                continue
            # The separator belongs to the block unless the block is complete.
            block.append(line)
            left -= len(line)
            if left > 0:
                block.append(b"\r\n")
                left -= 2
                if left < 0:
                    broken("a record ends elsewhere than its length says")
                if left > 0:
                    continue
            elif left < 0:
                broken("a record ends elsewhere than its length says")
            state = "outside"
            kind = fields.get("warc-type")
            if kind not in ("response", "resource", "revisit", "continuation"):
                continue
            content = b"".join(block)
            out.append((fields.get("warc-segment-origin-id") or fields.get("warc-record-id"), kind, int(fields.get("warc-segment-number", 0)),
                        int(fields["warc-segment-total-length"]) if "warc-segment-total-length" in fields else None, fields.get("warc-target-uri"),
                        fields.get("warc-payload-digest"), fields.get("warc-refers-to"), content))
            size += len(content)
            if size > 4 << 20:
                yield flush()
                out, size = [], 0
    if state != "outside":
        broken("ends inside a record")
    if out:
        yield flush()


def dechunk(body: bytes) -> bytes:
    """The payload of a chunked body. Chunk extensions and trailers are allowed; anything else is an error."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        length = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if length == 0:
            while (end := body.index(b"\r\n", at)) > at:  # trailers, up to an empty line
                at = end + 2
            return b"".join(parts)
        if body[at + length:at + length + 2] != b"\r\n":
            raise ValueError("a chunk ends elsewhere than its length says")
        parts.append(body[at:at + length])
        at += length + 2


def _payload(kind: str, block: bytes, sealed: str | None) -> tuple[bytes | None, int, str]:
    """Content (None for a revisit), its length, its digest."""
    if kind == "resource":
        return block, len(block), digest(block)
    head, _, body = block.partition(b"\r\n\r\n")
    fields = _fields(head.split(b"\r\n")[1:])
    if kind == "revisit":
        return None, int(fields["content-length"]), (sealed or "").removeprefix("sha1:")
    if fields.get("transfer-encoding", "").lower() == "chunked":
        body = dechunk(body)
    found = digest(body)
    if sealed and sealed.startswith("sha1:") and sealed[5:] != found:
        raise ValueError("the payload's digest differs")
    return body, len(body), found


OPENED = "record_id string, record_type string, uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, damage string"


def _open(on_damage: str):
    names = [f.split()[0] for f in OPENED.split(", ")]
    types = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, kind, uri, sealed, refers, block, damage in zip(*(batch.column(c).to_pylist() for c in (
                    "origin", "kind", "uri", "payload_digest", "refers_to", "block", "damage"))):
                content, length, found = None, None, None
                if damage is None:
                    try:
                        content, length, found = _payload(kind, block, sealed)
                    except (ValueError, KeyError) as e:
                        damage = str(e)
                if damage is not None and on_damage == "error":
                    raise ValueError(f"{origin}: {damage}")
                out.append((origin, "revisit" if kind == "revisit" else "response", uri, refers, content, length, found, damage))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return decode


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per origin: blocks in order of their segment numbers, with `damage` where numbers or the total length are wrong.

    Whole records take no shuffle. Segments are grouped by origin: a group is one payload.
    """
    whole = segments.where("number = 0").withColumn("damage", F.lit(None).cast("string"))
    one = F.struct("number", "block", "total", "kind", "uri", "payload_digest", "refers_to")
    parts = segments.where("number > 0").groupBy("origin").agg(F.array_sort(F.collect_list(one)).alias("all"))
    parts = parts.withColumn("all", F.expr("filter(all, (x, i) -> i = 0 OR x.number <> all[i - 1].number)"))
    numbers, last = F.transform("all", lambda x: x["number"]), F.element_at("all", -1)
    block = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["block"])), ""))
    damage = (F.when(last["total"].isNull() | (numbers != F.sequence(F.lit(1).cast("long"), last["number"])), F.lit("a segment is missing"))
              .when(F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"])) != last["total"], F.lit("the total length differs")))
    first = F.element_at("all", 1)
    joined = parts.select("origin", first["kind"].alias("kind"), first["uri"].alias("uri"), first["payload_digest"].alias("payload_digest"),
                          first["refers_to"].alias("refers_to"), block.alias("block"), damage.alias("damage"))
    return whole.select(*joined.columns).unionByName(joined)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives of a folder, segments apart. Archives are compressed with gzip, as is usual, so that no file is split."""
    lines = (spark.read.option("lineSep", "\r\n").text(folder)
             .select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path")))
    return lines.mapInArrow(_parse, SEGMENTS)


def read_warc(spark: SparkSession, folder: str, on_damage: str = "error") -> DataFrame:
    """Records with payload, length and digest of the whole payload; `refers_to` is the record a revisit stands for."""
    return reassemble(read_segments(spark, folder)).mapInArrow(_open(on_damage), OPENED)


def page_number(name: str) -> Column:
    """The number in `<urn:page:NUMBER...>`; null where there is none."""
    return F.expr(f"try_cast(regexp_extract({name}, 'urn:page:(-?[0-9]+)', 1) AS long)")
