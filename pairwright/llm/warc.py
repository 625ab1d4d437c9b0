"""WARC archives: a writer with revisit records and a reader that splits gzip members."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.frames import table
from pairwright.plans.storage import Scratch, new_path
from pairwright.sources.files import opened

MAGIC = b"\x1f\x8b\x08"
#: What the content of every record begins with.
START = b"WARC/"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
SPLIT_BYTES = 32 << 20
READ_BYTES = 256 << 10
#: Up to so many ranges each has a task of its own; beyond, a task reads some one after the other.
MOST_TASKS = 10_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "path string, offset long, record_type string, record_id string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, damage string"


def _line(value: str) -> str:
    """A header's value: what could end the line is percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, level: int = 6) -> bytes:
    """One gzip member. A revisit keeps the HTTP header, which tells the payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"WARC-Target-URI: {_line(uri)}"] if uri else []
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []
    return zlib.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level, 31)


def _write(root: str):
    def run(batches):
        path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with opened(path, "wb") as f:
            while first is not None:
                for x in first.to_pylist():
                    size += f.write(data := record(x["kind"], x["id"], x["uri"], x["payload"], x["digest"], x["refers_to"])) or len(data)
                    n += 1
                first = next((b for b in batches if b.num_rows), None)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], ["path", "bytes", "records"])

    return run


def write_warc(pages: DataFrame, root: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Archives below ``root``, one a task, and their manifest ``path, bytes, records``, which has been written when this returns.

    Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a
    response and the others revisit it (rows that repeat this id are all responses; null ids never lead
    a group). Payloads are compared by SHA-256, and only the digests are grouped, not the pages. A
    group of copies that is most of the table is a skewed join, which AQE splits.

    Null and empty payloads are responses of no bytes; a null uri has no header. A file counts only once its task has ended, as
    the manifest lists it: what a lost task left is never read. An empty table gives an empty manifest. Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    light = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("__id").alias("lead"), F.count("*").alias("n"))
    led = rows.join(light.filter("n > 1").select("digest", "lead"), "digest", "left")
    revisit = F.coalesce(F.col("lead").isNotNull() & ~F.col("__id").eqNullSafe(F.col("lead")), F.lit(False))
    made = led.select(
        F.when(revisit, "revisit").otherwise("response").alias("kind"),
        F.coalesce(F.col("__id").cast("string"), F.lit("null")).alias("id"),
        "uri",
        "payload",
        "digest",
        F.when(revisit, F.col("lead").cast("string")).alias("refers_to"),
    )
    return Scratch(pages.sparkSession, "warc").write(made.mapInArrow(_write(root), "path string, bytes long, records long"), "manifest")


class Window:
    """Forward reads of a file from an offset on, holding only what is not yet used."""

    def __init__(self, f, at: int):
        self.f, self.at, self.data = f, at, bytearray()
        f.seek(at)

    def more(self) -> bool:
        got = self.f.read(READ_BYTES)
        self.data += got
        return bool(got)

    def skip(self, n: int) -> None:
        del self.data[:n]
        self.at += n


@dataclass(frozen=True)
class Damage:
    """A place in an archive from which on bytes could not be read as a record."""

    offset: int
    what: str


def members(w: Window, end: int) -> Iterator[tuple[int, bytes] | Damage]:
    """The gzip members that start before ``end`` and hold WARC records, as offset and content, and what is damaged.

    A magic number can turn up inside compressed data. A candidate whose content does not begin as a record
    does is such a chance, and the search goes on a byte later. One that begins as a record and then fails to decode, or ends
    with the file, is damage. So are bytes behind a record, or at the start of the file, at
    which no record begins; whoever owns the record before them reports them, so each place counts once.
    """
    close = w.at == 0  # a record must begin right here
    while w.at < end or close:
        beyond = w.at >= end
        got = _decode(w, peek=beyond) if _filled(w, len(MAGIC)) and w.data.startswith(MAGIC) else None
        if close and got is None and w.data:
            yield Damage(w.at, "bytes at which no record begins")
        if beyond:
            return
        close = False
        if isinstance(got, tuple):
            yield got
            close = True
        elif got is not None:
            yield got
            w.skip(1)
        elif w.data:
            at = w.data.find(MAGIC, 1)
            w.skip(at if at > 0 else max(1, len(w.data) - len(MAGIC) + 1))
        else:
            return


def _filled(w: Window, n: int) -> bool:
    while len(w.data) < n:
        if not w.more():
            return False
    return True


def _decode(w: Window, peek: bool = False) -> tuple[int, bytes] | Damage | None:
    """The member at the window's start, which is then behind it; damage; or None, where it holds no record. A ``peek`` stops
    as soon as a record begins."""
    machine, out, head, used = zlib.decompressobj(31), [], b"", 0
    while not machine.eof:
        if used == len(w.data) and not w.more():
            return Damage(w.at, "a record that the file's end cuts off") if head == START else None
        short = len(head) < len(START)
        step = w.data[used : used + (1 << 10 if short else READ_BYTES)]
        try:
            part = machine.decompress(step, len(START) if short else 0)  # so that the beginning is known before an error behind it
        except zlib.error as e:
            return Damage(w.at, f"a record that does not decode: {e}") if head == START else None
        used += len(step) - (0 if machine.eof else len(machine.unconsumed_tail))
        out.append(part)
        head = (head + part)[: len(START)] if short else head
        if not START.startswith(head):
            return None
        if peek and head == START:
            return w.at, b""
    if head != START:
        return None
    start = w.at
    w.skip(used - len(machine.unused_data))
    return start, b"".join(out)


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(member: bytes) -> tuple:
    """The columns of a record but for its place; ValueError where it is not what its headers say."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = _fields(head)
    length = int(fields.get("content-length", "none"))
    block = rest[:length]
    if len(block) < length:
        raise ValueError(f"a block of {len(block)} bytes where {length} are promised")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(_fields(http).get("content-length", len(payload)))
    if kind == "response":
        if digest and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not have its digest")
        size = len(payload)
    bare = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") if name in fields else None
    return kind, bare("warc-record-id"), fields.get("warc-target-uri"), digest, size, bare("warc-refers-to"), payload if kind == "response" else None


def _read(with_payload: bool, damaged: str):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def found(path: str, size: int, start: int, end: int):
        with opened(path, "rb") as f:
            if start == 0 and (there := f.seek(0, 2)) != size:
                yield Damage(min(there, size), f"a file of {there} bytes where {size} are listed")
            for got in members(Window(f, start), end):
                if isinstance(got, tuple):
                    try:
                        got = (path, got[0], *parse(got[1]), None)
                    except ValueError as e:
                        got = Damage(got[0], str(e))
                yield got

    def run(batches):
        rows, held = [], 0
        for part in batches:
            for x in part.to_pylist():
                for got in found(x["path"], x["bytes"], x["start"], x["end"]):
                    if isinstance(got, Damage):
                        if damaged == "raise":
                            raise ValueError(f"{x['path']} at byte {got.offset}: {got.what}")
                        got = (x["path"], got.offset, "damaged", *[None] * 6, got.what)
                    *most, payload, what = got
                    rows.append((*most, payload if with_payload else None, what))
                    held += len(payload or b"") * with_payload + 200
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True, damaged: str = "raise") -> DataFrame:
    """The records of archives ``files (path, bytes)``, in byte ranges of ``split_bytes`` that any task can read.

    A record belongs to the range that its first byte is in, however far it reaches, so each is read
    exactly once. Ranges are dealt evenly over tasks whose number follows from that of the ranges. Revisits have the digest and
    length of the full payload, but null as payload.

    Nothing is lost silently: a record that does not decode, that the file's end cuts off, that is shorter than it says or whose
    payload does not have its digest, bytes between records, and a file that is not as long as listed are errors. With
    ``damaged="report"`` each is a row instead, with record_type ``damaged``, the offset and what is wrong in ``damage``
    (null for all other rows), and reading goes on at the next record; counting these rows counts the damage.
    A file cut off exactly behind a record shows only where ``bytes`` is of an older listing.

    Empty files have no records; an empty list of files gives an empty result; a file that is listed twice is read twice.
    A record that spans many ranges is held by one task as a whole, as its payload is one value.
    """
    if damaged not in ("raise", "report"):
        raise ValueError("damaged is 'raise' or 'report'")
    listed = files.filter("bytes > 0").select("path", F.col("bytes").cast("long").alias("bytes"))
    n = listed.agg(F.sum(F.expr(f"(bytes - 1) div {split_bytes} + 1"))).first()[0] or 0
    ranges = listed.select("path", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {split_bytes})")).alias("i"))
    ranges = ranges.select("path", "bytes", (F.col("i") * split_bytes).alias("start"), F.least("bytes", (F.col("i") + 1) * split_bytes).alias("end"))
    # By number: of rows this small the adaptive planner would make one task.
    tasks = max(1, min(n, max(MOST_TASKS, n // 16)))
    return ranges.repartition(tasks).mapInArrow(_read(with_payload, damaged), RECORD)


def find_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes`` of the archives in a folder; their contents are not read. Empty files are listed with 0 bytes, files of
    other names are not; a folder without archives gives an empty result, as long as it is there."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", F.col("length").alias("bytes"))


def op10_warc_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "archives"))
    records = read_warc(manifest, with_payload=False)
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL10 = f"""
with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
l as (select *, min(page_id) over (partition by d) as lead from p),
r as (select *, n >= {LEAST} and lead is not null and page_id is distinct from lead as again from l)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when again then 'revisit' else 'response' end as record_type, case when again then lead end as refers_to from r
"""
