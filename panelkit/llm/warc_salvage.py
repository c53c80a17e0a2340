"""WARC archives: writing pages as records, and a salvage reader.

Writing: pages with equal payloads of at least ``min_revisit`` bytes share one
``response`` (the smallest id); the others become ``revisit`` records that
name it. Only ids and digests are grouped; payloads move once, to their
archive, and only those of responses. Every record is a gzip member of its
own. Spark's text writer lays the members into one file per archive, so any
store Spark writes to will do; an empty gzip member stands between two
records (the writer needs a separator; a reader passes over it). Archives
hold about ``archive_bytes`` of payload each, so their number grows with the
input.

Reading: ``binaryFile`` deals whole archives to tasks. A member that fails its
checks (deflate stream, CRC, length, version line, header, Content-Length,
block digest if there is one) does not end the file: the reader looks for the
next gzip magic or ``WARC/1.x`` line that starts a record passing all checks,
goes on from there, and logs the bytes between as a quarantined gap with the
reason. Inside the unpacked bytes of a member the same search goes from version
line to version line; such a gap has the bytes of the member and names its
place in the unpacked bytes. Of a member that is cut short the whole records
before the cut are kept, of a damaged one those whose block digest was checked.
A record whose digest is of an unknown algorithm has that as its ``reason``.

Cases: a null payload is empty; a null id is written as an empty id, read back
as null and always a response; rows that repeat an id and a payload all carry
the type of that id; an empty table gives no
archive and no record; extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import fresh_path, register, table, text_or_empty

ARCHIVE_BYTES = 16 << 20
MIN_REVISIT = 100
#: Longest record (headers and block, unpacked) that the reader accepts; a
#: longer one is a gap with the reason "too long", never a cut record.
MAX_RECORD = 1 << 30
MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member (no name, no time, one empty final block, CRC and length 0).
EMPTY_MEMBER = MAGIC + b"\x00\x00\x00\x00\x00\x00\xff" + b"\x03\x00" + b"\x00" * 8
VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str,
                 n_archives: int, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """id, url, payload (binary, null for revisits), payload_bytes, digest,
    record_type, refers_to for every row, one partition per archive. The
    payload is shuffled once: the deal into archives also serves the join."""
    payload = F.encode(text_or_empty(F.col(payload_col)), "UTF-8")
    full = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    slim = full.select("id", F.length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    large = slim.where(F.col("size") >= min_revisit)
    first = large.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = (large.join(first, "digest").where("id <> first_id")
                .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first_id").distinct()
                .repartition(n_archives, "r_id", "r_digest"))
    full = full.select("*", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("payload_bytes")) \
        .repartition(n_archives, "id", "digest")
    met = full.join(revisits, (F.col("id") == F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    is_revisit = F.col("r_digest").isNotNull()
    return met.select(
        "id", "url", F.when(~is_revisit, F.col("payload")).alias("payload"), "payload_bytes", "digest",
        F.when(is_revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(is_revisit, F.col("first_id")).alias("refers_to"),
    )


def record_bytes(rec_id, url, payload: bytes | None, size: int, digest: str, kind: str, refers) -> bytes:
    """One WARC/1.0 record, not packed."""
    block = payload or b""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if rec_id is None else rec_id}>",
        f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{'' if refers is None else refers}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [
            member(record_bytes(None if pd.isna(i) else int(i), u, p, int(n), d, k, None if pd.isna(r) else int(r)))
            for i, u, p, n, d, k, r in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["payload_bytes"], pdf["digest"],
                                           pdf["record_type"], pdf["refers_to"])
        ]
        yield pd.DataFrame({"member": out})


def archive_count(pages: DataFrame, payload_col: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Archives for these pages: total payload and heads over ``archive_bytes``."""
    total, rows = pages.agg(F.sum(F.octet_length(F.col(payload_col)).cast("long")), F.count(F.lit(1))).first()
    return max(1, -(-((total or 0) + 500 * rows) // archive_bytes))


def write_archives(records: DataFrame, path: str) -> None:
    """Write planned records under ``path``, each partition as one archive."""
    names = ["id", "url", "payload", "payload_bytes", "digest", "record_type", "refers_to"]
    (records.select(*names).mapInPandas(_pack, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path))


# ---------------------------------------------------------------- reading

RECORD_FIELDS = "kind string, archive string, start long, stop long, record_id long, url string, record_type string, " \
    "payload binary, payload_bytes long, payload_digest string, refers_to long, reason string"


def _page_id(value: str | None):
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value or "")
    return int(m[1]) if m else None


ALGORITHMS = {"md5": hashlib.md5, "sha1": hashlib.sha1, "sha256": hashlib.sha256}


def _digest_note(value: str | None, block: bytes) -> str | None:
    """None if the block has this digest (hex or base32), else why it was not
    checked; raises ValueError if it differs."""
    if not value:
        return "no block digest"
    name, _, want = value.partition(":")
    make = ALGORITHMS.get(name.strip().lower().replace("-", ""))
    if make is None:
        return f"block digest not checked: {name.strip()}"
    found, want = make(block).digest(), want.strip()
    if want.lower() != found.hex() and want.upper().rstrip("=") != base64.b32encode(found).decode().rstrip("="):
        raise ValueError("block digest differs")
    return None


def parse_record(data: bytes, at: int = 0):
    """(record dict, end) of the record that starts at ``data[at]``; raises
    ValueError with the failed check."""
    if not VERSION.match(data, at):
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("header without end")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            raise ValueError("bad header line")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    if not (fields.get(b"warc-type") and fields.get(b"warc-record-id")):
        raise ValueError("mandatory header missing")
    length = fields.get(b"content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise ValueError("no Content-Length")
    if int(length) > MAX_RECORD:
        raise ValueError("too long")
    end = stop + 4 + int(length)
    block = data[stop + 4:end]
    if len(block) < int(length) or data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("block cut short or overrun")
    note = _digest_note(fields.get(b"warc-block-digest"), block)
    return {"fields": fields, "block": block, "note": note}, end + 4


def _unpack(data, at: int):
    """(bytes, end) of the gzip member at ``at``; ValueError if it is broken."""
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(memoryview(data)[at:], MAX_RECORD + 65536)
    except zlib.error as e:
        raise ValueError("broken gzip member") from e
    if not d.eof:
        raise ValueError("too long" if d.unconsumed_tail else "gzip member cut short")
    return out, len(data) - len(d.unused_data)


def _inside(out: bytes) -> Iterator[tuple]:
    """("record", record) and ("gap", reason) of unpacked bytes."""
    k, gap_from, reason = 0, None, ""
    while k < len(out):
        try:
            rec, end = parse_record(out, k)
        except ValueError as e:
            if gap_from is None:
                gap_from, reason = k, str(e)
            m = VERSION.search(out, k + 1)
            k = m.start() if m else len(out)
            continue
        if gap_from is not None:
            yield "gap", f"{reason} (unpacked bytes {gap_from} to {k})"
            gap_from = None
        yield "record", rec
        k = end
    if gap_from is not None:
        yield "gap", f"{reason} (unpacked bytes {gap_from} to {len(out)})"


def _before_damage(data: bytes, at: int) -> list:
    """Whole records of the broken or cut member at ``at``, as far as it unpacks."""
    d, parts, size, cut = zlib.decompressobj(31), [], 0, True
    for k in range(at, len(data), 4096):
        try:
            parts.append(d.decompress(data[k:k + 4096]))
        except zlib.error:
            cut = False
            # byte by byte up to the damage
            d = zlib.decompressobj(31)
            try:
                d.decompress(data[at:k])
                for j in range(k, min(k + 4096, len(data))):
                    parts.append(d.decompress(data[j:j + 1]))
            except zlib.error:
                pass
            break
        size += len(parts[-1])
        if d.eof or size > MAX_RECORD:
            break
    records = [x for kind, x in _inside(b"".join(parts)) if kind == "record"]
    return [r for r in records if cut or r["note"] is None]


def _one(data: bytes, at: int):
    """(parts of the member or line at ``at``, end)."""
    if data.startswith(MAGIC, at):
        # unused_data would copy the rest of the file at every member: bound it
        step = 1 << 16
        while True:
            piece = data[at:at + step]
            try:
                out, end = _unpack(piece, 0)
                break
            except ValueError as e:
                if "cut short" in str(e) and at + step < len(data):
                    step *= 4
                    continue
                raise
        found = list(_inside(out))
        if found and all(kind == "gap" for kind, _ in found):
            raise ValueError(found[0][1])
        return found, at + end
    rec, end = parse_record(data, at)
    return [("record", rec)], end


def salvage(data: bytes) -> Iterator[tuple]:
    """("record", start, stop, record) and ("gap", start, stop, reason) in
    order; with the empty members they cover every byte of the archive. Records
    of a broken member have no bytes of their own: the gap has them."""
    at, gap_from, reason, kept = 0, None, "", []
    starts = re.compile(re.escape(MAGIC) + rb"|WARC/1\.[01]\r\n")
    while at < len(data):
        try:
            found, end = _one(data, at)
        except ValueError as e:
            early = _before_damage(data, at) if data.startswith(MAGIC, at) else []
            if early:
                kept = early
                if gap_from is not None:
                    yield "gap", gap_from, at, reason
                    gap_from = None
                for rec in early:
                    yield "record", at, at, rec
            if gap_from is None:
                gap_from, reason = at, str(e)
            m = starts.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if gap_from is not None:
            # a broken member that only stores its bytes shows its records a second time
            if not data.startswith(MAGIC, at) and found[0][1] in kept:
                at = end
                continue
            yield "gap", gap_from, at, reason
            gap_from = None
        kept = []
        for kind, x in found:
            yield kind, at, end, x
        at = end
    if gap_from is not None:
        yield "gap", gap_from, len(data), reason


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in RECORD_FIELDS.split(", ")]
    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"]):
            rows, held = [], 0
            for kind, start, stop, x in salvage(data):
                if kind == "gap":
                    rows.append(("gap", path, start, stop, None, None, None, None, None, None, None, x))
                    continue
                f, block = x["fields"], x["block"]
                typ = f.get(b"warc-type")
                if typ == "revisit":
                    digest = f.get(b"warc-payload-digest", "").removeprefix("sha256:")
                    size = int(f.get(b"x-payload-length", "0") or 0)
                else:
                    digest, size = hashlib.sha256(block).hexdigest(), len(block)
                rows.append(("record", path, start, stop, _page_id(f.get(b"warc-record-id")), f.get(b"warc-target-uri"),
                             typ, block, size, digest, _page_id(f.get(b"warc-refers-to")), x["note"]))
                held += len(block)
                if held > 4 << 20:
                    yield _frame(rows, names)
                    rows, held = [], 0
            if rows:
                yield _frame(rows, names)


def _frame(rows, names) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names)
    for c in ("start", "stop", "record_id", "payload_bytes", "refers_to"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and quarantined gaps of every archive under ``path`` (gzip
    members or plain records); ``kind`` is "record" or "gap"."""
    files = spark.read.format("binaryFile").schema(
        T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                      T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])).load(path)
    return files.where(F.col("length") > 0).select("path", "content").mapInPandas(_read, RECORD_FIELDS)


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@register("op4_warc_salvage", ORACLE)
def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder, read them back."""
    pages, path = table(spark, sf_dir, "pages"), fresh_path(spark, "warc")
    write_archives(plan_records(pages, "page_id", "url", "html", archive_count(pages, "html")), path)
    return read_archives(spark, path).where("kind = 'record'").select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
