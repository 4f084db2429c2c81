"""WARC archives: write, normalise monolithic gzip, index, read back.

* ``write_monolithic`` writes pages as WARC records after a warcinfo record, each archive one gzip stream over the whole
  file.  Of pages with equal payloads of at least ``LEAST`` bytes the largest id is a response, the others revisit it.
* ``normalise`` inflates each stream once, in pieces of at most ``PIECE`` bytes however well they compress, rewrites every
  record as a gzip member of its own and writes a sidecar index (offset, length, type, record id) beside it.  Memory holds
  one record and one piece.  Any archive will do: header names in any case and spacing, any record type or id, one member
  or many.  A stream that ends before its checksum, within a record or with other bytes is an error, not a short result.
* ``read_records`` reads the index with Spark and deals the members out by offset: after normalising, one archive can be
  read by many tasks.

Archives go to a folder that all executors share, through ``pyarrow.fs`` (local, HDFS, object stores).  A task writes
under a name of its attempt and renames at its end, so retried tasks leave whole archives only.

Null html is an empty payload, a null url leaves the header out, rows with a null id are responses and come back with a
null id.  Rows that repeat an id are records of their own.  Very long payloads are one record.  Of equal payloads the
largest id is the response; two rows with that id are both responses.  Input columns other than the three named are not
read, so names can't clash.  An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import delete_path, fresh_path, materialize, slices, spread, table, utf8

LEAST, LEVEL, PIECE, MOST_ARCHIVE = 1000, 6, 1 << 20, 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response with its payload, or a revisit with the payload's digest and length alone."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url)}"] if url is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(), f"Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(name: str, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The warcinfo record that an archive begins with."""
    block = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[str, str]:
    """Header fields of a record by lower-case name; folded lines go on with the field before."""
    first, *lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    headers = headers_of(head)
    return headers, block[: int(headers["content-length"])]


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated stream, one at a time."""
    buf, need, seen = bytearray(), 0, 0
    for chunk in chunks:
        buf += chunk
        while True:
            if not need:
                end = buf.find(b"\r\n\r\n", max(0, seen - 3))
                seen = len(buf)
                if end < 0:
                    break
                size = headers_of(bytes(buf[:end])).get("content-length", "")
                if not size.isdigit():
                    raise ValueError("a WARC record has no Content-Length")
                need = end + 4 + int(size) + 4
            if len(buf) < need:
                break
            if buf[need - 4 : need] != b"\r\n\r\n":
                raise ValueError("a WARC record doesn't end where its Content-Length says")
            yield bytes(buf[:need])
            del buf[:need]
            need = seen = 0
    if buf.strip():
        raise ValueError("the stream ends within a record")


def inflate(f) -> Iterator[bytes]:
    """A gzip file's bytes in pieces of at most ``PIECE``, whether one member or many; a member without its end is an error."""
    z, data, began = zlib.decompressobj(31), f.read(PIECE), False
    while data:
        piece = z.decompress(data, PIECE)
        began = True
        if piece:
            yield piece
        if z.eof:
            data, z, began = z.unused_data or f.read(PIECE), zlib.decompressobj(31), False
        else:
            data = z.unconsumed_tail or f.read(PIECE)
    if not began:
        return
    while piece := z.decompress(b"", PIECE):  # what the last bytes held back
        yield piece
    if not z.eof:
        raise EOFError("the gzip stream ends before its end mark")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the response's id for revisits, else null."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keys = rows.filter(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", F.sha1("html").alias("d"), F.octet_length("html").alias("n"))
    groups = keys.groupBy("d", "n").agg(F.max("page_id").alias("keep"), F.min("page_id").alias("low")).filter("keep <> low").drop("low")
    # an id may repeat with another payload, so the payload's digest is part of the key
    revisits = keys.join(groups, ["d", "n"]).filter("page_id <> keep").select("page_id", "d", F.col("keep").alias("refers_to")).distinct()
    revisits = materialize(revisits, "revisits")
    # only pages that may be revisits are shuffled; a page wrongly taken for one costs its shuffle alone
    key = lambda df: df.withColumn("k", F.xxhash64("page_id", "d"))
    filt = pages.sparkSession.sparkContext.broadcast(bloom.key_filter(key(revisits).select("k")))
    keyed = key(rows.withColumn("d", F.sha1("html")))
    joined = bloom.having(keyed, "k", filt, True).join(revisits, ["page_id", "d"], "left").select("page_id", "url", "html", "refers_to")
    return bloom.having(keyed, "k", filt, False).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")).union(joined)


def write_monolithic(rows: DataFrame, folder: str, most: int = MOST_ARCHIVE) -> DataFrame:
    """Writes (page_id, url, html, refers_to); returns a row (path, records) for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, task = _open(folder), TaskContext.get()
        fs, root = where
        fs.create_dir(root, recursive=True)
        out, number, size, count, name, done = None, 0, 0, 0, "", []

        def close():
            nonlocal out
            out.write(z.flush())
            out.close()
            fs.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
            done.append((f"{folder}/{name}", count))
            out = None

        for batch in slices(batches, "html"):
            for i, url, html, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()):
                if out is None:
                    name, size, count, z = f"pages-{task.partitionId():06d}-{number:04d}.warc.gz", 0, 0, zlib.compressobj(LEVEL, wbits=31)
                    out = fs.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}", compression=None)
                    number += 1
                    out.write(z.compress(info(name)))
                raw = record(i, url, html, to)
                out.write(z.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= most:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done]), "records": pa.array([n for _, n in done], pa.int64())})

    return materialize(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"), "archives")


INDEX = "path string, offset long, length long, type string, record_id string"


def normalise(archives: DataFrame, folder: str) -> str:
    """Rewrites the archives of column ``path`` with a member for each record; returns the folder of the index files.

    An output is named by a digest of its archive's whole path and by its last part, so archives of one name in different
    folders stay apart; a path that is listed twice is one archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(f"{root}/index", recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                src, at = _open(path)
                name, offset, n = f"{hashlib.md5(path.encode()).hexdigest()}-{path.rpartition('/')[2]}", 0, 0
                tmp, tmp_index = f"{root}/.{name}.{attempt}", f"{root}/index/.{name}.{attempt}"
                with src.open_input_stream(at, compression=None) as f, fs.open_output_stream(tmp, compression=None) as out, fs.open_output_stream(tmp_index, compression=None) as index:
                    for raw in split_records(inflate(f)):
                        head = headers_of(raw[: raw.index(b"\r\n\r\n")])
                        kind, rid = (re.sub(r"\s", " ", head.get(k, "")) for k in ("warc-type", "warc-record-id"))
                        z = zlib.compressobj(LEVEL, wbits=31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        index.write(f"{folder}/{name}\t{offset}\t{len(member)}\t{kind}\t{rid}\n".encode())
                        offset, n = offset + len(member), n + 1
                fs.move(tmp, f"{root}/{name}")
                fs.move(tmp_index, f"{root}/index/{name}.idx")
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{name}"]), "records": pa.array([n], pa.int64())})

    archives = archives.repartition(max(spread(archives), 1), "path")
    materialize(archives.select("path").mapInArrow(run, "path string, records long"), "normalised")
    return f"{folder}/index"


def read_index(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(INDEX).option("sep", "\t").option("quote", "").csv(index)


def read_records(index: DataFrame) -> DataFrame:
    """(path, offset, record_id, record_type, url, payload, payload_bytes, payload_digest, refers_to) of the indexed members.

    A payload is what follows the HTTP head, or the whole block where there is none.  That of a revisit is null; its
    bytes and digest are the recorded ones (null where they aren't).  Digests are lower-case hex of SHA-1.  A response
    whose payload doesn't match its recorded SHA-1 is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            order = np.lexsort((batch.column("offset").to_numpy(), np.array(batch.column("path").to_pylist(), dtype=object).astype(str)))
            paths, offsets, lengths = (batch.column(c).to_pylist() for c in ("path", "offset", "length"))
            for part in np.array_split(order, max(1, len(order) // 256)):
                rows = []
                for k in part.tolist():
                    if paths[k] != name:
                        name = paths[k]
                        fs, at = _open(name)
                        f = fs.open_input_file(at)
                    f.seek(offsets[k])
                    h, block = parse(zlib.decompress(f.read(lengths[k]), 31))
                    kind = h.get("warc-type", "")
                    payload = block.partition(b"\r\n\r\n")[2] if h.get("content-type", "").lower().startswith("application/http") else block
                    told, mine = sha1_of(h.get("warc-payload-digest", "")), hashlib.sha1(payload).hexdigest()
                    if kind == "response" and told and mine != told:
                        raise ValueError(f"record {h.get('warc-record-id')} of {name} doesn't match its digest")
                    size = int(n) if (n := h.get("payload-length", "")).isdigit() else None
                    whole = kind != "revisit"
                    rows.append((name, offsets[k], h.get("warc-record-id"), kind, h.get("warc-target-uri"), payload if whole else None, len(payload) if whole else size, mine if whole else told, h.get("warc-refers-to")))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()))], names=["path", "offset", "record_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"])

    dealt = index.repartitionByRange(spread(index), "path", "offset")
    return dealt.mapInArrow(run, "path string, offset long, record_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def sha1_of(digest: str) -> str | None:
    """A digest header's SHA-1 as hex; base 32 or hex, null for others."""
    kind, _, text = digest.partition(":")
    if kind.lower() != "sha1":
        return None
    return text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()


def archive_and_read(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages' records as ``read_records`` gives them, with page_id and refers_to_page, after a round through archives below ``folder``."""
    spark = pages.sparkSession
    archives = write_monolithic(with_revisits(pages, id_col, url_col, html_col), f"{folder}/monolithic")
    index = normalise(archives, f"{folder}/members")
    if not archives.take(1):
        found = read_records(spark.createDataFrame([], INDEX))
    else:
        delete_path(spark, f"{folder}/monolithic")
        found = read_records(read_index(spark, index).filter("type <> 'warcinfo'"))
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    return found.withColumns({"page_id": page("record_id"), "refers_to_page": page("refers_to")})


def op7_warc(spark, sf_dir):
    out = archive_and_read(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep FROM pages
)
SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM p
"""
