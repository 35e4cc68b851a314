"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The writer makes gzip archives of one member a record (or plain ones) in a folder that Hadoop's and Arrow's file
systems both reach; a file is written under a hidden name and renamed when complete, so that a task that runs again
replaces its own files. The reader checks each record (version line, header, lengths, block digest, gzip checksum);
after a failed check it searches for the next valid member or version line, goes on there, and logs the bytes
between as quarantined. A damaged member's valid records are kept, and the next version line is searched for in what
could be decompressed of it.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_dir, small_batches

PIECE = 1 << 14
NEAR = 1 << 16  # bytes in which most headers end
ROLL = 16 << 20  # bytes of an archive before the next begins
MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One record: a response with its payload, or a revisit that has the header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """The record that begins at `at`: header, block, end. ValueError says which check failed."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    stop = data.find(END, at, at + NEAR)
    if stop < 0:  # a longer header ends before the next version line
        after = data.find(b"\n" + VERSION, at + 1)
        stop = data.find(END, at, len(data) if after < 0 else after + 1)
    if stop < 0:
        raise ValueError("no end of the header")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = stop + 4
    end = start + int(head["content-length"])
    if data[end : end + 4] != END:
        raise ValueError("the block doesn't end where its length says")
    block = data[start:end]
    if (d := head.get("warc-block-digest")) and d != f"sha1:{payload_digest(block)}":
        raise ValueError("block digest")
    return head, block, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member that begins at `at` holds, as far as it can be decompressed; its end, and its fault or ''."""
    z, out, view, p = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not z.eof and p < len(data):
            out.append(z.decompress(view[p : p + PIECE]))
            p = min(p + PIECE, len(data))
    except zlib.error as e:
        # the piece that failed once more by single bytes, for what comes before the fault
        z = zlib.decompressobj(31)
        for k in range(at, p, PIECE):
            z.decompress(view[k : k + PIECE])
        with contextlib.suppress(zlib.error):
            while p < len(data):
                out.append(z.decompress(view[p : p + 1]))
                p += 1
        return b"".join(out), p, f"gzip: {e}"
    if not z.eof:
        return b"".join(out), len(data), "gzip: cut short"
    return b"".join(out), p - len(z.unused_data), ""


def _plain(data: bytes, digests: bool = False):
    """salvage() of bytes that aren't packed; with `digests` records without a block digest don't count."""
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            head, block, end = parse(data, at)
            if digests and "warc-block-digest" not in head:
                raise ValueError("no block digest in a damaged member")
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            at = data.find(VERSION, at + 1)
            at = len(data) if at < 0 else at
            continue
        if bad is not None:
            yield "gap", bad, at, why, None
            bad = None
        yield "record", at, end, head, block
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why, None


def salvage(data: bytes):
    """Yields ("record", start, end, header, block) and ("gap", start, end, reason, None) over all bytes of an archive.

    In a gzip archive start and end are those of the member; of a member with a fault the valid records count and a
    gap follows, from its start to the next valid member if it can't be decompressed to its end.
    """
    packed = data.startswith(MAGIC) or (not data.startswith(VERSION) and 0 <= data.find(MAGIC) < (data.find(VERSION) if VERSION in data else len(data)))
    if not packed:
        yield from _plain(data)
        return
    at, bad, why = 0, None, ""
    while at < len(data):
        text, end, fault = _member(data, at) if data.startswith(MAGIC, at) else (b"", at, "no gzip member")
        # a failed checksum says nothing about where; what was cut short is right up to there
        got = list(_plain(text, fault not in ("", "gzip: cut short")))
        kept = [x for x in got if x[0] == "record"]
        if bad is not None and (kept or not (got or fault)):
            yield "gap", bad, at, why, None
            bad = None
        for kind, _, _, head, block in got if kept and not fault else kept:
            yield kind, at, end, head, block
        if (fault or (got and not kept)) and bad is None:
            bad, why = at, fault or got[0][3]
        if fault:
            end = data.find(MAGIC, at + 1)
            end = len(data) if end < 0 else end
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why, None


def _filesystem(uri: str):
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(uri)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, packed: bool = True) -> DataFrame:
    """Write a record for each row to archives in `folder`; (path, records, bytes) of each archive.

    Of rows with equal payloads of `least` bytes or more the largest page_id is the response and the others revisit
    it; shorter payloads are responses all. A null html is an empty payload, a null url about:blank. Of repeated rows (one id, equal payload)
    every row is a response if that id is the largest. Rows with a null id are responses and nothing refers to them.
    """
    ship_to = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    ship_to = ship_to.withColumns({"d": F.sha1(F.col("html").cast("binary")), "n": F.octet_length("html")})
    top = ship_to.where("id is not null").groupBy("d", "n").agg(F.max("id").alias("top"), F.count("*").alias("c")).where(f"c > 1 and n >= {least}").select(F.col("d").alias("d_"), F.col("n").alias("n_"), "top")
    rows = ship_to.join(top, (F.col("d") == F.col("d_")) & (F.col("n") == F.col("n_")), "left")
    rows = rows.select("id", "url", F.when((F.col("id") < F.col("top")) & F.col("id").isNotNull(), F.lit(None)).otherwise(F.col("html")).alias("html"), "d", "n", F.when(F.col("id") < F.col("top"), F.col("top")).alias("to"))
    small_batches(pages.sparkSession)
    run_id = uuid.uuid4().hex[:12]

    def run(batches):
        from pyspark import TaskContext

        fs, base = _filesystem(folder)
        base = base.rstrip("/")
        part, tried = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, size, count, seq = [], 0, 0, 0

        def close():
            # an attempt's own folder: what a failed one leaves behind is never read, since only the written paths are
            name = f"{base}/{part:06d}-{tried}/pages-{run_id}-{part:06d}-{seq:05d}.warc" + (".gz" if packed else "")
            hidden = f"{base}/.tmp-{run_id}-{part}-{seq}-{tried}"
            fs.create_dir(name.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(hidden, compression=None) as f:
                for x in out:
                    f.write(x)
            fs.move(hidden, name)
            return pa.RecordBatch.from_pydict({"path": [folder + name.removeprefix(base)], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for i, u, t, d, n, to in zip(*(b[c].to_pylist() for c in ("id", "url", "html", "d", "n", "to"))):
                digest = base64.b32encode(bytes.fromhex(d)).decode()
                payload = t.encode() if to is None else bytes(n)
                r = record(i, u, payload, digest, to)
                if packed:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    r = z.compress(r) + z.flush()
                out.append(r)
                size += len(r)
                count += 1
                if size >= ROLL:
                    yield close()
                    out, size, count, seq = [], 0, 0, seq + 1
        if count:
            yield close()

    return rows.mapInArrow(run, "path string, records long, bytes long")


READ = "path string, start long, end long, kind string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, reason string"


def read(spark: SparkSession, folder: str | list[str], payloads: bool = False) -> DataFrame:
    """Rows of kind `record` and, for quarantined bytes, of kind `gap` with its reason, from all archives of a folder, or from the archives named.

    A response's length and digest come from its payload; a revisit's from its headers. With `payloads` a column
    `payload` holds the responses' bytes. An empty folder gives no rows.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    urn = re.compile(r"<urn:page:(-?\d+)>")

    def page(x):
        m = urn.fullmatch(x or "")
        return int(m[1]) if m else None

    def run(batches):
        for b in batches:
            for path, data in zip(b["path"].to_pylist(), b["content"]):
                cols: dict[str, list] = {k.split()[0]: [] for k in READ.split(", ")}
                body = []

                def batch():
                    kinds = {"path": pa.string(), "kind": pa.string(), "record_type": pa.string(), "payload_digest": pa.string(), "reason": pa.string()}
                    t = {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()}
                    if payloads:
                        t["payload"] = pa.array(body, pa.binary())
                    return pa.RecordBatch.from_pydict(t)

                for kind, start, end, head, block in salvage(data.as_py()):
                    row = dict.fromkeys(cols) | {"path": path, "start": start, "end": end, "kind": kind}
                    payload = None
                    if kind == "gap":
                        row["reason"] = head
                    else:
                        http, _, payload = block.partition(END)
                        row |= {"page_id": page(head.get("warc-record-id")), "record_type": head.get("warc-type")}
                        if head.get("warc-type") == "revisit":
                            payload = None
                            m = re.search(rb"(?i)content-length:\s*(\d+)", http)
                            row |= {"payload_bytes": int(m[1]) if m else None, "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "refers_to": page(head.get("warc-refers-to"))}
                        else:
                            row |= {"payload_bytes": len(payload), "payload_digest": payload_digest(payload)}
                    for k in cols:
                        cols[k].append(row[k])
                    body.append(payload if payloads else None)
                    if len(body) >= 1000:
                        yield batch()
                        for v in (*cols.values(), body):
                            v.clear()
                yield batch()

    return files.mapInArrow(run, READ + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as read back from the archives of all rows.

    Fails if other than the records written are read, or anything is quarantined. Only archives of committed tasks are
    read, so what a failed attempt left in the folder doesn't count. An empty table gives no rows; repeated rows and
    rows with a null id each give a row.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/pulseframe/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    done = cut(write(pages, folder, least=least), "archives")
    written = done.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    # a folder for each task that was committed; other attempts' archives don't count
    folders = [r[0] for r in done.select(F.regexp_replace("path", "/[^/]*$", "")).distinct().collect()]
    back = cut(read(spark, folders or folder).select("kind", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    records, gaps = back.agg(F.count_if(F.col("kind") == "record"), F.count_if(F.col("kind") == "gap")).first()
    if records != written or gaps:
        raise RuntimeError(f"{written} records written to {folder}, {records} and {gaps} gaps read back")
    return back.drop("kind")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
m AS (SELECT d, n, max(page_id) AS top FROM h GROUP BY d, n)
SELECT page_id, CAST(h.n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h.d, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM h JOIN m ON h.d = m.d AND h.n = m.n
"""
