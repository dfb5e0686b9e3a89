"""WARC archives: write request, response or revisit, and metadata records; read them back; assemble transactions.

Which payload is stored is decided before writing: digests are aggregated (largest page id per digest, and of rows that
repeat it the first one) and those that repeat are written. A response that others revisit is named by its page and digest, so
WARC-Refers-To holds the id of a record that is in the archives; other records are named by task attempt and place. Up to MOST_REPEATED of them are broadcast, and no payload moves; a longer list is joined on the digest by
a shuffle, whose hot digests can be split. Each task then streams its
rows into gzip-membered archives in the shared folder and rolls to a new file at `roll_bytes`. A file's name holds the
task attempt, and the manifest of finished files is itself written as a table, so after a lost executor only the files
of attempts that succeeded are read. Files are opened through pyarrow's file systems by URI.

Assembly: request and metadata records name their response or revisit in WARC-Concurrent-To; the three kinds are joined
on it and each capture becomes one row with nested structs.

Nulls and edges: a null payload is empty. Rows with a null id are always stored as responses. Rows that repeat the
chosen id and payload are responses too, and one of them is the one that revisits name. A null url is written as an empty target.
An empty table gives no archives and no rows. Rows are told apart by their place in the scan, so pages should be a table that is read,
not one whose rows come in another order each time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import arrow_uri
from .common import WRITTEN, materialise, shared_dir, slices, table

MOST_REPEATED = 200_000  # digests of 40 characters with an id
REVISIT_LEAST = 1000  # bytes a payload needs to be stored once only
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, concurrent_to string, type string, refers_to string, target string, page_id long, payload_bytes long, payload_digest string, payload binary"


def planned(pages: DataFrame, least: int = REVISIT_LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, n, refers, named): refers is the id of the response that a revisit points to, else null; named is
    true for the responses that revisits point to."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload")).withColumn("row", F.monotonically_increasing_id())
    stored = rows.where(F.col("n") >= least).groupBy("digest").agg(F.max(F.struct("id", (-F.col("row")).alias("row"))).alias("m"), F.count("*").alias("of")).where("of > 1").select("digest", F.col("m.id").alias("first"), (-F.col("m.row")).alias("first_row"))
    stored = materialise(stored, "warc-repeated")
    out = rows.join(F.broadcast(stored) if stored.count() <= MOST_REPEATED else stored.hint("merge"), "digest", "left")
    return out.withColumn("refers", F.when((F.col("n") >= least) & (F.col("id") < F.col("first")), F.col("first"))).withColumn("named", (F.col("n") >= least) & F.coalesce(F.col("row") == F.col("first_row"), F.lit(False))).select("id", "url", "payload", "digest", "n", "refers", "named")


def member(kind: str, record_id: str, target: str, block: bytes, more: list[str]) -> bytes:
    """One record as a gzip member."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", *more, f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def one_line(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A").strip()


def page_record(page_id: int, digest: str) -> str:
    return f"urn:x-page:{page_id}:{digest}"


def capture(name: str, page_id, url: str, payload: bytes, digest: str, refers, named: bool) -> list[bytes]:
    """The response or revisit, its request and its metadata."""
    target = one_line(url)
    own = f"urn:x-capture:{name}"
    main_id = page_record(page_id, digest) if named else f"{own}:main"
    link = [f"WARC-Concurrent-To: <{main_id}>"]
    path = "/" + target.partition("://")[2].partition("/")[2]
    known = [f"WARC-Payload-Digest: sha1:{digest}"]
    if refers is None:
        main = member("response", main_id, target, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload, [*known, "Content-Type: application/http;msgtype=response"])
    else:
        main = member("revisit", main_id, target, b"HTTP/1.1 200 OK\r\n\r\n", [*known, f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{page_record(refers, digest)}>", "Content-Type: application/http;msgtype=response"])
    request = member("request", f"{own}:request", target, f"GET {path} HTTP/1.1\r\n\r\n".encode(), [*link, "Content-Type: application/http;msgtype=request"])
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-bytes: {len(payload)}\r\n".encode()
    return [main, request, member("metadata", f"{own}:metadata", target, fields, [*link, "Content-Type: application/warc-fields"])]


def write_archives(plan: DataFrame, roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes the archives and returns the written manifest (path, records, bytes) of finished files."""
    spark = plan.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    WRITTEN.append(folder)

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(arrow_uri(folder))
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        label, n, part, sink, size, records = f"{task.partitionId()}-{task.taskAttemptId()}", 0, 0, None, 0, 0
        done = []
        for whole in batches:
            for batch in slices(whole):
                for page_id, url, payload, digest, _, refers, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sink is None:
                        name = f"part-{label}-{part}.warc.gz"
                        sink, size, records, part = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0, part + 1
                    for raw in capture(f"{label}-{n}", page_id, url, payload, digest, refers, named):
                        sink.write(raw)
                        size, records = size + len(raw), records + 1
                    n += 1
                    if size >= roll_bytes:
                        sink.close()
                        done.append((name, records, size))
                        sink = None
        if sink is not None:
            sink.close()
            done.append((name, records, size))
        names = pa.array([[{"path": f"{folder}/{n}", "records": r, "bytes": b} for n, r, b in done]], pa.list_(pa.struct([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])))
        yield pa.record_batch([names], ["files"])

    # One row per task: a task that runs again sends its row where the first one went, so a reader has the files of one run.
    rows = plan.select("id", "url", "payload", "digest", "n", "refers", "named")
    finished = rows.mapInArrow(run, "files array<struct<path:string,records:long,bytes:long>>")
    few = finished.repartition(max(1, spark.sparkContext.defaultParallelism // 4))
    return materialise(few.select(F.inline("files")), "warc-manifest")


def members(stream, chunk: int = 1 << 16):
    """The decompressed gzip members of a stream, one after another."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while raw := rest or stream.read(chunk):
        rest = b""
        out.append(z.decompress(raw))
        if z.eof:
            yield b"".join(out)
            rest, z, out = z.unused_data, zlib.decompressobj(31), []
    if any(out):
        raise ValueError("an archive ends within a record")


def parse(raw: bytes, with_payload: bool) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    kind, payload, page_id, n, digest = h["warc-type"], None, None, None, None
    if kind == "metadata":
        f = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
        page_id, n = int(f["page-id"]) if f.get("page-id") else None, int(f["payload-bytes"])
    elif kind in ("response", "revisit"):
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            n = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    bare = lambda x: x and x.strip("<>")
    return bare(h["warc-record-id"]), bare(h.get("warc-concurrent-to")), kind, bare(h.get("warc-refers-to")), h.get("warc-target-uri"), page_id, n, digest, payload if with_payload else None


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives listed in the manifest; payload digests are verified."""
    schema = pa.schema([("record_id", pa.string()), ("concurrent_to", pa.string()), ("type", pa.string()), ("refers_to", pa.string()), ("target", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(arrow_uri(uri))
                held, size = [], 0
                with system.open_input_stream(path, compression=None) as f:
                    for raw in members(f):
                        held.append(parse(raw, with_payload))
                        size += len(raw) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    files = manifest.select("path")
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n, "path").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: structs response (or revisit), request, metadata; missing companions are null. If several
    records of a kind name the same capture, the one with the smallest record id is taken and `n_*` counts them. Both
    kinds of companions meet by the capture's id in one aggregate, which is then joined."""
    mine = records.where(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    of = lambda kind, *columns: F.when(F.col("type") == kind, F.struct("record_id", *columns))
    first = [F.min(of("request", "target")).alias("request"), F.count_if(F.col("type") == "request").alias("n_request"), F.min(of("metadata", "page_id", "payload_bytes")).alias("metadata"), F.count_if(F.col("type") == "metadata").alias("n_metadata")]
    companions = mine.groupBy(F.col("concurrent_to").alias("main_id")).agg(*first)
    main = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("main_id"), F.struct("record_id", "type", "refers_to", "target", "payload_bytes", "payload_digest", "payload").alias("response"))
    return main.join(companions.hint("merge"), "main_id", "left")


def op8(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(planned(table(spark, sf_dir, "pages")))
    got = transactions(read_archives(manifest, with_payload=False))
    return got.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.regexp_extract("response.refers_to", r"^urn:x-page:(-?\d+):", 1).try_cast("long").alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS h FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < m THEN m END AS refers_to
FROM f
"""
