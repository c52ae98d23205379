"""Pages as WARC archives: an index written first, records read by coalesced byte ranges.

Each task writes gzip archives, one member per record, straight to the shared folder, and gives
one index row per record: archive, offset, length, URL and digest. The index is a table of its
own; archives of a task that failed are in no index, so a task may run again. To read, records
are selected in the index, sorted by archive and offset, and near ones joined to one range;
ranges, not records, are dealt out to tasks and read with one request each.

Payloads that are equal are kept once: all but one of their records are revisits, which hold the
HTTP headers only and name the record they refer to.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import BATCH_BYTES, in_batches, partitions, text_of, work_path, written
from quarry.llm.ranges import with_totals

#: Shorter payloads are never revisited.
LEAST = 100
#: An archive is closed at so many bytes.
ARCHIVE = 256 << 20
#: Ranges with at most so many bytes between them are read together, up to READ bytes and one record.
GAP, READ = 64 << 10, 4 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def decided(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page with its digest and record type: (page_id, url, payload, digest, n_bytes, record_type, refers_to).

    Of equal payloads of LEAST bytes or more the smallest page_id (null last) is the response;
    of rows that share that id too, one.
    """
    payload = F.encode(text_of(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    ids = rows.filter(F.col("n_bytes") >= LEAST).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "n"))
    copies = ids.groupBy("digest").agg(first.alias("of"), F.sum("n").alias("n_rows")).filter("n_rows > 1")
    copies = written(copies.select("digest", F.col("of.page_id").alias("first_id"), F.col("of.n").alias("n_first"), "n_rows"), "warc-copies")
    met = with_totals(rows, copies, "digest", "n_rows")
    leads = F.col("n_rows").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    plain = ["page_id", "url", "payload", "digest", "n_bytes"]
    kind = lambda is_first: (F.when(is_first, "response").otherwise("revisit").alias("record_type"), F.when(~is_first, F.col("first_id")).alias("refers_to"))
    tied = F.coalesce(F.col("n_first") > 1, F.lit(False)) & leads
    if copies.filter("n_first > 1").isEmpty():
        return met.select(*plain, *kind(leads))
    # rows that only their place tells apart: written, so that the place stays
    several = written(met.filter(tied).select(*plain, "first_id", F.monotonically_increasing_id().alias("row")), "warc-ties")
    stays = written(several.groupBy("digest").agg(F.min("row").alias("least"), F.count("*").alias("n_tied")), "warc-least")
    several = with_totals(several, stays, "digest", "n_tied")
    return met.filter(~tied).select(*plain, *kind(leads)).unionByName(several.select(*plain, *kind(F.col("row") == F.col("least"))))


def _record_id(page_id: int | None, digest: str, copy: str = "") -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}{copy}>"


def _plain(url: str | None) -> str:
    """A URL as a header's value: percent signs of ours for control characters only."""
    return "urn:x-none" if url is None else "".join(f"%{ord(x):02X}" if x < " " or x == "\x7f" else x for x in url)


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + squeeze.flush()


def _write(root: str, date: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        task, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, name, at, n, n_records = None, "", 0, 0, 0
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if out is None:
                    name, n = f"{task:06}-{own}-{n:04}.warc.gz", n + 1
                    out = store.open_output_stream(posixpath.join(folder, name), compression=None)
                    info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: quarry\r\n")
                    out.write(info)
                    at = len(info)
                response = r["record_type"] == "response"
                once = response and r["n_bytes"] >= LEAST
                fields = [
                    ("WARC-Record-ID", _record_id(r["page_id"], r["digest"], "" if once else f":{own}-{n_records}")),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", _plain(r["url"])),
                    ("WARC-Payload-Digest", f"sha256:{r['digest']}"),
                    ("Content-Type", HTTP),
                ]
                if not response:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(r["refers_to"], r["digest"]))]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['n_bytes']}\r\n\r\n".encode()
                data = _record(r["record_type"], fields, http + (r["payload"] or b""))
                out.write(data)
                found.append({"page_id": r["page_id"], "url": r["url"], "record_type": r["record_type"], "refers_to": r["refers_to"], "payload_digest": r["digest"], "payload_bytes": r["n_bytes"], "archive": name, "offset": at, "length": len(data)})
                at, n_records = at + len(data), n_records + 1
                if at >= ARCHIVE:
                    out.close()
                    out = None
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=schema)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, root: str | None = None, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write one record per row of ``pages`` into archives under ``root``; returns the root and its index.

    The index has page_id, url, record_type, refers_to, payload_digest, payload_bytes, archive,
    offset and length. Null html is an empty payload, a null URL is written as urn:x-none; control
    characters of a URL are written percent-encoded. Repeated rows are records of their own; an empty
    table gives an empty index and no archive. A payload of any size is one record, held whole by
    its task. Other columns are not read. ``root`` is a folder that all executors reach, by path or URI
    of a store that pyarrow opens; it defaults to one in the shared folder.
    """
    spark = pages.sparkSession
    root = (root or work_path(spark, "warc")).rstrip("/")
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    rows = decided(pages, id_col, url_col, html_col)
    rows = rows.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    in_batches(rows).mapInArrow(_write(root, date), INDEX).write.parquet(f"{root}/index")
    return root, read_index(spark, root)


def read_index(spark, root: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{root}/index")


def ranges(selected: DataFrame) -> DataFrame:
    """Index rows joined to byte ranges: (archive, at, size, records), records (offset, length) in order.

    A range ends where more than GAP bytes are not wanted and at each multiple of READ.
    """
    order = Window.partitionBy("archive").orderBy("offset")
    before = F.lag("offset").over(order)
    cut = before.isNull() | (F.col("offset") - before - F.lag("length").over(order) > GAP) | (F.floor(F.col("offset") / READ) != F.floor(before / READ))
    wanted = selected.select("archive", "offset", "length").withColumn("cut", cut.cast("long")).withColumn("range", F.sum("cut").over(order))
    end = F.max(F.col("offset") + F.col("length"))
    joined = wanted.groupBy("archive", "range").agg(F.min("offset").alias("at"), (end - F.min("offset")).alias("size"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))
    return joined.drop("range")


def parsed(data: bytes) -> dict:
    """A record's fields, its payload checked against its digest. A record that does not check is an error."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines)
    size = int(field["Content-Length"])
    if version != VERSION or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not one whole record: {field.get('WARC-Record-ID')}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    said = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = field["WARC-Payload-Digest"].removeprefix("sha256:"), field["WARC-Type"]
    page = lambda name: None if (x := field[name].split(":")[2]) == "null" else int(x)
    found = {"page_id": page("WARC-Record-ID"), "url": None if field["WARC-Target-URI"] == "urn:x-none" else field["WARC-Target-URI"], "record_type": kind, "refers_to": None, "payload_digest": digest, "payload_bytes": said, "payload": None}
    if kind == "revisit":
        return found | {"refers_to": page("WARC-Refers-To")}
    found |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    if (found["payload_digest"], len(payload)) != (digest, said):
        raise ValueError(f"payload does not match its digest: {field['WARC-Record-ID']}")
    return found


def _read(root: str):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(root)
        name, archive, found, held = None, None, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != name:
                    if archive is not None:
                        archive.close()
                    name, archive = r["archive"], store.open_input_file(posixpath.join(folder, r["archive"]))
                data = memoryview(archive.read_at(r["size"], r["at"]))
                for x in r["records"]:
                    start = x["offset"] - r["at"]
                    found.append(parsed(data[start : start + x["length"]]))
                    held += len(found[-1]["payload"] or b"") + 200
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found, held = [], 0
        if archive is not None:
            archive.close()
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return run


def read_records(root: str, selected: DataFrame) -> DataFrame:
    """The records of the index rows ``selected``: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    Digest and bytes of a response are those of the payload as read, of a revisit those of the full
    payload as its headers say; a revisit has no payload of its own. A damaged record ends the job.
    No rows give no records; a row selected twice is read twice.
    """
    wanted = ranges(selected).repartition(partitions(selected.sparkSession), "archive", "at").sortWithinPartitions("archive", "at")
    return in_batches(wanted).mapInArrow(_read(root), RECORD)


def page_archive(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    root, index = write_archives(pages)
    return read_records(root, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
