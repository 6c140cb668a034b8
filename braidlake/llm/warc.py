"""WARC archives: monolithic gzip files, their normaliser and random access through the sidecar index."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm.common import byte_texts, fresh_path, id_or_max, id_or_null

CHUNK = 1 << 20
_DATE = "2000-01-01T00:00:00Z"  # the tables have no fetch time


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: bytes, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with its HTTP head and payload, or a revisit record with the head only."""
    target = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%d>" % page_id, b"WARC-Date: " + _DATE.encode(), b"WARC-Target-URI: " + target, b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _cleared(folder: str, keep: set[str]) -> None:
    """Deletes what repeated or lost attempts have left in a folder: all files but those of the attempts that count."""
    fs, root = _opened(folder)
    for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
        if f.base_name not in keep:
            fs.delete_file(f.path)


# ---------------------------------------------------------------- monolithic archives


def write_archives(typed: DataFrame, folder: str) -> list[str]:
    """Writes (id, url, payload, refers_to) as one whole-file gzip stream per partition; gives the files that have records.

    Each attempt of a task writes a file of its own name, and only the files that Spark takes as the tasks' results count;
    those of other attempts are deleted at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        sink, gz, n = None, zlib.compressobj(6, zlib.DEFLATED, 31), 0
        for b in batches:
            for i, url, payload, other in zip(b.column("id").to_pylist(), byte_texts(b.column("url")), byte_texts(b.column("payload")), b.column("refers_to").to_pylist(), strict=True):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                sink.write(gz.compress(record(i, url, payload, digest32(payload), other)))
                n += 1
        if sink is not None:
            sink.write(gz.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], type=pa.int64())], names=["path", "n"])

    paths = sorted(r["path"] for r in typed.mapInArrow(run, "path string, n long").collect())  # one row per file
    _cleared(folder, {p.rsplit("/", 1)[1] for p in paths})
    return paths


# ---------------------------------------------------------------- normaliser


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of bounded size. Each member must have its whole trailer; a file without any byte is cut off as well."""
    gz, data = zlib.decompressobj(31), b""
    while True:
        data = data or read(CHUNK)
        if not data:
            if not gz.eof:
                raise ValueError("the gzip stream is cut off")
            return
        if gz.eof:
            gz = zlib.decompressobj(31)
        out = gz.decompress(data, CHUNK)
        data = gz.unused_data if gz.eof else gz.unconsumed_tail
        if out:
            yield out


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, Iterator[bytes]]]:
    """(headers, the bytes of the head, the block and its end in pieces) per record. Each record's pieces must be used up before the next is asked for."""
    held = b""
    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            more = next(pieces, None)
            if more is None:
                if held.strip(b"\r\n"):
                    raise ValueError("the archive ends within a record")
                return
            held = (held + more).lstrip(b"\r\n") if not held else held + more
        head, held = held[: at + 4], held[at + 4 :]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}
        left = int(headers["content-length"]) + 4

        def body() -> Iterator[bytes]:
            nonlocal held, left
            while left:
                if not held:
                    held = next(pieces, b"")
                    if not held:
                        raise ValueError("the archive ends within a record")
                out, held = held[:left], held[left:]
                left -= len(out)
                yield out

        yield headers, head, body()
        if left:
            raise RuntimeError("a record was not read to its end")


def normalise_file(source: str, target: str) -> int:
    """Inflates a file once, writes every record as a gzip member of its own to target, and target.cdx with
    id, offset, length, type and digest of each record, one line each. Memory stays bounded for records of any size."""
    fs, path = _opened(source)
    out_fs, out_path = _opened(target)
    out_fs.create_dir(out_path.rsplit("/", 1)[0], recursive=True)
    lines, offset = [], 0
    with fs.open_input_stream(path, compression=None) as f, out_fs.open_output_stream(out_path, compression=None) as sink:
        for headers, head, body in split_records(inflated(f.read)):
            gz, start = zlib.compressobj(6, zlib.DEFLATED, 31), offset
            for piece in itertools.chain([head], body):
                data = gz.compress(piece)
                sink.write(data)
                offset += len(data)
            data = gz.flush()
            sink.write(data)
            offset += len(data)
            lines.append(f"{headers['warc-record-id'].removeprefix('<urn:page:').removesuffix('>')} {start} {offset - start} {headers['warc-type']} {headers.get('warc-payload-digest', '-')}\n")
    with out_fs.open_output_stream(f"{out_path}.cdx") as f:
        f.write("".join(lines).encode())
    return len(lines)


def _each(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One task for each file: a gzip stream can't be cut."""
    return spark.range(0, len(paths), 1, max(1, len(paths)))


def normalise(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Normalises gzip archives, one task each, into folder; gives the new files, whose index is beside each. As in write_archives, each attempt has file names of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                target = f"{folder}/{paths[i].rsplit('/', 1)[1].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:12]}.warc.gz"
                n = normalise_file(paths[i], target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], type=pa.int64())], names=["path", "n"])

    made = sorted(r["path"] for r in _each(spark, paths).mapInArrow(run, "path string, n long").collect())
    _cleared(folder, {name for p in made for name in (p.rsplit("/", 1)[1], p.rsplit("/", 1)[1] + ".cdx")})
    return made


# ---------------------------------------------------------------- reading through the index


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a member."""
    headers, _, body = next(split_records(iter([zlib.decompress(data, 31)])))
    block = b"".join(body)[:-4]
    return headers, block


_PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per record, each member found by its offset in the index and inflated on its own; a response whose payload differs from its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                fs, path = _opened(paths[k])
                with fs.open_input_stream(f"{path}.cdx") as f:
                    index = f.read().decode().splitlines()
                rows: list[tuple] = []
                with fs.open_input_file(path) as f:
                    for line in index:
                        _, offset, length, _, _ = line.split(" ")
                        f.seek(int(offset))
                        h, block = read_member(f.read(int(length)))
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and (len(payload), digest32(payload)) != (size, digest):
                            raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
                        other = re.fullmatch(r"<urn:page:(-?\d+)>", h.get("warc-refers-to", ""))
                        rows.append((int(re.fullmatch(r"<urn:page:(-?\d+)>", h["warc-record-id"])[1]), h["warc-target-uri"], size, digest, h["warc-type"], int(other[1]) if other else None))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return _each(spark, paths).mapInArrow(run, _PAGE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def archived(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a WARC record for each row of df, normalises the archives and reads them back:
    (page_id, url, payload_bytes, payload_digest, record_type, refers_to).

    Of records with equal payloads of at least `least` bytes the one with the largest id is a response and the others
    revisit it; smaller ones are all responses. Payloads are grouped by digest with partial aggregation, so a hot group
    is one row by the time it is shuffled; only groups of two or more are joined back, where AQE splits hot keys.

    Archives go to `folder`, by default a new one in the shared folder; each partition is one monolithic gzip file, which is
    removed once it is normalised. The shared folder must be one that pyarrow's file systems can open (file, hdfs, s3, gs).

    A null payload is empty, a null url empty; a null id counts as the largest one; rows that share the largest id of a
    group are all responses; an empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = df.select(id_or_max(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    hashed = rows.withColumn("digest", F.unhex(F.sha1(F.encode("payload", "UTF-8"))))
    groups = hashed.filter(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("same")).agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    typed = hashed.join(groups, (F.col("digest") == F.col("same")) & (F.octet_length("payload") >= least), "left").select("id", "url", "payload", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to"))
    raw = write_archives(typed, f"{folder}/raw")
    if not raw:
        return spark.createDataFrame([], _PAGE)
    paths = normalise(spark, raw, f"{folder}/archives")
    fs, path = _opened(f"{folder}/raw")
    fs.delete_dir(path)
    back = read_archives(spark, paths)
    return back.select(id_or_null(F.col("page_id")).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", id_or_null(F.col("refers_to")).alias("refers_to"))
