"""Sharded WARC archives: the same rows give the same files, and nothing counts before its manifest is in place.

Rows are put in order of key and payload digest, the order is cut into segments by running payload bytes, and one
task writes each segment. Where a segment begins depends on the data alone, so file names, contents and digests do
not depend on the cluster. Every file is written under a temporary name and renamed when it is whole; a task that
runs twice writes the same bytes under the same names. The manifest (a table of the files) is renamed last, and the
reader reads only files of a manifest.

Records: a payload of at least ``least`` bytes that several rows share is stored once, by the row with the largest
key; the others become ``revisit`` records that name it. Rows that share key and payload: the first stores it.
Defined cases: a null payload is empty; null keys come first; a null or empty address becomes ``urn:row``; control
characters and spaces of an address are percent-encoded; further columns are ignored; an empty table gives an empty
manifest. A key that holds very many rows is written by as few tasks as its payloads' digests span.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions.series import running_total
from strataline.llm.common import Steps, join_unique
from strataline.settings import ship

# Raw payload bytes of a segment, and the most segments of an archive: larger archives have larger segments.
SEGMENT_BYTES, MOST_SEGMENTS = 32 << 20, 65_536
# A file is closed once it holds so many compressed bytes.
ROLL_BYTES = 64 << 20
LEAST_BYTES = 1000
MANIFEST = "file string, segment long, records long, file_bytes long, file_sha1 string, first_key string, last_key string"
BATCH_BYTES = 8 << 20
_READ = 1 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder's address, as Spark writes it (``file:/x``, ``hdfs://…``, ``s3://…``)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _address(url: str | None, key: str | None) -> str:
    if not url:
        return "urn:row"
    return "".join(c if "\x21" <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _record_id(key: str | None, digest: bytes, nth: int) -> str:
    name = hashlib.sha256(f"{'' if key is None else 'k' + key}\n{nth}\n".encode() + digest).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=name[:16], version=4)}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without time stamp."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Files:
    """The files of one segment, rolled by compressed size."""

    def __init__(self, folder: str, segment: int, date: str, roll: int):
        self.system, self.path = _open(folder)
        self.segment, self.date, self.roll = segment, date, roll
        self.count, self.out, self.done = 0, None, []

    def _begin(self) -> None:
        self.name = f"part-{self.segment:06d}-{self.count:05d}.warc.gz"
        self.count += 1
        self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.temporary, compression=None)
        self.size, self.records, self.hash, self.first, self.last = 0, 0, hashlib.sha1(), None, None
        block = f"software: strataline\r\nformat: WARC File Format 1.1\r\nfile: {self.name}\r\n".encode()
        self._put(
            _member(
                [
                    ("WARC-Type", "warcinfo"),
                    ("WARC-Record-ID", _record_id(self.name, b"", 0)),
                    ("WARC-Date", self.date),
                    ("WARC-Filename", self.name),
                    ("Content-Type", "application/warc-fields"),
                    ("WARC-Block-Digest", _sha1(block)),
                ],
                block,
            )
        )

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def add(self, key: str | None, member: bytes) -> None:
        if self.out is None:
            self._begin()
        if not self.records:
            self.first = key
        self._put(member)
        self.records, self.last = self.records + 1, key
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.system.move(self.temporary, f"{self.path}/{self.name}")
        self.done.append((self.name, self.segment, self.records, self.size, self.hash.hexdigest(), self.first, self.last))
        self.out = None


def _write(folder: str, date: str, roll: int, least: int):
    """Rows in order of segment, key, digest and kind (a decision, then the rows it is about) to files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split(" ") for c in MANIFEST.split(", "))]
        )
        files: _Files | None = None
        before, nth, winner = None, 0, None
        for piece in batches:
            for segment, key, digest, kind, url, payload, best in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if files is None or files.segment != segment:
                    if files is not None:
                        files.close()
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in files.done], schema)
                    files = _Files(folder, segment, date, roll)
                if before != (key, digest):
                    before, nth, winner = (key, digest), 0, None
                if kind == 0:
                    winner = (best,)
                    continue
                data = (payload or "").encode()
                own = winner is None and (nth == 0 or len(data) < least)
                refers = key if winner is None else winner[0]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n\r\n".encode()
                block = http + data if own else http
                headers = [
                    ("WARC-Type", "response" if own else "revisit"),
                    ("WARC-Record-ID", _record_id(key, digest, nth)),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", _address(url, key)),
                    ("Content-Type", "application/http; msgtype=response"),
                    ("WARC-Payload-Digest", _sha1(data)),
                    ("WARC-Block-Digest", _sha1(block)),
                ]
                if key is not None:
                    headers.append(("X-Row-Key", base64.b64encode(key.encode()).decode()))
                if not own:
                    headers += [
                        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                        ("WARC-Refers-To", _record_id(refers, digest, 0)),
                    ]
                    if refers is not None:
                        headers.append(("X-Refers-To-Key", base64.b64encode(refers.encode()).decode()))
                files.add(key, _member(headers, block))
                nth += 1
        if files is not None:
            files.close()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d, strict=True)) for d in files.done], schema)

    return run


def _segment_of(bounds: list[tuple]):
    """The segment of a row by binary search in the segments' first (key, digest); null keys come first."""
    first = [(k is not None, k if k is not None else 0, bytes(d)) for k, d in bounds]

    @F.arrow_udf("long")
    def place(key: pa.Array, digest: pa.Array) -> pa.Array:
        found = (
            bisect_right(first, (False, 0, d) if k is None else (True, k, d)) - 1 for k, d in zip(key.to_pylist(), digest.to_pylist(), strict=True)
        )
        return pa.array([max(0, x) for x in found], pa.int64())

    return place


def write_warc(
    pages: DataFrame,
    folder: str,
    *,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    least: int = LEAST_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write the rows as an archive below ``folder`` (a new folder that all executors reach) and return its manifest.

    Keys (whole numbers or strings) and digests of all rows are sorted without the payloads; payloads are shuffled once, to the
    task that writes their segment, next to one small row per revisit. ``functions.running_total`` numbers the bytes, so no
    task sees the whole order. The driver holds one row per segment, at most 65,536.
    """
    spark = pages.sparkSession
    ship(spark)
    steps = Steps(spark, "warc")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    held = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if held.exists(hadoop(f"{folder}/manifest")):
        raise FileExistsError(f"{folder} already has a manifest")
    whole = pages.select(
        F.col(key).alias("key"),
        F.unhex(F.sha2(F.coalesce(payload, F.lit("")).cast("binary"), 256)).alias("digest"),
        F.col(url).alias("url"),
        F.coalesce(payload, F.lit("")).alias("payload"),
    )
    light = steps.keep(whole.select("key", "digest", F.octet_length("payload").cast("long").alias("n_bytes")))
    total, n = light.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    step = max(segment_bytes, -(-(total or 0) // MOST_SEGMENTS), 1)
    upto = running_total(light, [], ["key", "digest"], F.col("n_bytes"), n)
    placed = steps.keep(upto.select("key", "digest", "n_bytes", F.floor((F.col("_upto") - F.col("n_bytes")) / step).alias("segment")))
    bounds = [
        (r.s, r.f["key"], r.f["digest"])
        for r in placed.groupBy(F.col("segment").alias("s")).agg(F.min(F.struct("key", "digest")).alias("f")).collect()
    ]
    bounds.sort(key=lambda b: b[0])
    shared = steps.keep(
        light.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("key").alias("best"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )
    place = _segment_of([b[1:] for b in bounds])
    gone = join_unique(light.select("key", "digest").distinct(), shared, "digest", F.col("copies") * 1000 > n).where(~F.col("key").eqNullSafe(F.col("best")))
    absent = F.lit(None).cast("string")
    decisions = gone.select(
        place("key", "digest").alias("segment"), "key", "digest", F.lit(0).alias("kind"), absent.alias("url"), absent.alias("payload"), "best"
    )
    rows = whole.select(
        place("key", "digest").alias("segment"), "key", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast(light.schema["key"].dataType).alias("best")
    )
    last = max((b[0] for b in bounds), default=0) + 1
    dealt = (
        rows.unionByName(decisions)
        .repartitionById(last, F.col("segment").cast("int"))
        .sortWithinPartitions("segment", "key", "digest", "kind", "url")
        .select("segment", F.col("key").cast("string"), "digest", "kind", "url", "payload", F.col("best").cast("string"))
    )
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    temporary = f"{folder}/.manifest-{uuid.uuid4().hex}"
    dealt.mapInArrow(_write(folder, date, roll_bytes, least), MANIFEST).write.parquet(temporary)
    if not held.rename(hadoop(temporary), hadoop(f"{folder}/manifest")):
        raise OSError(f"the manifest of {folder} could not be put in place")
    steps.drop_all_but()
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORD = (
    "file string, record_id string, record_type string, key string, url string, payload_bytes long, "
    "payload_digest string, refers_to string, refers_to_id string, payload string"
)


class _Source:
    """The decompressed records of a file, gzip member after gzip member."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def members(self) -> Iterator[bytes]:
        while True:
            if not self.rest:
                self.rest = self.stream.read(_READ)
                if not self.rest:
                    return
            unpacker, parts = zlib.decompressobj(31), []
            while not unpacker.eof:
                if not self.rest:
                    self.rest = self.stream.read(_READ)
                    if not self.rest:
                        raise ValueError("archive ends within a record")
                parts.append(unpacker.decompress(self.rest))
                self.rest = unpacker.unused_data
            yield b"".join(parts)


def _parse(member: bytes, file: str) -> dict | None:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"{file}: not a WARC record")
    found = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(found["Content-Length"])]
    if len(block) != int(found["Content-Length"]) or _sha1(block) != found["WARC-Block-Digest"]:
        raise ValueError(f"{file}: {found['WARC-Record-ID']} is damaged")
    if found["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    own = found["WARC-Type"] == "response"
    if own and (len(payload) != size or _sha1(payload) != found["WARC-Payload-Digest"]):
        raise ValueError(f"{file}: payload of {found['WARC-Record-ID']} is damaged")

    def name(header: str) -> str | None:
        return base64.b64decode(found[header]).decode() if header in found else None

    return {
        "file": file,
        "record_id": found["WARC-Record-ID"],
        "record_type": found["WARC-Type"],
        "key": name("X-Row-Key"),
        "url": found["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": base64.b32decode(found["WARC-Payload-Digest"][5:]).hex(),
        "refers_to": name("X-Refers-To-Key"),
        "refers_to_id": found.get("WARC-Refers-To"),
        "payload": payload.decode() if own else None,
    }


def read_warc(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names, headers parsed and every digest checked.

    A missing manifest, a missing or shortened file or a wrong digest fails. A revisit has no payload of its own;
    its ``payload_bytes`` and ``payload_digest`` are those of the full payload.
    """
    ship(spark)
    manifest = read_manifest(spark, folder)
    kinds = [(c.split(" ")[0], pa.int64() if c.endswith("long") else pa.string()) for c in RECORD.split(", ")]
    schema = pa.schema(kinds if payloads else kinds[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            for file, size, records in zip(*(piece.column(c).to_pylist() for c in ("file", "file_bytes", "records")), strict=True):
                system, path = _open(folder)
                if system.get_file_info(f"{path}/{file}").size != size:
                    raise ValueError(f"{file}: not as the manifest has it")
                found, held, count = [], 0, 0
                with system.open_input_stream(f"{path}/{file}", compression=None) as stream:
                    for member in _Source(stream).members():
                        row = _parse(member, file)
                        if row is None:
                            continue
                        count += 1
                        if not payloads:
                            del row["payload"]
                        found.append(row)
                        held += len(member) if payloads else 500
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held = [], 0
                if count != records:
                    raise ValueError(f"{file}: {count} records, the manifest has {records}")
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    parts = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.repartition(parts, "file").mapInArrow(run, RECORD if payloads else RECORD.rsplit(", ", 1)[0])
