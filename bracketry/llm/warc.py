"""WARC archives as a Python data source of Spark, and their records from pages.

The writer makes plain WARC 1.1 files: headers are readable as they are, a response's payload is compressed inside its HTTP
block (Content-Encoding), so that a reader passes over a record by its Content-Length without decoding anything. A small index
beside each file has the offset of the first record of each stretch; partitions are stretches of files. A task writes files
of its own names and the driver commits a list of them: files of lost or repeated attempts are on no list and are not read.

The reader takes .warc and .warc.gz files from elsewhere too, whole files a partition if they have no index. It parses headers
first, tests the predicates that were pushed down, and decodes a payload only if the record passes and the schema asks for it.
"""

from __future__ import annotations

import gzip
import io
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import left_join_by_size, materialize

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, content_type string, payload binary"
#: Columns that headers give; predicates on them are tested before a payload is decoded.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
#: Fixed values of the format.
VERSION, PROFILE, HTTP = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "application/http; msgtype=response"
#: Bytes of payloads from which equal ones are revisits; a file's and a partition's size, and how far index entries are apart.
MIN_REVISIT, FILE_BYTES, SPLIT_BYTES, INDEX_BYTES = 100, 1 << 30, 64 << 20, 1 << 20
BATCH_BYTES, LEVEL, EPOCH = 8 << 20, 4, "1970-01-01T00:00:00Z"
LONGEST_LINE = 1 << 20


def _safe(value: str) -> str:
    """A header's value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]|^ +| +$", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), value)


def record_bytes(row: dict) -> bytes:
    """A record. A revisit has the HTTP headers of its block and no payload; types other than response and revisit have a plain block."""
    kind, payload = row.get("record_type") or "response", row.get("payload")
    payload = payload or b""
    digest = row.get("payload_digest") or sha256(payload).hexdigest()
    size = row.get("payload_bytes")
    size = len(payload) if size is None else size
    lines = [VERSION, f"WARC-Type: {_safe(kind)}", f"WARC-Record-ID: <{_safe(row.get('record_id') or uuid.uuid4().urn)}>", f"WARC-Date: {_safe(row.get('date') or EPOCH)}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {_safe(row['target_uri'])}")
    lines += [f"WARC-Payload-Digest: sha256:{_safe(digest)}", f"X-Payload-Bytes: {size}"]
    content = row.get("content_type")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
        if row.get("refers_to") is not None:
            lines.append(f"WARC-Refers-To: <{_safe(row['refers_to'])}>")
    if kind in ("response", "revisit"):
        http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
        body = b""
        if kind == "response":
            packed = zlib.compress(payload, LEVEL, 31)
            body, coded = (packed, True) if len(packed) < len(payload) else (payload, False)
            http += [*["Content-Encoding: gzip"] * coded, f"Content-Length: {len(body)}"]
        block, content = "\r\n".join([*http, "", ""]).encode() + body, content or HTTP
    else:
        block, content = payload, content or "application/octet-stream"
    lines += [f"Content-Type: {_safe(content)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while at < len(body):
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def payload_of(block: bytes, content_type: str | None) -> bytes:
    """The decoded body of an HTTP block (chunks, gzip and deflate; other codings stay as they are), else the whole block."""
    if not (content_type or "").lower().startswith("application/http"):
        return block
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return b""
    http = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if b"chunked" in http.get(b"transfer-encoding", b""):
        body = _dechunked(body)
    coding = http.get(b"content-encoding", b"")
    if coding in (b"gzip", b"x-gzip"):
        return gzip.decompress(body)
    if coding == b"deflate":
        return zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
    return body


def _line(stream: io.BufferedIOBase) -> bytes:
    line = stream.readline(LONGEST_LINE)
    if len(line) == LONGEST_LINE and not line.endswith(b"\n"):
        raise ValueError("a header line is too long: this is no WARC file")
    return line


def headers_of(stream: io.BufferedIOBase) -> dict[str, str] | None:
    """Headers of the record that begins here, by lower-case names; None at the end of the file."""
    line = _line(stream)
    while line and not line.strip():
        line = _line(stream)
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins with {line[:40]!r}")
    out, last = {}, ""
    while (line := _line(stream)).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and last:
            out[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            out[last := name.strip().lower()] = value.strip()
    return out


def _values(h: dict[str, str]) -> dict:
    """Columns that the headers give."""
    out = {c: h.get(name) for c, name in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if out[c] is not None:
            out[c] = out[c].removeprefix("<").removesuffix(">")
    digest = out["payload_digest"]
    out["payload_digest"] = digest.partition(":")[2] if digest and digest.lower().startswith("sha256:") else digest
    size = h.get("x-payload-bytes", "")
    out["payload_bytes"] = int(size) if size.isdigit() else None
    return out


def _holds(f: ds.Filter, row: dict) -> bool:
    if isinstance(f, ds.Not):
        return row[f.child.attribute[0]] is not None and not _holds(f.child, row)
    v = row[f.attribute[0]]
    if isinstance(f, ds.IsNull):
        return v is None
    if isinstance(f, ds.EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    if isinstance(f, ds.IsNotNull):
        return True
    if isinstance(f, ds.EqualTo):
        return v == f.value
    if isinstance(f, ds.In):
        return v in f.value
    return v.startswith(f.value) if isinstance(f, ds.StringStartsWith) else v.endswith(f.value) if isinstance(f, ds.StringEndsWith) else f.value in v


def _pushable(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return isinstance(f.child, (ds.EqualTo, ds.In, ds.StringStartsWith)) and _pushable(f.child)
    known = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)
    return isinstance(f, known) and tuple(f.attribute) in {(c,) for c in HEADERS}


@dataclass
class Stretch(ds.InputPartition):
    """Records of a file that begin from start up to end; without an index, all."""

    uri: str
    start: int
    end: int
    indexed: bool

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list = field(default_factory=list)


def _committed(fs: pafs.FileSystem, base: str) -> list[dict] | None:
    """Files on the lists of a folder; None if it has no list."""
    lists = [f for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("_committed-")]
    if not lists:
        return None
    out = []
    for f in sorted(lists, key=lambda f: f.path):
        with fs.open_input_stream(f.path) as s:
            out += json.loads(s.read())
    return out


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.filters = schema, options["path"], []
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, base = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(base)
        scheme = self.path[: len(self.path) - len(base)] if self.path.endswith(base) else ""
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            files = [(base, info.size, False)]
        elif (own := _committed(fs, base)) is not None:
            files = [(f"{base}/{f['name']}", f["bytes"], True) for f in own]
        else:
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
            files = [(f.path, f.size, False) for f in found if f.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", f.base_name) and f.base_name[0] not in "._"]
        return [Stretch(scheme + p, a, min(a + self.split, n), True) for p, n, indexed in files if indexed for a in range(0, n, self.split)] + [Stretch(scheme + p, 0, n, False) for p, n, indexed in files if not indexed]

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        columns, payload = self.schema.names, "payload" in self.schema.names
        kind = to_arrow_schema(self.schema)
        held: list[dict] = []
        size = 0
        for row in records(partition, self.filters, payload):
            held.append(row)
            size += 400 + len(row.get("payload") or b"")
            if size > BATCH_BYTES:
                yield _batch(held, columns, kind)
                held, size = [], 0
        if held:
            yield _batch(held, columns, kind)


def _batch(rows: list[dict], columns: list[str], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind.field(c).type) for c in columns], schema=kind)


def records(part: Stretch, filters: list[ds.Filter] = (), payload: bool = True) -> Iterator[dict]:
    """Rows of a stretch. What fails a filter, and payloads if they are not asked for, are passed over undecoded.

    Where a record has a payload and a digest of it, they must agree; another payload is an error.
    """
    fs, base = pafs.FileSystem.from_uri(part.uri)
    at, stop = 0, None
    if part.indexed:
        with fs.open_input_stream(f"{base}.idx") as s:
            index = np.frombuffer(s.read(), "<i8")
        ahead, behind = (int(np.searchsorted(index, x)) for x in (part.start, part.end))
        if ahead == behind:
            return
        at, stop = int(index[ahead]), int(index[behind]) if behind < len(index) else None
    with fs.open_input_file(base) as file:
        file.seek(at)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=file) if base.endswith(".gz") else file, 1 << 18)
        while stop is None or stream.tell() < stop:
            h = headers_of(stream)
            if h is None:
                return
            n = int(h["content-length"])
            row = _values(h)
            wanted = all(_holds(f, row) for f in filters)
            if wanted and payload and row["record_type"] != "revisit":
                block = stream.read(n)
                if len(block) < n:
                    raise ValueError(f"{part.uri} ends inside a record")
                row["payload"] = payload_of(block, row["content_type"])
                if re.fullmatch("[0-9a-f]{64}", row["payload_digest"] or "") and sha256(row["payload"]).hexdigest() != row["payload_digest"]:
                    raise ValueError(f"record {row['record_id']} of {part.uri} is damaged")
                row["payload_bytes"] = len(row["payload"])
            else:
                stream.seek(n, io.SEEK_CUR)
            if part.indexed:
                stream.read(4)  # the end of a record is not the beginning of the next one
            if wanted:
                yield row


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("fileBytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        rows = (r for b in iterator for i in range(0, b.num_rows, 16) for r in b.slice(i, 16).to_pylist())
        done = Written()
        for first in rows:
            name, size, n, index, due = f"part-{uuid.uuid4().hex}.warc", 0, 0, [], 0
            with fs.open_output_stream(f"{base}/{name}") as out:
                about = {"record_type": "warcinfo", "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"}
                for row in itertools.chain([about, first], rows):
                    data = record_bytes(row)
                    if size >= due:
                        index.append(size)
                        due = size + INDEX_BYTES
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= self.file_bytes:
                        break
            with fs.open_output_stream(f"{base}/{name}.idx") as out:
                out.write(np.array(index, "<i8").tobytes())
            done.files.append({"name": name, "bytes": size, "records": n})
        return done

    def commit(self, messages):
        fs, base = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(base, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("_committed-")] if self.overwrite else []
        gone = _committed(fs, base) or [] if self.overwrite else []
        with fs.open_output_stream(f"{base}/_committed-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())
        for p in old:
            fs.delete_file(p)
        self._remove(fs, base, gone)

    def abort(self, messages):
        fs, base = pafs.FileSystem.from_uri(self.path)
        self._remove(fs, base, [f for m in messages if m for f in m.files])

    @staticmethod
    def _remove(fs, base, files):
        for f in files:
            for p in (f"{base}/{f['name']}", f"{base}/{f['name']}.idx"):
                fs.delete_file(p)


class Warc(ds.DataSource):
    """format("warc"): options path, splitBytes (reader) and fileBytes (writer). A schema without payload decodes none."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known, with predicates pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Records of a file or a folder, with the columns of schema, which may be any of SCHEMA."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records with any columns of SCHEMA; others are left out. A row without a type is a response, one without an id gets a new one."""
    register(records.sparkSession)
    known = [c.split()[0] for c in SCHEMA.split(", ")]
    records.select(*[c for c in known if c in records.columns]).write.format("warc").mode(mode).save(path)


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def page_id(record_id_: Column) -> Column:
    return F.regexp_extract(record_id_, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of pages: of equal payloads of MIN_REVISIT bytes and more the first one is a response, others revisit it.

    The first has the smallest id (a null one comes last), then the smallest url; of rows equal in all three one is the
    response. A null html is an empty payload, and small payloads are all responses. An empty table gives no rows. Only
    digests are grouped, in the tasks that read them first; payloads are not shuffled unless many different ones repeat, and
    one that a large share of all pages has is met by a broadcast of its digest. Other columns are not read.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    seen = rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "id", "target_uri").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "target_uri", "copies")).alias("first")
    repeats = seen.groupBy("payload_digest").agg(first, F.sum("copies").alias("n")).where("n > 1")
    repeats = materialize(repeats, "repeats")
    met = left_join_by_size(rows, repeats, ["payload_digest"], "n")
    leads = F.col("first.id").eqNullSafe(F.col("id")) & F.col("first.target_uri").eqNullSafe(F.col("target_uri"))
    kind = lambda response: F.when(response, "response").otherwise("revisit")
    tied = F.col("first").isNotNull() & leads & (F.col("first.copies") > 1)
    if repeats.where("first.copies > 1").isEmpty():
        out = met.withColumn("record_type", kind(F.col("first").isNull() | leads))
    else:
        own = met.where(~tied).withColumn("record_type", kind(F.col("first").isNull() | leads))
        same = met.where(tied).dropDuplicates(["payload_digest"]).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("first.copies"))))
        out = own.unionByName(same.withColumn("record_type", kind(F.col("k") == 1)).drop("k"))
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "record_type",
        record_id(F.col("id")).alias("record_id"),
        "target_uri",
        F.when(revisit, record_id(F.col("first.id"))).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
