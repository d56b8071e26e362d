"""WARC archives, and a converter of legacy ARC archives.

``read_arc`` walks an archive by its declared lengths: a version block tells
whether record headers have five fields (version 1) or ten (version 2), each
header ends with the length of what follows.  ``arc_to_warc`` synthesises what
ARC lacks: record identifiers, ISO timestamps, record types and digests.  Of
records with equal payloads one is a response, the others revisit it.

Archives are gzip files that Spark's text source writes and reads with the
record's own separator, so they can be in any store that Spark reaches; gzip
files aren't split, so a task walks a whole archive, one record in memory at a
time.  Payloads may hold the separator: lengths decide, not separators.  Bytes
pass as they are, whether or not they are UTF-8.
"""

from __future__ import annotations

import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspec.llm._shared import new_path, stored

#: The fields of the headers of both versions, and of the version block's second line.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF2 = "\r\n\r\n"
#: An archive has about so many bytes of payload, or so many records if they are small.
FILE_BYTES = 16 << 20
RECORDS_PER_FILE = 4000
#: Up to so many recurring payloads (some 300 bytes each) are broadcast; beyond, it is a shuffled join.
BROADCAST_DIGESTS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_SCHEMA = "archive string, arc_version int, url string, ip string, archive_date string, content_type string, result_code string, payload binary, payload_bytes long, payload_digest string, complete boolean"
WARC_SCHEMA = "archive string, headers map<string,string>, payload binary, payload_bytes long, payload_digest string, complete boolean"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return b32encode(hashlib.sha1(payload).digest()).decode()


def write_arc(records: DataFrame, path: str, version: int = 1, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes ARC archives of one version; ``records``: key, url, ip, archive_date (14 digits), content_type, payload (string or binary).

    Key and url only spread records over files, each of which has a task of
    its own.  A null payload is empty; null or empty header fields are written
    as ``-``, blanks in them as ``%20``.
    """
    spark = records.sparkSession
    count, size = records.agg(F.count("*"), F.sum(F.length(F.col("payload").cast("binary")))).first()
    files = max(1, -(-count // records_per_file), -(-(size or 0) // file_bytes))
    field = lambda c: F.regexp_replace(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")), r"[ \r\n]", "%20")
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    middle = [field("ip"), field("archive_date"), field("content_type")]
    if version == 2:
        middle += [F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("modspec.arc")]
    header = F.concat_ws(" ", field("url"), *middle, F.length(payload).cast("string"))
    rows = records.select(F.pmod(F.xxhash64("key", "url"), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("seq"), F.concat(F.lit("\n").cast("binary"), F.concat(header, F.lit("\n")).cast("binary"), payload).alias("value"))
    about = f"{version} 0 modspec\n{ARC_FIELDS[version]}\n"
    extra = " 200 - - 0 modspec.arc" if version == 2 else ""
    block = F.concat(F.lit("filedesc://modspec-"), F.col("id").cast("string"), F.lit(f".arc 0.0.0.0 19700101000000 text/plain{extra} {len(about)}\n{about}"))
    heads = spark.range(files).select(F.col("id").cast("int").alias("file"), F.lit(0).alias("seq"), block.cast("binary").alias("value"))
    rows = heads.union(rows).repartitionById(files, F.col("file")).sortWithinPartitions("file", "seq")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _chunks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    lines = spark.read.option("lineSep", separator).text(path)
    return lines.select(F.input_file_name().alias("archive"), F.col("value").cast("binary").alias("value"))


class _Walker:
    """Records of an archive from the chunks between separators."""

    def __init__(self, separator: bytes):
        self.separator = separator
        self.archive = None
        self.start()

    def start(self) -> None:
        self.header: list[bytes] | None = None
        self.parts: list[bytes] = []
        self.have = self.length = 0

    def header_of(self, chunk: bytes) -> tuple[object, int] | None:
        """What a chunk outside of records declares, with the payload's length; None if it isn't a header."""
        raise NotImplementedError

    def feed(self, archive: str, chunk: bytes) -> Iterator[tuple]:
        if archive != self.archive:
            yield from self.end()
            self.archive = archive
            self.begin()
        while True:
            if self.header is None:
                got = self.header_of(chunk)
                if got:
                    self.header, self.length = got
                return
            if self.parts:
                self.have += len(self.separator)
            self.parts.append(chunk)
            self.have += len(chunk)
            if self.have < self.length:
                return
            body = self.separator.join(self.parts)
            header, length = self.header, self.length
            self.start()
            yield from self.record(header, body[:length], True)
            chunk = body[length:].removeprefix(self.separator)
            if not chunk:
                return

    def begin(self) -> None:
        pass

    def end(self) -> Iterator[tuple]:
        if self.header is not None:
            header, body = self.header, self.separator.join(self.parts)
            self.start()
            yield from self.record(header, body, False)

    def record(self, header: object, payload: bytes, complete: bool) -> Iterator[tuple]:
        raise NotImplementedError


class _Arc(_Walker):
    def begin(self) -> None:
        self.version = 1

    def header_of(self, chunk: bytes):
        text = chunk.decode("utf-8", "surrogateescape").strip("\r")
        fields = text.rsplit(" ", 9 if self.version == 2 and not text.startswith("filedesc:") else 4)
        if text.startswith("filedesc:"):
            fields = text.split(" ")
        return (fields, int(fields[-1])) if len(fields) >= 5 and fields[-1].isdigit() else None

    def record(self, header, payload, complete):
        if header[0].startswith("filedesc:"):
            self.version = 2 if payload[:1] == b"2" else 1
            return
        url, ip, date, kind = (x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for x in header[:4])
        code = header[4] if self.version == 2 else None
        yield self.archive, self.version, url, ip, date, kind, code, payload, len(payload), digest(payload), complete


class _Warc(_Walker):
    def header_of(self, chunk: bytes):
        lines = chunk.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            return None
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        length = fields.get("Content-Length", "")
        return (fields, int(length)) if length.isdigit() else None

    def record(self, header, block, complete):
        # a message's payload begins after its own header
        payload = block.partition(b"\r\n\r\n")[2] if header.get("Content-Type", "").startswith("application/http") else block
        yield self.archive, list(header.items()), payload, len(payload), digest(payload), complete


def _walked(chunks: DataFrame, walker: type[_Walker], separator: str, schema: str) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = walker(separator.encode())
        held, size = [], 0
        names = [x.strip().split(" ")[0] for x in schema.replace("map<string,string>", "map").split(",")]
        kinds = {"map": pa.map_(pa.string(), pa.string()), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
        types = [kinds[x.strip().split(" ")[1]] for x in schema.replace("map<string,string>", "map").split(",")]

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

        for batch in batches:
            for archive, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in state.feed(archive, chunk):
                    held.append(r)
                    size += len(r[-4])
                    if size > 1 << 22 or len(held) >= 2000:
                        yield out()
                        held, size = [], 0
        held += state.end()
        if held:
            yield out()

    return chunks.mapInArrow(walk, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC archives under ``path`` (version blocks excepted); ``complete`` is false where the archive ends within one."""
    return _walked(_chunks(spark, path, "\n"), _Arc, "\n", ARC_SCHEMA)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC archives under ``path``: headers, payload, its length and digest, whether it is complete."""
    return _walked(_chunks(spark, path, CRLF2), _Warc, CRLF2, WARC_SCHEMA)


def _uuid(*parts: Column) -> Column:
    h = F.sha1(F.concat_ws("\n", *[p.cast("string") for p in parts]))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-5"), cut(14, 3), F.lit("-a"), cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"))


def arc_to_warc(records: DataFrame, order: Column, least_bytes: int = 0) -> DataFrame:
    """WARC records for ARC records: headers (ordered array of name and value) and payload (the block; a response's is an HTTP message).

    ``order`` ranks records with equal payloads: the largest is the response,
    the others become revisits without a payload of their own, if the payload
    has at least ``least_bytes`` bytes.  Ties of ``order`` are responses too.
    A null ``order`` ranks below all others, and of such records alone all are
    responses.  Addresses other than http(s) become ``resource`` records.  A
    date that isn't 14 digits becomes the epoch.
    """
    date = F.when(F.col("archive_date").rlike("^[0-9]{14}$"), F.regexp_replace("archive_date", r"^(....)(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z")).otherwise("1970-01-01T00:00:00Z")
    known = records.withColumn("order", order).withColumn("warc_date", date).withColumn("id", _uuid(F.col("url"), F.col("archive_date"), F.col("order"), F.col("payload_digest")))
    original = known.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max(F.struct("order", "id", "url", "warc_date")).alias("original"))
    # only payloads that recur need a look-up; the payloads themselves stay where they are if those are few
    original = stored(original.where("n > 1").drop("n"), "originals")
    original = F.broadcast(original) if original.count() <= BROADCAST_DIGESTS else original
    joined = known.join(original, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("order") < F.col("original.order"), F.col("order").isNull() & F.col("original.order").isNotNull())
    kind = F.when(revisit, "revisit").when(F.lower("url").rlike("^https?:"), "response").otherwise("resource")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: "), "content_type", F.lit("\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF2)).cast("binary")
    payload = F.when(revisit, F.lit(b"")).when(kind == "response", F.concat(http, F.col("payload"))).otherwise(F.col("payload"))
    content = F.when(revisit, None).when(kind == "response", "application/http; msgtype=response").otherwise(F.col("content_type"))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    if_revisit = lambda value: F.when(revisit, value)
    headers = F.filter(F.array(
        header("WARC-Type", kind), header("WARC-Record-ID", F.col("id")), header("WARC-Date", F.col("warc_date")), header("WARC-Target-URI", F.col("url")), header("WARC-IP-Address", F.when(F.col("ip") != "-", F.col("ip"))),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")), header("WARC-Refers-To", if_revisit(F.col("original.id"))), header("WARC-Refers-To-Target-URI", if_revisit(F.col("original.url"))),
        header("WARC-Refers-To-Date", if_revisit(F.col("original.warc_date"))), header("WARC-Profile", if_revisit(F.lit(PROFILE))), header("Content-Type", content), header("Content-Length", F.length(payload)),
    ), lambda h: h["value"].isNotNull())
    return joined.select(headers.alias("headers"), payload.alias("payload"))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records (headers, payload) as WARC archives, one for each task."""
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\r\n")
    row = F.concat(F.concat(F.lit("WARC/1.1\r\n"), lines, F.lit(CRLF2)).cast("binary"), F.col("payload"))
    records.select(row.cast("string").alias("value")).write.option("lineSep", CRLF2).option("compression", "gzip").text(path)


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int = 2) -> DataFrame:
    """Sends pages through legacy archives and WARC: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, warc_date.

    Pages are written as ARC records (their id as a fragment of the address),
    which are converted, written as WARC and read back.  Null html is an empty
    payload, a null address ``-``.  Rows of a repeated id are records of their
    own; a null id is -1.
    """
    spark = pages.sparkSession
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))
    url = F.concat(F.coalesce(F.nullif(F.col(url_col), F.lit("")), F.lit("http://-/")), F.lit("#record="), key)
    legacy = pages.select(key.alias("key"), url.alias("url"), F.lit("0.0.0.0").alias("ip"), F.lit("20240101000000").alias("archive_date"), F.lit("text/html").alias("content_type"), F.col(html_col).alias("payload"))
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(legacy, arc, version)
    page_of = lambda c: F.regexp_extract(c, r"#record=(-?[0-9]+)$", 1).try_cast("long")
    write_warc(arc_to_warc(read_arc(spark, arc), page_of(F.col("url"))), warc)
    got = read_warc(spark, warc)
    h = lambda name: F.get(F.map_values(F.map_filter("headers", lambda k, _: k == name)), F.lit(0))
    rows = got.select(page_of(h("WARC-Target-URI")).alias("page_id"), "payload_bytes", F.regexp_replace(h("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"), h("WARC-Type").alias("record_type"),
                      page_of(h("WARC-Refers-To-Target-URI")).alias("refers_to"), h("WARC-Record-ID").alias("record_id"), h("WARC-Date").alias("warc_date"))
    rows = stored(rows, "records")  # without payloads, so that the archives are read once
    # a revisit has no payload; its length is that of the record it refers to
    lengths = rows.where("record_type <> 'revisit'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    rows = rows.join(lengths, "payload_digest", "left")
    return rows.select("page_id", F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "record_id", "warc_date")
