"""WARC archives with a two-level capture index.

``write`` puts one record per page into archives (each record its own gzip
member): of records with equal payloads of at least ``least_bytes``, the one with
the largest page id is the response, the others revisit it.  Index lines (key,
place) are sorted over all archives by reversed-host URL key and page id, in
blocks of ``BLOCK`` lines, each compressed on its own; a sparse directory keeps
each block's first and last key and place.

``lookup`` finds captures: it takes the directory entries that its keys span,
binary-searches them, reads the block's byte range, searches the lines and reads
the record's byte range.  ``read`` reads the archives front to back and resolves
the payload of revisits by ``lookup``, each target once.

Files are written by tasks through the file system of the shared folder under
names of their own; only the files that a successful task reports are in the
index, so a task that is lost and repeated leaves no double record.

Defined cases: null html is the empty payload; null url has the key ``-`` and no
target header; of a group whose ids are all null every row is a response; rows
that repeat the winning id are responses, too; control characters in URLs are
percent-encoded; an empty table gives empty archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, map_arrow, shared_path, written

BLOCK = 1000
#: Sorted keys looked up with one reading of the directory.
LOOKUP_KEYS = 10_000
#: An archive is closed when it has grown to so many bytes.
ROLL = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: ``com,example)/a?b``."""
    if not url:
        return "-"
    m = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", _clean(url))
    if not m:
        return _clean(url) or "-"
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (m[2] or "/").lower()


def capture_key(url: str | None, page_id: int | None, digest: str) -> str:
    """Key of one capture, unique by page id and payload: pages that repeat an id
    with another text are captures of their own."""
    return f"{url_key(url)} {'-' if page_id is None else page_id} {digest}"


def _record(kind: str, page_id, url, digest: str, payload: bytes, refers_to=None, refers_url=None) -> bytes:
    body = HTTP.format(len(payload)).encode() + payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        *([f"WARC-Target-URI: {_clean(url)}"] if url else []),
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", *([f"WARC-Refers-To-Target-URI: {_clean(refers_url)}"] if refers_url else []), f"WARC-Refers-To-Date: {DATE}", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and HTTP payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.lower()] = value.strip(" \t")  # other white space may belong to a URL
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _page(uri: str) -> int | None:
    value = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _writer(root: str):
    """Batches of pages with their roles to archives; yields a line of the index
    for each record."""

    def run(batches):
        fs, base = _files(root)
        out, name, at, lines = None, "", 0, []

        def told():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines) if lines else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])
            lines.clear()
            return batch

        try:
            for b in batches:
                for page_id, url, page, digest, winner, winner_url in zip(*(b.column(i) for i in range(6))):
                    page_id, url, winner = page_id.as_py(), url.as_py(), winner.as_py()
                    if out is None or at >= ROLL:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    payload = page.as_py()
                    revisit = winner is not None and winner != page_id
                    data = _gzip(_record("revisit" if revisit else "response", page_id, url, digest.as_py(), b"" if revisit else (payload or "").encode("utf-8", "surrogatepass"), winner, winner_url.as_py()))
                    out.write(data)
                    lines.append((capture_key(url, page_id, digest.as_py()), name, at, len(data)))
                    at += len(data)
                yield told()
        finally:
            if out:
                out.close()

    return run


def _indexer(root: str):
    """Sorted index lines to compressed blocks; yields the directory's entries."""

    def run(batches):
        fs, base = _files(root)
        out, at, name, held = None, 0, f"{uuid.uuid4().hex}.idx", []
        entries: list[tuple] = []

        def flush(rows):
            nonlocal out, at
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            entries.append((rows[0][0], rows[-1][0], name, at, len(data)))
            at += len(data)

        for b in batches:
            held += zip(*(c.to_pylist() for c in b.columns))
            while len(held) >= BLOCK:
                flush(held[:BLOCK])
                del held[:BLOCK]
        if held:
            flush(held)
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries) if entries else [[]] * 5, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["first_key", "last_key", "file", "offset", "length"])

    return run


class Capture:
    """Places of a written capture: archives, index blocks and directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.archives, self.blocks, self.directory, self.lines = (f"{root}/{x}" for x in ("archives", "blocks", "directory", "lines"))

    def files(self) -> DataFrame:
        """(file): the archives, each with at least one record."""
        return self.spark.read.parquet(self.lines).select("file").distinct()


def write(pages: DataFrame, least_bytes: int = 0) -> Capture:
    """Archives, index and directory of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    at = Capture(spark, shared_path(spark, "capture"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("n", F.octet_length("html"))
    # roles by digest, without the payloads: a hot digest moves a few bytes a row
    slim = rows.where(F.col("n") >= least_bytes).select("page_id", "url", "sha")
    winners = slim.where("page_id IS NOT NULL").groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("w"), F.count("*").alias("copies"))
    shared = written(winners.where("copies > 1").selectExpr("sha", "w.page_id AS winner", "w.url AS winner_url", "copies"), "shared-payloads")
    roles = hot_join(slim, shared, "sha", F.col("page_id")).where("NOT page_id <=> winner").select("page_id", "sha", "winner", "winner_url").distinct()
    roles = roles.select(F.col("page_id").alias("its_id"), F.col("sha").alias("its_sha"), "winner", "winner_url")
    same = (F.col("sha") == F.col("its_sha")) & F.col("page_id").eqNullSafe(F.col("its_id"))
    told = rows.join(roles, same, "left").withColumn("html", F.when(F.col("winner").isNull(), F.col("html")))
    lines = map_arrow(told.select("page_id", "url", "html", _base32(F.col("sha")).alias("digest"), "winner", "winner_url"), _writer(at.archives), "key string, file string, offset long, length long")
    lines.write.parquet(at.lines)
    sorted_lines = spark.read.parquet(at.lines).repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    map_arrow(sorted_lines, _indexer(at.blocks), "first_key string, last_key string, file string, offset long, length long").write.parquet(at.directory)
    return at


def _base32(hex_: Column) -> Column:
    """Base 32 of a 40-digit hex column: each 10 hex digits are 8 letters."""
    parts = []
    for i in range(4):
        value = F.conv(F.substring(hex_, 10 * i + 1, 10), 16, 32)
        parts.append(F.lpad(value, 8, "0"))
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def lookup(at: Capture, wanted: DataFrame) -> DataFrame:
    """(key, page_id, payload_bytes, payload_digest) of the captures whose ``key``
    (see ``capture_key``) is wanted; keys without a capture give no row."""
    archives, blocks, directory = at.archives, at.blocks, at.directory

    def run(batches):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        fs, base = _files(archives)
        block_base, directory_base = _files(blocks)[1], _files(directory)[1]
        open_files: dict[str, object] = {}

        def ranged(path: str, offset: int, length: int) -> bytes:
            if path not in open_files:
                if len(open_files) > 16:
                    open_files.popitem()[1].close()
                open_files[path] = fs.open_input_file(path)
            return open_files[path].read_at(length, offset)

        held, lines, keys = None, [], []

        def steps():
            """Keys of many small batches together, so that the directory is read
            for them once."""
            own: list = []
            for b in batches:
                own += b.column("key").to_pylist()
                if len(own) >= LOOKUP_KEYS:
                    yield own
                    own = []
            yield own

        for wanted_keys in steps():
            want = sorted(set(wanted_keys) - {None})
            if not want:
                continue
            span = (pc.field("last_key") >= want[0]) & (pc.field("first_key") <= want[-1])
            part = ds.dataset(directory_base, filesystem=fs, format="parquet").to_table(filter=span).sort_by([("first_key", "ascending"), ("last_key", "ascending")])
            firsts, lasts = part.column("first_key").to_pylist(), part.column("last_key").to_pylist()
            places = list(zip(*(part.column(c).to_pylist() for c in ("file", "offset", "length"))))
            out: list[tuple] = []
            for key in want:
                k = bisect_left(lasts, key)
                if k == len(places) or firsts[k] > key:
                    continue
                if held != places[k]:
                    held = places[k]
                    text = zlib.decompress(ranged(f"{block_base}/{held[0]}", held[1], held[2])).decode("utf-8", "surrogatepass")
                    lines = [x.split("\t") for x in text.split("\n")]
                    keys = [x[0] for x in lines]
                i = bisect_left(keys, key)
                if i == bisect_right(keys, key):
                    continue
                _, name, offset, length = lines[i]
                headers, payload = parse(zlib.decompress(ranged(f"{base}/{name}", int(offset), int(length)), 31))
                out.append((key, _page(headers["warc-record-id"]), len(payload), sha1_base32(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["key", "page_id", "payload_bytes", "payload_digest"])
        for f in open_files.values():
            f.close()

    sorted_keys = wanted.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return map_arrow(sorted_keys, run, "key string, page_id long, payload_bytes long, payload_digest string")


def records(at: Capture) -> DataFrame:
    """Every record of the archives, read front to back: page_id, payload_bytes
    and payload_digest (computed from what was read; null for revisits),
    record_type, refers_to and refers_key."""
    archives = at.archives

    def run(batches):
        fs, base = _files(archives)
        for b in batches:
            for name in b.column("file").to_pylist():
                out: list[tuple] = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read(1 << 20)
                    member, parts = zlib.decompressobj(31), []
                    while data:
                        parts.append(member.decompress(data))
                        if member.eof:
                            headers, payload = parse(b"".join(parts))
                            kind = headers["warc-type"]
                            page = _page(headers["warc-record-id"])
                            if kind == "response":
                                out.append((page, len(payload), sha1_base32(payload), kind, None, None))
                            else:
                                target, digest = _page(headers["warc-refers-to"]), headers["warc-payload-digest"].removeprefix("sha1:")
                                out.append((page, None, digest, kind, target, capture_key(headers.get("warc-refers-to-target-uri"), target, digest)))
                            data, member, parts = member.unused_data, zlib.decompressobj(31), []
                        else:
                            data = b""
                        data = data or f.read(1 << 20)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                for lo in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 10_000]), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_key"])

    files = at.files().repartition("file")
    return map_arrow(files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_key string")


def read(at: Capture) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    record; revisits get the payload that the index finds for them.  A target
    that the index does not find is an error."""
    found = written(records(at), "records")
    revisits = found.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "refers_key")
    keys = written(revisits.groupBy(F.col("refers_key").alias("key")).agg(F.count("*").alias("copies")), "targets")
    targets = keys.join(lookup(at, keys).withColumnsRenamed({"page_id": "target"}), "key", "left")
    lost = F.raise_error(F.concat(F.lit("no capture for "), "key"))
    targets = targets.select(F.col("key").alias("refers_key"), "copies", F.when(F.col("payload_digest").isNull(), lost.cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest")
    full = hot_join(revisits, written(targets, "target-payloads"), "refers_key", F.col("page_id")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return found.where("record_type = 'response'").select(*full.columns).unionByName(full)


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS winner FROM p)
SELECT page_id, payload_bytes, to_base32(sha) AS payload_digest,
       CASE WHEN winner IS NULL OR winner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN winner = page_id THEN NULL ELSE winner END AS refers_to
FROM w
"""


def oracle() -> str:
    """DuckDB SQL; base 32 digit by digit from the hex digest."""
    value = "(" + " + ".join(f"(strpos('0123456789abcdef', substr(sha, 10 * g + {i + 1}, 1)) - 1) * {16 ** (9 - i)}::BIGINT" for i in range(10)) + ")"
    letters = "array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (({v}) // CAST(pow(32, 7 - j % 8) AS BIGINT)) % 32 AS INTEGER), 1)), '')"
    return ORACLE.replace("to_base32(sha)", letters.replace("{v}", value.replace("10 * g", "10 * (j // 8)")))
