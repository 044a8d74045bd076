"""WARC archives: writer with payload deduplication, and a sequential reader.

The writer gives every page one record and every record one gzip member.  Of pages
with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest
``page_id`` holds the payload, the others are revisits that name it.  Who that is
comes from one partial aggregation on the payload digests.  Each task writes its own
files into the shared folder and returns their names; only names of finished tasks
reach the manifest, so a task that runs again adds nothing twice.

The reader goes through a file in blocks: incremental inflation member by member,
headers, content-length framing, then block and payload digests, which are verified.
It holds one record at a time.

Defined cases: a NULL html is an empty payload, always a response; a NULL page_id
is smaller than any other, and a group without any id has responses only; rows that
repeat the largest page_id with the same payload are all responses; a NULL url is
written as none; an empty table gives no archive and an empty result; other columns
of the table are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import small_batches, table, written
from tapeloom.session import new_shared_path

MIN_REVISIT = 1000
#: Compressed bytes after which a task begins another file.
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 16
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-page:"
#: Carries a url, wholly quoted, whose characters a header cannot hold; other urls stand in the record as they are.
_EXACT_URL = "X-Page-URL"
_NONE = "none"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record_kinds(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to): the page that holds the payload of each revisit."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    shared = rows.where(F.col("size") >= min_revisit).groupBy("digest", "size")
    holders = shared.agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = rows.join(holders, ["digest", "size"], "left")
    own = F.col("page_id").eqNullSafe(F.col("holder"))
    return named.select("page_id", "url", "html", F.when(~own, F.col("holder")).alias("refers_to"))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, compressed as a gzip member of its own."""
    name = _NONE if page_id is None else str(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_ID}{name}>",
        "WARC-Date": DATE,
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": _sha1(payload),
        "WARC-Block-Digest": _sha1(block),
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=~%")
        if head["WARC-Target-URI"] != url:  # no header can hold it as it is
            head[_EXACT_URL] = quote(url, safe="")
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{_ID}{refers_to}>", "WARC-Profile": _PROFILE}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(wbits=31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _whole(value) -> int | None:
    return None if pd.isna(value) else int(value)


def write_archives(kinds: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives of a (page_id, url, html, refers_to) table; returns (file, n_records, n_bytes).

    ``folder`` is a full URI.  The returned table is written, so the archives exist.
    Ids travel as text: a NULL would turn a whole batch of numbers into floats.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done = None, []
        for frame in frames:
            for page_id, url, html, refers_to in frame.itertuples(index=False, name=None):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count = store.open_output_stream(f"{root}/{name}", compression=None), 0
                out.write(record(_whole(page_id), url, (html or "").encode("utf-8"), _whole(refers_to)))
                count += 1
                if out.tell() >= file_bytes:
                    done.append((f"{folder}/{name}", count, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((f"{folder}/{name}", count, out.tell()))
            out.close()
        yield pd.DataFrame(done, columns=["file", "n_records", "n_bytes"])

    small_batches(kinds.sparkSession)
    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    rows = kinds.withColumns(ids).select("page_id", "url", "html", "refers_to")
    return written(rows.mapInPandas(run, "file string, n_records bigint, n_bytes bigint"), "warc-manifest")


class Inflated:
    """The bytes of concatenated gzip members, inflated as they are asked for."""

    def __init__(self, source: BinaryIO):
        self._source, self._held, self._member, self._raw = source, b"", None, b""

    def _more(self) -> bool:
        """Inflate another block; False at the end of the archive."""
        raw = self._raw or self._source.read(READ_BYTES)
        self._raw = b""
        if not raw:
            if self._member is not None:
                raise EOFError("the archive ends inside a gzip member")
            return False
        if self._member is None:
            self._member = zlib.decompressobj(wbits=31)
        self._held += self._member.decompress(raw)
        if self._member.eof:
            self._raw, self._member = self._member.unused_data, None
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the archive."""
        at = 0
        while (found := self._held.find(mark, at)) < 0:
            at = max(0, len(self._held) - len(mark) + 1)
            if not self._more():
                if self._held:
                    raise EOFError("the archive ends inside a record header")
                return None
        return self.exactly(found + len(mark))

    def exactly(self, size: int) -> bytes:
        parts, length = [self._held], len(self._held)
        while length < size:
            self._held = b""
            if not self._more():
                raise EOFError("the archive ends inside a record")
            parts.append(self._held)
            length += len(self._held)
        whole = b"".join(parts)
        self._held = whole[size:]
        return whole[:size]


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def _digest_hex(named: str) -> str:
    kind, _, value = named.partition(":")
    if kind != "sha1":
        raise ValueError(f"digest of another kind: {kind}")
    return base64.b32decode(value).hex()


def _page(reference: str | None) -> int | None:
    name = (reference or "").strip("<>").removeprefix(_ID)
    return int(name) if name and name != _NONE else None


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, HTTP head, payload) of each record in order; digests are verified."""
    stream = Inflated(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        block = stream.exactly(int(fields["content-length"]))
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its content length says")
        if hashlib.sha1(block).hexdigest() != _digest_hex(fields["warc-block-digest"]):
            raise ValueError(f"block digest differs: {fields['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        whole = fields["warc-type"] == "response"
        if whole and hashlib.sha1(payload).hexdigest() != _digest_hex(fields["warc-payload-digest"]):
            raise ValueError(f"payload digest differs: {fields['warc-record-id']}")
        yield fields, http, payload


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the listed files, with the payload as ``html`` if wanted (NULL for revisits)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file in frame["file"]:
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as source:
                    rows, held = [], 0
                    for fields, http, payload in read_records(source):
                        size = int(_fields(b"\r\n" + http)["content-length"])
                        kind, uri = fields["warc-type"], fields.get("warc-target-uri")
                        if (exact := fields.get(_EXACT_URL.lower())) is not None:
                            uri = unquote(exact)
                        ids = _page(fields["warc-record-id"]), _page(fields.get("warc-refers-to"))
                        row = (ids[0], uri, size,
                               _digest_hex(fields["warc-payload-digest"]), kind, ids[1])
                        text = payload.decode("utf-8") if kind == "response" else None
                        rows.append((*row, text) if payloads else row)
                        held += len(payload) if payloads else 0
                        if len(rows) >= 4096 or held >= 8 << 20:
                            yield framed(rows)
                            rows, held = [], 0
                    yield framed(rows)

    columns = RECORDS + (", html string" if payloads else "")
    names = [c.split()[0] for c in columns.split(", ")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = manifest.select("file")
    return files.repartitionByRange(max(1, files.count()), "file").mapInPandas(run, columns)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared place, as a full URI that every executor reads the same way."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_shared_path(spark, "warc"))
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, _, rest = full.partition(":")
    return f"{scheme}://{rest}" if not rest.startswith("//") else full


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to archives, read those back: what each record says."""
    manifest = write_archives(record_kinds(pages), archive_folder(pages.sparkSession))
    return read_archives(manifest, payloads=False).drop("url")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


ORACLE = f"""WITH rows AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
  sha1(coalesce(html, '')) AS payload_digest FROM pages),
holders AS (SELECT payload_digest, max(page_id) AS holder FROM rows WHERE payload_bytes >= {MIN_REVISIT}
  GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < holder THEN holder END AS refers_to
FROM rows LEFT JOIN holders USING (payload_digest)"""
