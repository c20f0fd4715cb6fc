"""WARC archives with an index: offset, length, URL and digest of every record.

Each task writes its rows as gzip members, one per record, to archives of its own in the shared folder, and returns
an index row for each; the index is a Parquet table, so a task that is lost and run again leaves only the rows of the
run that counts (its first archive stays behind unread). Reading starts from the index: the wanted records are sorted
by archive and offset, neighbours are joined into ranges of about ``RANGE`` bytes, each range is fetched once and its
records are cut out; every digest is checked against the bytes that were read.

Of records with equal payloads of at least ``least`` bytes, that with the smallest id is a response, the others are
revisits, which carry no payload. Only digests are grouped to find revisits; payloads are never shuffled unless the
table of repeated digests is too large to be broadcast (checked).

Defined results: a null payload is empty; a null URL is left out, and control characters, spaces and ``%`` in URLs are
percent-encoded; equal rows become records of their own (all responses if theirs is the smallest id), each with a
record id that its archive and place decide; records with a null id have no page number and never are referred to; an empty table gives no records and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.shared import checked, new_path, written

ARCHIVE, RANGE, GAP, LEAST_PAYLOAD = 1 << 30, 4 << 20, 64 << 10, 100
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "page_id long, url string, record_type string, payload string, payload_bytes long, payload_digest string, refers_to long"
_INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def _quoted(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)


def record(name: uuid.UUID, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None, date: str = DATE) -> bytes:
    """A whole record, not compressed. Its own fields tell the page's number and, of a revisit, that of the response."""
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Date": date,
        "WARC-Record-ID": f"<urn:uuid:{name}>",
        "WARC-Target-URI": _quoted(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": None if refers_to is None else _PROFILE,
        "WARC-Refers-To-Target-URI": None if refers_to is None else _quoted(refers_url),
        "WARC-Refers-To-Date": None if refers_to is None else date,
        "Page-ID": None if page_id is None else str(page_id),
        "Refers-To-Page-ID": None if refers_to is None else str(refers_to),
        "Content-Type": "text/html",
        "Content-Length": str(len(payload) if refers_to is None else 0),
    }
    head = "WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields.items() if v is not None) + END
    return head.encode() + (payload if refers_to is None else b"") + END.encode()


def _number(x) -> int | None:
    return None if pd.isna(x) else int(x)


def _writer(folder: str, archive_bytes: int, date: str):
    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        part, out, name, at, count = TaskContext.get().partitionId(), None, "", 0, 0
        try:
            for pdf in batches:
                rows = []
                for page_id, url, payload, digest, refers_to, refers_url in zip(*(pdf[c] for c in ("page_id", "url", "payload", "digest", "refers_to", "refers_url")), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at, count = f"part-{part:05d}-{count:03d}-{uuid.uuid4().hex}.warc.gz", 0, count + 1
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    page_id, refers_to = _number(page_id), _number(refers_to)
                    whole = record(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{at}"), page_id, url, payload.encode(), digest, refers_to, refers_url, date)
                    member = gzip.compress(whole, 6, mtime=0)
                    out.write(member)
                    rows.append((f"{folder}/{name}", at, len(member), page_id, url, digest, "response" if refers_to is None else "revisit"))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "page_id", "url", "digest", "record_type"]).astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_PAYLOAD, archive_bytes: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """Writes a record per row; returns the index, a written table: file, offset, length, page_id, url, digest, record_type."""
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    firsts = base.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("refers_url"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    firsts = checked(written(firsts, "warc-firsts"))
    marked = base.join(firsts, "digest", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))
    folder = new_path(pages.sparkSession, "warc")
    return written(marked.select("page_id", "url", "payload", "digest", "refers_to", "refers_url").mapInPandas(_writer(folder, archive_bytes, date), _INDEX), "warc-index")


def _record(raw: bytes) -> dict:
    head, _, rest = raw.partition(END.encode())
    named = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    named["payload"] = rest[: int(named["Content-Length"])]
    return named


def _page(number: str | None) -> int | None:
    return int(number) if number else None


def _fetch(batches):
    from pyarrow import fs

    for pdf in batches:
        for file, start, end, records in zip(pdf["file"], pdf["start"], pdf["end"], pdf["records"], strict=True):
            out = []
            store, path = fs.FileSystem.from_uri(file)
            with store.open_input_file(path) as f:
                got = f.read_at(end - start, start)
            for r in records:
                x = _record(gzip.decompress(got[r["offset"] - start : r["offset"] - start + r["length"]]))
                digest, revisit = x["WARC-Payload-Digest"].removeprefix("sha256:"), x["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha256(x["payload"]).hexdigest() != digest:
                    raise ValueError(f"{file}: the record at {r['offset']} doesn't have its digest")
                url = x.get("WARC-Target-URI")
                out.append((_page(x.get("Page-ID")), None if url is None else unquote(url), x["WARC-Type"], None if revisit else x["payload"].decode(), None if revisit else len(x["payload"]), digest, _page(x.get("Refers-To-Page-ID"))))
            # A range at a time: no more than that is held.
            frame = pd.DataFrame(out, columns=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])
            yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def ranges(selected: DataFrame, size: int = RANGE, gap: int = GAP) -> DataFrame:
    """Wanted records as sorted byte ranges: a range starts where more than ``gap`` bytes aren't wanted, or a further ``size`` bytes begin."""
    order = Window.partitionBy("file").orderBy("offset")
    cut = F.coalesce((F.col("offset") > F.lag(F.col("offset") + F.col("length")).over(order) + gap) | (F.floor(F.col("offset") / size) > F.floor(F.lag("offset").over(order) / size)), F.lit(False))
    numbered = selected.select("file", "offset", "length").withColumn("_cut", cut.cast("int")).withColumn("_range", F.sum("_cut").over(order))
    return numbered.groupBy("file", "_range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def read_records(selected: DataFrame, size: int = RANGE, gap: int = GAP) -> DataFrame:
    """Reads the records that ``selected`` (rows of an index) names; revisits have null payload and size."""
    total = selected.agg(F.sum("length")).first()[0] or 0
    parts = max(8, -(-total // (4 * size)))  # a task's share, so that small index rows don't put all reads in one task
    return ranges(selected, size, gap).select("file", "start", "end", "records").repartition(parts, "file", "start").mapInPandas(_fetch, _READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes ``pages``, reads all archives back and resolves revisits: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    index = write_archives(pages, id_col, url_col, payload_col, least)
    read = written(read_records(index).drop("payload"), "warc-read")
    held = read.filter("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    # A revisit takes its size from the response that it names, checked by digest.
    named = held.join(read.filter("record_type = 'revisit'").select(F.col("refers_to").alias("_page"), F.col("payload_digest").alias("_digest")).distinct(), ["_page", "_digest"], "left_semi").distinct()
    named = checked(written(named, "warc-named"))
    return read.join(named, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left").select(
        F.col("page_id").alias(id_col), F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url"
    )
