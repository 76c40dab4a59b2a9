"""WARC writing and reading, with segment reassembly."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import materialise, maybe_broadcast, scratch_path

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: A record whose block is longer is cut into a first record and continuation records.
SEGMENT_BYTES = 32 << 10
#: HTTP bodies are framed in chunks of this many bytes.
HTTP_CHUNK = 8 << 10
#: An archive is closed, and the next begun, once it holds this many compressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Archives bear this date, so that writing twice gives equal files.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: str | None, digest: str, occurrence: str | None = None) -> str:
    name = f"{page_id}/{digest}" if occurrence is None else f"{page_id}/{digest}/{occurrence}"
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def frame_chunks(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    """Chunked transfer framing."""
    out = [b"%x\r\n%s\r\n" % (len(part), part) for i in range(0, len(payload), size) if (part := payload[i : i + size])]
    return b"".join([*out, b"0\r\n\r\n"])


def unframe_chunks(body: bytes) -> bytes:
    """The payload behind chunked framing; extensions and trailers are skipped, a broken frame raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";", 1)[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member of its own per record
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def page_records(page_id: str | None, url: str | None, payload: bytes, digest: str, original: str | None, occurrence: str | None = None) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response in as many segments as its block needs.

    Of rows equal in id and digest all but one have an `occurrence`, so that no two records bear one record id.
    """
    own = record_id(page_id, digest, occurrence)
    common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None and "\n" not in url and "\r" not in url:
        common.append(("WARC-Target-URI", url))
    if page_id is not None:
        common.append(("X-Page-ID", page_id))
    if original is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        yield _record([("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original, digest)), *common], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + frame_chunks(payload)
    if len(block) <= SEGMENT_BYTES:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), ("WARC-Segment-Number", "1"), *common], block[:SEGMENT_BYTES])
    cuts = range(SEGMENT_BYTES, len(block), SEGMENT_BYTES)
    for n, at in enumerate(cuts, 2):
        part = uuid.uuid5(_SPACE, f"{own}/{n}")
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{part}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n))]
        if at == cuts[-1]:
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        yield _record(headers, block[at : at + SEGMENT_BYTES])


def _plain(stream) -> Iterator[bytes]:
    """The bytes of an archive in pieces, unpacked if it is gzip (one member or many)."""
    piece = stream.read(1 << 20)
    if piece[:2] != b"\x1f\x8b":
        while piece:
            yield piece
            piece = stream.read(1 << 20)
        return
    squeeze = zlib.decompressobj(31)
    while piece:
        yield squeeze.decompress(piece)
        piece = b""
        if squeeze.eof:
            piece, squeeze = squeeze.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
            fresh = not piece
        else:
            fresh = False
        piece = piece or stream.read(1 << 20)
        if not piece and not fresh:
            raise ValueError("archive ends within a record")


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, packed or plain, holding one record at a time.

    Header names are given in lower case; folded lines belong to the header before.
    """
    pieces, held = _plain(stream), bytearray()

    def fill(until) -> bool:
        """Read on until `until()` holds; whether it does."""
        while not until():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        fill(lambda: len(held.lstrip(b"\r\n")) > 0)
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if not held:
            return
        if not fill(lambda: b"\r\n\r\n" in held):
            raise ValueError("archive ends within a record")
        at = held.index(b"\r\n\r\n")
        lines = held[:at].decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        end = at + 4 + int(headers["content-length"])
        if not fill(lambda: len(held) >= end):
            raise ValueError("archive ends within a record")
        block = bytes(held[at + 4 : end])
        del held[:end]
        yield headers, block


def digest_fits(header: str, *bodies: bytes) -> bool | None:
    """Whether a digest header (algorithm:value in hex or base32) is that of one of the bodies; None if its algorithm isn't known."""
    name, _, value = header.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return None
    for body in bodies:
        d = hashlib.new(name, body, usedforsecurity=False).digest()
        if value.strip().lower() == d.hex() or value.strip().upper().rstrip("=") == base64.b32encode(d).decode().rstrip("="):
            return True
    return False


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row, and return the manifest: path, records, bytes of every archive.

    Of rows with equal payloads of at least 100 bytes the smallest id is the response and the others revisit it; the
    rows that share that id are all responses, told apart by an occurrence in their record ids (the place in the scan; none
    for the first).  The choice is an aggregate over (digest, id), combined before the shuffle.
    Each task writes its own archives under a name taken from its partition, first under a private name and then moved,
    so a task that runs again replaces its files with equal ones.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.monotonically_increasing_id().alias("tag")
    )
    grouped = materialise(
        rows.select("digest", "page_id", F.octet_length("payload").alias("size"), "tag")
        .groupBy("digest", "page_id")
        .agg(F.max("size").alias("size"), F.min("tag").alias("lead"), F.count(F.lit(1)).alias("n")),
        "warc-grouped",
    )
    first = grouped.where(f"size >= {LEAST_REVISIT}").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("ids")).where("ids > 1").select("digest", "first")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull())
    marks = materialise(
        grouped.join(first, "digest", "left")
        .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.when(revisit, F.col("first")).alias("first"), F.when(F.col("n") > 1, F.col("lead")).alias("lead"))
        .where("first is not null or lead is not null"),
        "warc-marks",
    )
    # payloads stay where they were read while the marks are few enough to broadcast; beyond, this join shuffles them
    choice = rows.join(maybe_broadcast(marks), F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    occurrence = F.when(F.col("tag") != F.col("lead"), F.col("tag"))  # a string, as pandas would turn longs with nulls into doubles
    ready = choice.select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("first").cast("string").alias("original"), occurrence.cast("string").alias("occurrence")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        done, out, count, number = [], None, 0, 0
        system, root = _open(folder)
        system.create_dir(root, recursive=True)

        def close():
            nonlocal out, count, number
            if out is None:
                return
            size = out.tell()
            out.close()
            name = f"{root}/pages-{task.partitionId():06d}-{number:04d}.warc.gz"
            system.move(hidden, name)
            done.append((f"{folder}/{name.rsplit('/', 1)[1]}", count, size))
            out, count, number = None, 0, number + 1

        for batch in batches:
            for page_id, url, payload, digest, original, occurrence in batch.itertuples(index=False):
                if out is None:
                    hidden = f"{root}/.{task.partitionId()}-{task.taskAttemptId()}-{number}"
                    out = system.open_output_stream(hidden, compression=None)
                for record in page_records(page_id, url, bytes(payload), digest, original, occurrence):
                    out.write(record)
                    count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return ready.mapInPandas(write, "path string, records bigint, bytes bigint")


_RECORD = "type string, record string, page_id string, url string, digest string, refers string, origin string, segment int, total bigint, block binary"
#: Kinds of records that carry a page; others (warcinfo, request, metadata, conversion) are skipped.
_KINDS = ("response", "resource", "revisit", "continuation")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _RECORD.split(", ")]
    for batch in batches:
        for path in batch["path"]:
            rows, size = [], 0
            system, name = _open(path)
            with system.open_input_stream(name, compression=None) as stream:
                for h, block in read_records(stream):
                    if h.get("warc-type") not in _KINDS:
                        continue
                    segment = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                    total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                    own = h["warc-record-id"]
                    url = h.get("warc-target-uri")
                    rows.append(
                        (h["warc-type"], own, h.get("x-page-id"), url and url.strip("<>"), h.get("warc-payload-digest"), h.get("warc-refers-to"), h.get("warc-segment-origin-id", own if segment else None), segment, total, block)
                    )
                    size += len(block)
                    if size >= 4 << 20:
                        yield _frame(rows, names)
                        rows, size = [], 0
            yield _frame(rows, names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    for c in ("segment", "total", "payload_bytes"):
        if c in out:
            out[c] = out[c].astype("Int64")
    return out


_PAGE = "record string, page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers string"


def _decode(with_payload: bool):
    names = [c.split()[0] for c in _PAGE.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, record, page_id, url, digest, refers, block in batch.itertuples(index=False):
                if kind == "revisit":  # what it says of the payload itself; length and the rest are those of what it refers to
                    own = digest.partition(":")[2].lower() if digest is not None and digest.lower().startswith("sha256:") and len(digest) == 71 else None
                    rows.append((record, page_id, url, None, own, kind, refers, None))
                    continue
                head, _, body = bytes(block).partition(b"\r\n\r\n") if kind == "response" and bytes(block[:5]) == b"HTTP/" else (b"", b"", bytes(block))
                fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
                payload = unframe_chunks(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
                # some writers digest the body as it was sent, others the payload
                if digest is not None and digest_fits(digest, payload, body) is False:
                    raise ValueError(f"payload of record {record} differs from its digest")
                rows.append((record, page_id, url, len(payload), hashlib.sha256(payload).hexdigest(), "response", None, payload))
            yield _frame([r[: len(names)] for r in rows], names)

    return run


def read_archives(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per response, resource or revisit: record, page_id, url, payload_bytes, payload_digest (SHA-256), record_type,
    refers_to (the page id of what a revisit refers to) and, on demand, payload (null for revisits).

    Reads archives of any writer, packed or plain: records of other kinds are skipped; page_id is null where a record
    has no X-Page-ID; payload digests in any algorithm and base are verified; a revisit gets length and digest from the
    record its WARC-Refers-To names, or null where that isn't among the archives.

    Whole records go straight on.  Segments are grouped by the origin's record id, put in order of segment number, and
    joined only if the numbers run from 1 without a gap and the length equals the announced total; otherwise the read
    fails, naming the record.  Then chunked framing is undone and the payload's digest verified.  A group holds the
    segments of one record, so its size is that of the largest page.

    Rows that repeat a path are read as often; records that share an id count as one where they are referred to (the one of
    the smallest page id); an empty table of paths, and an empty archive, give no rows; other columns are never read.
    """
    records = paths.select("path").mapInPandas(_parse, _RECORD)
    columns = ["type", "record", "page_id", "url", "digest", "refers", "block"]
    whole = records.where("origin is null").select(*columns)
    parts = (
        records.where("origin is not null")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
            F.max("total").alias("total"),
            *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in columns[:-1]],
        )
    )
    block = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["block"])), ""))
    sound = F.expr("transform(parts, x -> x.segment) = sequence(1, size(parts))")
    joined = parts.withColumn("block", block).withColumn(
        "block",
        F.when(sound & (F.octet_length("block") == F.col("total")), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), F.col("origin")))),
    )
    pages = materialise(whole.unionByName(joined.select(*columns)).mapInPandas(_decode(with_payload), _PAGE + ", payload binary" * with_payload), "warc-pages")
    sought = pages.where("record_type = 'revisit'").select(F.col("refers").alias("record")).distinct()
    known = pages.where("record_type = 'response'").join(sought, "record", "left_semi").groupBy("record").agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("of"))
    out = pages.join(known.select(F.col("record").alias("refers"), "of"), "refers", "left")
    return out.select(
        "record",
        "page_id",
        "url",
        F.coalesce("payload_bytes", "of.payload_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "of.payload_digest").alias("payload_digest"),
        "record_type",
        F.col("of.page_id").alias("refers_to"),
        *(["payload"] if with_payload else []),
    )


def warc_round_trip(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page to archives under `folder` (a scratch folder by default) and read them back, a row per page.

    Null html is an empty payload; a very long one is cut into segments; null urls are left out of the record; a null page id
    gives a record without one, and is smaller than no other id; repeated rows, and ties for the smallest id, are written and read
    as often as they occur; an empty table gives no archive and an empty result; other columns are never read.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    manifest = write_archives(pages, folder, id_col, url_col, html_col)
    listed = scratch_path(spark, "warc-manifest")
    manifest.write.parquet(listed)
    paths = spark.read.schema(manifest.schema).parquet(listed)
    n = paths.count()
    paths = paths.repartition(max(1, min(n, 10_000)), "path")
    kind = pages.schema[id_col].dataType.simpleString()
    pages = read_archives(paths)
    return pages.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
