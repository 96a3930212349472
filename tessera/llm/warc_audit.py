"""WARC (10): archive records and a Merkle fixity audit of replicas.

Records are ordered by page id and digest in files of consecutive page ids, each with an offset and a length. A leaf of a
file's tree hashes a record's offset, length and digest; an inner node hashes the ordered nodes of FANOUT neighbouring
index ranges below it. The audit joins the roots of two replicas and goes down only from nodes that differ; what lies
under equal nodes is never compared. The records at differing leaves are then paired to say what happened to each.

Replicas are archives in the shared folder: gzip files of WARC records that Spark's text writer makes, rebalanced by
size, so that neither a small file for every few pages nor a huge one for a hot id comes out. They are read as streams
of bytes, record by record, and what was read is audited.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

FANOUT = 16
#: Page ids of a file.
PER_FILE = 256
END = "\r\n\r\n"
#: Bytes that are handed on and that are decompressed at once, and how a gzip member begins.
PIECE, CHUNK, MEMBER = 1 << 20, 1 << 16, b"\x1f\x8b\x08"
#: How the digest of a stretch begins in which no record can be read.
UNREADABLE = "unreadable:"


def record_text(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record without the two line ends after it."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", " "), F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END), body,
    )


def write_warc(records: DataFrame, folder: str, parts: list[str] | None = None) -> None:
    """Writes (file, page_id, digest, record, and parts) as gzip WARC files, a subfolder for each value of the parts.

    Records of a file stand in their order; a hot file is divided among several archives by its size.
    """
    parts = parts or []
    order = [*parts, "file", F.col("page_id").asc_nulls_first(), "digest"]
    rows = records.hint("rebalance", F.col("file")).sortWithinPartitions(*order).select(*parts, "record")
    writer = rows.write.option("lineSep", END).option("compression", "gzip")
    (writer.partitionBy(*parts) if parts else writer).text(folder)


def _pieces(data: bytes, strict: bool = True) -> Iterator[bytes | None]:
    """The bytes of an archive in pieces; gzip, of one member or many, is decompressed on the way. Unless strict, a member
    that can't be read any further ends there, None marks the gap, and the next member that begins goes on."""
    if not data.startswith(MEMBER) and (strict or data.find(MEMBER) < 0):
        yield from (data[k : k + PIECE] for k in range(0, len(data), PIECE))
        return
    at = max(0, data.find(MEMBER))
    while at < len(data):
        member, fine, begun = zlib.decompressobj(31), True, at
        while at < len(data) and not member.eof:
            chunk, before = data[at : at + CHUNK], None if strict else member.copy()
            try:
                out = member.decompress(chunk)
            except zlib.error:
                if strict:
                    raise
                out, fine = _salvaged(before, chunk), False
            yield from (out[k : k + PIECE] for k in range(0, len(out), PIECE))
            if not fine:
                break
            at += len(chunk) - len(member.unused_data)
        if not member.eof:
            if strict:
                raise ValueError("gzip member is cut off")
            yield None
        if not fine or (not strict and not data.startswith(MEMBER, at)):
            at = data.find(MEMBER, max(at, begun + 1))
            at = len(data) if at < 0 else at


def _salvaged(member, chunk: bytes) -> bytes:
    """What the bytes of a chunk give before the one that can't be read."""
    out = []
    try:
        for k in range(len(chunk)):
            out.append(member.decompress(chunk[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _length(headers: dict[str, str]) -> int | None:
    told = headers.get("Content-Length", "")
    return int(told) if told.isascii() and told.isdigit() and len(told) < 16 else None


def parse_warc(pieces: Iterator[bytes] | bytes, strict: bool = True) -> Iterator[tuple[int, dict[str, str], bytes, bytes]]:
    """(offset, headers, record, body) of every record of an archive; the record is head and body. A damaged or cut archive
    is an error at its place. Unless strict, all that can be read is: a record whose length isn't the one that it tells, or
    that tells none, ends where the next one begins or where the archive breaks off, and bytes that begin no record are
    one with no headers (None in their place) up to the next. No more than one record and a piece are held."""
    source = iter(_pieces(pieces, strict) if isinstance(pieces, bytes) else pieces)
    held, at, end, broken = b"", 0, END.encode(), False

    def more() -> bool:
        """Whether there is more of the same stretch; a gap ends it."""
        nonlocal held, broken
        piece = None if broken else next(source, b"")
        if piece is None:
            broken = True
        held += piece or b""
        return bool(piece)

    while True:
        while len(held) < 5 and more():
            pass
        if not held:
            if broken:
                broken = False
                continue
            return
        while (head := held.find(end)) < 0 and held.startswith(b"WARC/") and more():
            pass
        if head < 0 or not held.startswith(b"WARC/"):
            if strict:
                raise ValueError(f"no WARC record at byte {at}")
            while (here := held.find(end + b"WARC/")) < 0 and more():
                pass
            stop = here if here >= 0 else len(held) - len(end) * held.endswith(end)
            yield at, None, held[:stop], b""
            held, at = held[stop + 4 :], at + stop + 4
            continue
        lines = held[:head].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = _length(headers)
        if size is None and strict:
            raise ValueError(f"record at byte {at} tells no length")
        stop = head + 4 + (size or 0)
        while len(held) < stop + 32 and more():
            pass
        apart = held[stop : stop + 4] == end and (len(held) == stop + 4 or held.startswith(b"WARC/", stop + 4))
        if not apart and strict and len(held) != stop:
            raise ValueError(f"record at byte {at} is cut off" if len(held) < stop else f"no WARC record at byte {at + stop + 4}")
        if not strict and not (apart or size is not None and held[stop : stop + 4] == end):
            here = held.find(end + b"WARC/", max(head, stop - 16), stop + 32) if size is not None else -1  # a few bytes more or less
            while here < 0 and (here := held.find(end + b"WARC/", head)) < 0 and more():
                pass
            stop = here if here >= 0 else len(held) - 4 * held.endswith(end)
        yield at, headers, held[:stop], held[head + 4 : stop]
        held, at = held[stop + 4 :], at + stop + 4


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(path, record_offset, record_id, url, body) of all WARC files below a folder, plain or gzip; bodies are bytes as
    they are. An archive is read by one task, as a stream; it has to be under 2 GB as stored, and offsets are those of
    the decompressed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for at, h, _, body in parse_warc(data):
                    rows.append((path, at, h.get("WARC-Record-ID"), h.get("WARC-Target-URI"), body))
                    size += len(body)
                    if size > PIECE:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "record_offset", "record_id", "url", "body"])

    return _archives(spark, folder).mapInArrow(run, "path string, record_offset long, record_id string, url string, body binary")


PAGE = re.compile(r"<urn:page:(-?\d+)>")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(file, page_id, digest, copies, n_bytes, first_at, last_at) of the records of an archive folder, hashed as they are
    read. first_at and last_at are where the first and last copy stand, in bytes from where the records of their file begin
    in the archive. A stretch in which no record can be read is one without an id whose digest begins with UNREADABLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, file, begun = [], -1, 0
                for at, h, record, _ in parse_warc(data, strict=False):
                    found = PAGE.search(h.get("WARC-Record-ID", "")) if h is not None else None
                    page = int(found[1]) if found else None
                    own = None if page is None else page // PER_FILE
                    if own != file:
                        file, begun = own, at
                    rows.append((page, (UNREADABLE if h is None else "") + hashlib.sha256(record).hexdigest(), len(record), at - begun))
                if rows:
                    ids, digests, sizes, places = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests), pa.array(sizes, pa.int64()), pa.array(places, pa.int64())], ["page_id", "digest", "n_bytes", "place"])

    rows = _archives(spark, folder).select("content").mapInArrow(run, "page_id long, digest string, n_bytes long, place long")
    return rows.groupBy(file_of(), "page_id", "digest").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.min("place").alias("first_at"), F.max("place").alias("last_at"))


def file_of() -> Column:
    """The file of a page: PER_FILE consecutive ids."""
    return F.coalesce(F.floor(F.col("page_id") / PER_FILE).cast("string"), F.lit("null")).alias("file")


def _records(pages: DataFrame) -> DataFrame:
    text = record_text(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), text.alias("record")).withColumn("digest", F.sha2("record", 256))


def filed(pages: DataFrame) -> DataFrame:
    """(file, page_id, copies, digest, record): the records of pages and the file of each; equal rows are one record with
    a number of copies."""
    rows = _records(pages).groupBy("page_id", "digest").agg(F.count("*").alias("copies"), F.first("record").alias("record"))
    return rows.select(file_of(), "page_id", "copies", "digest", "record")


def leaves(records: DataFrame) -> DataFrame:
    """(file, idx, page_id, digest, copies, record_offset, n_bytes, hash) of (file, page_id, digest, copies, n_bytes), and of
    first_at and last_at, the places at which they were read: these are hashed, so that another order is another tree.

    Records of a file are ordered by page id and digest; each copy has the record's bytes and the two line ends. Places
    are counted within a segment, the records of a page whose digests begin alike, and the segments of a file are added
    up; so an id that a third of all records have isn't counted in one task.
    """
    size = (F.col("n_bytes") + len(END)) * F.col("copies")
    for place in ("first_at", "last_at"):
        records = records if place in records.columns else records.withColumn(place, F.lit(None).cast("long"))
    rows = records.withColumn("seg", F.substring("digest", 1, 2))
    inside = Window.partitionBy("file", "page_id", "seg").orderBy("digest")
    rows = rows.withColumn("k", F.row_number().over(inside) - 1).withColumn("before", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - size)
    over = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "seg").rowsBetween(Window.unboundedPreceding, -1)
    segments = records.groupBy("file", "page_id", F.substring("digest", 1, 2).alias("seg")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    segments = segments.select("file", "page_id", "seg", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes").over(over), F.lit(0)).alias("bytes"))
    r, s = rows.alias("r"), segments.hint("merge").alias("s")
    both = r.join(s, (F.col("r.file") == F.col("s.file")) & F.col("r.page_id").eqNullSafe(F.col("s.page_id")) & (F.col("r.seg") == F.col("s.seg"))).select("r.*", "n", "bytes")
    placed = both.withColumn("idx", (F.col("k") + F.col("n")).cast("long")).withColumn("record_offset", (F.col("before") + F.col("bytes")).cast("long"))
    return placed.withColumn("hash", F.sha2(F.concat_ws("|", "record_offset", "n_bytes", "copies", "digest", "first_at", "last_at"), 256)).select("file", "idx", "page_id", "digest", "copies", "record_offset", "n_bytes", "hash")


def tree(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Level 0 has (file, idx, hash) of the leaves; each level above hashes the ordered nodes of FANOUT indices."""
    out = [nodes.select("file", "idx", "hash")]
    for _ in range(levels):
        below = F.array_sort(F.collect_list(F.struct("idx", "hash")))
        up = out[-1].groupBy("file", F.floor(F.col("idx") / FANOUT).alias("up")).agg(below.alias("c"))
        out.append(up.select("file", F.col("up").alias("idx"), F.sha2(F.concat_ws("|", F.transform("c", lambda x: F.concat_ws(":", x["idx"].cast("string"), x["hash"]))), 256).alias("hash")))
    return out


def differing(first: list[DataFrame], second: list[DataFrame]) -> DataFrame:
    """(file, idx) of the leaves that differ or that only one replica has: roots first, then down mismatching branches."""
    found = None
    for a, b in zip(reversed(first), reversed(second), strict=True):
        if found is not None:
            a, b = (x.withColumn("up", F.floor(F.col("idx") / FANOUT)).join(found.hint("merge"), ["file", "up"], "left_semi") for x in (a, b))
        both = a.select("file", "idx", F.col("hash").alias("ha")).join(b.select("file", "idx", F.col("hash").alias("hb")).hint("merge"), ["file", "idx"], "full_outer")
        found = both.where(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", F.col("idx").alias("up"))
    return found.select("file", F.col("up").alias("idx"))


def audit(manifest: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record of the manifest, and one for each further record of the replica.

    Both: (file, page_id, digest, copies, n_bytes). Result: page_id, file,
    record_offset, n_bytes, copies, record_sha256, status: ok; moved (same bytes, other place); corrupt (the replica
    has other bytes under the id); missing; extra (only the replica has it); unreadable (a stretch of the replica in which
    no record could be read, as long as n_bytes tells).
    """
    a = common.written(leaves(manifest), "leaves")
    b = common.written(leaves(replica), "leaves")
    last = a.unionByName(b).agg(F.max("idx")).first()[0] or 0
    levels = 1
    while last >= FANOUT**levels:
        levels += 1
    bad = common.written(differing(tree(a, levels), tree(b, levels)), "differing")
    mine = a.join(bad.hint("merge"), ["file", "idx"], "left_semi")
    theirs = b.join(bad.hint("merge"), ["file", "idx"], "left_semi")
    same = (F.col("a.file") == F.col("b.file")) & F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.digest") == F.col("b.digest")) & (F.col("a.copies") == F.col("b.copies"))
    pairs = mine.alias("a").join(theirs.hint("merge").alias("b"), same, "full_outer")
    one = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    pairs = common.written(pairs.select(*[one(c) for c in ("file", "page_id", "digest", "copies", "n_bytes")], F.col("a.idx").alias("idx"), F.coalesce("a.record_offset", "b.record_offset").alias("record_offset"), F.col("a.digest").isNotNull().alias("ours"), F.col("b.digest").isNotNull().alias("there")), "pairs")
    lone = pairs.where("ours <> there").groupBy("file", "page_id").agg(F.max("ours").alias("any_ours"), F.max("there").alias("any_there"))
    key = (F.col("p.file") == F.col("l.file")) & F.col("p.page_id").eqNullSafe(F.col("l.page_id"))
    told = pairs.alias("p").join(lone.hint("merge").alias("l"), key, "left").select("p.*", F.coalesce("any_ours", F.lit(False)).alias("any_ours"), F.coalesce("any_there", F.lit(False)).alias("any_there"))
    status = F.when(F.col("ours") & F.col("there"), "moved").when(F.col("ours") & F.col("any_there"), "corrupt").when(F.col("ours"), "missing").when(F.col("digest").startswith(UNREADABLE), "unreadable").when(~F.col("any_ours"), "extra")
    told = told.withColumn("status", status).where("status is not null")
    known = a.join(told.where("ours").select("file", "idx", "status").hint("merge"), ["file", "idx"], "left")
    cols = ["page_id", "file", "record_offset", "n_bytes", "copies", F.col("digest").alias("record_sha256")]
    return known.select(*cols, F.coalesce("status", F.lit("ok")).alias("status")).unionByName(told.where("status in ('extra', 'unreadable')").select(*cols, "status"))


def _damage() -> tuple[Column, Column]:
    """(lost, record) of a copy with known damage, for drills: by crc32 of the page id modulo 97, at 3 the last
    character changes, at 5 the record is lost, at 7 its last character is cut off."""
    rest = common.crc_mod("page_id", 97)
    head = F.expr("substring(record, 1, length(record) - 1)")
    record = F.when(rest == 3, F.concat(head, F.when(F.col("record").endswith(">"), "<").otherwise(">"))).when(rest == 7, head).otherwise(F.col("record"))
    return F.coalesce(rest == 5, F.lit(False)), record


def write_replicas(pages: DataFrame, folder: str) -> None:
    """Writes the records of pages as the archive ``replica=a``, and a damaged copy of it as ``replica=b``: one shuffle of
    the records, after which the copy is made."""
    lost, copy = _damage()
    rows = _records(pages).select(file_of(), "page_id", "digest", "record").hint("rebalance", F.col("file"))
    both = F.array(F.struct(F.lit("a").alias("replica"), F.col("record")), F.struct(F.lit("b").alias("replica"), F.when(~lost, copy).alias("record")))
    order = ["replica", "file", F.col("page_id").asc_nulls_first(), "digest"]
    out = rows.select("file", "page_id", "digest", F.inline(both)).where("record is not null").sortWithinPartitions(*order)
    out.select("replica", "record").write.partitionBy("replica").option("lineSep", END).option("compression", "gzip").text(folder)


def fixity_drill(pages: DataFrame) -> DataFrame:
    """Archives the records of all pages and a damaged copy, reads both archives and audits the copy against the first.

    Repeated rows are one record with its copies; null urls and bodies count as empty; an empty table gives no rows;
    other columns aren't looked at.
    """
    before = common.held()
    spark = pages.sparkSession
    folder = common.scratch(spark, "warc")
    write_replicas(pages, folder)
    common.released(spark)
    if pages.isEmpty():
        none = spark.createDataFrame([], "file string, page_id long, digest string, copies long, n_bytes long")
        return audit(none, none)
    a, b = (common.written(read_manifest(spark, f"{folder}/replica={r}"), "manifest") for r in "ab")
    common.deleted(spark, folder)
    return common.swept(audit(a, b), before)


ORACLE = r"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') || chr(13) || chr(10) || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS record FROM pages),
bits AS (SELECT i, CASE WHEN i & 1 = 1 THEN xor(i >> 1, 3988292384) ELSE i >> 1 END AS c1 FROM range(256) t(i)),
b2 AS (SELECT i, CASE WHEN c1 & 1 = 1 THEN xor(c1 >> 1, 3988292384) ELSE c1 >> 1 END AS c FROM bits),
b3 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM b2),
b4 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM b3),
b5 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM b4),
b6 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM b5),
b7 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM b6),
b8 AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM b7),
tab AS (SELECT list(c ORDER BY i) AS t FROM b8),
d AS (SELECT page_id, sha256(record) AS digest, count(*) AS copies, any_value(record) AS record FROM r GROUP BY 1, 2),
x AS (SELECT d.*, octet_length(encode(record)) AS n_bytes, CAST(page_id // 256 AS VARCHAR) AS file,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(page_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
        lambda acc, v: xor(t[(xor(acc, v) & 255) + 1], acc >> 8)), 4294967295) % 97 AS rest FROM d, tab),
y AS (SELECT *, CASE WHEN rest = 3 THEN substr(record, 1, length(record) - 1) || CASE WHEN ends_with(record, '>') THEN '<' ELSE '>' END WHEN rest = 7 THEN substr(record, 1, length(record) - 1) ELSE record END AS copy FROM x),
z AS (SELECT *, sum((n_bytes + 4) * copies) OVER w - (n_bytes + 4) * copies AS pos,
    sum(CASE WHEN rest = 5 THEN 0 ELSE (octet_length(encode(copy)) + 4) * copies END) OVER w - CASE WHEN rest = 5 THEN 0 ELSE (octet_length(encode(copy)) + 4) * copies END AS pos_copy
    FROM y WINDOW w AS (PARTITION BY file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING))
SELECT page_id, file, pos::BIGINT AS record_offset, n_bytes::BIGINT AS n_bytes, copies::BIGINT AS copies, digest AS record_sha256,
  CASE WHEN rest = 5 THEN 'missing' WHEN rest IN (3, 7) THEN 'corrupt' WHEN pos <> pos_copy THEN 'moved' ELSE 'ok' END AS status FROM z
"""
