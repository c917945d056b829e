"""Operator 6: WARC files and a Merkle fixity audit of their replicas.

Pages become WARC/1.1 response records, laid out one after another in archives of `ARCHIVE` consecutive page ids. A leaf
of an archive's tree is the place of one page id; its digest is that of the record's length and bytes. Each node above is the
SHA-256 of its `FAN` children's digests, in order, up to one root per archive. Nodes also carry the range of offsets that
their records take, which is no part of the digest: a record that is lost, added or grown moves all later ones, and must
not report them. Two replicas are compared at the roots; only children of nodes that differ are compared one level
below, down to the leaves. `write_warc` and `read_warc` bring records to files and back; the audit of a stored replica reads its
bytes.

Edge cases: null url or html counts as empty; a record that one replica lacks is reported as missing or added; records with a null
page_id have archives of their own by their digest, so a damaged one is one missing and one added; records that repeat a page
id share a leaf, whose digest then stands for all of them in any order; an empty table has no archives and no differences.
Line ends in a url are written as %0D and %0A, so no url ends a header. A file that is cut off, or bytes that are no record, give
a row with `error`; reading goes on at the next record, and the audit of a stored replica reports the range as unreadable beside the
records that are missing for it. Files are not compressed, so that one bad byte costs one record and offsets are those of the file;
compressed ones are read member by member, and a broken member costs what it holds from there on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import Tables, scratch

ARCHIVE = 512
FAN = 8
DEPTH = 3  # levels above the leaves: FAN ** DEPTH >= ARCHIVE
#: Records that make one file, at most.
FILE_RECORDS = 4096
#: Records carry one date: when they were written is no part of what they hold.
DATE = "2024-01-01T00:00:00Z"
_TREE = ["unnamed", "archive"]


def record_text(page_id: Column, url: Column, body: Column) -> Column:
    """The record without its closing two line ends: header lines, an empty line, the body."""
    name = F.coalesce(page_id.cast("string"), F.lit(""))
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def written(pages: DataFrame) -> DataFrame:
    """(page_id, record) of pages."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return pages.select(F.col("page_id").cast("long"), record_text(F.col("page_id").cast("long"), blank("url"), blank("html")).alias("record"))


def write_warc(pages: DataFrame, path: str, archive: int = ARCHIVE) -> None:
    """WARC files, each with whole runs of page ids; a record ends in two line ends. Records without a page id are dealt out by
    their digest."""
    rows = written(pages).withColumn("archive", F.coalesce(F.floor(F.col("page_id") / archive), -1 - F.pmod(F.xxhash64("record"), F.lit(1 << 20))))
    rows = rows.repartition("archive").sortWithinPartitions("archive", "page_id")
    rows.select("record").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


RECORDS = "file string, start long, length long, page_id long, url string, body binary, record_sha256 string, error string"
_MARK = b"WARC/1."


def parsed(data: bytes) -> Iterator[tuple]:
    """(start, length, page_id, url, body, sha256 of the record without closing line ends, error) of every record or broken run of bytes."""
    at = 0
    while at < len(data):
        error = None
        head_end = data.find(b"\r\n\r\n", at)
        head = {}
        if not data.startswith(_MARK, at):
            error = "no record here"
        elif head_end < 0:
            error = "header is cut off"
        else:
            head = dict(x.split(b": ", 1) for x in data[at:head_end].split(b"\r\n")[1:] if b": " in x)
            size = head.get(b"Content-Length", b"")
            if not size.isdigit():
                error = "no length"
            elif head_end + 8 + int(size) > len(data):
                error = "body is cut off"
            elif data[head_end + 4 + int(size) : head_end + 8 + int(size)] != b"\r\n\r\n":
                error = "record does not end where its length says"
        if error:
            after = data.find(b"\r\n\r\n" + _MARK, at + 1)
            end = len(data) if after < 0 else after + 4
            yield at, end - at, None, None, None, None, error
        else:
            end = head_end + 8 + int(size)
            name = head.get(b"WARC-Record-ID", b"").removeprefix(b"<urn:page:").removesuffix(b">")
            page = int(name) if name.removeprefix(b"-").isdigit() else None
            url = head.get(b"WARC-Target-URI", b"").decode("utf-8", "replace")
            yield at, end - at, page, url, data[head_end + 4 : end - 4], hashlib.sha256(data[at : end - 4]).hexdigest(), None
        at = end


def inflated(data: bytes, step: int = 1 << 16) -> bytes:
    """gzip members one after another; other bytes as they are. Of a broken member the part before the break is kept, and reading goes
    on at the next member's header."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out, at = [], 0
    while 0 <= at < len(data):
        z, pos = zlib.decompressobj(31), at
        try:
            while pos < len(data) and not z.eof:
                out.append(z.decompress(data[pos : pos + step]))
                pos += step
            at = min(pos, len(data)) - len(z.unused_data)
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", at + 1)
    return b"".join(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files. A task reads one file at a time."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(name, *r) for r in parsed(inflated(data))]
                for i in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 500]), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, RECORDS)


def leaves(records: DataFrame, archive: int = ARCHIVE) -> DataFrame:
    """(unnamed, archive, position, page_id, records, start, stop, digest) from (page_id, length, sha): one row per leaf.

    Lengths and digests are added up leaf by leaf, so a page id that fills the table is combined before the shuffle; the window
    over an archive holds `archive` rows at most.
    """
    own = F.pmod(F.xxhash64("sha"), F.lit(1 << 40))
    number = F.coalesce(F.col("page_id"), own)
    half = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("decimal(38,0)")
    keyed = records.select(F.col("page_id").isNull().alias("unnamed"), F.floor(number / archive).alias("archive"), F.pmod(number, F.lit(archive)).alias("position"),
                           "page_id", "length", "sha", half(1).alias("x"), half(16).alias("y"))
    found = keyed.groupBy(*_TREE, "position").agg(
        F.min("page_id").alias("page_id"), F.count("*").alias("records"), F.sum("length").alias("length"), F.min("sha").alias("sha"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    digest = F.when(F.col("records") == 1, F.sha2(F.concat_ws("|", "length", "sha"), 256)).otherwise(F.sha2(F.concat_ws("|", "records", "length", "x", "y"), 256))
    stop = F.sum("length").over(W.partitionBy(*_TREE).orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    return found.withColumn("stop", stop).select(*_TREE, "position", "page_id", "records", (F.col("stop") - F.col("length")).alias("start"), "stop", digest.alias("digest"))


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, length, sha) of pages as they would be written, closing line ends in the length."""
    return written(pages).select("page_id", (F.octet_length("record") + 4).cast("long").alias("length"), F.sha2("record", 256).alias("sha"))


def stored_records(warc: DataFrame) -> DataFrame:
    return warc.filter("error IS NULL").select("page_id", "length", F.col("record_sha256").alias("sha"))


def tree(leaf: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """All nodes (unnamed, archive, level, node, digest, start, stop): level 0 are the leaves, level `depth` the roots.
    A node has at most `fan` children."""
    level = leaf.select(*_TREE, F.lit(0).alias("level"), F.col("position").alias("node"), "digest", "start", "stop")
    levels = [level]
    for d in range(1, depth + 1):
        child = F.struct("node", "digest")
        joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["node"], c["digest"])))
        level = level.groupBy(*_TREE, F.floor(F.col("node") / fan).alias("up")).agg(
            F.sha2(joined, 256).alias("digest"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        ).select(*_TREE, F.lit(d).alias("level"), F.col("up").alias("node"), "digest", "start", "stop")
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def audit(left: DataFrame, right: DataFrame, t: Tables, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """Leaves that differ between two trees; null on the side that has none."""
    differ, made = None, []
    for level in range(depth, -1, -1):
        side = lambda df, digest, a, b: df.filter(F.col("level") == level).select(
            *_TREE, "node", F.col("digest").alias(digest), F.col("start").alias(a), F.col("stop").alias(b))
        ours, theirs = side(left, "expected", "start", "stop"), side(right, "found", "found_start", "found_stop")
        if differ is not None:  # only below nodes that differ
            up = F.floor(F.col("node") / fan)
            ours, theirs = (x.withColumn("up", up).join(differ, [*_TREE, "up"], "left_semi").drop("up") for x in (ours, theirs))
        both = ours.join(theirs, [*_TREE, "node"], "full").filter(~F.col("expected").eqNullSafe(F.col("found")))
        if level:
            differ = t(both.select(*_TREE, F.col("node").alias("up")), f"differ-{level}")
            made.append(differ)
    out = t(both.withColumnRenamed("node", "position"), "differ-0")
    t.drop(*made)
    return out


#: The stored replica of the query, by the first hex digits of md5(page_id): damaged in place, lost, and grown by one byte;
#: one page in 256 is stored twice over under a page id that nobody knows.
DAMAGED, LOST, GROWN, ADDED = "substr(md5(cast(page_id AS string)), 1, 2) IN ('70', '71', '72', '73')", "substr(md5(cast(page_id AS string)), 1, 2) = 'a1'", "substr(md5(cast(page_id AS string)), 1, 2) = 'b2'", "substr(md5(cast(page_id AS string)), 1, 2) = 'c3'"


def damaged_replica(pages: DataFrame) -> DataFrame:
    html = F.when(F.expr(DAMAGED), F.translate("html", "e", "E")).when(F.expr(GROWN), F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    kept = pages.select("page_id", "url", html.alias("html")).filter(~F.coalesce(F.expr(LOST), F.lit(False)))
    return kept.unionByName(pages.filter(F.expr(ADDED)).select((-1 - F.col("page_id")).alias("page_id"), "url", "html"))


def fixity_audit(ours: DataFrame, theirs: DataFrame, archive: int = ARCHIVE, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """Differences between two tables of records (page_id, length, sha): one row per page id that differs."""
    t = Tables(ours.sparkSession)
    a, b = t(leaves(ours, archive), "leaves"), t(leaves(theirs, archive), "replica")
    left, right = t(tree(a, fan, depth), "left"), t(tree(b, fan, depth), "right")
    found = audit(left, right, t, fan, depth)
    t.drop(left, right)
    key = [*_TREE, "position"]
    names = found.join(a.select(*key, F.col("page_id").alias("a_id")), key, "left").join(b.select(*key, F.col("page_id").alias("b_id")), key, "left")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "added").otherwise("changed")
    return names.select(*key, F.coalesce("a_id", "b_id").alias("page_id"), status.alias("status"), "start", "stop", "found_start", "found_stop", "expected", "found")


def unreadable(warc: DataFrame) -> DataFrame:
    """Ranges of stored bytes that are no record, as rows of an audit."""
    at = F.col("start")
    none = {"archive": "long", "position": "long", "page_id": "long", "start": "long", "stop": "long", "expected": "string"}
    rows = warc.filter("error IS NOT NULL").select(F.lit(True).alias("unnamed"), F.lit("unreadable").alias("status"), at.alias("found_start"), (at + F.col("length")).alias("found_stop"), F.concat_ws(": ", "file", "error").alias("found"))
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in none.items()})


def audit_stored(pages: DataFrame, path: str) -> DataFrame:
    """Differences between pages and the WARC files of a replica: what is missing, added or changed by page id, and ranges of bytes that
    cannot be read (with their file in `found`)."""
    t = Tables(pages.sparkSession)
    stored = t(read_warc(pages.sparkSession, path).drop("body"), "stored")
    out = fixity_audit(page_records(pages), stored_records(stored))
    return out.unionByName(unreadable(stored).select(*[F.col(c).cast(out.schema[c].dataType).alias(c) for c in out.columns]))


def stored_audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """The replica is written to WARC files in the shared folder; the audit compares pages with what is read from the files."""
    path = scratch(pages.sparkSession, "warc")
    write_warc(replica, path)
    return audit_stored(pages, path)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(page_id::VARCHAR), 1, 2) AS h FROM pages),
v AS (
  SELECT 0 AS side, page_id, url, html FROM p
  UNION ALL SELECT 1, page_id, url, CASE WHEN h IN ('70', '71', '72', '73') THEN translate(html, 'e', 'E') WHEN h = 'b2' THEN html || '!' ELSE html END FROM p WHERE h <> 'a1'
  UNION ALL SELECT 1, -1 - page_id, url, html FROM p WHERE h = 'c3'),
r AS (
  SELECT side, page_id, floor(page_id / 512.0)::BIGINT AS archive, 'WARC/1.1' || n || 'WARC-Type: response' || n || 'WARC-Record-ID: <urn:page:' || page_id || '>' || n || 'WARC-Date: 2024-01-01T00:00:00Z' || n || 'WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || n
    || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(html) || n || n || html AS record
  FROM v, (SELECT chr(13) || chr(10) AS n)),
l AS (
  SELECT side, archive, page_id - archive * 512 AS position, page_id, strlen(record) + 4 AS len, sha256((strlen(record) + 4) || '|' || sha256(record)) AS digest FROM r),
o AS (SELECT *, (sum(len) OVER (PARTITION BY side, archive ORDER BY position ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM l)
SELECT false AS unnamed, coalesce(a.archive, b.archive) AS archive, coalesce(a.position, b.position) AS position, coalesce(a.page_id, b.page_id) AS page_id,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'added' ELSE 'changed' END AS status,
  coalesce(a.stop - a.len, -1) AS start, coalesce(a.stop, -1) AS stop, coalesce(b.stop - b.len, -1) AS found_start, coalesce(b.stop, -1) AS found_stop, a.digest AS expected, b.digest AS found
FROM (SELECT * FROM o WHERE side = 0) a FULL JOIN (SELECT * FROM o WHERE side = 1) b ON a.page_id = b.page_id WHERE a.digest IS DISTINCT FROM b.digest
"""
