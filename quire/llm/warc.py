"""WARC files, and a Merkle fixity audit of two replicas.

The records of an archive stand in its files one after another by id; a record's place is its offset.
An audit reads both replicas' files and hashes every record's bytes. A lost or longer record moves all
that follow, so the trees are laid over ordered ranges of record ids, in which both replicas agree, and
offsets say where a record is found: a range of sixteen ids hashes its records in order, sixteen
ranges make the next, and an archive's root hashes its topmost ranges. The audit compares roots, and
level by level reads only the children of nodes that differ, down to the records. Records that share
an id count as a set, whose hash is summed, so that none of them need be brought together.

`read_warc` gives what can't be read as a row with an `error`, and goes on at the next line that begins
a record: `no header` (other bytes between records), `broken length` (none, or no number), `cut short`
(the file ends before the record), `bad gzip` (a member that can't be unpacked; what comes after it in
the file is left out). A file is held in one task, so it must be under 2 GB; `write_warc` gives a file
`per_file` records at most.

Rows with a null id can't be placed and are left out; null payloads are empty; extra columns are left
out; an empty replica has no root, so that all of the other's records are `missing` or `extra`.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

END = "\r\n\r\n"
#: Children of a node, and levels of ranges between the records and the root.
FANOUT, LEVELS = 16, 3


#: The date of records that have none: every record needs one.
DATE = "1970-01-01T00:00:00Z"


def record(url: Column, payload: Column, record_id: Column, date: Column | None = None) -> Column:
    """The record's text without the two line ends that close it; `date`: UTC, as in `DATE`."""
    body = F.coalesce(payload, F.lit(""))
    head = ("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:", record_id.cast("string"), ">\r\nWARC-Date: ", F.lit(DATE) if date is None else F.coalesce(date, F.lit(DATE)), "\r\nWARC-Target-URI: ", F.coalesce(url, F.lit("")), "\r\nContent-Type: text/html\r\nContent-Length: ")
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in head], F.octet_length(body).cast("string"), F.lit(END), body)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per_archive: int = 1000) -> DataFrame:
    """(archive, page_id, record): ids are dealt to archives in runs of `per_archive`."""
    page = F.col(id_col).cast("bigint")
    rows = pages.filter(page.isNotNull()).select(F.floor(page / per_archive).cast("bigint").alias("archive"), page.alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload"))
    return rows.select("archive", "page_id", record(F.col("url"), F.col("payload"), F.col("page_id")).alias("record"))


def write_warc(rows: DataFrame, path: str, compression: str = "none", per_file: int = 1000, dealt: bool = False) -> None:
    """Writes (archive, page_id, record) as one folder of WARC files for each archive, by id; a record ends with two line ends.

    `dealt`: the rows of an archive are in one task already, as those are that were read from its file; then nothing is shuffled.
    """
    if dealt:
        _write(rows, path, compression, per_file)
        return
    large = c.materialise(rows.groupBy("archive").agg(F.ceil(F.count("*") / per_file).alias("__files")).filter("__files > 1"))
    parts = c.join_small(rows, large, ["archive"], "left").withColumn("__file", F.pmod(F.xxhash64("page_id", "record"), F.coalesce("__files", F.lit(1))))
    _write(parts.repartition("archive", "__file"), path, compression, per_file)


def _write(rows: DataFrame, path: str, compression: str, per_file: int) -> None:
    placed = rows.sortWithinPartitions("archive", "page_id", "record")
    placed.select("archive", "record").write.partitionBy("archive").option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", 2 * per_file).text(path)


_START = re.compile(rb"(?:\A|(?<=\n))WARC/1")


def _unpacked(data: bytes) -> tuple[bytes, int]:
    """The members of a gzipped file one after another, and how many bytes of it couldn't be unpacked."""
    out: list[bytes] = []
    while data:
        member = zlib.decompressobj(31)
        try:
            for i in range(0, len(data), 1 << 16):
                out.append(member.decompress(data[i : i + (1 << 16)]))
                if member.eof:
                    break
        except zlib.error:
            return b"".join(out), len(data)
        if not member.eof:
            return b"".join(out), len(data)
        data = member.unused_data + data[i + (1 << 16) :]
    return b"".join(out), 0


def parse(data: bytes) -> Iterator[tuple]:
    """(offset, length, record id, url, payload, sha256, error) of each record of an unpacked file, and of each stretch that is none."""
    at = 0
    while at < len(data):
        cut = data.find(END.encode(), at)
        fields = (line.split(b":", 1) for line in data[at:cut].split(b"\r\n")[1:] if b":" in line)
        head = {name.strip().lower(): value.strip() for name, value in fields}  # names are written in any case
        size = head.get(b"content-length", b"")
        error = "no header" if not data.startswith(b"WARC/1", at) else "cut short" if cut < 0 else "broken length" if not size.isdigit() else None
        end = len(data)
        if not error:
            end = cut + 8 + int(size)
            if end > len(data):
                error = "cut short"
            elif data[end - 4 : end] != END.encode():
                error = "broken length"
        if error:
            after = _START.search(data, at + 1)
            end = after.start() if after else len(data)
            yield at, end - at, None, None, None, None, error
        else:
            yield at, end - at, head.get(b"warc-record-id", b"").decode("utf-8", "replace"), head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), data[cut + 4 : end - 4], hashlib.sha256(data[at:end]).hexdigest(), None
        at = end


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(file, offset, length, record_id, url, payload, sha256, error) of every record of the WARC files in a folder; gzipped files are unpacked, and offsets are in the unpacked file."""
    names = ["file", "offset", "length", "record_id", "url", "payload", "sha256", "error"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data, lost = content.as_py(), 0
                if data[:2] == b"\x1f\x8b":
                    data, lost = _unpacked(data)
                rows = [(name.as_py(), *r) for r in parse(data)]
                if lost:
                    rows.append((name.as_py(), len(data), lost, None, None, None, None, "bad gzip"))
                if not payloads:
                    rows = [(*r[:5], None, *r[6:]) for r in rows]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return c.small_batches(files).mapInArrow(run, "file string, offset bigint, length bigint, record_id string, url string, payload binary, sha256 string, error string")


def placed(read: DataFrame) -> DataFrame:
    """What read_warc gives of files that write_warc wrote, with `archive` and `page_id`; what it can't read is left out."""
    archive = F.regexp_extract("file", r"/archive=(-?\d+)/[^/]*$", 1).cast("bigint")
    page = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    return read.filter("error is null").filter(page != "").withColumns({"archive": archive, "page_id": page.cast("bigint")})


def leaves(read: DataFrame) -> DataFrame:
    """(archive, page_id, offset, length, hash) of the records of files that write_warc wrote; a record that can't be read is `missing`."""
    return placed(read).select("archive", "page_id", "offset", "length", F.col("sha256").alias("hash"))


def _parent(children: DataFrame, order: str, key: Column) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "hash"))), lambda x: x["hash"]), "")
    return children.withColumn("node", key).groupBy("archive", "node").agg(F.sha2(joined.cast("binary"), 256).alias("hash"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels of (archive, node, hash) from ranges of sixteen ids up; the last level has one root for each archive."""
    sums = [F.sum(F.xxhash64(F.lit(k), "hash", "length").cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    own = leaf.groupBy("archive", "page_id").agg(F.count("*").alias("n"), *sums)
    own = own.select("archive", "page_id", F.sha2(F.concat_ws(":", "page_id", "n", "s0", "s1", "s2", "s3").cast("binary"), 256).alias("hash"))
    levels = [c.materialise(_parent(own, "page_id", F.floor(F.col("page_id") / FANOUT)))]
    for _ in range(LEVELS - 1):
        levels.append(c.materialise(_parent(levels[-1].withColumnRenamed("node", "child"), "child", F.floor(F.col("child") / FANOUT))))
    levels.append(c.materialise(_parent(levels[-1].withColumnRenamed("node", "child"), "child", F.lit(0).cast("bigint"))))
    return levels


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """(archive, page_id, offset, other_offset, length, fault, n_records) of records that differ between two replicas' leaves.

    fault: `altered` (other bytes under this id), `missing` (only in `one`) or `extra` (only in
    `other`); of several records with one id and fault, the first place in each replica and their number.
    """
    one, other = c.materialise(one), c.materialise(other)
    ours, theirs = tree(one), tree(other)
    wrong: DataFrame | None = None
    for level in range(LEVELS, -1, -1):
        a, b = ours[level], theirs[level]
        if wrong is not None:
            up = F.floor(F.col("node") / FANOUT) if level < LEVELS - 1 else F.lit(0).cast("bigint")
            a, b = (x.withColumn("up", up).join(wrong, (x["archive"] == wrong["w_archive"]) & (F.col("up") == wrong["w_node"]), "left_semi").drop("up") for x in (a, b))
        both = a.select("archive", "node", F.col("hash").alias("h1")).join(b.select("archive", "node", F.col("hash").alias("h2")), ["archive", "node"], "full_outer")
        wrong = c.materialise(both.filter(~F.col("h1").eqNullSafe(F.col("h2"))).select(F.col("archive").alias("w_archive"), F.col("node").alias("w_node")))
    sides = []
    for x, sign in ((one, 1), (other, -1)):
        within = x.join(wrong, (x["archive"] == wrong["w_archive"]) & (F.floor(x["page_id"] / FANOUT) == wrong["w_node"]), "left_semi")
        sides.append(within.select("archive", "page_id", "hash", "length", F.when(F.lit(sign > 0), F.col("offset")).alias("offset"), F.when(F.lit(sign < 0), F.col("offset")).alias("other_offset"), F.lit(sign).alias("sign")))
    each = sides[0].union(sides[1]).groupBy("archive", "page_id", "hash", "length").agg(F.sum("sign").alias("n"), F.min("offset").alias("offset"), F.min("other_offset").alias("other_offset")).filter("n <> 0")
    per = each.groupBy("archive", "page_id").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("a"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("b"), F.min(F.when(F.col("n") > 0, F.col("offset"))).alias("offset"), F.min(F.when(F.col("n") < 0, F.col("other_offset"))).alias("other_offset"),
        F.min(F.when(F.col("n") > 0, F.struct("offset", "length"))).alias("f1"), F.min(F.when(F.col("n") < 0, F.struct("other_offset", "length"))).alias("f2"),
    )
    faults = F.array(
        F.struct(F.lit("altered").alias("fault"), F.least("a", "b").alias("n_records")), F.struct(F.lit("missing").alias("fault"), (F.col("a") - F.col("b")).alias("n_records")), F.struct(F.lit("extra").alias("fault"), (F.col("b") - F.col("a")).alias("n_records"))
    )
    rows = per.withColumn("f", F.explode(F.filter(faults, lambda x: x["n_records"] > 0)))
    return rows.select("archive", "page_id", F.when(F.col("f.fault") != "extra", F.col("offset")).alias("offset"), F.when(F.col("f.fault") != "missing", F.col("other_offset")).alias("other_offset"), F.coalesce("f1.length", "f2.length").alias("length"), "f.fault", "f.n_records")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as gzipped WARC files, and a replica in which a rule on md5(page_id) damages records and leaves some out; reads both and audits them."""
    mark = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    first, second = c.shared_path(spark, "warc"), c.shared_path(spark, "warc")
    write_warc(records(c.table(spark, sf_dir, "pages")), first, "gzip")
    html = F.col("payload").cast("string")
    html = F.when(mark < "04", F.concat(F.lit("#"), F.substring(html, 2, 1 << 30))).otherwise(html)
    copied = placed(read_warc(spark, first)).filter(mark < "fc").select("archive", "page_id", record(F.col("url"), html, F.col("page_id")).alias("record"))
    write_warc(copied, second, "gzip", dealt=True)
    return audit(*(leaves(read_warc(spark, path, payloads=False)) for path in (first, second)))


_SQL = r"""
WITH p AS (SELECT page_id, page_id // 1000 AS archive, coalesce(url, '') AS url, coalesce(html, '') AS html, left(md5(page_id::varchar), 2) AS mark FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT *, CASE WHEN mark < '04' THEN '#' || substr(html, 2) ELSE html END AS other FROM p),
r AS (SELECT *, octet_length(encode(html)) AS n, octet_length(encode(other)) AS m, octet_length(encode('WARC/1.1..WARC-Type: resource..WARC-Record-ID: <urn:page:' || page_id || '>..WARC-Date: 1970-01-01T00:00:00Z..WARC-Target-URI: ' || url || '..Content-Type: text/html..Content-Length: ....')) + 4 AS head FROM q),
l AS (SELECT *, (head + length(n::varchar) + n)::bigint AS length, CASE WHEN mark < 'fc' THEN (head + length(m::varchar) + m)::bigint ELSE 0 END AS other_length FROM r),
o AS (SELECT *, coalesce(sum(length) OVER w, 0)::bigint AS "offset", CASE WHEN mark < 'fc' THEN coalesce(sum(other_length) OVER w, 0)::bigint END AS other_offset FROM l WINDOW w AS (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT archive, page_id, "offset", other_offset, length, CASE WHEN mark >= 'fc' THEN 'missing' ELSE 'altered' END AS fault, 1::bigint AS n_records FROM o WHERE mark >= 'fc' OR other <> html
"""

QUERIES = {"op3_warc_fixity": op3_warc_fixity}
ORACLES = {"op3_warc_fixity": _SQL}
