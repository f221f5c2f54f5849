"""Merkle fixity audit of WARC replicas.

Pages are laid out as WARC records, archive by archive; a fixity table gives each record's place (archive, ordinal, offset,
length) and SHA-256. An archive's records are the leaves of a tree in which a node stands for ``FANOUT`` consecutive
children, that is for an ordered range of offsets, and its hash is the SHA-256 of their lines (offset, length, copies,
digest). Two replicas are compared from the roots down, and only the children of differing nodes are looked at: the work
after hashing grows with the damage, not with the archives. A record that is lost or added moves all behind it, so the
differing leaves are aligned by their digests before they are judged: a record that has only moved is not damaged.

Defined cases: null fields of a page count as empty, and pages without a page_id lie in archive -1. Equal records are one
row of a fixity table, with their number (copies). A record that only one replica has, or has in fewer copies, is missing or
extra; if both have another record of the same page_id it is changed, paired in order. Equal replicas give an empty result,
and so do empty tables; an archive that only one replica has differs as a whole. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.llm.common import durable

#: Pages of an archive, by page_id; children of a node; hex digits of a digest that split a page_id's records in numbering.
PAGES, FANOUT, DIGITS = 512, 8, 3


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.1 resource record, with two line breaks at its end."""
    body = F.encode(F.coalesce(html, F.lit("")), "utf-8")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "utf-8"), body, F.lit(b"\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(archive long, page_id, record binary) of pages (page_id, url, html). A null page_id goes to archive -1."""
    archive = F.coalesce(F.floor(F.col("page_id") / PAGES), F.lit(-1)).cast("long")
    return pages.select(archive.alias("archive"), F.col("page_id").cast("long").alias("page_id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def fixity(warc: DataFrame) -> DataFrame:
    """(archive, ordinal, page_id, offset, length, sha256, copies) of records (archive, page_id, record).

    Records are hashed where they are, and equal ones are counted before anything is shuffled. They are ordered by page_id
    and digest. To number them, the parts that a page_id and the first DIGITS of a digest name are numbered in an archive
    (of PAGES page_ids), and then the records in a part; so neither null nor repeated page_ids meet in one task.
    """
    hashed = warc.select("archive", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    one = durable(hashed.groupBy("archive", "page_id", "length", "sha256").agg(F.count("*").alias("copies")))
    one = one.withColumns({"part": F.substring("sha256", 1, DIGITS), "bytes": F.col("length") * F.col("copies")})
    parts = one.groupBy("archive", "page_id", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))

    def before(window, col: str):
        return F.coalesce(F.sum(col).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    outer = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "part")
    parts = parts.select("archive", F.col("page_id").alias("id"), F.col("part").alias("p"), before(outer, "n").alias("n0"), before(outer, "size").alias("size0"))
    inner = Window.partitionBy("archive", "page_id", "part").orderBy("sha256")
    placed = one.withColumns({"n1": F.row_number().over(inner) - 1, "size1": before(inner, "bytes")})
    both = placed.join(parts.withColumnRenamed("archive", "a"), (F.col("archive") == F.col("a")) & F.col("page_id").eqNullSafe(F.col("id")) & (F.col("part") == F.col("p")))
    return both.select("archive", (F.col("n0") + F.col("n1")).cast("long").alias("ordinal"), "page_id", (F.col("size0") + F.col("size1")).alias("offset"), "length", "sha256", "copies")


def _parent(level: DataFrame) -> DataFrame:
    """The next level of (archive, node, offset, length, hash)."""
    line = F.concat_ws(":", "offset", "length", "hash")
    up = level.groupBy("archive", F.floor(F.col("node") / FANOUT).cast("long").alias("node"))
    grown = up.agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", line.alias("line")))), lambda x: x["line"]), "\n"), 256).alias("hash"))
    return grown.select("archive", "node", "offset", "length", "hash")


def merkle_levels(table: DataFrame) -> list[DataFrame]:
    """Levels of (archive, node, offset, length, hash) from the leaves to the roots; one root an archive."""
    copies = F.when(F.col("copies") > 1, F.concat(F.col("copies").cast("string"), F.lit("x"))).otherwise(F.lit(""))
    leaves = durable(table.select("archive", F.col("ordinal").alias("node"), "offset", (F.col("length") * F.col("copies")).alias("length"), F.concat(copies, F.col("sha256")).alias("hash")))
    levels, widest = [leaves], leaves.agg(F.coalesce(F.max("node"), F.lit(0))).first()[0]
    while widest > 0:
        levels.append(durable(_parent(levels[-1])))
        widest //= FANOUT
    return levels


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """(archive, node) of the leaves in which two fixity tables differ, by descent from the roots."""
    a, b = merkle_levels(one), merkle_levels(other)
    while len(a) < len(b):
        a.append(durable(_parent(a[-1])))
    while len(b) < len(a):
        b.append(durable(_parent(b[-1])))
    suspects = None
    for low, high in zip(reversed(a), reversed(b)):
        if suspects is not None:
            up = [F.col("archive"), F.floor(F.col("node") / FANOUT).cast("long").alias("up")]
            low, high = (x.select("*", up[1]).join(suspects, ["archive", "up"], "left_semi").drop("up") for x in (low, high))
        left = low.select("archive", "node", *[F.col(c).alias(f"{c}_a") for c in ("offset", "length", "hash")])
        right = high.select("archive", "node", *[F.col(c).alias(f"{c}_b") for c in ("offset", "length", "hash")])
        differ = left.join(right, ["archive", "node"], "full").where(~(F.col("hash_a").eqNullSafe(F.col("hash_b")) & F.col("offset_a").eqNullSafe(F.col("offset_b")) & F.col("length_a").eqNullSafe(F.col("length_b"))))
        differ = durable(differ.select("archive", "node"))
        suspects = differ.select("archive", F.col("node").alias("up"))
    return differ


def audit(one: DataFrame, other: DataFrame, moved: bool = False) -> DataFrame:
    """Records in which two fixity tables differ: (archive, page_id, status, and ordinal, offset, length, hash, copies of either side).

    status: changed, missing (not in ``other``, or in fewer copies) or extra; with ``moved`` also moved, for records that are
    the same at another offset.
    """
    leaves = differing(one, other)
    sides = []
    for t, s in ((one, "a"), (other, "b")):
        own = t.withColumnRenamed("ordinal", "node").join(leaves, ["archive", "node"], "left_semi")
        named = {"node": "ordinal", "sha256": "hash"}
        sides.append(own.select("archive", "page_id", "sha256", *[F.col(c).alias(f"{named.get(c, c)}_{s}") for c in ("node", "offset", "length", "sha256", "copies")]))
    left, right = sides
    right = right.withColumnsRenamed({"archive": "r_archive", "page_id": "r_page_id", "sha256": "r_sha256"})
    same = (F.col("archive") == F.col("r_archive")) & (F.col("sha256") == F.col("r_sha256")) & F.col("page_id").eqNullSafe(F.col("r_page_id"))
    met = left.join(right, same, "full")
    where = [F.coalesce("archive", "r_archive").alias("archive"), F.when(F.col("archive").isNull(), F.col("r_page_id")).otherwise(F.col("page_id")).alias("page_id")]
    values = [f"{c}_{s}" for s in "ab" for c in ("ordinal", "offset", "length", "hash", "copies")]
    met = durable(met.select(*where, *values))
    kept = F.when(F.col("copies_a") > F.col("copies_b"), "missing").when(F.col("copies_a") < F.col("copies_b"), "extra").otherwise("moved")
    equal = met.where("hash_a is not null and hash_b is not null").withColumn("status", kept)
    alone = [met.where(f"hash_{t} is null").select("archive", "page_id", F.row_number().over(Window.partitionBy("archive", "page_id").orderBy(f"ordinal_{s}")).alias("nth"), *[v for v in values if v[-1] == s]) for s, t in ("ab", "ba")]
    lone = alone[1].withColumnsRenamed({"archive": "r_archive", "page_id": "r_page_id", "nth": "r_nth"})
    paired = alone[0].join(lone, (F.col("archive") == F.col("r_archive")) & F.col("page_id").eqNullSafe(F.col("r_page_id")) & (F.col("nth") == F.col("r_nth")), "full")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    out = equal.select("archive", "page_id", *values, "status").unionByName(paired.select(*where, *values, status.alias("status")))
    return (out if moved else out.where("status <> 'moved'")).select("archive", "page_id", "status", *values)


def damaged(warc: DataFrame, every: int = 101) -> DataFrame:
    """A replica for drills: the last byte of the body of records whose crc32 of the page_id as text is divisible by ``every`` is lost to ``?``."""
    hit = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit(""))) % every == 0
    n = F.octet_length("record")
    bad = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit(b"?\r\n\r\n"))
    return warc.withColumn("record", F.when(hit & (n > 5), bad).otherwise(F.col("record")))


def audit_report(pages: DataFrame) -> DataFrame:
    """(page_id, archive, offset, length, sha256, replica_sha256, status) of the records in which a drill's replica differs."""
    good = records(pages)
    found = audit(durable(fixity(good)), durable(fixity(damaged(good))))
    return found.select("page_id", "archive", F.col("offset_a").alias("offset"), F.col("length_a").alias("length"), F.col("hash_a").alias("sha256"), F.col("hash_b").alias("replica_sha256"), "status")


def members(data: bytes):
    """(offset, length, bytes) of the gzip members of ``data``, or of all of it if it isn't compressed."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at offset {at}")
        unzip, parts, stop = zlib.decompressobj(31), [], at
        while not unzip.eof:
            if stop >= len(data):
                raise ValueError(f"gzip member at offset {at} is cut off")
            parts.append(unzip.decompress(view[stop : stop + (1 << 16)]))
            stop += 1 << 16
        stop = min(stop, len(data)) - len(unzip.unused_data)
        yield at, stop - at, b"".join(parts)
        at = stop


def parse_records(name: str, data: bytes):
    """(offset, length, uri, body) of the records of a WARC file. Of compressed ones, offset and length are their member's."""
    for begin, size, plain in members(data):
        at = 0
        while at < len(plain):
            head_end = plain.find(b"\r\n\r\n", at)
            if head_end < 0:
                if not plain[at:].strip():
                    break
                raise ValueError(f"{name}: no header end after offset {begin + at}")
            head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in plain[at:head_end].split(b"\r\n")[1:])}
            if not head.get(b"content-length", b"").isdigit():
                raise ValueError(f"{name}: no Content-Length in the record at offset {begin + at}")
            stop = head_end + 4 + int(head[b"content-length"])
            after = min(len(plain), stop + 4)
            own = (begin, size) if plain is not data else (at, after - at)
            yield (*own, head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), plain[head_end + 4 : stop])
            at = after


def read_warc(spark, path: str) -> DataFrame:
    """(archive path, offset, length, uri, body) of the records of WARC files (.warc, .warc.gz) at ``path``, by Spark's binaryFile reader.

    A file is parsed by one task, as the format has no split points; archives are bounded when they are written.
    """

    def parse(batches):
        import pandas as pd

        for frame in batches:
            for name, data in zip(frame["path"], frame["content"]):
                yield pd.DataFrame([(name, *r) for r in parse_records(name, data)], columns=["archive", "offset", "length", "uri", "body"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "archive string, offset long, length long, uri string, body binary")


def archive_bytes(warc: DataFrame) -> DataFrame:
    """(archive, content): the bytes of each archive, its records in order; for writers, and for tests of read_warc."""
    rows = warc.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("page_id", F.sha2("record", 256).alias("h"), F.hex("record").alias("r")))).alias("rows"))
    return rows.select("archive", F.unhex(F.array_join(F.transform("rows", lambda x: x["r"]), "")).alias("content"))
