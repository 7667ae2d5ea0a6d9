"""Fixity audit of web-archive replicas with Merkle trees.

A replica is a table of archive records (archive, record_id, record bytes or
their digest, offset, length). Leaves are record digests in offset order; every
inner node hashes up to ``FANOUT`` children and covers their range of offsets.
Two replicas are compared root by root, and only the children of nodes that
differ are looked at, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rinkline.llm.common import staged

FANOUT = 16
#: Levels above the records: an archive of up to 16 ** 3 = 4096 records has one root, a longer one several.
LEVELS = 3


def response_record(url: Column, record_id: Column, body: Column) -> Column:
    """Bytes of a WARC response record: header block, body and the two line ends after it."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaves(records: DataFrame, with_offsets: bool = False) -> DataFrame:
    """(archive, record_id, offset, length, digest, place) of records (archive, record_id, record).

    The record's bytes are hashed where they are read and never shuffled. Without
    offsets in the table, a record starts where the one before it in its archive
    ends, in order of record_id; equal and null ids are ordered by digest. A null
    record counts as empty. Archives hold a bounded number of records (as web
    archive files do), so the running sum over one is bounded.
    """
    data = F.coalesce(F.col("record"), F.lit("").cast("binary"))
    given = ["offset"] if with_offsets else []
    small = records.select("archive", "record_id", *given, F.octet_length(data).cast("long").alias("length"), F.sha2(data, 256).alias("digest"))
    order = [F.col("offset")] * with_offsets + [F.col("record_id").asc_nulls_first(), F.col("digest"), F.col("length")]
    inside = Window.partitionBy("archive").orderBy(*order)
    if not with_offsets:
        small = small.withColumn("offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return small.withColumn("place", (F.row_number().over(inside) - 1).cast("long"))


def tree(leaf_rows: DataFrame) -> DataFrame:
    """All nodes: (archive, level, place, start, stop, digest); level 0 are records, level ``LEVELS`` the roots.

    A group never holds more than ``FANOUT`` children, so no task gathers an archive.
    """
    level = leaf_rows.select("archive", F.lit(0).alias("level"), "place", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), "digest")
    nodes = level
    for n in range(1, LEVELS + 1):
        ordered = F.array_sort(F.collect_list(F.struct("place", "digest")))
        level = level.groupBy("archive", parent_of("place").alias("place")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), ordered.alias("children"))
        level = level.select("archive", F.lit(n).alias("level"), "place", "start", "stop", F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256).alias("digest"))
        nodes = nodes.unionByName(level)
    return nodes


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """Records on which two replicas (leaf rows) disagree, found from the roots down.

    Result: archive, record_id, status, offset, length, digest of the first
    replica, other_offset, other_digest. ``changed``: same record id, other
    bytes; ``missing`` and ``extra``: only in the first or only in the second;
    ``moved``: same bytes at another offset. Archives that only one replica has
    are missing or extra in whole. Records with equal ids in one archive are
    told apart by their order. Equal replicas and empty tables give no rows.
    """
    one, two = staged(one, "leaves"), staged(two, "leaves")
    left, right = staged(tree(one), "tree"), staged(tree(two), "tree")
    # Null archives and nodes compare equal to themselves.
    differ = None
    for n in range(LEVELS, 0, -1):
        a = left.where(F.col("level") == n).select("archive", "place", "start", "stop", "digest")
        b = right.where(F.col("level") == n).select("archive", "place", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"), F.col("digest").alias("b_digest"))
        if differ is not None:
            a, b = under(a, differ), under(b, differ)
        b = b.select(F.col("archive").alias("b_archive"), F.col("place").alias("b_place"), "b_start", "b_stop", "b_digest")
        both = a.join(b, F.col("archive").eqNullSafe(F.col("b_archive")) & (F.col("place") == F.col("b_place")), "full_outer")
        unlike = ~(F.col("digest").eqNullSafe(F.col("b_digest")) & F.col("start").eqNullSafe(F.col("b_start")) & F.col("stop").eqNullSafe(F.col("b_stop")))
        differ = both.where(unlike).select(F.when(F.col("place").isNotNull(), F.col("archive")).otherwise(F.col("b_archive")).alias("archive"), F.coalesce("place", "b_place").alias("parent"))
    a, b = under(one, differ), under(two, differ)
    nth = Window.partitionBy("archive", "record_id").orderBy("place")
    a = a.withColumn("nth", F.row_number().over(nth))
    b = b.withColumn("nth", F.row_number().over(nth)).select(*[F.col(c).alias(f"b_{c}") for c in ("archive", "record_id", "offset", "digest", "nth")])
    same = F.col("archive").eqNullSafe(F.col("b_archive")) & F.col("record_id").eqNullSafe(F.col("b_record_id")) & (F.col("nth") == F.col("b_nth"))
    both = a.join(b, same, "full_outer")
    status = (
        F.when(F.col("nth").isNull(), "extra").when(F.col("b_nth").isNull(), "missing")
        .when(F.col("digest") != F.col("b_digest"), "changed").when(F.col("offset") != F.col("b_offset"), "moved")
    )
    only_b = F.col("nth").isNull()
    out = both.select(
        F.when(only_b, F.col("b_archive")).otherwise(F.col("archive")).alias("archive"), F.when(only_b, F.col("b_record_id")).otherwise(F.col("record_id")).alias("record_id"), status.alias("status"),
        "offset", "length", "digest", F.col("b_offset").alias("other_offset"), F.col("b_digest").alias("other_digest"),
    )
    return out.where("status IS NOT NULL")


def under(nodes: DataFrame, differ: DataFrame) -> DataFrame:
    """Those of ``nodes`` whose parent is among the nodes that differ (archive, parent)."""
    found = differ.select(F.col("archive").alias("_archive"), F.col("parent").alias("_parent"))
    return nodes.join(found, F.col("archive").eqNullSafe(F.col("_archive")) & (F.col("_parent") == parent_of("place")), "left_semi")


def parent_of(place: str) -> Column:
    return F.floor(F.col(place) / FANOUT).cast("long")
