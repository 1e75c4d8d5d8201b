"""Merkle fixity audit of a web archive and its replica.

Every record is hashed with its header; records stand at whole-number positions,
and each tree level joins FANOUT neighbouring ranges: a node's hash covers its
children's positions and hashes. Two replicas agree where a node's hashes agree.
The audit compares the roots and goes down only below nodes that differ, level by
level, to the records; the joins on the way carry the differing branches alone.

Records also get their byte offsets in the archive, by prefix sums over ranges
of positions: totals by range first, then sums within a range.

Null header or body counts as empty. A position that occurs more than once holds
all its records, hashed in the order of their digests; a record with a null
position is not part of the archive. Empty tables: two empty replicas agree; an
empty replica misses every record. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import stored

FANOUT = 256


def record_header(url: str, body: str) -> Column:
    """The archive record's header for a page: type, target and length."""
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(url), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(F.coalesce(F.col(body), F.lit(""))).cast("string"), F.lit("\r\n\r\n"))


def records(pages: DataFrame, position: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """position, length in bytes (with the two line ends after each record) and sha256 of each record."""
    header, text = record_header(url, body), F.coalesce(F.col(body), F.lit(""))
    whole = F.concat(header, text)
    return pages.where(F.col(position).isNotNull()).select(F.col(position).cast("long").alias("position"), (F.octet_length(whole) + 4).cast("long").alias("length"), F.sha2(whole, 256).alias("digest"))


def with_offsets(recs: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Adds each record's byte offset in position order. Only one total per ``span`` positions goes through the global sum."""
    part = recs.withColumn("__range", F.floor(F.col("position") / span))
    totals = part.groupBy("__range").agg(F.sum("length").alias("__total"))
    # sums of sums: blocks of ranges keep the one-task step tiny
    totals = totals.withColumn("__block", F.floor(F.col("__range") / span))
    blocks = totals.groupBy("__block").agg(F.sum("__total").alias("__sum"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__block").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.join(blocks, "__block").select("__range", (F.col("__start") + F.coalesce(F.sum("__total").over(within), F.lit(0))).alias("__base"))
    each = Window.partitionBy("__range").orderBy("position", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return part.join(ranges, "__range").select("position", "length", "digest", (F.col("__base") + F.coalesce(F.sum("length").over(each), F.lit(0))).cast("long").alias("offset"))


def _hash_of(kids: Column) -> Column:
    """sha256 of an array of texts in order; null for an empty one: the side has nothing here."""
    return F.when(F.size(kids) > 0, F.sha2(F.concat_ws(",", F.array_sort(kids)), 256))


def leaves(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """(node, hash, other_hash) of level 0: one leaf a position, hashed on either side (null: missing there)."""
    both = archive.select("position", "digest", F.lit(True).alias("own")).unionByName(replica.select("position", "digest", F.lit(False).alias("own")))
    listed = [F.collect_list(F.when(side, F.col("digest"))) for side in (F.col("own"), ~F.col("own"))]
    return both.groupBy(F.col("position").alias("node")).agg(_hash_of(listed[0]).alias("hash"), _hash_of(listed[1]).alias("other_hash"))


def level_above(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The same for the level over ``level``: at most ``fanout`` children a node, hashed with their numbers."""
    number = F.lpad(F.col("node").cast("string"), 20, "0")
    listed = [F.collect_list(F.when(F.col(h).isNotNull(), F.concat(number, F.lit(":"), F.col(h)))) for h in ("hash", "other_hash")]
    return level.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(_hash_of(listed[0]).alias("hash"), _hash_of(listed[1]).alias("other_hash"))


def trees(archive: DataFrame, replica: DataFrame, levels: int | None = None, fanout: int = FANOUT) -> list[DataFrame]:
    """Both sides' levels from the leaves to the root. ``levels``: None for as many as the largest position takes."""
    out = [stored(leaves(archive, replica), "level0")]
    if levels is None:
        largest, levels = out[0].agg(F.max("node")).first()[0] or 0, 1
        while fanout**levels <= largest:
            levels += 1
    for k in range(levels):
        out.append(stored(level_above(out[-1], fanout), f"level{k + 1}"))
    return out


def differing(levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """node, hash, other_hash of the leaves that differ, found from the root down: of each level only the nodes below differing ones are compared (the level's own table is scanned for them)."""
    found = None
    for level in reversed(levels):
        if found is not None:
            level = level.join(found.select(F.col("node").alias("__up")), F.floor(F.col("node") / fanout) == F.col("__up"), "left_semi")
        found = level.where(~F.col("hash").eqNullSafe(F.col("other_hash")))
    return found


def audit(archive: DataFrame, replica: DataFrame, levels: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """position, offset, length, digest, status of every record of either side: intact, altered, missing (from the replica) or added (to it).

    Offset and length are the archive's; both are null for added records.
    """
    mine, theirs = records(archive), records(replica)
    bad = stored(differing(trees(mine, theirs, levels, fanout), fanout), "differing")
    status = F.when(F.col("other_hash").isNull(), "missing").when(F.col("hash").isNull(), "added").otherwise("altered")
    bad = bad.select(F.col("node").alias("position"), status.alias("status"))
    all_ = with_offsets(mine).join(bad, "position", "left").withColumn("status", F.coalesce("status", F.lit("intact")))
    added = bad.where("status = 'added'").join(theirs, "position").select("position", F.lit(None).cast("long").alias("length"), "digest", F.lit(None).cast("long").alias("offset"), "status")
    return all_.unionByName(added)


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A stand-in for a second copy, with known damage: pages 7 mod 101 have their last character gone, pages 5 mod 211 are lost."""
    body = F.when(F.col("page_id") % 101 == 7, F.expr("substring(html, 1, greatest(length(html) - 1, 0))")).otherwise(F.col("html"))
    return pages.where((F.col("page_id") % 211 != 5) | F.col("page_id").isNull()).withColumn("html", body)


def page_fixity(pages: DataFrame) -> DataFrame:
    """The audit of all pages against their stand-in replica."""
    return audit(pages, damaged_replica(pages)).select(F.col("position").alias("page_id"), "offset", "length", "digest", "status")


PAGE_FIXITY_SQL = """
with w as (
  select page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), 'Content-Length: ', cast(strlen(coalesce(html, '')) as varchar), chr(13), chr(10), chr(13), chr(10), coalesce(html, '')) as rec, coalesce(html, '') as html
  from pages where page_id is not null
), r as (select page_id, html, cast(strlen(rec) + 4 as bigint) as length, sha256(rec) as digest from w)
select page_id, cast(coalesce(sum(length) over (order by page_id, digest rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset", length, digest,
  case when page_id % 211 = 5 then 'missing' when page_id % 101 = 7 and length(html) > 0 then 'altered' else 'intact' end as status
from r
"""
