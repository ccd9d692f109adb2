"""Fixity audit of archive files: Merkle trees over records and ranges of offsets, compared from the roots down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlens.llm.common import cut

#: Bytes of the lowest ranges, and how many ranges make one of the next level.
RANGE, FANOUT = 1 << 16, 16


def warc_records(pages: DataFrame, *, id_col: str = "page_id", records_per_file: int = 1024) -> DataFrame:
    """(file_id, record_id, url, payload, content): pages as response records, files by ranges of ids.

    `content` tells records with the same id apart. Null urls and payloads count as empty. Pages without an id have no
    place in a file and are left out.
    """
    return pages.where(F.col(id_col).isNotNull()).select(
        F.floor(F.col(id_col) / records_per_file).alias("file_id"),
        F.col(id_col).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
        F.xxhash64("url", "html").alias("content"),
    )


def digests(records: DataFrame) -> DataFrame:
    """(file_id, record_id, content, length, hash) of the rendered records; payloads go no further than this."""
    size = F.octet_length("payload")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nContent-Length: "),
        size.cast("string"),
        F.lit("\r\n\r\n"),
        F.col("payload"),
        F.lit("\r\n\r\n"),
    )
    return records.select(
        "file_id",
        "record_id",
        "content",
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record.cast("binary"), 256).alias("hash"),
    )


def with_offsets(digest: DataFrame) -> DataFrame:
    """The same with `offset`, the bytes of the file before the record; records lie by id, equal ids by content.

    Files hold a bounded range of ids, so the window of one file is bounded.
    """
    before = Window.partitionBy("file_id").orderBy("record_id", "content").rowsBetween(Window.unboundedPreceding, -1)
    return digest.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def merkle_levels(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (file_id, node, hash) by level: records by offset at level 0, then ranges of offsets, each the hash of its
    children's places and hashes in order. A range gathers at most the records that fit in RANGE bytes, a higher one
    FANOUT children.
    """
    out = [leaves.select("file_id", F.col("offset").alias("node"), "hash")]
    for level in range(1, levels + 1):
        width = RANGE if level == 1 else FANOUT
        child = F.struct(F.col("node"), F.col("hash"))
        ordered = F.transform(
            F.sort_array(F.collect_list(child)), lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["hash"])
        )
        node = F.floor(F.col("node") / width).alias("up")
        grouped = out[-1].groupBy("file_id", node).agg(F.sha2(F.array_join(ordered, ","), 256).alias("hash"))
        out.append(cut(grouped.withColumnRenamed("up", "node")))
    return out


def _mismatches(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    keys = ["file_id", "node"]
    both = mine.join(theirs.withColumnRenamed("hash", "other"), keys, "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("other")))


def audit(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row per file: file_id, n_records, n_bytes, root, replica_root, n_damaged, damaged.

    Both inputs are (file_id, record_id, offset, length, hash). Roots are compared first; at each level below only the
    children of nodes that differ are read and compared, down to records. `damaged` lists `offset:kind` by offset:
    changed, missing (not in the replica) or extra (only there). A file that one side lacks has a null root there and
    all its records listed. Records that share an offset in a file are compared as a list. No rows give no rows.
    """
    mine, theirs = cut(mine), cut(theirs)
    last = max((x.agg(F.max("offset")).first()[0] or 0) for x in (mine, theirs))
    levels, width = 1, RANGE
    while width <= last:
        levels, width = levels + 1, width * FANOUT
    flat = [
        x.groupBy("file_id", "offset").agg(F.array_join(F.sort_array(F.collect_list("hash")), "+").alias("hash"))
        for x in (mine, theirs)
    ]
    trees = [merkle_levels(x, levels) for x in flat]
    wrong = cut(_mismatches(trees[0][levels], trees[1][levels]).select("file_id", "node"))
    for level in range(levels - 1, -1, -1):
        width = RANGE if level == 0 else FANOUT
        up = wrong.withColumnRenamed("node", "up")
        below = [t[level].withColumn("up", F.floor(F.col("node") / width)).join(up, ["file_id", "up"], "left_semi").drop("up") for t in trees]
        wrong = cut(_mismatches(*below))
    kind = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    damaged = wrong.groupBy("file_id").agg(
        F.count("*").alias("n_damaged"), F.sort_array(F.collect_list(F.struct("node", kind.alias("kind")))).alias("found")
    )
    roots = [t[levels].select("file_id", F.col("hash").alias(name)) for t, name in zip(trees, ("root", "replica_root"))]
    sizes = mine.groupBy("file_id").agg(F.count("*").alias("n_records"), F.sum("length").alias("n_bytes"))
    whole = reduce(lambda a, b: a.join(b, "file_id", "full"), [sizes, *roots, damaged])
    return whole.select(
        "file_id",
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"),
        "root",
        "replica_root",
        F.coalesce("n_damaged", F.lit(0)).alias("n_damaged"),
        F.coalesce(
            F.array_join(F.transform("found", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["kind"])), ","), F.lit("")
        ).alias("damaged"),
    )


def damaged_replica(records: DataFrame) -> DataFrame:
    """A copy of the records as decaying storage would leave it: bytes turned, payloads cut short, records lost."""
    lost = F.col("record_id") % 1499 == 7
    payload = (
        F.when(F.col("record_id") % 997 == 5, F.translate("payload", "<", "("))
        .when(F.col("record_id") % 2003 == 11, F.left("payload", (F.length("payload") / 2).cast("int")))
        .otherwise(F.col("payload"))
    )
    return records.where(~lost).withColumn("payload", payload)


def audit_pages(pages: DataFrame) -> DataFrame:
    """Audit of the pages as archive files against a replica derived from them.

    The replica keeps the offsets of the index that was written with the files, as an audit of storage does.
    """
    records = warc_records(pages)
    index = cut(with_offsets(digests(records)))
    same = ["file_id", "record_id", "content"]
    nth = lambda c: F.row_number().over(Window.partitionBy(*same).orderBy(c)).alias("nth")
    places = index.select(*same, "offset", nth("offset"))
    copies = digests(damaged_replica(records)).select("*", nth("hash")).join(places, [*same, "nth"])
    return audit(index, copies)
