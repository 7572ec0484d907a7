"""Merkle fixity audit of WARC records.

Each record's SHA-256 is a leaf.  Leaves stand in the order of their files and of their places in a file, which is that of
offsets; nodes hash ordered ranges of 16, 256 and 4096 places, then a file, a group of files and the replica.  The replicas'
trees are built apart from each other and compared from the root; only the children of nodes that differ are looked at.
A record that was lost or added moves those behind it, so that the ranges up to the end of its file differ; of the leaves
in them, records are brought together by their ids, and those that differ are altered, missing or extra.

``audit_files`` compares two folders of WARC files as they are.  ``audit`` compares two tables of pages: the first one,
in the order of ids, is cut into files of ``FILE_RECORDS`` records, and a record of the other one belongs to the file
in which its id would stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm import warc
from arborspark.llm.common import cut, only_ids, ordered

#: Records of a file that a table is cut into.
FILE_RECORDS = 4096
FANOUT = 16
#: Of so many groups of files, each is a child of the root.
GROUPS = 256


def warc_record(url: Column, html: Column) -> Column:
    """A WARC/1.1 resource record's text.  A null url or page reads as ``-`` in the header, unlike an empty one."""
    size = F.coalesce(F.octet_length(html).cast("string"), F.lit("-"))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("-")), F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), F.coalesce(html, F.lit("")), F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(key, digest, length): one leaf for each id, the null one too; records that share an id are hashed together, in the order of their hashes."""
    record = warc_record(F.col(url_col), F.col(html_col))
    id_ = F.col(id_col)
    rows = pages.select(F.struct(id_.isNotNull().alias("known"), id_.alias("id")).alias("key"), F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("bigint").alias("length"))
    # counts first, so that a record that is repeated very often is one row
    rows = rows.groupBy("key", "digest").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("n") == 1, F.col("digest")).otherwise(F.concat("digest", F.lit("*"), F.col("n").cast("string")))
    rows = rows.groupBy("key").agg(F.sort_array(F.collect_list(named)).alias("all"), F.sum("length").alias("length"))
    single = (F.size("all") == 1) & ~F.contains(F.col("all")[0], F.lit("*"))
    return rows.select("key", F.when(single, F.col("all")[0]).otherwise(F.sha2(F.array_join("all", ","), 256)).alias("digest"), "length")


def _sums_before(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """(part, name): the sum of a column over all earlier parts; one row for each range, of which there are as many as tasks."""
    sums = rows.groupBy("part").agg(F.sum(column).alias("_n"))
    return sums.select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(name))


def in_files(records: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(key, digest, length, file, ordinal) of leaves: in files of ``FILE_RECORDS`` leaves, or in those that begin at the keys of ``starts`` (key)."""
    if starts is None:
        rows = ordered(records, "key")
        place = F.col("place") + F.col("before")
        rows = rows.join(F.broadcast(_sums_before(rows, F.lit(1), "before")), "part")
        return rows.select("key", "digest", "length", F.floor(place / FILE_RECORDS).alias("file"), (place % FILE_RECORDS).alias("ordinal"))
    both = records.withColumn("is_record", F.lit(1)).unionByName(starts.select("key", F.lit(0).alias("is_record")), allowMissingColumns=True)
    rows = ordered(both, "key", "is_record")
    # a range fits a task, so that running sums inside of it are windows
    inside = W.partitionBy("part").orderBy("place")
    rows = rows.withColumn("started", F.sum(1 - F.col("is_record")).over(inside)).withColumn("seen", F.sum("is_record").over(inside))
    for column, name in ((1 - F.col("is_record"), "started_before"), (F.col("is_record"), "seen_before")):
        rows = rows.join(F.broadcast(_sums_before(rows, column, name)), "part")
    rows = rows.filter("is_record = 1").select("key", "digest", "length", F.greatest(F.lit(0), F.col("started") + F.col("started_before") - 1).alias("file"), (F.col("seen") + F.col("seen_before")).alias("at"))
    rows = cut(rows)
    return rows.join(rows.groupBy("file").agg(F.min("at").alias("first")), "file").select("key", "digest", "length", "file", (F.col("at") - F.col("first")).alias("ordinal"))


def build_tree(placed: DataFrame) -> list[DataFrame]:
    """The levels of one replica, from (key, digest, file, ordinal): its leaves (node, digest, key), then (node, digest) up to the root.

    Each level is computed from the one below and checkpointed: an audit reads it several times.
    """
    levels = [cut(placed.select(F.struct("file", F.col("ordinal").alias("range")).alias("node"), "digest", "key"))]
    for up in parents():
        label = F.to_json("key") if len(levels) == 1 else F.to_json("node")
        below = levels[-1].select(up.alias("up"), F.struct(F.col("node"), F.concat(label, F.lit(":"), F.col("digest")).alias("text")).alias("child"))
        children = F.transform(F.sort_array(F.collect_list("child")), lambda x: x["text"])
        levels.append(cut(below.groupBy("up").agg(F.sha2(F.array_join(children, ","), 256).alias("digest")).select(F.col("up").alias("node"), "digest")))
    return levels


def parents() -> list[Column]:
    """The parent of a node, level by level: three of ranges, then file, group of files and root."""
    file, none = F.col("node.file"), F.lit(-1).cast("bigint")
    ranges = F.struct(file, F.floor(F.col("node.range") / FANOUT).alias("range"))
    group = F.pmod(F.xxhash64(file.cast("string")), F.lit(GROUPS)).cast("string")
    return [ranges, ranges, ranges, F.struct(file, none.alias("range")), F.struct(group.alias("file"), none.alias("range")), F.struct(F.lit("").alias("file"), none.alias("range"))]


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, digest, replica_digest): the leaves of two replicas, (key, digest, file, ordinal) each, that differ; found from the root down."""
    left, right = build_tree(a), build_tree(b)
    ups, frontier = parents(), None
    for level in range(len(ups), -1, -1):
        key = "node" if level else "key"
        x, y = left[level], right[level]
        if frontier is not None:
            above = frontier.select(F.col("node").alias("up"))
            x, y = (only_ids(t.withColumn("up", ups[level]), above, "up").drop("up") for t in (x, y))
        met = x.select(key, "digest").join(y.select(key, F.col("digest").alias("replica_digest")), key, "full_outer")
        frontier = cut(met.filter(~F.col("digest").eqNullSafe(F.col("replica_digest"))))
    return frontier


def _fault() -> Column:
    return F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("altered")


def audit(pages: DataFrame, replica: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, file_id, fault, offset, length, digest, replica_digest): the records in which the replicas differ.

    ``fault`` is altered, missing (from the replica) or extra (only there); ``offset`` is the record's place in bytes among
    its file's records in the first table, null for an extra one.

    - Ids are of any type that has an order, alike in both tables; whole numbers may be sparse or hashes.
    - A null id is an id of its own, before all others; null and empty urls and pages are different contents.
    - Records that repeat an id are one leaf, so a lost or added copy is found as altered.  Long pages are hashed whole.
    - Two empty tables agree; of one empty table, all records of the other are missing or extra.
    - Other columns are ignored, whatever their names.
    """
    a = cut(in_files(leaves(pages, id_col, url_col, html_col)))
    b = cut(in_files(leaves(replica, id_col, url_col, html_col), a.filter("ordinal = 0")))
    found = differing(a, b)
    begins = F.sum("length").over(W.partitionBy("file").orderBy("key").rowsBetween(W.unboundedPreceding, -1))
    place = a.select("key", "file", F.coalesce(begins, F.lit(0)).alias("offset"), "length")
    there = b.select("key", F.col("file").alias("file_there"))
    found = found.join(place, "key", "left").join(there, "key", "left")
    return found.select(F.col("key.id").alias("page_id"), F.coalesce("file", "file_there").alias("file_id"), _fault().alias("fault"), "offset", "length", "digest", "replica_digest")


def audit_files(spark: SparkSession, folder: str, replica_folder: str) -> DataFrame:
    """(file, record_id, fault, offset, length, replica_offset, digest, replica_digest): where the WARC files of two folders differ.

    - Records are compared as they are stored, byte by byte.  The n-th record of an id in a file meets the n-th one there.
    - A stretch that can't be read is altered if a record begins at its offset in the other file, else missing or extra; it has no id.
    - Files that only one folder has are missing or extra record by record.  Two empty folders agree.
    """

    def placed(where: str) -> DataFrame:
        rows = warc.read(spark, where).drop("payload", "url", "date")
        nth = F.row_number().over(W.partitionBy("file", "record_id").orderBy("ordinal"))  # a file fits a task
        key = F.struct("file", F.coalesce("record_id", F.lit("")).alias("record_id"), F.when(F.col("record_id").isNull(), -1 - F.col("offset")).otherwise(nth).alias("nth"))
        return cut(rows.select(key.alias("key"), "digest", "file", "ordinal", "offset", "length"))

    a, b = placed(folder), placed(replica_folder)
    found = differing(a, b).join(a.select("key", "offset", "length"), "key", "left").join(b.select("key", F.col("offset").alias("replica_offset"), F.col("length").alias("replica_length")), "key", "left")
    found = found.select("key.file", F.when(F.col("key.record_id") != "", F.col("key.record_id")).alias("record_id"), "offset", "length", "replica_offset", "replica_length", "digest", "replica_digest")
    # what can't be read has no id: it meets what begins at its offset
    at = F.coalesce("offset", "replica_offset")
    whole = found.filter("offset is not null and replica_offset is not null").withColumn("at", at)
    half = found.filter("offset is null or replica_offset is null").groupBy("file", at.alias("at")).agg(*[F.max(c).alias(c) for c in ("record_id", "offset", "length", "replica_offset", "replica_length", "digest", "replica_digest")])
    both = whole.unionByName(half)
    return both.select("file", "record_id", _fault().alias("fault"), "offset", F.coalesce("length", "replica_length").alias("length"), "replica_offset", "digest", "replica_digest")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of (page_id, url, html) with faults at known places, to audit against: some pages changed in one character, some lost, some added."""
    rows = pages.select("page_id", "url", "html").filter("page_id % 503 <> 11 or page_id is null")
    changed = rows.withColumn("html", F.when(F.col("page_id") % 211 == 7, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    extra = pages.filter("page_id % 997 = 5").select((F.col("page_id") + 100_000_000).alias("page_id"), "url", "html")
    return changed.union(extra)


_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"
SQL = f"""
with a as (select page_id, url, html from pages),
b as (select page_id, url, case when page_id % 211 = 7 then '?' || substring(html, 2) else html end as html from pages where page_id % 503 <> 11
      union all select page_id + 100000000, url, html from pages where page_id % 997 = 5),
ra as (select page_id, {_RECORD} as r from a),
rb as (select page_id, {_RECORD} as r from b),
la as (select page_id, sha256(r) as digest, strlen(r) as length, (row_number() over (order by page_id) - 1) // {FILE_RECORDS} as file_id from ra),
lo as (select *, sum(length) over (partition by file_id order by page_id) - length as offset_ from la),
starts as (select file_id, min(page_id) as start from la group by 1)
select coalesce(lo.page_id, rb.page_id) as page_id, coalesce(lo.file_id, (select max(file_id) from starts where start <= rb.page_id), 0) as file_id,
    case when rb.r is null then 'missing' when lo.page_id is null then 'extra' else 'altered' end as fault,
    lo.offset_::bigint as "offset", lo.length::bigint as length, lo.digest, sha256(rb.r) as replica_digest
from lo full join rb on lo.page_id = rb.page_id where lo.digest is distinct from sha256(rb.r)
"""
