"""WARC fixity audit by Merkle trees.

Records are hashed where they are read; only digests and lengths move.  Records are
known by their id, not by their place: a shard (one WARC file) holds a run of ids, an
id its records, cut into chunks by digest.  Every level orders its children and hashes
their keys, digests and offsets from the parent's start, so that a record which is
missing or added changes the digests above it and no others.  Two replicas are compared
by their roots, and only below nodes that differ are children compared, so an intact
shard costs one row.

A chunk bounds what one task sorts: an id, or no id, with a great share of all rows
is spread over ``16 ** CHUNK_HEX`` chunks.

Defined results: null urls and bodies are empty; a record of any length is hashed whole;
equal records of an id are one row with their number of copies; of an id's records in
one replica only, as many as the replicas can pair, in the order of digests, are corrupt
and the rest missing or added; records without an id have only their content to be known
by, so a damaged one is missing and its successor added; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

SHARD_IDS = 512
GROUP_IDS = 16
CHUNK_HEX = 4
#: The shard of all records without an id.
NO_ID = -(1 << 62)


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of one WARC resource record, as text."""
    text = F.coalesce(body, F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, text, F.lit("\r\n\r\n"))


#: The levels from records up: what names a node of the level.
LEVELS = [["shard", "group", "page_id", "chunk", "digest"], ["shard", "group", "page_id", "chunk"], ["shard", "group", "page_id"], ["shard", "group"], ["shard"]]


def leaves(pages: DataFrame) -> DataFrame:
    """Rows (shard, group, page_id, chunk, digest, record_length, copies) of a replica."""
    whole = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.octet_length(whole).cast("long").alias("record_length"), F.sha2(whole.cast("binary"), 256).alias("digest"))
    place = {
        "shard": F.coalesce(F.floor(F.col("page_id") / SHARD_IDS), F.lit(NO_ID)).cast("long"),
        "group": F.coalesce(F.floor(F.col("page_id") / GROUP_IDS), F.lit(NO_ID)).cast("long"),
        "chunk": F.substring("digest", 1, CHUNK_HEX),
    }
    return rows.withColumns(place).groupBy(*LEVELS[0], "record_length").agg(F.count("*").alias("copies"))


def _starts(children: DataFrame, keys: list[str]) -> DataFrame:
    """Children (.., length) with the offset of each from its parent's start."""
    order = Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
    return children.withColumn("start", (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).cast("long"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Nodes by level, records first and roots last, each written: the names of
    :data:`LEVELS`, digest (for records: of the node), length and start in the parent.

    What a task gathers for one node is a chunk's records, an id's chunks, a group's
    ids or a shard's groups."""
    node = F.sha2(F.concat("digest", F.lit("x"), F.col("copies").cast("string")).cast("binary"), 256)
    below = records.select(*LEVELS[0], (F.col("record_length") * F.col("copies")).cast("long").alias("length"), node.alias("node"))
    out = []
    for keys, above in zip(LEVELS, LEVELS[1:]):
        placed = store.table(_starts(below, keys), "nodes")
        out.append(placed)
        name = F.coalesce(F.col(keys[-1]).cast("string"), F.lit(""))
        parts = F.array_sort(F.collect_list(F.struct("start", F.concat(name, F.lit(":"), "node", F.lit("@"), F.col("start").cast("string")).alias("part"))))
        joined = F.array_join(F.transform(parts, lambda p: p["part"]), ";")
        below = placed.groupBy(*above).agg(F.sum("length").cast("long").alias("length"), F.sha2(joined.cast("binary"), 256).alias("node"))
    return [*out, store.table(below, "roots")]


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def differing(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """The names of records that differ, found from the roots down: a level is compared
    only under nodes that differed above."""
    above: DataFrame | None = None
    for level in range(len(LEVELS) - 1, -1, -1):
        keys, sides = LEVELS[level], []
        for name, side in (("ours", ours[level]), ("theirs", theirs[level])):
            if above is not None:
                side = side.join(above, _same(side, above, LEVELS[level + 1]), "left_semi")
            sides.append(side.select(*keys, F.col("node").alias(name)))
        both = sides[0].withColumn("theirs", F.lit(None).cast("string")).unionByName(sides[1].withColumn("ours", F.lit(None).cast("string")))
        found = both.groupBy(*keys).agg(F.max("ours").alias("ours"), F.max("theirs").alias("theirs")).where(~F.col("ours").eqNullSafe(F.col("theirs")))
        above = store.table(found.select(*keys), "differing")
    return above


def _before(rows: DataFrame, value: str) -> DataFrame:
    """The sum of ``value`` over the records of the same id that come before, chunk by chunk."""
    chunk = ["shard", "group", "page_id", "chunk"]
    inside = Window.partitionBy(*chunk).orderBy("digest", "record_length").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*chunk[:-1]).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    chunks = rows.groupBy(*chunk).agg(F.sum(value).alias("_sum"))
    chunks = chunks.select(*[F.col(c).alias(f"_{c}") for c in chunk], (F.sum("_sum").over(across) - F.col("_sum")).alias("_ahead"))
    met = F.lit(True)
    for c in chunk:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = rows.withColumn("_within", F.sum(value).over(inside) - F.col(value)).join(chunks, met)
    return placed.withColumn(f"{value}_before", F.col("_ahead") + F.col("_within")).drop("_within", "_ahead", *[f"_{c}" for c in chunk])


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every distinct record of our replica, and those that only the other one has: its
    place in our shard, copies here, shard root, status (the gravest that applies) and how many
    of its copies are corrupt, missing or added."""
    left, right = store.table(leaves(ours), "leaves"), store.table(leaves(theirs), "leaves")
    a, b = tree(left), tree(right)
    names = store.table(differing(a, b), "suspects")

    def suspect(side: DataFrame, name: str) -> DataFrame:
        return side.join(names, _same(side, names, LEVELS[0]), "left_semi").withColumn(name, F.col("copies")).drop("copies")

    zero = F.lit(0).cast("long")
    both = suspect(left, "ours").withColumn("theirs", zero).unionByName(suspect(right, "theirs").withColumn("ours", zero))
    both = both.groupBy(*LEVELS[0], "record_length").agg(F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs"))
    both = both.withColumns({"lost": F.greatest(F.col("ours") - F.col("theirs"), zero), "found": F.greatest(F.col("theirs") - F.col("ours"), zero)})
    both = store.table(both, "unlike")
    # Of an id's lost and found records the first ones pair up; without an id none do.
    sums = both.where("page_id is not null").groupBy("page_id").agg(F.least(F.sum("lost"), F.sum("found")).alias("pairs"))
    placed = _before(_before(both, "lost"), "found").join(sums, "page_id", "left")
    pairs = F.coalesce("pairs", zero)

    def paired(value: str) -> Column:
        return F.greatest(F.least(F.col(value), pairs - F.col(f"{value}_before")), zero)

    bad = placed.select(*LEVELS[0], "record_length", "ours", paired("lost").alias("corrupt"), (F.col("lost") - paired("lost")).alias("missing"), (F.col("found") - paired("found")).alias("added"))
    bad = store.table(bad.where("corrupt + missing + added > 0"), "damage")
    # Offsets of our records: starts from the root down.
    starts = a[0].select(*LEVELS[0], "start")
    for level in range(1, len(LEVELS) - 1):
        up = a[level].select(*LEVELS[level], F.col("start").alias("_up"))
        starts = starts.join(up, _same(starts, up, LEVELS[level]), "inner").select(*[starts[c] for c in LEVELS[0]], (F.col("start") + F.col("_up")).alias("start"))
    roots = a[-1].select("shard", F.col("node").alias("root"))
    kept = left.join(starts, _same(left, starts, LEVELS[0])).select(*[left[c] for c in LEVELS[0]], "record_length", "copies", F.col("start").alias("record_offset"))
    damage = bad.select("page_id", "digest", "corrupt", "missing", "added")
    judged = kept.join(damage.where("corrupt + missing > 0"), _same(kept, damage, ["page_id", "digest"]), "left").select(
        kept["page_id"], "shard", "record_offset", "record_length", kept["digest"], "copies", F.coalesce("corrupt", zero).alias("corrupt"), F.coalesce("missing", zero).alias("missing"), zero.alias("added")
    )
    extra = bad.where("added > 0").select("page_id", "shard", F.lit(None).cast("long").alias("record_offset"), "record_length", "digest", zero.alias("copies"), zero.alias("corrupt"), zero.alias("missing"), "added")
    status = F.when(F.col("missing") > 0, "missing").when(F.col("corrupt") > 0, "corrupt").when(F.col("added") > 0, "added").otherwise("intact")
    return judged.unionByName(extra).join(roots, "shard", "left").select("page_id", "shard", "record_offset", "record_length", "digest", "copies", "corrupt", "missing", "added", "root", status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted damage, by the MD5 of the id: of 256 records one has its
    first character replaced, one has grown, one is gone, one has a second version
    beside it and one has a sibling under an id of its own."""
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    long_enough = F.char_length("html") > 0
    html = F.when((mark == "00") & long_enough, F.concat(F.lit("?"), F.expr("substr(html, 2)"))).when(mark == "40", F.concat("html", F.lit(" and more"))).otherwise(F.col("html"))
    kept = pages.where(F.coalesce(mark != "80", F.lit(True))).withColumn("html", html)
    version = pages.where(mark == "c0").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit(" again")))
    sibling = pages.where(mark == "c1").withColumn("page_id", -F.col("page_id") - 1)
    return kept.unionByName(version).unionByName(sibling)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


ORACLE = """
WITH marked AS (
  SELECT page_id, url, html, substr(md5(page_id::VARCHAR), 1, 2) AS mark FROM pages
), replica AS (
  SELECT 1 AS side, page_id, url, html FROM marked
  UNION ALL
  SELECT 2, page_id, url, CASE WHEN mark = '00' AND length(html) > 0 THEN '?' || substr(html, 2) WHEN mark = '40' THEN html || ' and more' ELSE html END FROM marked WHERE mark IS DISTINCT FROM '80'
  UNION ALL
  SELECT 2, page_id, url, coalesce(html, '') || ' again' FROM marked WHERE mark = 'c0'
  UNION ALL
  SELECT 2, -page_id - 1, url, html FROM marked WHERE mark = 'c1'
), records AS (
  SELECT side, page_id, coalesce(floor(page_id / 512.0::DOUBLE)::BIGINT, -4611686018427387904) AS shard, coalesce(floor(page_id / 16.0::DOUBLE)::BIGINT, -4611686018427387904) AS grp,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR
         || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS whole
  FROM replica
), leaf AS (
  SELECT side, shard, grp, page_id, substr(sha256(whole), 1, 4) AS chunk, sha256(whole) AS digest, strlen(whole)::BIGINT AS record_length, count(*) AS copies FROM records GROUP BY ALL
), l0 AS (
  SELECT *, sha256(digest || 'x' || copies) AS node, record_length * copies AS len, sum(record_length * copies) OVER (PARTITION BY side, shard, grp, page_id, chunk ORDER BY digest ROWS UNBOUNDED PRECEDING) - record_length * copies AS start FROM leaf
), n1 AS (
  SELECT side, shard, grp, page_id, chunk, sum(len) AS len, sha256(string_agg(digest || ':' || node || '@' || start::BIGINT, ';' ORDER BY digest)) AS node FROM l0 GROUP BY ALL
), l1 AS (
  SELECT *, sum(len) OVER (PARTITION BY side, shard, grp, page_id ORDER BY chunk ROWS UNBOUNDED PRECEDING) - len AS start FROM n1
), n2 AS (
  SELECT side, shard, grp, page_id, sum(len) AS len, sha256(string_agg(chunk || ':' || node || '@' || start::BIGINT, ';' ORDER BY chunk)) AS node FROM l1 GROUP BY ALL
), l2 AS (
  SELECT *, sum(len) OVER (PARTITION BY side, shard, grp ORDER BY page_id ROWS UNBOUNDED PRECEDING) - len AS start FROM n2
), n3 AS (
  SELECT side, shard, grp, sum(len) AS len, sha256(string_agg(coalesce(page_id::VARCHAR, '') || ':' || node || '@' || start::BIGINT, ';' ORDER BY page_id)) AS node FROM l2 GROUP BY ALL
), l3 AS (
  SELECT *, sum(len) OVER (PARTITION BY side, shard ORDER BY grp ROWS UNBOUNDED PRECEDING) - len AS start FROM n3
), root AS (
  SELECT side, shard, sha256(string_agg(grp || ':' || node || '@' || start::BIGINT, ';' ORDER BY grp)) AS root FROM l3 GROUP BY ALL
), unlike AS (
  SELECT shard, page_id, digest, record_length, greatest(coalesce(sum(copies) FILTER (side = 1), 0) - coalesce(sum(copies) FILTER (side = 2), 0), 0) AS lost,
         greatest(coalesce(sum(copies) FILTER (side = 2), 0) - coalesce(sum(copies) FILTER (side = 1), 0), 0) AS found FROM leaf GROUP BY ALL
), summed AS (
  SELECT *, CASE WHEN page_id IS NULL THEN 0 ELSE least(sum(lost) OVER (PARTITION BY page_id), sum(found) OVER (PARTITION BY page_id)) END AS pairs,
         sum(lost) OVER w - lost AS lost_before, sum(found) OVER w - found AS found_before FROM unlike WINDOW w AS (PARTITION BY page_id ORDER BY digest ROWS UNBOUNDED PRECEDING)
), damage AS (
  SELECT *, greatest(least(lost, pairs - lost_before), 0) AS corrupt, lost - greatest(least(lost, pairs - lost_before), 0) AS missing, found - greatest(least(found, pairs - found_before), 0) AS added FROM summed
), ours AS (
  SELECT l0.page_id, l0.shard, (l0.start + l1.start + l2.start + l3.start)::BIGINT AS record_offset, l0.record_length, l0.digest, l0.copies
  FROM l0 JOIN l1 ON l1.side = 1 AND l1.page_id IS NOT DISTINCT FROM l0.page_id AND l1.chunk = l0.chunk JOIN l2 ON l2.side = 1 AND l2.page_id IS NOT DISTINCT FROM l0.page_id
  JOIN l3 ON l3.side = 1 AND l3.grp = l0.grp WHERE l0.side = 1
), everything AS (
  SELECT o.*, d.corrupt::BIGINT AS corrupt, d.missing::BIGINT AS missing, 0::BIGINT AS added FROM ours o JOIN damage d ON d.page_id IS NOT DISTINCT FROM o.page_id AND d.digest = o.digest
  UNION ALL
  SELECT page_id, shard, NULL, record_length, digest, 0, 0, 0, added::BIGINT FROM damage WHERE added > 0
)
SELECT e.*, r.root, CASE WHEN missing > 0 THEN 'missing' WHEN corrupt > 0 THEN 'corrupt' WHEN added > 0 THEN 'added' ELSE 'intact' END AS status
FROM everything e LEFT JOIN root r ON r.side = 1 AND r.shard = e.shard
"""
