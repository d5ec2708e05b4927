"""Mixing sources to target weights by Pareto order sampling.

Targets are water-filled: sources share the mix by weight, none above ``max_copies``
times its size.  Each document gets the certain whole copies of its source's rate;
the rest of the target is filled by an order sample of unequal probability: a document's
inclusion goes with the square root of its words, scaled so that the expected words fill
the target, and documents whose inclusion comes to one are certain.  Documents are ranked
by random odds over inclusion odds, and the least ranks win until their words fill the
target; at most three of those after the cut then close the gap that the last one leaves.
The cut is found by radix: sums of ever narrower rank buckets locate it, so a source of
any size is never sorted in one task.

Defined results: null texts have size 0 and no copy but the whole ones; a null source is a source of its own, after
all others; sources without words have target 0; repeated rows are documents of
their own and may be taken differently; ties of ranks fall to the least id; a very long
text is counted whole; other columns may have any names but those that begin with two
underscores; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
BUCKETS = 1024
RADIX_LEVELS = 2
CLOSING_FITS = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and bytes 9 to 13."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, "[ \t\n\x0b\x0c\r]+"), ""))).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, size).

    The only single task here reads one row for each source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(named) - 1) % len(weights)
    weighed = totals.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), place + 1)).withColumn("cap", F.col("source_size") * max_copies)
    # Sources fill up in the order of cap over weight; a source is full if the level of all later ones passes it.
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    after, every = fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    filled = weighed.select(
        "source", "source_size", "w", "cap",
        F.sum("w").over(after).alias("w_left"),
        (F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("used"),
        (F.sum("source_size").over(every) * share).alias("mix"),
    ).withColumn("full", F.col("cap") * F.col("w_left") <= (F.col("mix") - F.col("used")) * F.col("w"))
    full = F.col("full")
    level = F.try_divide(F.col("mix") - F.sum(F.when(full, F.col("cap")).otherwise(0)).over(every), F.sum(F.when(~full, F.col("w")).otherwise(0)).over(every))
    open_target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("w") * level)
    return filled.select("source", "source_size", F.least(open_target, F.col("cap").cast("double")).alias("target"))


def _rank(key: Column, seed: str, inclusion: Column) -> Column:
    """Random odds over inclusion odds, mapped to 0..1 so that buckets are even in
    the part that decides; null where nothing is to be sampled."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    q = F.try_divide(u / (1 - u), F.try_divide(inclusion, 1 - inclusion))
    return F.when(inclusion > 0, q / (1 + q))


def inclusions(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with what tells each document's inclusion from its odds weight: ``sure``, the least
    weight that is certain, ``want``, the words left for the others, and ``scale``, the
    words times weights of these.

    One row for each source and weight; a weight is at most the root of a text's words.
    """
    levels = sized.where("size > 0").groupBy("source", odds_weight().alias("f")).agg(F.sum("size").alias("s"), F.sum(F.col("size") * odds_weight()).alias("sf"))
    met = levels.join(plan.select(F.col("source").alias("_source"), F.col("want").alias("_want")), F.col("source").eqNullSafe(F.col("_source")))
    down = Window.partitionBy("source").orderBy(F.col("f").desc())
    ahead = F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")
    rest = F.sum("sf").over(down.rowsBetween(0, Window.unboundedFollowing))
    judged = met.select("source", "f", "s", "sf", "_want", (F.col("f") * (F.col("_want") - ahead) >= rest).alias("sure"))
    found = judged.groupBy("source", "_want").agg(F.min(F.when(F.col("sure"), F.col("f"))).alias("sure"), F.sum(F.when(F.col("sure"), F.col("s")).otherwise(0)).alias("_s"), F.sum(F.when(~F.col("sure"), F.col("sf"))).alias("scale"))
    found = found.select(F.col("source").alias("_source"), "sure", (F.col("_want") - F.col("_s")).alias("_left"), F.col("scale").cast("double").alias("scale"))
    out = plan.join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.withColumn("want", F.coalesce("_left", "want")).drop("_source", "_left")


def odds_weight() -> Column:
    return F.ceil(F.sqrt("size"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, carry: str | None = None, **shares) -> DataFrame:
    """Rows (id, source, size, source_size, target, copies) for all documents, and
    the column ``carry`` if one is named."""
    carried = [F.col(carry)] if carry else []
    key = F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("_row"), *carried)
    sized = store.table(sized, "sizes")
    plan = targets(sized, **shares)
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0)).withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = store.table(inclusions(sized, plan), "targets")

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(right, left["source"].eqNullSafe(right["_source"]), "left").drop("_source")

    certain = F.coalesce((F.col("size") > 0) & (odds_weight() >= F.col("sure")), F.lit(False))
    inclusion = F.when((F.col("size") > 0) & ~certain, odds_weight() * F.col("want") / F.col("scale")).otherwise(0.0)
    ranked = meet(sized, plan).select(
        "id", "source", "size", "_row", *carried, "source_size", "target", (F.col("whole") + F.when(certain, 1).otherwise(0)).alias("whole"), "want", _rank(F.col("key"), seed, inclusion).alias("v")
    )
    ranked = store.table(ranked, "ranks")

    # Per source: the bucket path of the cut so far and the words still wanted at its start.
    cut = plan.select("source", F.lit(0).cast("long").alias("path"), F.col("want").alias("room"))
    depth = 1
    for _ in range(RADIX_LEVELS):
        bucket = F.floor(F.col("v") * float(BUCKETS**depth))
        inside = meet(ranked.where("v is not null").select("source", "size", bucket.alias("bucket")), cut).where(F.floor(F.col("bucket") / BUCKETS) == F.col("path"))
        sums = inside.groupBy("source", "bucket", "room").agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
        over = sums.withColumn("before", before).where(F.col("before") + F.col("words") > F.col("room"))
        cut = store.table(over.groupBy("source").agg(F.min(F.struct("bucket", (F.col("room") - F.col("before")).alias("room"))).alias("b")).select("source", F.col("b.bucket").alias("path"), F.col("b.room").alias("room")), "cut")
        depth += 1
    # The last bucket is narrow: at most a few documents in a million of a source.
    at = F.floor(F.col("v") * float(BUCKETS**RADIX_LEVELS))
    last = meet(ranked.where("v is not null"), cut).where(at == F.col("path"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("v", F.col("id").asc_nulls_first(), "_row").rowsBetween(Window.unboundedPreceding, 0))
    edge = last.withColumn("upto", upto).where(F.col("upto") > F.col("room"))
    edge = edge.groupBy("source").agg(F.min(F.struct("v", F.col("id").isNotNull().alias("known"), "id", "_row", (F.col("room") - (F.col("upto") - F.col("size"))).alias("left"))).alias("edge"))
    beyond = F.coalesce(F.struct("v", F.col("id").isNotNull(), "id", "_row") >= F.struct("edge.v", "edge.known", "edge.id", "edge._row"), F.lit(False))
    placed = store.table(meet(ranked, edge).select("*", beyond.alias("beyond"), F.lit(False).alias("closes"), F.col("edge.left").alias("left")).drop("edge"), "placed")
    # Documents from beyond the cut close the gap that its document leaves: the largest
    # that fit, then the one that brings the words nearest, if any brings them nearer.
    for step in range(CLOSING_FITS + 1):
        off = F.col("left") - F.col("size")
        fits = (off >= 0) & (F.col("size") > 0) if step < CLOSING_FITS else F.abs(off) < F.col("left")
        best = F.min(F.struct(F.abs(off).alias("off"), "v", F.col("id").isNotNull().alias("known"), "id", "_row", "size")).alias("best")
        best = placed.where(F.col("beyond") & ~F.col("closes") & fits).groupBy("source").agg(best)
        met = meet(placed, best.select("source", F.col("best._row").alias("closer"), F.col("best.size").alias("closed")))
        closes = F.col("closes") | F.coalesce(F.col("_row") == F.col("closer"), F.lit(False))
        placed = met.withColumn("closes", closes).withColumn("left", F.col("left") - F.coalesce("closed", F.lit(0))).drop("closer", "closed")
        placed = store.table(placed, "placed") if step < CLOSING_FITS else placed
    won = F.col("v").isNotNull() & (~F.col("beyond") | F.col("closes"))
    return placed.select("id", "source", "size", "source_size", "target", (F.col("whole") + F.when(won, 1).otherwise(0)).cast("long").alias("copies"), *carried)


def query(spark, sf_dir: str) -> DataFrame:
    mixed = sample(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '')) END::BIGINT AS size,
         md5('mix|' || concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))) AS hash
  FROM documents
), weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM sized GROUP BY source
), filling AS (
  SELECT *, 2 * source_size AS cap,
         sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_left,
         (sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 2 * source_size)::BIGINT AS used,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS mix
  FROM weighed
), filled AS (
  SELECT *, cap * w_left <= (mix - used) * w AS is_full FROM filling
), targets AS (
  SELECT source, source_size,
         least(CASE WHEN is_full THEN cap::DOUBLE ELSE w * ((mix - (sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE) / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::DOUBLE) END, cap::DOUBLE) AS target
  FROM filled
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), rated AS (
  SELECT *, target - whole * source_size AS asked FROM plan
), levels AS (
  SELECT source, ceil(sqrt(size))::BIGINT AS f, sum(size)::BIGINT AS s, sum(size * ceil(sqrt(size))::BIGINT)::BIGINT AS sf FROM sized WHERE size > 0 GROUP BY ALL
), judged AS (
  SELECT l.*, r.asked, f * (asked - ((sum(s) OVER (PARTITION BY l.source ORDER BY f DESC ROWS UNBOUNDED PRECEDING)) - s)::DOUBLE)
         >= (sum(sf) OVER (PARTITION BY l.source ORDER BY f DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS is_sure
  FROM levels l JOIN rated r ON l.source IS NOT DISTINCT FROM r.source
), scaled AS (
  SELECT source, min(f) FILTER (is_sure) AS sure, asked - coalesce(sum(s) FILTER (is_sure), 0)::DOUBLE AS want, (sum(sf) FILTER (NOT is_sure))::DOUBLE AS scale FROM judged GROUP BY source, asked
), included AS (
  SELECT s.*, r.source_size, r.target, coalesce(c.want, r.asked) AS want, r.whole + CASE WHEN size > 0 AND ceil(sqrt(size)) >= c.sure THEN 1 ELSE 0 END AS whole,
         CASE WHEN size > 0 AND (c.sure IS NULL OR ceil(sqrt(size)) < c.sure) THEN ceil(sqrt(size)) * c.want / c.scale ELSE 0 END AS p
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN scaled c ON c.source IS NOT DISTINCT FROM s.source
), odds AS (
  SELECT *, (('0x' || substr(hash, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM included
), ranked AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + ((u / (1 - u)) / (p / (1 - p)))) END AS v FROM odds
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY v NULLS LAST, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY source ORDER BY v NULLS LAST, doc_id NULLS FIRST) AS rank
  FROM ranked
), edge AS (
  SELECT source, min(rank) AS edge_rank, arg_min(want - (upto - size), rank) AS gap FROM summed WHERE v IS NOT NULL AND upto > want GROUP BY source
), placed AS (
  SELECT s.*, e.edge_rank, e.gap FROM summed s LEFT JOIN edge e ON s.source IS NOT DISTINCT FROM e.source
), fit1 AS (
  SELECT source, rank AS chosen1, gap - size AS gap1 FROM placed WHERE v IS NOT NULL AND rank >= edge_rank AND gap >= size AND size > 0
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(gap - size), rank) = 1
), joined1 AS (
  SELECT p.*, f.chosen1, coalesce(f.gap1, p.gap) AS gap1 FROM placed p LEFT JOIN fit1 f ON p.source IS NOT DISTINCT FROM f.source
), fit2 AS (
  SELECT source, rank AS chosen2, gap1 - size AS gap2 FROM joined1 WHERE v IS NOT NULL AND rank >= edge_rank AND gap1 >= size AND size > 0 AND rank IS DISTINCT FROM chosen1
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(gap1 - size), rank) = 1
), joined2 AS (
  SELECT p.*, f.chosen2, coalesce(f.gap2, p.gap1) AS gap2 FROM joined1 p LEFT JOIN fit2 f ON p.source IS NOT DISTINCT FROM f.source
), fit3 AS (
  SELECT source, rank AS chosen3, gap2 - size AS gap3 FROM joined2 WHERE v IS NOT NULL AND rank >= edge_rank AND abs(gap2 - size) < gap2 AND rank IS DISTINCT FROM chosen1 AND rank IS DISTINCT FROM chosen2
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(gap2 - size), rank) = 1
), joined3 AS (
  SELECT p.*, f.chosen3, coalesce(f.gap3, p.gap2) AS gap3 FROM joined2 p LEFT JOIN fit3 f ON p.source IS NOT DISTINCT FROM f.source
), counted AS (
  SELECT *, (whole + CASE WHEN v IS NOT NULL AND (edge_rank IS NULL OR rank < edge_rank OR rank IN (chosen1, chosen2, chosen3)) THEN 1 ELSE 0 END)::BIGINT AS copies FROM joined3
)
SELECT doc_id, size, source_size, target, source, copies, (size * copies)::BIGINT AS taken FROM counted
"""


def mixed(docs: DataFrame) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as it is taken, with its
    columns.  Rows are known by two hashes of all their columns; rows that are equal in
    all of them are one row with the copies of all."""
    since = store.mark()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    parts = [*columns, *[c.isNull() for c in columns]]
    key = F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))
    drawn = sample(docs.withColumn("__key", key), carry="__key").groupBy("__key").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    drawn = store.table(drawn, "copies")
    store.release(docs.sparkSession, since, keep=(drawn,))
    keyed = docs.withColumn("__key", key)
    if not drawn.where("__rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["__key"])
    taken = keyed.join(drawn.where("__copies > 0").select("__key", "__copies"), "__key")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*columns)
